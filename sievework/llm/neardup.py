"""Near-duplicates by b-bit minwise signatures, a multi-index Hamming join and exact confirmation."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import texts as tx
from sievework.llm.components import connected
from sievework.sources.stage import staged

#: Minwise hash functions; the first CHUNKS * CHUNK are the signature's slots of 16 bits each.
FUNCTIONS, CHUNKS, CHUNK = 64, 9, 6
#: Rows whose keys are made at a time.
KEYED = 1000
#: Bytes kept of a shingle's hash.
WIDTH = 6
#: Slots of the table of shingle counts that travels to every task.
COUNTED = 1 << 18
#: Words of 64 bits that say in which slots a set has an odd number of shingles.
ODD = 8

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**32, FUNCTIONS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, FUNCTIONS, dtype=np.uint32)
_C = _rng.integers(0, 2**63, (CHUNKS, CHUNK), dtype=np.uint64) | np.uint64(1)
_D = _rng.integers(0, 2**63, (CHUNKS, CHUNK), dtype=np.uint64)


@dataclass(frozen=True)
class Similarity:
    """Link texts whose sets of ``width``-word shingles satisfy 100 * |A ∩ B| >= percent * |A ∪ B|."""

    width: int = 5
    percent: int = 80

    @property
    def bits(self) -> int:
        """Differing bits of two 64-bit sketches that a linked pair may have: the mean and 4.5 deviations."""
        p = (100 - self.percent) / 200
        return ceil(FUNCTIONS * p + 4.5 * sqrt(FUNCTIONS * p * (1 - p)))


def _sets(texts: pa.Array, width: int):
    """Sorted distinct shingle hashes of all rows, and how many each row has."""
    w = tx.words(*tx.raw(texts), lower=True)
    sh, n = tx.shingles(w.hashes(), w.counts, width)
    sh >>= np.uint64(64 - 8 * WIDTH)
    at = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        sh[a:b].sort()
    new = np.ones(len(sh), bool)
    new[1:] = sh[1:] != sh[:-1]
    new[at[:-1][n > 0]] = True
    return sh[new], tx.sums(new, at)


def _minwise(sh: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketch and slots of the rows that have shingles."""
    starts = np.concatenate([[0], np.cumsum(n)])[:-1][n > 0]
    x = sh.astype(np.uint32)
    slots = np.empty((FUNCTIONS, len(starts)), np.uint32)
    for k in range(FUNCTIONS):
        slots[k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
    slots = ((slots ^ (slots >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    bits = (slots & np.uint32(1)).astype(np.uint64) << np.arange(FUNCTIONS, dtype=np.uint64)[:, None]
    sketch = np.bitwise_or.reduce(bits, axis=0)
    return sketch, slots[: CHUNKS * CHUNK].T.astype("<u2")


def _index_keys(slots: np.ndarray) -> np.ndarray:
    """Index keys of rows of slots; the last bit says in which of two orders a key's rows are read."""
    part = slots.T.astype(np.uint64).reshape(CHUNKS, CHUNK, -1) * _C[:, :, None]
    keys = tx.mix(part.sum(axis=1, dtype=np.uint64)[:, None, :] - part + _D[:, :, None])
    order = np.arange(CHUNKS, dtype=np.uint64)[:, None, None] & np.uint64(1)
    return ((keys & ~np.uint64(1)) | order).reshape(CHUNKS * CHUNK, -1).T


def _signatures(sh: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketch and index keys of the rows that have shingles."""
    sketch, slots = _minwise(sh, n)
    return sketch, _index_keys(slots)


def _keyed(batches):
    """The rows of ``batches`` once for each of their keys."""
    for whole in batches:
        for a in range(0, whole.num_rows, KEYED):
            batch = whole.slice(a, KEYED)
            slots = np.frombuffer(b"".join(batch.column("slots").to_pylist()), "<u2").reshape(-1, CHUNKS * CHUNK)
            keys = pa.array(np.ascontiguousarray(_index_keys(slots)).reshape(-1).view(np.int64))
            at = pa.array(np.repeat(np.arange(batch.num_rows), CHUNKS * CHUNK))
            rest = [batch.column(c).take(at) for c in ("row", "sketch", "n")]
            yield pa.RecordBatch.from_arrays([keys, *rest], names=["key", "row", "sketch", "n"])


def _profiles(width: int):
    def run(batches):
        for batch, texts in tx.parts(batches):
            sh, n = _sets(texts, width)
            packed = np.ascontiguousarray(sh.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).reshape(-1)
            at = np.concatenate([[0], np.cumsum(n)]) * WIDTH
            sets = tx.binary(packed, at).cast(pa.binary())
            has = n > 0
            node = pa.array([xxhash.xxh3_128_digest(s) if s else None for s in sets.to_pylist()], pa.binary())
            sketch, slots = np.zeros(len(n), np.uint64), np.zeros((len(n), CHUNKS * CHUNK), "<u2")
            if has.any():
                sketch[has], slots[has] = _minwise(sh, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file"), batch.column("line"), pa.array(n, pa.int64()), node,
                 pa.array(sketch.view(np.int64)), pa.array([v.tobytes() for v in slots], pa.binary()), sets],
                names=["doc_id", "file", "line", "n_shingles", "node", "sketch", "slots", "shingles"],
            )

    return run


_PROFILE = "doc_id long, file string, line long, n_shingles long, node binary, sketch long, slots binary, shingles binary"


def with_place(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and row each comes from, which name a row whatever its columns hold.

    They are the last two columns, under names that no column has.
    """
    try:
        return _placed(docs)
    except AnalysisException:  # not read from Parquet files: write it, then read it
        return _placed(staged(docs))


def _placed(docs: DataFrame) -> DataFrame:
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("_file", "_line"):
        while name in taken:
            name += "_"
        names.append(name)
    place = docs.metadataColumn("_metadata")  # the reader's, also beside a column of that name
    return docs.select("*", place["file_path"].alias(names[0]), place["row_index"].alias(names[1]))


def profiles(placed: DataFrame, like: Similarity, id_col: str, text_col: str) -> DataFrame:
    file, line = placed.columns[-2:]
    narrow = placed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(file).alias("file"), F.col(line).alias("line"))
    return staged(narrow.mapInArrow(_profiles(like.width), _PROFILE).withColumn("row", F.monotonically_increasing_id()))


def _near(pairs: DataFrame, classes: DataFrame, like: Similarity) -> DataFrame:
    """The pairs whose sketches and sizes allow the similarity."""
    side = lambda s: classes.select(F.col("row").alias(s), F.col("sketch").alias(f"sketch_{s}"), F.col("n").alias(f"n_{s}")).hint("merge")
    few = f"bit_count(sketch_a ^ sketch_b) <= {like.bits} AND 100 * least(n_a, n_b) >= {like.percent} * greatest(n_a, n_b)"
    return pairs.join(side("b"), "b").join(side("a"), "a").where(few).select("a", "b")


def _stars(batches):
    """Reads rows sorted by key and links each to the first of its key.

    kind 0: a pair (a, b) that shares a key; kind 1: a row of a key with three rows or more, or with rows in
    several partitions; kind 2: the first row of a key at a border of the partition.
    """

    def rows(kind, key, a, b):
        cols = [np.full(len(a), kind, np.int32), key, a, b]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["kind", "key", "a", "b"])

    lead = None  # key, row, rows so far of the key at the end of the last batch
    for batch in batches:
        if not batch.num_rows:
            continue
        key, row = (batch.column(c).to_numpy() for c in ("key", "row"))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        goes_on = lead is not None and lead[0] == key[0]
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(key)))
        first, total = row[starts].copy(), size.copy()
        if goes_on:
            first[0] = lead[1]
            total[0] += lead[2]
        at = np.repeat(np.arange(len(starts)), size)
        pair = row != first[at]
        yield rows(0, key[pair], first[at][pair], row[pair])
        many = total >= 3
        many[0] |= lead is None or goes_on
        many[-1] = True
        keep = many[at]
        yield rows(1, key[keep], row[keep], row[keep])
        if lead is None:
            yield rows(2, key[:1], row[:1], row[:1])
        lead = (key[-1], first[-1], total[-1])
    if lead is not None:
        yield rows(2, np.array([lead[0]]), np.array([lead[1]]), np.array([lead[1]]))


_STAR = "kind int, key long, a long, b long"


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (_unpacked(v.as_buffer()) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _unpacked(raw) -> np.ndarray:
    wide = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return wide.view("<u8").reshape(-1)


def _sets_of(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """``profile`` narrowed to the rows wanted, before anything is shuffled.

    A row's number is its partition's and its place there, so 64 neighbours share a word of 64 bits.  The words of the
    wanted rows travel to every task: at most one for 64 rows, and no row but these passes, however many they are.
    """
    word, bit = F.shiftright("row", 6).alias("word"), F.expr("shiftleft(1L, CAST(row & 63 AS INT))").alias("bit")
    wanted = rows.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    here = F.expr("shiftright(row, 6) = word AND shiftright(bits, CAST(row & 63 AS INT)) & 1 = 1")
    return profile.select("row", "shingles").join(F.broadcast(wanted), here, "left_semi")


def _with_sets(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """The pairs with the sets of both rows.

    Both joins are sort-merge joins at every size.  Broadcast while the pairs are few, they would keep the sets
    where they are and shuffle them from some size on, so that disk grew faster than the input.
    """
    side = lambda s: _sets_of(pairs.select(F.col(s).alias("row")), profile).select(F.col("row").alias(s), F.col("shingles").alias(f"set_{s}")).hint("merge")
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b")


def confirmed(pairs: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of rows whose full shingle sets are similar enough."""
    return staged(_with_sets(pairs, profile).mapInArrow(_confirm(percent), "a long, b long"))


def _slots(batches):
    """How many shingles of this partition fall into each slot."""
    total = np.zeros(COUNTED, np.int64)
    for batch in batches:
        for raw in batch.column("shingles"):
            np.add.at(total, (_unpacked(raw.as_buffer()) % np.uint64(COUNTED)).astype(np.int64), 1)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "times"])


def _prefixes(times, percent: int):
    """The first shingles of each set in the order of rarity, as many as two similar sets cannot both miss."""

    def run(batches):
        common = times.value
        for batch in batches:
            out = [[] for _ in range(3 + ODD)]
            for raw in batch.column("shingles"):
                x = _unpacked(raw.as_buffer())
                x = x[np.lexsort((x, common[(x % np.uint64(COUNTED)).astype(np.int64)]))]
                n = len(x) + (percent * len(x)) // -100 + 1  # size - ceil(percent of it) + 1
                odd = np.bincount(((x >> np.uint64(20)) % np.uint64(64 * ODD)).astype(np.int64), minlength=64 * ODD) & 1
                odd = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")
                for col, part in zip(out, (x[:n].view(np.int64), np.arange(n), np.full(n, len(x)), *(np.full(n, v) for v in odd)), strict=True):
                    col.append(part)
            each = np.array([len(x) for x in out[0]], np.int64)
            at = pa.array(np.repeat(np.arange(len(each)), each))
            cols = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), *cols], names=["row", "shingle", "place", "n", *_odd()])

    return run


def _odd(side: str = "") -> list[str]:
    return [f"odd{k}{side}" for k in range(ODD)]


def _apart(open_rows: DataFrame, profile: DataFrame, like: Similarity) -> DataFrame:
    """Pairs (a, b) of rows in different components whose sets may be similar enough.

    Prefix filter: put the shingles of all sets into one order, rare ones first.  Two sets as similar as asked share a
    shingle among the first n - ceil(percent * n) + 1 of each, and from the places of the first one they
    share follows how large their intersection can be at most.  In as many of 512 slots as the counts of two sets differ in
    being odd, so many shingles at least are in one set only.  So copies that have each been
    altered in their own way, and are as far from each other as they are many, do not meet.  The order is by counts in
    COUNTED slots, a table of fixed size; any order gives exact results.
    """
    spark = profile.sparkSession
    sets = staged(_sets_of(open_rows, profile).join(open_rows, "row").select("row", "shingles"))
    counts = sets.select("shingles").mapInArrow(_slots, "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(COUNTED, np.int64)
    times[counts["slot"].to_numpy()] = counts["times"].to_numpy()
    del counts
    kinds = "row long, shingle long, place long, n long, " + ", ".join(f"{c} long" for c in _odd())
    prefix = sets.mapInArrow(_prefixes(spark.sparkContext.broadcast(times), like.percent), kinds)
    prefix = staged(prefix.join(open_rows, "row"))
    shared = prefix.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("shingle")
    prefix = prefix.join(shared, "shingle")
    side = lambda s: prefix.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("row", "place", "n", "component", "sketch", *_odd())))
    p = like.percent
    room = f"{100 + p} * least(n_a - place_a, n_b - place_b) >= {p} * (n_a + n_b)"
    differ = " + ".join(f"bit_count({a} ^ {b})" for a, b in zip(_odd("_a"), _odd("_b"), strict=True))
    few = f"bit_count(sketch_a ^ sketch_b) <= {like.bits} AND {100 + p} * ({differ}) <= {100 - p} * (n_a + n_b)"
    met = side("a").join(side("b"), "shingle").where(f"component_a < component_b AND {room} AND {few}")
    return met.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()


def links(profile: DataFrame, like: Similarity) -> tuple[DataFrame, DataFrame]:
    """Classes of rows with equal sets, and confirmed links between classes that connect every linked pair.

    Multi-index Hamming join: the signature's 54 slots are split into 9 chunks of 6.  Two signatures that
    differ in at most 17 slots differ in at most one slot of some chunk, so they share one of
    the 54 keys made of a chunk with one slot left out.  Rows of a key are not paired with each
    other: each is tested against the key's first row, in two different orders.  What stays apart
    although it shares a key is then tested pair by pair, but only across components, for pairs
    whose sketches and sizes allow the similarity.  So a large group of copies costs a star, and no
    pair under the signature distance is lost.  Keys are dealt by range of (key, order), which
    splits a key that very many rows share; the first rows of its pieces are linked afterwards.
    """
    classes = staged(
        profile.where("node IS NOT NULL").groupBy("node").agg(
            F.min("row").alias("row"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"),
            F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("slots").alias("slots"),
        )
    )
    keyed = classes.select("row", "sketch", "n", "slots").mapInArrow(_keyed, "key long, row long, sketch long, n long")
    keyed = keyed.select("key", "row")  # few rows share a key, so sketches and sizes follow once these are known
    order = ["key", F.hash("row", F.expr("pmod(key, 2)")), "row"]
    stars = staged(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stars, _STAR))

    pairs = stars.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = _near(pairs, classes, like)
    border = stars.where("kind = 2").groupBy("key").agg(F.min("a").alias("a"), F.max("a").alias("most"))
    border = stars.where("kind = 2").select("key", F.col("a").alias("b")).join(border.where("a < most").drop("most"), "key")
    tested = staged(pairs.union(border.where("a < b").select("a", "b")).distinct())
    edges = confirmed(tested, profile, like.percent)

    comp = connected(edges)
    groups = stars.where("kind = 1").select("key", F.col("a").alias("row"))
    groups = groups.join(comp.withColumnRenamed("vertex", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    groups = staged(groups)
    apart = groups.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    open_rows = groups.join(apart, "key", "left_semi").select("row", "component").distinct()
    open_rows = staged(open_rows.join(classes.select("row", "sketch"), "row").select("row", "sketch", "component"))
    rest = _apart(open_rows, profile, like).join(tested, ["a", "b"], "left_anti")
    return classes.select("node", "row", "least"), edges.union(confirmed(staged(rest), profile, like.percent))


def near_duplicates(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its group: doc_id, n_shingles, component_id (the least id reachable), chosen.

    A set holds the distinct shingles of the lower-cased (A-Z) words; a text with fewer words has its whole
    sequence as one, and one without words, empty or null, has none and is linked with nothing.
    ``chosen`` marks one row of each group, the first of those with the least id (a null id
    comes after any other), so repeated ids and repeated rows leave one.  ``file`` and ``line``
    say where the row was read.  An empty table gives no rows; other columns are not read.
    Links are confirmed on sets of 48-bit hashes.
    """
    return _grouped(with_place(docs), like, id_col, text_col)


def _grouped(placed: DataFrame, like: Similarity, id_col: str, text_col: str) -> DataFrame:
    profile = profiles(placed, like, id_col, text_col)
    classes, edges = links(profile, like)
    comp = connected(edges).withColumnRenamed("vertex", "row")
    member = classes.join(comp, "row", "left").select("node", "least", F.coalesce("component", "row").alias("component"))
    member = staged(member)
    least = member.groupBy("component").agg(F.min("least").alias("first"))
    of_node = member.select("node", "component").join(least, "component").select("node", "first")
    rows = profile.select("doc_id", "n_shingles", "node", "row", "file", "line").join(of_node, "node", "left")
    alone = F.col("first").isNull()
    return rows.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | (F.col("first.row") == F.col("row"))).alias("chosen"), "file", "line",
    )


def drop_near_duplicates(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, its columns as they are."""
    placed = with_place(docs)
    file, line = placed.columns[-2:]
    gone = _grouped(placed, like, id_col, text_col).where(~F.col("chosen")).select(F.col("file").alias(file), F.col("line").alias(line))
    return placed.join(gone, [file, line], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
