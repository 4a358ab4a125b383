"""Benchmark passages found in documents by latent semantic retrieval and by shared words, confirmed word by word."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import texts as tx

#: Hashed terms, directions sampled, leading ones left out (they tell languages apart, not passages), and the seed.
TERMS, SAMPLED, LEADING, SEED = 1 << 14, 96, 16, 7
#: Passages whose part of the matrix is multiplied at a time.
TOGETHER = 32
#: Words of a segment; passages of 4 segments make the matrix, windows of 2 and 4 are searched.
SEGMENT, PASSAGE = 12, 4
SCALES = (2, 4)
#: Items of up to this many words are sought in short windows, longer ones in long windows.
SHORT_ITEM = 30
#: Least cosine of a candidate, and what the longest common subsequence must cover.
COSINE, COVER, COVER_WITH_ANSWER, ANSWER = 0.5, 0.8, 0.6, 0.8
#: Rare words of an item that must stand near each other, and items looked up at a time.
SHARED, LOOKUP = 4, 256
#: Items held in a task at a time; a larger benchmark is searched block by block.
BLOCK = 4096
#: Words whose vectors are held at a time.
CHUNK_WORDS = 60_000


#: Bytes that are no UTF-8, as Python escapes them.
_BAD = re.compile("([\udc80-\udcff]+)")


def _test_matrix() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((TERMS, SAMPLED), dtype=np.float32)


def lowered(texts: pa.Array) -> pa.Array:
    """Lower case in every script, so that a passage set in capitals is found; bytes that are no UTF-8 stay."""
    try:
        return pc.utf8_lower(texts.cast(pa.large_string())).cast(pa.large_binary())
    except pa.ArrowInvalid:
        return pa.array([_lowered_row(t) for t in texts.to_pylist()], pa.large_binary())


def _lowered_row(text: bytes) -> bytes:
    """One text in lower case, the same as in a column of valid ones; the bytes that are no UTF-8 stay between."""
    runs = _BAD.split(text.decode("utf-8", "surrogateescape"))
    runs[::2] = pc.utf8_lower(pa.array(runs[::2], pa.large_string())).to_pylist()
    return "".join(runs).encode("utf-8", "surrogateescape")


@dataclass
class Cut:
    """The words of some rows and the segments that tile them."""

    hashes: np.ndarray
    counts: np.ndarray
    first: np.ndarray  # first word of each row
    starts: np.ndarray  # first word of each segment
    rows: np.ndarray  # row of each segment
    place: np.ndarray  # place of each segment in its row

    @classmethod
    def of(cls, texts: pa.Array) -> Cut:
        w = tx.words(*tx.raw(lowered(texts)))
        n = -(-w.counts // SEGMENT)
        rows = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(rows)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
        return cls(w.hashes(), w.counts, w.first, w.first[rows] + place * SEGMENT, rows, place)

    @property
    def terms(self) -> np.ndarray:
        return (self.hashes >> np.uint64(50)).astype(np.int64)

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        """Sum of the words' vectors for each segment.

        All but the last segment of a row have SEGMENT words; these are added place by place for many segments at once, in
        the order in which numpy reduces the others, so that a sum does not depend on how it was made.
        """
        out = np.empty((len(self.starts), vectors.shape[1]), np.float32)
        terms, step = self.terms, CHUNK_WORDS // SEGMENT
        size = np.diff(np.append(self.starts, len(terms)))
        for a in range(0, len(self.starts), step):
            start, n, part = self.starts[a : a + step], size[a : a + step], out[a : a + step]
            short, full = np.flatnonzero(n < SEGMENT), np.flatnonzero(n == SEGMENT)
            if len(short):
                first = np.cumsum(n[short]) - n[short]
                at = np.arange(n[short].sum()) + np.repeat(start[short] - first, n[short])
                part[short] = np.add.reduceat(vectors[terms[at]], first, axis=0)
            word = lambda k, at=start[full]: vectors[terms[at + k]]
            eight = (word(1) + word(2)) + (word(3) + word(4))
            eight += (word(5) + word(6)) + (word(7) + word(8))
            for k in range(9, SEGMENT):
                eight += word(k)
            eight += word(0)
            part[full] = eight
        return out


def _sketch(batches):
    """Of this partition's passage-term matrix T: passages per term, and T'(T times the test matrix)."""
    test = _test_matrix()
    df, g, passages = np.zeros(TERMS, np.int64), np.zeros((TERMS, SAMPLED), np.float64), 0
    place = np.zeros(TERMS, np.int64)
    for _, texts in tx.parts(batches, limit=600_000):
        cut = Cut.of(texts)
        if not len(cut.starts):
            continue
        opens = np.flatnonzero(cut.place % PASSAGE == 0)
        passages += len(opens)
        bounds = np.append(cut.starts[opens], len(cut.hashes))
        terms = cut.terms
        # few passages at a time, as a dense matrix of the terms they hold: two matrix products and no sort
        for a in range(0, len(opens), TOGETHER):
            b = min(len(opens), a + TOGETHER)
            here = terms[bounds[a] : bounds[b]]
            seen = np.zeros(TERMS, bool)
            seen[here] = True
            used = np.flatnonzero(seen)
            place[used] = np.arange(len(used))
            own = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
            counts = np.bincount(own * len(used) + place[here], minlength=(b - a) * len(used)).reshape(b - a, len(used))
            held = counts.astype(np.float32)
            g[used] += held.T @ (held @ test[used])
            df[used] += np.count_nonzero(counts, axis=0)
    if passages:
        used = np.flatnonzero(df)
        cols = [pa.array(used.astype(np.int32)), pa.array(df[used]), *(pa.array(g[used, k]) for k in range(SAMPLED))]
        yield pa.RecordBatch.from_arrays(cols, names=["term", "df", *(f"g{k}" for k in range(SAMPLED))])
        # the number of passages travels as a term of its own
        none = [pa.array([0.0]) for _ in range(SAMPLED)]
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([passages]), *none], names=["term", "df", *(f"g{k}" for k in range(SAMPLED))])


@dataclass
class Space:
    """Of each hashed term, its vector and the passages that hold it."""

    vectors: np.ndarray
    df: np.ndarray


def latent_space(docs: DataFrame, text_col: str = "text") -> Space:
    """A vector for each hashed term, from a randomised SVD of the TF-IDF matrix of the passages of all texts.

    One pass: every task multiplies its part of A'A with the test matrix, and the TERMS x SAMPLED sums
    meet on the driver, whose size does not depend on the data.  Since the idf weights are known only
    then, the test matrix is scaled by them afterwards, on both sides.  The
    singular vectors follow from the product by the Nystroem formula.  Terms are returned as
    idf * V / sigma without the leading directions, which all texts of a language share.
    """
    kinds = "term int, df long, " + ", ".join(f"g{k} double" for k in range(SAMPLED))
    # each task sends up to TERMS rows, so there are two tasks for each core, not one for each split
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    parts = docs.select(F.col(text_col).alias("text")).coalesce(tasks).mapInArrow(_sketch, kinds)
    summed = parts.groupBy("term").agg(F.sum("df").alias("df"), *(F.sum(f"g{k}").alias(f"g{k}") for k in range(SAMPLED)))
    got = summed.toPandas()
    out, df = np.zeros((TERMS, SAMPLED), np.float32), np.zeros(TERMS, np.int64)
    passages = int(got.loc[got.term < 0, "df"].sum())
    got = got[got.term >= 0]
    if not len(got):
        return Space(out, df)
    at = got.term.to_numpy()
    df[at] = got.df.to_numpy()
    idf = np.log1p(passages / got.df.to_numpy())[:, None]
    y = idf * got[[f"g{k}" for k in range(SAMPLED)]].to_numpy()
    core = (_test_matrix()[at].astype(np.float64) / idf).T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > value[-1] * 1e-10
    half = y @ (vector[:, good] / np.sqrt(value[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    use = s > s[0] * 1e-7
    use[: min(LEADING, int(use.sum()) // 4)] = False
    out[at, : int(use.sum())] = idf * u[:, use] / s[use]
    return Space(np.ascontiguousarray(out[:, : max(1, int(use.sum()))]), df)


@dataclass
class Item:
    id: object
    words: list[int]
    answer: list[int]


def _items(rows) -> list[Item]:
    """Items with words; the answer is the last sentence."""
    out = []
    for row in rows:
        text = row["text"] or ""
        cut = Cut.of(pa.array([text.encode()], pa.large_binary()))
        if not len(cut.hashes):
            continue
        body = text.rstrip(" .!?\n\t")
        last = max(body.rfind(c) for c in ".!?\n") + 1
        tail = Cut.of(pa.array([text[last:].encode()], pa.large_binary())).hashes
        out.append(Item(row["item_id"], cut.hashes.tolist(), tail.tolist()))
    return out


def common_subsequence(masks: dict[int, int], n: int, words) -> int:
    """Length of the longest common subsequence of n words, given as a bit mask per word, and ``words``."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            hit = v & m
            v = ((v + hit) | (v - hit)) & full
    return n - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _needed(n: int) -> int:
    """Words of an item of n words that a leak must have in common with it."""
    return max(min(n, 8), next(k for k in range(int(COVER_WITH_ANSWER * n), n + 1) if k >= COVER_WITH_ANSWER * n))


class Shared:
    """Finds where a text has enough of an item's rare words, whatever words stand around them.

    A leak has ``_needed(n)`` of an item's n words in common with it, so of its n - needed + SHARED rarest ones it has
    SHARED at least.  Where so many of them stand as near as the item and its slack allow, the item is laid over the
    text by the place of the first.  So no leak within the slack is missed, however many texts share it.
    """

    def __init__(self, items: list[Item], df: np.ndarray):
        entries: dict[int, list[tuple[int, int, int]]] = {}
        self.least, self.size = np.ones(len(items), np.int64), np.array([len(i.words) for i in items], np.int64)
        # half the item on each side; of a long one 24 words and an eighth
        self.slack = np.minimum(self.size // 2, 24 + self.size // 8)
        for i, item in enumerate(items):
            n, places = len(item.words), {}
            for k, w in enumerate(item.words):
                places.setdefault(w, []).append(k)
            self.least[i] = min(SHARED, _needed(n))
            left = n - _needed(n) + self.least[i]
            for w in sorted(places, key=lambda w: (df[w >> 50], w)):
                if left <= 0:
                    break
                entries.setdefault(w, []).append((i, places[w][0], places[w][-1]))
                left -= len(places[w])
        words = sorted(entries)
        self.words = np.array(words, np.uint64)
        self.ends = np.cumsum([0, *(len(entries[w]) for w in words)])
        self.entries = np.array([e for w in words for e in entries[w]], np.int64).reshape(-1, 3)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.words >> np.uint64(46)] = True

    def windows(self, cut: Cut):
        """(row, item, first word, end) of windows that may hold the item."""
        if not len(self.words):
            return
        at = np.flatnonzero(self.maybe[cut.hashes >> np.uint64(46)])
        word = np.minimum(np.searchsorted(self.words, cut.hashes[at]), len(self.words) - 1)
        same = self.words[word] == cut.hashes[at]
        at, word = at[same], word[same]
        size = self.ends[word + 1] - self.ends[word]
        entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.ends[word], size)
        item, low, high = self.entries[entry].T
        order = np.argsort(item, kind="stable")
        at, item, low, high = np.repeat(at, size)[order], item[order], low[order], high[order]
        last = np.minimum(np.arange(len(at)) + self.least[item] - 1, len(at) - 1)
        first = np.flatnonzero((item[last] == item) & (at[last] - at < self.size[item] + 2 * self.slack[item]) & (last - np.arange(len(at)) == self.least[item] - 1))
        row = np.searchsorted(cut.first, at[first], "right") - 1
        inside = at[last[first]] < cut.first[row + 1]
        first, row = first[inside], row[inside]
        item = item[first]
        a = np.maximum(at[first] - high[first] - self.slack[item], cut.first[row])
        b = np.minimum(at[first] - low[first] + self.size[item] + self.slack[item], cut.first[row + 1])
        seen = np.ones(len(first), bool)
        seen[1:] = (item[1:] != item[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield from zip(row[seen].tolist(), item[seen].tolist(), a[seen].tolist(), b[seen].tolist(), strict=True)


class Finder:
    """Looks for the items in batches of texts."""

    def __init__(self, items: list[Item], space: Space):
        vectors = space.vectors
        self.items, self.vectors = items, vectors
        unit = np.zeros((len(items), vectors.shape[1]), np.float32)
        for i, item in enumerate(items):
            unit[i] = vectors[[w >> 50 for w in item.words]].sum(axis=0)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-30)
        self.size = np.array([len(i.words) for i in items], np.int64)
        short = self.size <= SHORT_ITEM
        self.groups = [(SCALES[0], np.flatnonzero(short)), (SCALES[1], np.flatnonzero(~short))]
        self.unit = unit
        self.masks = [_masks(i.words) for i in items]
        self.answers = [_masks(i.answer) for i in items]
        # no subsequence is longer than the distinct words shared and the item's repeats together
        self.distinct = [frozenset(i.words) for i in items]
        self.enough = [_needed(len(i.words)) - (len(i.words) - len(d)) for i, d in zip(items, self.distinct, strict=True)]
        self.shared = [(a, Shared(items[a : a + LOOKUP], space.df)) for a in range(0, len(items), LOOKUP)]

    def candidates(self, cut: Cut):
        """(row, item, first word, end, cosine) of windows near an item, with half the item and a segment more on each side."""
        sums = cut.sums(self.vectors)
        for scale, which in self.groups:
            if not len(which) or not len(sums):
                continue
            window, end = sums.copy(), np.arange(len(sums)) + 1
            for k in range(1, scale):
                same = cut.rows[k:] == cut.rows[:-k]
                window[:-k][same] += sums[k:][same]
                end[:-k][same] += 1
            window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-30)
            stop = np.append(cut.starts, len(cut.hashes))
            step = max(1, min(4096, (1 << 20) // len(which)))
            for a in range(0, len(window), step):
                cos = window[a : a + step] @ self.unit[which].T
                at, item = np.divmod(np.flatnonzero(cos >= COSINE), len(which))
                near, at, item = cos[at, item], at + a, which[item]
                row, more = cut.rows[at], self.size[item] // 2 + SEGMENT
                low = np.maximum(cut.first[row], cut.starts[at] - more)
                high = np.minimum(cut.first[row + 1], stop[end[at]] + more)
                yield from zip(row.tolist(), item.tolist(), low.tolist(), high.tolist(), near.tolist(), strict=True)

    def confirm(self, words: list[int], item: int) -> tuple[float, float] | None:
        """The covered shares of the item and of its answer, if they make a leak."""
        if len(self.distinct[item].intersection(words)) < self.enough[item]:
            return None
        n = len(self.items[item].words)
        got = common_subsequence(self.masks[item], n, words)
        if got < min(n, 8) or got < COVER_WITH_ANSWER * n:
            return None
        of_answer = len(self.items[item].answer)
        answer = common_subsequence(self.answers[item], of_answer, words) / of_answer if of_answer else 1.0
        return (got / n, answer) if got >= COVER * n or answer >= ANSWER else None

    def find(self, texts: pa.Array) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(row, item) to covered share, answer's share and cosine of the best window."""
        cut = Cut.of(texts)
        words = cut.hashes.tolist()
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for row, item, a, b, cos in self.candidates(cut):
            best = found.get((row, item))
            if best and best[0] == 1:
                continue
            got = self.confirm(words[a:b], item)
            if got and (best is None or (*got, cos) > best):
                found[row, item] = (*got, cos)
        for base, shared in self.shared:
            for row, i, a, b in shared.windows(cut):
                best = found.get((row, base + i))
                if best and best[0] == 1:
                    continue
                got = self.confirm(words[a:b], base + i)
                if got and (best is None or got > best[:2]):
                    found[row, base + i] = (*got, self.cosine(cut.terms[a:b], base + i))
        return found

    def cosine(self, terms: np.ndarray, item: int) -> float:
        window = self.vectors[terms].sum(axis=0)
        return float(window @ self.unit[item] / max(np.linalg.norm(window), 1e-30))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The benchmark's items, at most about BLOCK at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    blocks = -(-items.count() // BLOCK)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        got = _items(part.collect())
        if got:
            yield got


def _hits(bench, space):
    def run(batches):
        finder = Finder(bench.value, space.value)
        for batch, texts in tx.parts(batches, limit=600_000):
            found = finder.find(texts)
            docs = batch.column("doc_id").take(pa.array([r for r, _ in found], pa.int64()))
            items = pa.array([finder.items[i].id for _, i in found], pa.int64())
            scores = [pa.array([v[k] for v in found.values()], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([docs, items, *scores], names=["doc_id", "item_id", "covered", "answer_covered", "cosine"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, covered, answer_covered, cosine.

    Windows of the document whose latent vector has a cosine of 0.5 or more with an item's are candidates, and so
    are those that have as many of the item's rare words as a leak must have, whatever their cosine.
    A candidate is a leak if the longest common subsequence of words covers 0.8 of the item, or 0.6 and
    0.8 of its answer (its last sentence), and eight words at least (all of a shorter item).
    Case does not matter.  Null and empty texts, on either side, have no windows and never match.
    Rows with equal ids each give their own rows; a null id stays null.  An empty table on
    either side gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = "doc_id long, item_id long, covered double, answer_covered double, cosine double"
    out = spark.createDataFrame([], kinds)
    space = None
    for bench in _blocks(benchmark, item_col, item_text):
        space = space or spark.sparkContext.broadcast(latent_space(narrow))
        out = out.union(narrow.mapInArrow(_hits(spark.sparkContext.broadcast(bench), space), kinds))
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """``docs`` without the rows in which an item is found, columns as they are; each text is searched in one task."""
    spark = docs.sparkSession
    space = None
    for bench in _blocks(benchmark, item_col, item_text):
        space = space or spark.sparkContext.broadcast(latent_space(docs, text_col))
        docs = docs.mapInArrow(_without(spark.sparkContext.broadcast(bench), space, text_col), T.StructType(docs.schema.fields))
    return docs


def _without(bench, space, text_col):
    def run(batches):
        finder = Finder(bench.value, space.value)
        for batch, texts in tx.parts(batches, text_col, 600_000):
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, _ in finder.find(texts)]] = False
            yield batch.filter(pa.array(keep))

    return run
