"""Words inside passages that an earlier document holds already, found by sharded phrase automata.

A passage recurs if a window of ``width`` consecutive words starts in documents of different ids.
Every window is named by its least run of ANCHOR words (its anchor), so equal windows carry equal
anchors and only windows under an anchor of several documents are looked at again.  Those are
compared window by window, which gives each its first document; neighbouring windows of one passage
with the same first document make a phrase.  Phrases travel as text to the groups of documents that
can hold them, each group compiles them into Aho-Corasick automata of bounded size, and all its
documents are streamed through these; what the automata find is what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import texts as tx
from sievework.llm.neardup import with_place
from sievework.sources.stage import staged

#: Words of an anchor, and how many windows in a row may be kept under one anchor as one passage.
ANCHOR, RUN = 8, 64
#: Words of the documents that one group streams, and phrases of one automaton.
GROUP_WORDS, SHARD = 1_000_000, 8192

_INVERSE = np.uint64(pow(int(tx.BASE), -1, 1 << 64))
_SPACE = pa.scalar(b" ", pa.large_binary())
_NOTHING = hashlib.sha256().hexdigest()


class _Runs:
    """Hashes of any run of words of a batch, from prefix polynomials modulo 2^64."""

    def __init__(self, words: tx.Words):
        h = words.hashes()
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(h), tx.BASE)))
        self.back = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(h), _INVERSE)))
        self.total = np.append(np.uint64(0), np.cumsum(h * power[:-1], dtype=np.uint64))

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return tx.mix((self.total[start + size] - self.total[start]) * self.back[start] + np.asarray(size).astype(np.uint64))


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` neighbours."""
    have = 1
    while 2 * have <= span:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (span - have)], x[span - have :]) if have < span else x


def joined(words: tx.Words, keep: np.ndarray | None = None) -> pa.Array:
    """Each row's words, or those of them kept, with one space between."""
    counts, items = words.counts, words.array()
    if keep is not None:
        counts = tx.sums(keep, words.first)
        items = items.filter(pa.array(keep))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items), _SPACE)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _anchored(width: int):
    """Each document's passages: runs of windows with one anchor, as far as RUN windows."""
    short = min(ANCHOR, width)

    def run(batches):
        for batch, texts in tx.parts(batches):
            w = tx.words(*tx.raw(texts))
            runs = _Runs(w)
            n = np.maximum(w.counts - width + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            first = np.concatenate([[0], np.cumsum(n)])[:-1]
            start = w.first[row] + np.arange(len(row)) - first[row]
            if len(start):
                grams = runs.of(np.arange(len(w.offsets) - short), short)
                anchor = _least(grams, width - short + 1)[start]
                new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))
                since = np.arange(len(new)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                heads = np.flatnonzero(since % RUN == 0)
                count = np.diff(np.append(heads, len(new)))
                of_row = np.bincount(row[heads], minlength=len(n))
                columns = (
                    anchor[heads].view(np.int64), (start - w.first[row])[heads], count,
                    runs.of(start[heads], count + width - 1).view(np.int64),
                )
            else:
                of_row, columns = np.zeros(len(n), np.int64), (np.zeros(0, np.int64),) * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            sha = [hashlib.sha256(t).digest() for t in joined(w).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file"), batch.column("line"), pa.array(w.counts, pa.int64()), pa.array(sha, pa.binary()),
                 *[_lists(c, of_row, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "file", "line", "n_words", "sha", "anchor", "start", "count", "print"],
            )

    return run


_ANCHORED = (
    "doc_id long, file long, line long, n_words long, sha binary, anchor array<long>, start array<int>, count array<int>, print array<long>"
)


def _cut_out(width: int):
    """The wanted passages of each document: their text and, where several share an anchor, their windows' hashes."""

    def run(batches):
        for batch, texts in tx.parts(batches):
            w = tx.words(*tx.raw(texts))
            runs = _Runs(w)
            wanted = batch.column("wanted")
            parent, item = pc.list_parent_indices(wanted).to_numpy(), pc.list_flatten(wanted)
            start = w.first[parent] + pc.struct_field(item, "start").to_numpy()
            count = pc.struct_field(item, "count").to_numpy().astype(np.int64)
            size = count + width - 1
            index = np.repeat(start - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
            text = pc.binary_join(_lists_of(w.array().take(pa.array(index)), size), _SPACE)
            n = np.where(pc.struct_field(item, "shared").to_numpy(zero_copy_only=False), count, 0)
            at = np.repeat(start - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pc.struct_field(item, c) for c in ("anchor", "print", "low", "high")]
                + [_lists(runs.of(at, width).view(np.int64), n, pa.int64()), text.cast(pa.binary())],
                names=["anchor", "print", "low", "high", "windows", "passage"],
            )

    return run


def _lists_of(items: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items)


def _phrases(table: pa.Table, width: int) -> dict[bytes, int]:
    """The phrases of a group's passages and each one's first document.

    Without owners all windows of a passage belong to ``low``; else neighbouring windows of one owner
    make a phrase, and windows without one none.
    """
    out = {}
    for passage, low, owners in zip(*(table.column(c).to_pylist() for c in ("passage", "low", "owners")), strict=True):
        if owners is None:
            out[passage] = low
            continue
        words = passage.split(b" ")
        owners = sorted((o["at"], o["owner"]) for o in owners)
        begin = 0
        for i in range(1, len(owners) + 1):
            if i == len(owners) or owners[i] != (owners[i - 1][0] + 1, owners[i - 1][1]):
                out[b" ".join(words[owners[begin][0] : owners[i - 1][0] + width])] = owners[begin][1]
                begin = i
    return out


class PhraseAutomaton:
    """Locates whole phrases of words.

    Each word of the phrases has a number, written as two or three letters, so that a state has at most 256
    ways on; all other words are number 0, which no phrase holds.
    """

    def __init__(self, phrases: list[bytes]):
        parts = [p.split(b" ") for p in phrases]
        self.size = np.array([len(p) for p in parts])
        flat = pa.array([x for p in parts for x in p], pa.large_binary())
        self.known = pc.unique(flat)
        self.letters = 2 if len(self.known) < 1 << 16 else 3
        code, step = self._code(flat), self.letters
        ends = np.cumsum(self.size) * step
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, (a, b) in enumerate(zip(ends - self.size * step, ends, strict=True)):
            self.automaton.add_word(code[a:b], i)
        self.automaton.make_automaton()

    def _code(self, words: pa.Array) -> str:
        number = pc.fill_null(pc.add(pc.index_in(words, value_set=self.known), 1), 0).to_numpy()
        shift = 8 * np.arange(self.letters - 1, -1, -1)
        return (number[:, None] >> shift).astype(np.uint8).tobytes().decode("latin-1")

    def occurrences(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases end (the word after) and which they are."""
        hits = np.fromiter((x for hit in self.automaton.iter(self._code(words)) for x in hit), np.int64).reshape(-1, 2)
        ends, which = hits[:, 0] + 1, hits[:, 1]
        whole = ends % self.letters == 0  # a match that starts inside a word's letters is none
        return ends[whole] // self.letters, which[whole]


def _covered(words: tx.Words, ids: np.ndarray, automaton: PhraseAutomaton, owner: np.ndarray, mark: np.ndarray) -> None:
    """Adds to ``mark`` a start and an end for every occurrence whose phrase an earlier document owns."""
    # a word of its own between rows keeps phrases inside them
    place = np.insert(np.arange(len(words.offsets) - 1), words.first[1:-1], -1)
    stream = words.array().take(pa.array(place, mask=place < 0))
    end, which = automaton.occurrences(stream)
    begin = end - automaton.size[which]
    row = np.searchsorted(words.first + np.arange(len(words.first)), begin, "right") - 1
    use = owner[which] < ids[row]
    np.add.at(mark, begin[use] - row[use], 1)
    np.add.at(mark, end[use] - row[use], -1)


def _located(width: int):
    """Streams a group's documents through the automata of its phrases."""

    def run(docs: pa.Table, routed: pa.Table) -> pa.Table:
        found: list[pa.RecordBatch] = []
        phrases = _phrases(routed, width) if len(docs) else {}
        names, owners = list(phrases), np.fromiter(phrases.values(), np.int64, len(phrases))
        slices = [(b, tx.words(*tx.raw(t))) for b, t in tx.parts(docs.combine_chunks().to_batches())] if names else []
        marks = [np.zeros(len(w.offsets), np.int64) for _, w in slices]
        for a in range(0, len(names), SHARD):
            automaton = PhraseAutomaton(names[a : a + SHARD])
            for (batch, w), mark in zip(slices, marks, strict=True):
                _covered(w, batch.column("doc_id").to_numpy(), automaton, owners[a : a + SHARD], mark)
        for (batch, w), mark in zip(slices, marks, strict=True):
            found.append(_removed(batch, w, np.cumsum(mark)[:-1] > 0))
        return pa.Table.from_batches(found, _FOUND_ARROW)

    return run


_SPANS = "array<struct<begin:long,end:long>>"
_FOUND = f"file long, line long, n_removed long, kept_sha256 string, removed {_SPANS}"
_FOUND_ARROW = pa.schema(
    [("file", pa.int64()), ("line", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
     ("removed", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
)


def _removed(batch: pa.RecordBatch, w: tx.Words, gone: np.ndarray) -> pa.RecordBatch:
    """The rows that lose words: how many, which, and the digest of what stays."""
    n = tx.sums(gone, w.first)
    has = pa.array(n > 0)
    sha = [hashlib.sha256(t).hexdigest() for t in joined(w, ~gone).filter(has).to_pylist()]
    here = np.append(gone, False)
    head = np.zeros(len(here), bool)
    head[w.first[:-1]] = True  # a span ends with its row
    before = np.append(False, here[:-1]) & ~head
    after = np.append(here[1:] & ~head[1:], False)
    begin, last = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after)
    row = np.searchsorted(w.first, begin, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(begin - w.first[row]), pa.array(last + 1 - w.first[row])], ["begin", "end"])
    of_row = _lists_of(spans, np.bincount(row, minlength=len(n)))
    return pa.RecordBatch.from_arrays(
        [batch.column("file").filter(has), batch.column("line").filter(has), pa.array(n[n > 0], pa.int64()), pa.array(sha, pa.string()),
         of_row.filter(has)],
        schema=_FOUND_ARROW,
    )


def repeated_passages(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with what an earlier document says already: doc_id, n_words, n_removed, kept_sha256, removed.

    A word is removed if a window of ``width`` words over it also starts in a document with a smaller id;
    windows are judged on the whole input.  ``removed`` lists the word ranges, ``kept_sha256`` is the digest
    of the words that stay, joined by one space.

    A null text has no words.  A null id is neither smaller nor larger, so such rows lose nothing and
    take nothing from others.  Rows of one id never take from each other; repeated rows are
    rows like others.  An empty table gives no rows; other columns are not read.  Texts are compared byte by
    byte, valid UTF-8 or not.  Copies of one whole text are compared by its sha256 and only
    the first takes part in the search, so a large group of copies costs one row each.
    """
    return _passages(with_place(docs), width, id_col, text_col).drop("file", "line")


def _passages(placed: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    file, line = placed.columns[-2:]
    read = placed.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(file).alias("file"), F.col(line).alias("line"), F.col(text_col).alias("text")
    )
    every = staged(read.mapInArrow(_anchored(width), _ANCHORED))
    whole = every.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= width))
    one = F.min(F.struct("doc_id", "file", "line")).alias("one")
    firsts = staged(whole.groupBy("sha").agg(one).select("sha", "one.*"))

    # passages under anchors of several documents; of the copies of a text the first only
    several = (
        whole.select("doc_id", F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        .where("a < b").select("anchor")
    )
    item = F.explode(F.arrays_zip("anchor", "start", "count", "print")).alias("item")
    runs = whole.join(firsts.select("file", "line"), ["file", "line"], "left_semi").select("doc_id", "file", "line", item)
    runs = staged(runs.select("doc_id", "file", "line", "item.*").join(several, "anchor", "left_semi"))

    # each distinct passage once, with its first and last document and one place to read it
    place = F.min(F.struct("file", "line", "start", "count")).alias("place")
    distinct = runs.groupBy("anchor", "print").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), place)
    shared = distinct.groupBy("anchor").agg(F.min("low").alias("least"), F.max("high").alias("most"), (F.count("*") > 1).alias("shared"))
    shared = staged(shared.where("least < most").drop("most"))
    wanted = distinct.join(shared, "anchor").select(
        "place.file", "place.line",
        F.struct("anchor", "print", "place.start", "place.count", "low", "high", "shared").alias("item"),
    )
    wanted = wanted.groupBy("file", "line").agg(F.collect_list("item").alias("wanted"))  # of one document
    passage = "anchor long, print long, low long, high long, windows array<long>, passage binary"
    texts = staged(read.select("file", "line", "text").join(wanted, ["file", "line"]).mapInArrow(_cut_out(width), passage))

    # where passages differ under one anchor, the first document of every window that several hold
    windows = texts.select("anchor", "print", "low", "high", F.posexplode("windows").alias("at", "window"))
    owner = windows.groupBy("anchor", "window").agg(F.min("low").alias("owner"), F.max("high").alias("last")).where("owner < last").drop("last")
    owners = windows.select("anchor", "print", "at", "window").join(owner, ["anchor", "window"])
    owners = owners.groupBy("anchor", "print").agg(F.collect_list(F.struct("at", "owner")).alias("owners"))
    owned = texts.select("anchor", "print", "low", "passage", F.size("windows").alias("n")).join(owners, ["anchor", "print"], "left")
    owned = owned.where("n = 0 OR owners IS NOT NULL").drop("n")

    # phrases to the groups of documents that may hold them; all documents to their groups
    groups = max(1, ceil((every.agg(F.sum("n_words")).first()[0] or 0) / GROUP_WORDS))
    group = F.pmod(F.xxhash64("file", "line"), F.lit(groups)).alias("group")
    later = runs.join(shared.select("anchor", "least"), "anchor").where("doc_id > least").select(group, "anchor", "print").distinct()
    routed = later.join(owned, ["anchor", "print"]).select("group", "low", "passage", "owners")
    long_enough = F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * width - 1)
    stream = read.where(long_enough).select(group, "doc_id", "file", "line", "text")
    found = stream.groupBy("group").cogroup(routed.groupBy("group")).applyInArrow(_located(width), _FOUND)

    of_text = firsts.join(found, ["file", "line"], "left").select("sha", F.col("doc_id").alias("first"), "n_removed", "kept_sha256", "removed")
    rows = every.select("doc_id", "n_words", "sha", "file", "line").join(of_text, "sha", "left")
    copy, own = F.col("doc_id") > F.col("first"), F.col("doc_id").isNotNull() & F.col("n_removed").isNotNull()
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end")))
    return rows.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).when(own, F.col("n_removed")).otherwise(0).alias("n_removed"),
        F.when(copy, _NOTHING).when(own, F.col("kept_sha256")).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
        F.when(copy, all_words).when(own, F.col("removed")).otherwise(F.array().cast(_SPANS)).alias("removed"), "file", "line",
    )


def _without(text_col: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in tx.parts([whole], column=text_col):
                at = batch.schema.get_field_index(text_col)
                spans = batch.column(batch.num_columns - 1)
                w = tx.words(*tx.raw(texts))
                mark = np.zeros(len(w.offsets), np.int64)
                row, span = pc.list_parent_indices(spans).to_numpy(), pc.list_flatten(spans)
                for name, by in (("begin", 1), ("end", -1)):
                    np.add.at(mark, w.first[row] + pc.struct_field(span, name).to_numpy(), by)
                kept = joined(w, np.cumsum(mark)[:-1] == 0)
                data, ends = tx.raw(kept)
                kept = pa.Array.from_buffers(pa.string(), len(kept), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                column = pc.if_else(pc.greater(pc.fill_null(pc.list_value_length(spans), 0), 0), kept, batch.column(at))
                yield pa.RecordBatch.from_arrays(
                    [column if i == at else c for i, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1]
                )

    return run


def drop_repeated(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words that ``repeated_passages`` removes; a text that loses none stays as it is.

    The words that stay are joined by one space.  Columns, rows and their number are unchanged.
    """
    placed = with_place(docs)
    file, line = placed.columns[-2:]
    gone = _passages(placed, width, id_col, text_col).where("n_removed > 0")
    taken, names = {c.lower() for c in placed.columns}, []
    for name in ("_in", "_at", "_spans"):
        while name in taken:
            name += "_"
        names.append(name)
    gone = gone.select(*[F.col(c).alias(n) for c, n in zip(("file", "line", "removed"), names, strict=True)])
    rows = placed.join(gone, (F.xxhash64(file) == F.col(names[0])) & (F.col(line) == F.col(names[1])), "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], names[2])
    return rows.mapInArrow(_without(text_col), docs.schema)
