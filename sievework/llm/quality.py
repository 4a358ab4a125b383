"""Quality rules as a ledger: measurements and failure bits once, policies and ablations as bit arithmetic."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import texts as tx

SYMBOLS = b"#*$%&|<>"

#: name, and when a row fails it, from its measurements.  A rule's place is its bit and never changes.
RULES = (
    ("few_words", lambda m: m["n_words"] < 10),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    ("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    ("capitals", lambda m: (m["n_letters"] >= 20) & (2 * m["n_upper"] > m["n_letters"])),
    ("exclamations", lambda m: 5 * m["n_exclaims"] > m["n_words"]),
    ("long_words", lambda m: m["word_chars"] > 25 * m["n_words"]),
    ("no_letters", lambda m: 2 * (m["n_letters"] + m["n_high"]) < m["word_chars"]),
    ("list_of_lines", lambda m: (m["n_lines"] >= 10) & (2 * m["n_words"] < 3 * m["n_lines"])),
)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_high", "n_exclaims",
)
BASE_RULES = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force: a row goes if it fails any of ``rules``."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


POLICIES = {
    "v1": Policy("v1", ("few_words", "repeated_words", "symbols", "repeated_lines")),
    "v2": Policy("v2", tuple(name for name, _ in RULES)),
}

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _measure(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    n = len(at) - 1
    w = tx.words(data, at)
    word_at = w.offsets[w.first]
    chars = tx.sums((w.data & 0xC0) != 0x80, word_at)
    upper = data - np.uint8(65) < 26
    letters = upper | (data - np.uint8(97) < 26)

    # lines: runs between line feeds, the first and last of a row bounded by the row
    feeds = np.flatnonzero(data == 10)
    per_row = tx.sums(data == 10, at) + 1
    row = np.repeat(np.arange(n), per_row)
    first = np.concatenate([[0], np.cumsum(per_row)])
    inner = np.ones(len(row), bool)
    inner[first[1:] - 1] = False
    end = np.repeat(at[1:], per_row)
    end[inner] = feeds
    begin = np.repeat(at[:-1], per_row)
    begin[1:][inner[:-1]] = feeds + 1
    solid = np.concatenate([[0], np.cumsum(~((data == 32) | (data - np.uint8(9) < 5)))])
    full = solid[end] > solid[begin]
    row, begin, end = row[full], begin[full], end[full]
    n_lines = np.bincount(row, minlength=n)
    if len(row):
        size = end - begin
        place = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)])[:-1], size)
        byte = data[np.repeat(begin, size) + place].astype(np.uint64) + np.uint64(1)
        cut = np.concatenate([[0], np.cumsum(size)])[:-1]
        line = tx.mix(np.add.reduceat(byte * tx.powers(int(size.max()) + 1)[place], cut))
        line = tx.mix(line + row.astype(np.uint64) * tx.BASE)
        kinds, which = np.unique(line, return_index=True)
        dup = n_lines - np.bincount(row[which], minlength=n)
    else:
        dup = np.zeros(n, np.int64)

    # windows of five words
    repeat = np.zeros(n, np.int64)
    h = w.hashes()
    if len(h) >= 5:
        win = h[:-4]
        for k in range(1, 5):
            win = win * tx.BASE + h[k : len(h) - 4 + k]
        word_row = w.rows
        inside = word_row[:-4] == word_row[4:]
        start = np.flatnonzero(inside)
        win = tx.mix(win[start] + word_row[start].astype(np.uint64) * tx.BASE)
        order = np.argsort(win)
        ranked = win[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(ranked), bool)
        twice[1:] |= same
        twice[:-1] |= same
        mark = np.zeros(len(h) + 5, np.int32)
        at_twice = start[order[twice]]
        np.add.at(mark, at_twice, 1)
        np.add.at(mark, at_twice + 5, -1)
        repeat = tx.sums(np.cumsum(mark)[: len(h)] > 0, w.first)
    return [
        w.counts, chars, tx.sums(_IS_SYMBOL[data], at), dup, repeat, n_lines, tx.sums(letters, at), tx.sums(upper, at),
        tx.sums(data >= 0xC0, at), tx.sums(data == 33, at),
    ]


def _measured(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a struct of all measurements under a name that no column has."""
    name = "measures"
    while name in docs.columns:
        name += "_"

    def run(batches):
        for batch, texts in tx.parts(batches, text_col):
            got = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in _measure(*tx.raw(texts))], names=MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, name])

    kinds = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kinds)])), name


def _failed(measures: Column) -> Column:
    bits = [F.when(rule(measures), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    return reduce(Column.bitwiseOR, bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, all measurements, and ``failed``, bit i set if RULES[i] fails.

    Every rule is evaluated once, in one pass without a shuffle.  A null text counts as empty: it
    has no words and fails ``few_words``.  Null and repeated ids, empty tables and extra columns
    need no care, since only the two columns are read and no row depends on another.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured, m = _measured(narrow, "text")
    return measured.select("doc_id", f"{m}.*", _failed(F.col(m)).alias("failed"))


def fails(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) != 0


def judge(led: DataFrame, policy: Policy) -> DataFrame:
    """``kept`` under a policy, and ``only_rule`` for rows that a single rule of it rejects (else null)."""
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask))
    only = F.coalesce(*(F.when(hit == (1 << i), F.lit(name)) for i, (name, _) in enumerate(RULES)))
    return led.withColumn("kept", ~fails(policy)).withColumn("only_rule", only)


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows it fails, rows only it rejects, and rows kept without it.

    Rows are first counted by their masked failure bits (at most 2^rules rows), so every ablation is
    bit arithmetic on those counts and the ledger is read once.
    """
    masks = led.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("mask")).agg(F.count("*").alias("n"))
    names = [name for name, _ in RULES]
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules))
    each = masks.select("mask", "n", F.explode(rules).alias("r")).select("mask", "n", "r.rule", "r.bit")
    without = F.col("mask").bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: Policy = POLICIES["v2"], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, with all their columns as they are, in one pass."""
    measured, m = _measured(docs, text_col)
    return measured.where(_failed(F.col(m)).bitwiseAND(F.lit(policy.mask)) == 0).drop(m)
