"""Fill-in-the-middle texts, cut and put together by Arrow compute on list arrays.

A batch of texts becomes a list array of units.  It is flattened with the index of its list, each
unit gets its ordinal and from that its role (prefix, middle or suffix); the units of one role are
filtered, put back into lists, joined, and the joined pieces are assembled row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import texts as tx

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, how many stay plain and how many of the others put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Text bytes whose units are in memory at once; a longer text is cut by segments.
SEGMENT = 1_000_000

_EMPTY = pa.scalar(b"", pa.large_binary())


def _heads(data: np.ndarray, at: np.ndarray, unit: str) -> np.ndarray:
    """Where the units of all rows start: every code point, or every line with its line feed."""
    raw = pa.Array.from_buffers(pa.uint8(), len(data), [None, pa.py_buffer(data)])
    if unit == "character":  # a byte that continues none, or the first of a row
        head = pc.not_equal(pc.bit_wise_and(raw, pa.scalar(0xC0, pa.uint8())), pa.scalar(0x80, pa.uint8()))
        head = head.to_numpy(zero_copy_only=False).copy()
    else:
        head = np.zeros(len(data), bool)
        head[1:] = data[:-1] == 10
    head[at[:-1][at[:-1] < at[1:]]] = True
    return pc.indices_nonzero(pa.array(head)).to_numpy().astype(np.int64)


def _joined(counts: np.ndarray, items: pa.Array) -> pa.Array:
    """One joined piece for each run of ``counts`` items."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), items), _EMPTY)


def _pieces(units: pa.ListArray, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each list, whose first unit is number ``first`` of its text."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    start = units.offsets[:-1]
    ordinal = pc.add(pc.subtract(pa.array(np.arange(len(flat))), start.take(parent)), pa.array(first).take(parent))
    after_low = pc.greater_equal(ordinal, pa.array(low).take(parent))
    after_high = pc.greater_equal(ordinal, pa.array(high).take(parent))
    out = []
    for role in (pc.invert(after_low), pc.and_(after_low, pc.invert(after_high)), after_high):
        own = np.bincount(parent.filter(role).to_numpy(), minlength=len(units))
        out.append(_joined(own, flat.filter(role)))
    return out


def split_units(texts: pa.Array, draws: list[np.ndarray], unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]:
    """Units of each text, where prefix and middle end, and the three pieces.

    A text ends its prefix after the smaller of ``draw % (units + 1)`` of its two draws, its middle
    after the larger.  Texts longer than SEGMENT are cut between units and joined again, so that
    what is held beside the texts themselves does not grow with a text.
    """
    data, at = tx.raw(texts)
    heads = _heads(data, at, unit)
    first = np.searchsorted(heads, at)
    n = np.diff(first)
    ends = np.sort(np.stack([d % (n + 1) for d in draws]), axis=0)
    low, high = ends[0], ends[1]
    # segments: runs of units of one row, of about SEGMENT bytes at most
    edges = np.union1d(first, np.searchsorted(heads, np.arange(0, len(data), SEGMENT)))
    row = np.searchsorted(first, edges[:-1], "right") - 1
    cut = np.append(heads, len(data))
    parts: list[list[pa.Array]] = [[], [], []]
    group = 0
    while group < len(row):
        last = group + 1
        while last < len(row) and cut[edges[last + 1]] - cut[edges[group]] <= SEGMENT:
            last += 1
        a, b = edges[group], edges[last]
        flat = tx.binary(data[cut[a] : cut[b]], cut[a : b + 1] - cut[a])
        units = pa.ListArray.from_arrays(pa.array((edges[group : last + 1] - a).astype(np.int32)), flat)
        rows = row[group:last]
        for role, piece in zip(parts, _pieces(units, edges[group:last] - first[rows], low[rows], high[rows]), strict=True):
            role.append(piece)
        group = last
    of_row = np.bincount(row, minlength=len(n))
    return n, low, high, [_joined(of_row, pa.concat_arrays(p) if p else pa.array([], pa.large_binary())) for p in parts]


def _text(values: pa.Array) -> pa.Array:
    """Bytes as a text column, unchanged also where they are no valid UTF-8."""
    data, at = tx.raw(values)
    return pa.Array.from_buffers(pa.string(), len(values), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _transform(unit: str):
    def run(batches):
        for batch, texts in tx.parts(batches, limit=SEGMENT):
            cut = batch.column("cut")
            rest = texts.filter(pc.invert(cut))
            chosen = batch.filter(cut)
            n, low, high, (prefix, middle, suffix) = split_units(
                texts.filter(cut), [chosen.column(c).to_numpy() for c in ("draw_1", "draw_2")], unit
            )
            marks = [pa.scalar(m.encode(), pa.large_binary()) for m in (PREFIX, SUFFIX, MIDDLE)]
            psm = pc.binary_join_element_wise(marks[0], prefix, marks[1], suffix, marks[2], middle, _EMPTY)
            spm = pc.binary_join_element_wise(marks[1], suffix, marks[0], prefix, marks[2], middle, _EMPTY)
            output = pc.if_else(chosen.column("suffix_first"), spm, psm)
            data, at = tx.raw(rest)
            n_rest = np.diff(np.searchsorted(_heads(data, at, unit), at))
            # rows that are cut come first, then the plain ones
            nulls = pa.nulls(len(rest), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([chosen.column("doc_id"), batch.column("doc_id").filter(pc.invert(cut))]),
                    pa.array(np.concatenate([n, n_rest]).astype(np.int64)),
                    pa.array(["spm" if s else "psm" for s in chosen.column("suffix_first").to_pylist()] + ["plain"] * len(rest)),
                    pa.concat_arrays([pa.array(low.astype(np.int64)), nulls]),
                    pa.concat_arrays([pa.array((high - low).astype(np.int64)), nulls]),
                    _text(pa.concat_arrays([output, rest])),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(docs: DataFrame, unit: str = "character", salt: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as a fill-in-the-middle text: doc_id, n, form, prefix_chars, middle_chars, output.

    The first four groups of eight hex digits of sha256 of ``salt:id`` decide: two are the cuts,
    one whether the text stays plain, one the order of the pieces; so a repeated run gives the same rows.
    Lengths are in units.  Texts that are empty or hold a mark already stay plain.  A null text is
    empty, a null id hashes as no digits.  Repeated rows are rows like others, an empty table gives no
    rows, other columns are not read.  Bytes that are no valid UTF-8 stay as they are; a byte that
    continues nothing belongs to the character before it.  Nothing is shuffled.
    """
    if unit not in ("character", "line"):
        raise ValueError(f"unit {unit!r} is neither character nor line")
    text, key = F.col(text_col), F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring("key", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    drawn = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), key.alias("key")).select(
        "doc_id", "text", draw[0].alias("draw_1"), draw[1].alias("draw_2"),
        ((F.octet_length("text") > 0) & ~marked & (draw[2] % 100 < 100 - PLAIN)).alias("cut"),
        (draw[3] % 100 < SUFFIX_FIRST).alias("suffix_first"),
    )
    return drawn.mapInArrow(_transform(unit), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made of; marks are found once each, since texts with marks stay plain."""

    def between(left: str | None, right: str | None) -> Column:
        piece = F.substring_index(output, right, 1) if right else output
        return F.substring_index(piece, left, -1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
