"""Vectorised helpers on Arrow text columns, used inside tasks.

A word is a run of characters other than blank, tab and the line breaks 0x09-0x0D, so words can be
found on the UTF-8 bytes.  Every helper works on whole texts; batches are cut between rows only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The C library's call that gives freed memory back, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Multiplier of the polynomial hash of a word's bytes (2^64 / golden ratio, odd).
BASE = np.uint64(0x9E3779B97F4A7C15)


def parts(batches, column: str = "text", limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The rows of ``batches`` in runs of about ``limit`` text bytes, with the text column (null: empty).

    A row is never cut, so a text longer than the limit comes alone.
    """
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_binary())
        if not len(texts):
            continue
        size = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), texts.slice(at, end - at)
            at = end
    batch = texts = size = None
    release()  # a worker that waits for its next task holds no more than it needs


def release() -> None:
    """Gives freed memory back to the system: that of Arrow's pool, and that which the C library keeps of numpy's arrays."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary column and where each row starts (one more for the end)."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


@dataclass
class Words:
    data: np.ndarray  # the words' bytes without what separates them
    offsets: np.ndarray  # of each word in data, and the end
    counts: np.ndarray  # words of each row

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def first(self) -> np.ndarray:
        """The first word of each row, and the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def array(self) -> pa.Array:
        return binary(self.data, self.offsets)

    def hashes(self) -> np.ndarray:
        """64 bits for each word."""
        if len(self.offsets) < 2:
            return np.zeros(0, np.uint64)
        return mix(poly(self.data, self.offsets))


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    keep = ~((data == 32) | (data - np.uint8(9) < 5))
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    start[heads] = keep[heads]
    begins = np.flatnonzero(start)
    before = np.cumsum(keep) - 1
    offsets = np.append(before[begins], before[-1] + 1 if len(before) else 0)
    return Words(data[keep], offsets, np.diff(np.searchsorted(begins, at)))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * n, BASE)))
    return _powers


def poly(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Polynomial of the bytes of each non-empty run data[offsets[i]:offsets[i+1]], modulo 2^64."""
    size = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    return np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers(int(size.max()) + 1)[place], offsets[:-1])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for each row, empty ones too."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``width`` words and how many each row has.

    A row with fewer words has its whole sequence as its only one; a row without words has none.
    """
    first = np.concatenate([[0], np.cumsum(counts)])
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    row = np.repeat(np.arange(len(counts)), n)
    start = first[row] + np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    out = np.zeros(len(row), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            here = k < counts[row]
            at = np.minimum(start + k, len(hashes) - 1)
            out = out * BASE + np.where(here, hashes[at], np.uint64(0)) if len(hashes) else out
        # the length keeps a short sequence apart from a longer one
        out = mix(out + np.minimum(counts[row], width).astype(np.uint64))
    return out, n
