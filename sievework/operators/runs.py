"""Runs of characters of many texts at once, by their hashes.

A literal is looked for through one run of it, as long as the largest of SIZES that fits.  So most short literals are
looked for as a whole, and a text has no more than len(SIZES) runs for each of its characters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SIZES = (3, 4, 5, 6, 8, 10, 12, 16, 20, 24)
#: Characters looked at together; longer texts are cut, with so much overlap that no run is lost.
BLOCK = 1 << 17
#: How the hash of a run comes from those of its parts.
_PARTS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 8: (4, 4), 10: (8, 2), 12: (8, 4), 16: (8, 8), 20: (16, 4), 24: (16, 8)}
_BASE = 0x9E3779B97F4A7C15
_POWERS = {n: np.uint64(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4, 8)}
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _hashes(codes: np.ndarray) -> dict[int, np.ndarray]:
    """For each size the hash of the run that starts at each place."""
    out = {1: codes}
    for size, (head, tail) in _PARTS.items():
        n = max(0, len(codes) - size + 1)
        out[size] = out[head][:n] * _POWERS[tail] + out[tail][head : head + n]
    return out


def _mixed(values: np.ndarray, size: int) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX + np.uint64(size)
    values = (values ^ (values >> np.uint64(29))) * _MIX
    return values ^ (values >> np.uint64(32))


def _pieces(texts: Sequence[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Some texts together, the number of the text each character is of, and how many it has from there."""
    some: list[str] = []
    owners: list[int] = []
    held = 0

    def piece() -> tuple[str, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in some], dtype=np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        return "".join(some), np.repeat(np.array(owners, dtype=np.int64), sizes), ends - np.arange(len(ends))

    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text)), BLOCK):
            part = text if len(text) <= BLOCK else text[start : start + BLOCK + SIZES[-1] - 1]
            some.append(part)
            owners.append(i)
            held += len(part)
            if held >= BLOCK:
                yield piece()
                some, owners, held = [], [], 0
    if some:
        yield piece()


def runs(texts: Sequence[str], sizes: Sequence[int] = SIZES, only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, hash) of every run; with ``only`` those of the one size given for each text."""
    for text, owner, left in _pieces(texts):
        hashes = _hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
        for size in sizes:
            values = hashes[size]
            fits = left[: len(values)] >= size
            if only is not None:
                fits &= only[owner[: len(values)]] == size
            at = np.flatnonzero(fits)
            if len(at):
                yield owner[at], _mixed(values[at], size)


def once(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, hash) once."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    return owner[new], keys[new]


def shares(texts: Sequence[str], sizes: Sequence[int] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs in ascending order, and the share of the texts that hold each."""
    found = [once(*pair) for pair in _joined(texts, sizes)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0)
    keys, counts = np.unique(np.concatenate([k for _, k in found]), return_counts=True)
    return keys, counts / len(texts)


def _joined(texts: Sequence[str], sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``runs`` of all texts for one size after the other, so that a text in parts has its runs together."""
    for size in sizes:
        parts = list(runs(texts, (size,)))
        if parts:
            yield np.concatenate([o for o, _ in parts]), np.concatenate([k for _, k in parts])


def rarest(texts: Sequence[str], known: tuple[np.ndarray, np.ndarray], sizes: Sequence[int] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """For each text of the least size or more its key, the run that the fewest known texts hold, and their share."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    only = np.array(sizes)[np.searchsorted(sizes, lengths, side="right") - 1]
    parts = list(runs(texts, sizes, only))
    owner, keys = np.concatenate([o for o, _ in parts]), np.concatenate([k for _, k in parts])
    hashes, held = known
    at = np.minimum(np.searchsorted(hashes, keys), max(0, len(hashes) - 1))
    share = np.where(hashes[at] == keys, held[at], 0.0) if len(hashes) else np.zeros(len(keys))
    order = np.lexsort((keys, share, owner))
    first = order[np.searchsorted(owner[order], np.arange(len(texts)))]
    return keys[first], share[first]


def places(keys: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a filter that stand for a hash."""
    return keys & np.uint64(mask), (keys >> np.uint64(32)) & np.uint64(mask)


def maybe(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether a filter may have a hash."""
    out = np.ones(len(keys), dtype=bool)
    for place in places(keys, 8 * len(bits) - 1):
        out &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
