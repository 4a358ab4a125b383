"""Adaptive context-mixing range coder for token ids; many blocks are coded side by side.

Each id is predicted from the last two (order 2), the last (order 1) and by its bit length alone (order 0).  The
order-2 and order-1 tables hold the id that followed a context, how often it did in a row, and a check that
tells contexts of one slot apart.  A binary decision says whether the candidate (order 2's, else order 1's) is
right; its probability mixes, in the logistic domain and with weights that learn, what all orders say.  An id not
predicted so is coded by its class (bit length and the two bits below the first), with adaptive frequencies, and
its remaining bits.  Decisions and classes are counted in a block's first 256 steps and learnt from at three of
them; context tables learn at every step.  An id's decision, class and bits narrow the range before digits are moved
once.  All arithmetic is on integers (quotients of integers below 2^48 by doubles, whose floor is exact), so a file
can be read on any machine.  Nothing passes from one block to the next.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import cache

import numpy as np

#: Ids of a block, slots of a context table.
BLOCK, SLOTS = 1024, 1024
#: Blocks coded side by side; bounds a task's memory.
LANES = 8192
#: Classes of ids below 2^17: 0 to 7 for themselves, then four for each bit length.
CLASSES = 64
#: Steps before which mixer and class frequencies are renewed from the counts so far; in longer runs every _RENEW steps too.
_EARLY, _RENEW = (16, 64, 256), 2048
#: Range coder: bits of its window, of a digit, and of the share of one class.
_WINDOW, _DIGIT, _SHARE = 48, 16, 10
_ONE = np.int64(1)
_FLOOR = _ONE << (_WINDOW - _DIGIT)
_KEEP = np.array([(1 << 63) - 1, (1 << (_WINDOW - _DIGIT)) - 1], np.int64)
#: In place of a digit.
_EMPTY = np.uint32(1 << 31)
#: Mixer: weight of an input at the start (16,384 is 1), rate of weights, least probability of 4096, trust in the first ones.
_WEIGHT, _LEARN, _LEAST, _TRUST = (12288, 8192, 8192), 9, 16, 4
#: An entry of a context table: check (10 bits), id (17 bits), times in a row (4 bits, from 1); a larger one is none.
_CHECK, _NONE = np.uint32(1023 << 21), np.uint32(1 << 21)
#: Where 0 stands in the table of sums of inputs.
_MIDDLE = 8192
#: Multipliers of the last id and of the one before in the hash of a context.
_LAST, _BEFORE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


@cache
def _tables() -> tuple[np.ndarray, ...]:
    """squash: logistic of x/256 in 1/4096; stretch: its inverse; class of every id; first id and bits of every class."""
    with localcontext() as c:
        c.prec = 30
        plain = [round(Decimal(4096) / (1 + (Decimal(-x) / 256).exp())) for x in range(-2048, 2048)]
    stretch = np.clip(np.searchsorted(np.array(plain, np.int64), np.arange(4096)) - 2048, -2047, 2047)
    sums = np.arange(2 * _MIDDLE) - _MIDDLE  # of three inputs
    squash = np.clip(np.array(plain, np.int64).take(np.clip(sums, -2048, 2047) + 2048), _LEAST, 4096 - _LEAST)
    first, bits = [*range(8)], [0] * 8
    for length in range(4, 18):
        first += [(4 + k) << (length - 3) for k in range(4)]
        bits += [length - 3] * 4
    first, bits = np.array(first, np.int64), np.array(bits, np.int64)
    kind = np.repeat(np.arange(CLASSES, dtype=np.uint8), _ONE << bits)
    return squash, stretch, kind, first, bits


class Writer:
    """The range coder's output, ``ids`` with a column for each block; a digit's carry is its 17th bit until all is settled."""

    def __init__(self, ids: np.ndarray):
        lanes = ids.shape[1]
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, (1 << _WINDOW) - 1, np.int64)
        #: Two rows of digits for each step (an id takes 31 bits at most) and the last ones; _EMPTY where none is moved.
        self.out = np.empty((2 * len(ids) + _WINDOW // _DIGIT, lanes), np.uint32)
        self.row, self.ids = 0, ids

    def is_id(self, lane: np.ndarray, step: int, p: np.ndarray, guess: np.ndarray) -> np.ndarray:
        """Codes whether the id is ``guess``, of probability p/4096."""
        right = self.ids[step].take(lane) == guess
        whole = self.range.take(lane)
        part = (whole >> 12) * p
        self.low[lane] += part * ~right
        self.range[lane] = np.where(right, part, whole - part)
        return right

    def symbol(self, step: int, n: int, order: _Classes, known: np.ndarray) -> np.ndarray:
        """Codes the ids that are not ``known`` by their classes and the bits below; returns the ids."""
        value = self.ids[step, :n]
        got = _tables()[2].take(value)
        start, size, bits = order.share(got, known)
        whole = self.range[:n]
        whole >>= _SHARE
        start *= whole
        whole *= size
        whole >>= bits
        below = value - _tables()[3].take(got)
        below *= ~known
        below *= whole
        start += below
        self.low[:n] += start
        return value

    def settle(self, n: int) -> None:
        """Moves out the digits that no later id can change but by a carry."""
        low, whole, row = self.low[:n], self.range[:n], self.out[self.row]
        row[n:] = _EMPTY
        row[:n] = low >> (_WINDOW - _DIGIT)
        kept = whole >= _FLOOR
        row[:n] |= kept.view(np.uint8) * _EMPTY
        small = (~kept).view(np.uint8)
        low &= _KEEP.take(small)
        small = small << np.int64(4)
        low <<= small
        whole <<= small
        row = self.out[self.row + 1]
        row[:] = _EMPTY
        more = np.flatnonzero(whole < _FLOOR)
        if len(more):
            rest = low.take(more)
            row[more] = rest >> (_WINDOW - _DIGIT)
            low[more] = (rest & (_FLOOR - 1)) << _DIGIT
            whole[more] <<= _DIGIT
        self.row += 2

    def finish(self) -> list[np.ndarray]:
        for _ in range(_WINDOW // _DIGIT):
            self.out[self.row] = self.low >> (_WINDOW - _DIGIT)
            self.low = (self.low & (_FLOOR - 1)) << _DIGIT
            self.row += 1
        words = []
        for a in range(0, len(self.low), 256):
            some = np.ascontiguousarray(self.out[:, a : a + 256].T)
            full = some < _EMPTY
            n = np.count_nonzero(full, axis=1)
            flat = some[full]
            while len(at := np.flatnonzero(flat >> _DIGIT)):  # never a block's first digit
                flat[at] &= (1 << _DIGIT) - 1
                flat[at - 1] += 1
            words += np.split(flat.astype("<u2"), np.cumsum(n)[:-1])
        return words


class Reader:
    """The range coder's input."""

    def __init__(self, coded: list[np.ndarray]):
        lanes, width = len(coded), max(len(c) for c in coded) + 4
        words = np.empty((lanes, width), np.uint16)
        words[:] = 0
        for i, c in enumerate(coded):
            words[i, : len(c)] = c
        self.words, self.at = words.reshape(-1), np.arange(lanes) * width + 3
        first = words[:, :3].astype(np.int64)
        self.code = (first[:, 0] << 32) | (first[:, 1] << 16) | first[:, 2]
        self.range = np.full(lanes, (1 << _WINDOW) - 1, np.int64)

    def is_id(self, lane: np.ndarray, step: int, p: np.ndarray, guess: np.ndarray) -> np.ndarray:
        whole, code = self.range.take(lane), self.code.take(lane)
        part = (whole >> 12) * p
        right = code < part
        self.code[lane] = code - part * ~right
        self.range[lane] = np.where(right, part, whole - part)
        return right

    def symbol(self, step: int, n: int, order: _Classes, known: np.ndarray) -> np.ndarray:
        whole, code = self.range[:n], self.code[:n]
        whole >>= _SHARE
        share = (code / whole).astype(np.int64)
        np.minimum(share, (1 << _SHARE) - 1, out=share)
        got = order.whose(share)
        start, size, bits = order.share(got, known)
        start *= whole
        code -= start
        whole *= size
        whole >>= bits
        value = (code / whole).astype(np.int64)
        np.minimum(value, (_ONE << bits) - 1, out=value)
        code -= value * ~known * whole
        value += _tables()[3].take(got)
        return value

    def settle(self, n: int) -> None:
        more = np.flatnonzero(self.range[:n] < _FLOOR)
        while len(more):
            at = self.at.take(more)
            self.code[more] = (self.code.take(more) << _DIGIT) | self.words.take(at, mode="clip")
            self.at[more] = at + 1
            whole = self.range.take(more) << _DIGIT
            self.range[more] = whole
            more = more[whole < _FLOOR]


class _Classes:
    """Order 0: each lane's shares of the classes, in 1/1024, renewed from counts now and then."""

    def __init__(self, lanes: int, look_up: bool):
        self.look_up, self.counts = look_up, True
        self.base, self.at = np.arange(lanes) * CLASSES, np.arange(lanes) << _SHARE
        self.seen = np.zeros(lanes * CLASSES, np.int32)
        self.renew(lanes)

    def renew(self, n: int) -> None:
        """Shares in proportion to the counts and one half, none below 1; the largest takes what is left over."""
        seen = 2 * self.seen[: n * CLASSES].reshape(n, CLASSES) + 1
        size = 1 + seen * ((1 << _SHARE) - CLASSES) // seen.sum(axis=1, keepdims=True)
        size[np.arange(n), seen.argmax(axis=1)] += (1 << _SHARE) - size.sum(axis=1)
        start = size.cumsum(axis=1, dtype=np.int32) - size
        self.shares = (start << 15 | size << 4 | _tables()[4]).astype(np.int32).reshape(-1)
        if self.look_up:
            self.owner = np.repeat(np.tile(np.arange(CLASSES, dtype=np.uint8), n), size.reshape(-1))

    def share(self, got: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the shares of the classes that came start, how large they are and the bits below; counts the classes.

        A known id has no class: its share is all.
        """
        at = self.base[: len(got)] + got
        if self.counts:
            self.seen[at] = self.seen.take(at) + ~known
        both = self.shares.take(at)
        np.putmask(both, known, 1 << _SHARE + 4)
        both = both.astype(np.int64)
        return both >> 15, both >> 4 & 2047, both & 15

    def whose(self, share: np.ndarray) -> np.ndarray:
        """The class that holds a share."""
        share += self.at[: len(share)]
        return self.owner.take(share)


@cache
def _start() -> tuple[np.ndarray, ...]:
    """What each state of the three orders says at first, in 1/65536."""
    times = np.arange(16)
    agree, apart, alone = (65536 * times * a // (times * a + b) for a, b in ((3, 1), (1, 1), (1, 2)))
    against = 65536 // (times + 3)
    half = np.full(16, 1 << 15)
    for known in (agree, apart, alone, against):
        known[0] = 1 << 15
    return np.concatenate([apart, agree]), np.concatenate([against, agree, alone, half]), np.full(_LENGTHS, 1 << 15)


#: Bit lengths of candidates' entries.
_LENGTHS = 22


class _Mixer:
    """A binary decision per lane from what three orders say of it."""

    def __init__(self, lanes: int):
        self.first = _start()
        self.width = [len(f) for f in self.first]
        #: Decisions of each state (in steps of 65,536) and right ones; each weight and the sum of its input times the error.
        self.seen = [np.zeros(lanes * k, np.int32) for k in self.width]
        self.weight = [np.full(lanes, w, np.int64) for w in _WEIGHT]
        self.slope = [np.zeros(lanes, np.int32) for _ in _WEIGHT]
        self.says = [np.zeros(0, np.int16)] * 3
        self.renew(lanes)

    def renew(self, n: int) -> None:
        """Weights learn from the errors, states from what was right."""
        stretch = _tables()[1]
        for k, (first, width) in enumerate(zip(self.first, self.width, strict=True)):
            self.weight[k] = weight = np.clip(self.weight[k][:n] + (self.slope[k][:n] >> _LEARN), 1024, 32768)
            self.slope[k][:] = 0
            seen = self.seen[k][: n * width].reshape(n, width)
            said = (first * _TRUST + ((seen & 0xFFFF).astype(np.int64) << 16)) // (_TRUST + (seen >> 16) << 4)
            x = stretch.take(np.minimum(said, 4095)).astype(np.int32)
            x *= weight[:, None].astype(np.int32)
            x >>= 14
            np.clip(x, -2047, 2047, out=x)
            if k == 2:
                x += _MIDDLE
            self.says[k] = x.astype(np.int16).reshape(-1)

    def predict(self, lane: np.ndarray, states: tuple[np.ndarray, ...]) -> np.ndarray:
        self.lane = lane
        self.at = [lane * width + state for state, width in zip(states, self.width, strict=True)]
        self.x = [says.take(at) for says, at in zip(self.says, self.at, strict=True)]
        total = self.x[0] + self.x[1]
        total += self.x[2]
        self.said = _tables()[0].take(total)
        return self.said

    def count(self, right: np.ndarray) -> None:
        miss = ((right * np.int32(4096) - self.said) >> 4).astype(np.int32)
        more = right + np.int32(65536)
        for k, (seen, at) in enumerate(zip(self.seen, self.at, strict=True)):
            seen[at] = seen.take(at) + more
            x = self.x[k] - np.int16(_MIDDLE) if k == 2 else self.x[k]
            self.slope[k][self.lane] += x * miss >> 4


def _follow(table: np.ndarray, at: np.ndarray, check: np.ndarray, entry: np.ndarray, new: np.ndarray) -> None:
    """Writes the contexts' entries after the ids of ``new`` came: the same id counts up, another one takes its place."""
    times = np.minimum(entry ^ new, np.uint32(16))  # the times in a row, where the ids are the same
    new = _TIMES.take(times) | new
    new |= check
    table[at] = new


_TIMES = np.array([1, *range(2, 16), 15, 1], np.uint32)


def _run(coder, sizes: np.ndarray) -> np.ndarray:
    """Codes or decodes all blocks, longest first, one id of each per step; a column of ids for each."""
    lanes, steps = len(sizes), int(sizes[0])
    ids = np.zeros((steps, lanes), np.uint32)
    # 16 slots in a line of memory: 8 of order 1 and 8 of order 2, picked by the last id, so both orders touch one line
    table = np.full(lanes * 2 * SLOTS, 0xFFFFFFFF, np.uint32)
    mixer, order = _Mixer(lanes), _Classes(lanes, isinstance(coder, Reader))
    last, before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)  # hashes
    base = np.arange(lanes) * (2 * SLOTS)
    left = np.searchsorted(-sizes, -np.arange(steps), "left")
    renewals = {k for k in range(1, min(steps, 1 << 15)) if k in _EARLY or k % _RENEW == 0}  # what a count can hold
    learns = max(renewals, default=0)
    line, slot, few = np.uint32(SLOTS // 8 - 1 << 4), np.uint32(7), np.uint32(15)
    for step in range(steps):
        n = int(left[step])
        if step in renewals:
            order.renew(n)
            mixer.renew(n)
        order.counts = step < learns
        h1 = last[:n]
        h2 = h1 + before[:n]
        near = ((h1 >> 7) & line) + base[:n]
        at1 = near + ((h1 >> 18) & slot)
        at2 = near + (((h2 >> 18) & slot) | 8)
        h2 &= _CHECK
        h1 = h1 & _CHECK
        e2, e1 = table.take(at2), table.take(at1)
        e2 ^= h2
        e1 ^= h1
        np.minimum(e2, _NONE, out=e2)
        np.minimum(e1, _NONE, out=e1)
        known = (e1 & 14) > 0  # came twice in a row
        known |= e2 < _NONE
        some = np.flatnonzero(known)
        if len(some):
            k2, k1 = e2.take(some), e1.take(some)
            guess = np.where(k2 < _NONE, k2, k1)
            length = (guess.astype(np.float32).view(np.int32) >> 23) - 127  # of the entry, as a float's exponent
            guess >>= 4
            same = ((k1 ^ k2) < 16).view(np.uint8) << 4
            s2, s1 = (k2 & few) | same, (k1 & few) | same
            s1 |= (k2 >> 16) & 32
            right = coder.is_id(some, step, mixer.predict(some, (s2, s1, length)), guess)
            if step < learns:
                mixer.count(right)
            known[some] = right
            got = ids[step, :n]
            got[:] = coder.symbol(step, n, order, known)
            hit = np.flatnonzero(right)
            got[some.take(hit)] = guess.take(hit)
        else:
            got = ids[step, :n]
            got[:] = coder.symbol(step, n, order, known)
        coder.settle(n)
        new = got << 4
        _follow(table, at2, h2, e2, new)
        _follow(table, at1, h1, e1, new)
        before[:n] = last[:n] * _BEFORE
        last[:n] = got * _LAST
    return ids


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's ids (below 2^17) as bytes of their own."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted((i for i in range(len(blocks)) if len(blocks[i])), key=lambda i: -len(blocks[i]))
    for a in range(0, len(order), LANES):
        some = order[a : a + LANES]
        sizes = np.array([len(blocks[i]) for i in some])
        ids = np.zeros((int(sizes[0]), len(some)), np.uint32)
        for b in range(0, len(some), 64):  # 64 columns at once: a line of memory is written whole
            few = np.zeros((64, len(ids)), np.uint32)
            for k, i in enumerate(some[b : b + 64]):
                few[k, : sizes[b + k]] = blocks[i]
            ids[:, b : b + 64] = few[: len(some) - b].T
        coder = Writer(ids)
        _run(coder, sizes)
        for i, words in zip(some, coder.finish(), strict=True):
            out[i] = words.tobytes()
    return out


def decode(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    out = [np.zeros(0, "<u4")] * len(coded)
    order = sorted((i for i in range(len(coded)) if sizes[i]), key=lambda i: -sizes[i])
    for a in range(0, len(order), LANES):
        some = order[a : a + LANES]
        ids = _run(Reader([np.frombuffer(coded[i], "<u2") for i in some]), np.array([sizes[i] for i in some]))
        for k in range(0, len(some), 64):
            strip = np.ascontiguousarray(ids[:, k : k + 64].T, "<u4")
            for i, got in zip(some[k : k + 64], strip, strict=True):
                out[i] = got[: sizes[i]].copy()
    return out
