"""Packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import texts as tx
from sievework.llm import tokens as tk
from sievework.sources.stage import staged

CAPACITY = 4096
#: Tokens and pieces of one island; both bound a task's memory.
ISLAND_TOKENS, ISLAND_PIECES = 4_000_000, 60_000
#: Bins each island sends on, and islands that meet on the next level.
MIGRANTS, MEET = 16, 64
POPULATION, GENERATIONS = 6, 12

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end_id: int, words_only: bool, capacity: int = CAPACITY, id_col="doc_id", text_col="text") -> DataFrame:
    """Every document's ids and the end id, cut into pieces of ``capacity`` ids (the last may be shorter)."""

    def run(batches):
        enc = tk.encoder(path, words_only)
        end = np.array([end_id], "<u4")
        for batch, texts in tx.parts(batches, "text", tk.BATCH_BYTES):
            ids, at = enc.ids(texts)
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for k, begin in enumerate(range(a, b + 1, capacity)):
                    part = ids[begin : min(begin + capacity, b)]
                    if begin + capacity > b:
                        part = np.concatenate([part, end])
                    rows.append((doc, k, begin - a, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


class Bins:
    """Partly filled bins, found by the least free room that suffices."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r is set if some bin has room r

    def add(self, items: list[int]) -> None:
        self.bins.append(items)
        self.free.append(self.capacity - sum(self.lengths[i] for i in items))
        self._offer(len(self.bins) - 1)

    def _offer(self, b: int) -> None:
        room = self.free[b]
        if room:
            self.by_room.setdefault(room, []).append(b)
            self.rooms |= 1 << room

    def best_fit(self, items) -> None:
        for i in items:
            n = self.lengths[i]
            fits = self.rooms >> n
            if not fits:
                self.add([i])
                continue
            room = n + (fits & -fits).bit_length() - 1
            here = self.by_room[room]
            b = here.pop()
            if not here:
                self.rooms &= ~(1 << room)
            self.bins[b].append(i)
            self.free[b] -= n
            self._offer(b)


def _fitness(s: Bins) -> tuple:
    return len(s.bins), -sum((s.capacity - f) ** 2 for f in s.free)


def crossover(a: Bins, b: Bins, rng: Random) -> Bins:
    """A child of ``a`` with whole well-filled bins of ``b``.

    Bins of ``a`` that share an item with the injected ones are dissolved, so no item comes twice,
    and what they leave behind is put back by best fit, longest first.
    """
    full = sorted(range(len(b.bins)), key=lambda k: b.free[k])
    pool = full[: max(1, len(full) // 2)]
    chosen = rng.sample(pool, max(1, len(pool) // 4))
    child = Bins(a.lengths, a.capacity)
    taken: set[int] = set()
    for k in chosen:
        child.add(list(b.bins[k]))
        taken.update(b.bins[k])
    displaced = []
    for items in a.bins:
        if taken.isdisjoint(items):
            child.add(list(items))
        else:
            displaced += [i for i in items if i not in taken]
    child.best_fit(sorted(displaced, key=lambda i: -a.lengths[i]))
    return child


def evolve(lengths: list[int], home: list[int] | None, capacity: int, seed: int) -> Bins:
    """The best packing found; ``home`` holds the bins that elite migrants bring along.

    The search ends where the number of bins reaches the sum of lengths over the capacity, rounded up.
    """
    rng = Random(seed)
    bound = -(-sum(lengths) // capacity)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    best = Bins(lengths, capacity)
    best.best_fit(order)
    if len(best.bins) <= bound:
        return best
    crowd = [best]
    if home:
        brought: dict[int, list[int]] = {}
        for i, h in enumerate(home):
            brought.setdefault(h, []).append(i)
        own = Bins(lengths, capacity)
        for items in brought.values():
            own.add(items)
        crowd.append(own)
    while len(crowd) < POPULATION:
        one = Bins(lengths, capacity)
        one.best_fit(sorted(order, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.25)))
        crowd.append(one)
    for _ in range(GENERATIONS):
        crowd.sort(key=_fitness)
        if len(crowd[0].bins) <= bound:
            break
        a, b = rng.sample(crowd[: POPULATION // 2 + 1], 2)
        child = crossover(a, b, rng)
        if _fitness(child) < _fitness(crowd[-1]):
            crowd[-1] = child
    return min(crowd, key=_fitness)


def _pack(capacity: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="island").sort_values(["length", "doc_id", "piece", "ids_crc32", "home"], ascending=False, kind="stable", ignore_index=True)
        lengths = rows["length"].tolist()
        homes = rows["home"].tolist()
        found = evolve(lengths, homes if homes[0] >= 0 else None, capacity, int(key[0]))
        worst = sorted(range(len(found.bins)), key=lambda b: -found.free[b])[:MIGRANTS]
        goes = set() if last else {b for b in worst if found.free[b]}
        bins, offsets = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        away = np.zeros(len(rows), bool)
        for b, items in enumerate(found.bins):
            at = 0
            for i in items:
                bins[i], offsets[i], away[i] = b, at, b in goes
                at += lengths[i]
        return rows.assign(home=bins + int(key[0]) * (1 << 24), offset=offsets, away=away)

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset`` there.

    A piece that fills a sequence is one by itself.  The rest is dealt evenly over islands, each small
    enough for a task, and every island evolves a packing.  Its least filled bins then migrate: 64
    islands meet as one, whose first parent is the packing the migrants bring, until one is left.  So at the
    end about one bin in all, not one per island, is poorly filled.  An island returns at most 16 bins,
    so islands of the next level are small too.
    """
    narrow = parts.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("row"))
    whole = narrow.where(F.col("length") >= capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = narrow.where(F.col("length") < capacity)
    tokens, rows = rest.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    islands = max(1, -(-tokens // ISLAND_TOKENS), -(-rows // ISLAND_PIECES))
    kinds = f"{PIECE}, home long, offset long, away boolean"
    todo = rest.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.lit(-1).cast("long").alias("home"),
        F.pmod(F.xxhash64("row", "ids_crc32"), F.lit(islands)).alias("island"),
    )
    done, level = whole, 0
    while True:
        last = islands == 1
        got = todo.groupBy("island").applyInPandas(_pack(capacity, last), kinds)
        got = staged(got)
        stay = got.where(~F.col("away"))
        done = done.unionByName(
            stay.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("home") + F.lit(level << 56)).alias("sequence_id"), "offset")
        )
        if last:
            return done
        todo = got.where("away").select(
            "doc_id", "piece", "start", "length", "ids_crc32", "home", F.expr(f"(home div {1 << 24}) div {MEET}").alias("island")
        )
        islands, level = -(-islands // MEET), level + 1


def packed_documents(
    docs: DataFrame, path: str, end_id: int = 1, words_only: bool = True, capacity: int = CAPACITY, id_col="doc_id", text_col="text"
) -> DataFrame:
    """All documents encoded, cut and packed.

    Null and empty texts are the end id alone.  Rows with equal or null ids are documents of their
    own.  An empty table gives no rows.  Only the id and the text are read.
    """
    return pack(staged(pieces(docs, path, end_id, words_only, capacity, id_col, text_col)), capacity)
