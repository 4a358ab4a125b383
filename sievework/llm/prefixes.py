"""The trie of conversation starts, from sorted neighbours and union-find.

A conversation is the sequence of its turns' digests, 16 bytes each, so sorted sequences bring equal
starts together.  Neighbours are joined in descending length of their common prefix: every merge of two
components makes a branching node of that depth.  This is done for each range of the sorted
order.  Only nodes that the neighbour across a boundary shares, the prefixes of a range's first and
last sequence, stay open; these few are contracted to one row each and merged by their prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.stage import staged

#: Bytes of a turn's digest; ids that are written as one text; sequences and their bytes of one range.
TURN, BLOCK, RANGE_ROWS, RANGE_BYTES = 16, 65_536, 20_000, 16_000_000

_NO_ENDS = hashlib.sha256().hexdigest()


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id`` and ``turns``, an array of (key, size) in the order of turns.

    The key is a digest of role and text, the size the text's code points; null role and text are empty.
    A null turn comes first; turns of one number come in the order of their keys.  Rows without a
    conversation's id belong to none.  The turns of one conversation meet in one row, about 20 bytes each.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    digest = F.substring(F.sha2(body, 256), 1, 2 * TURN)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), digest.alias("key"), F.length(text).alias("size")).alias("item"),
    )
    ordered = F.transform(F.sort_array(F.collect_list("item")), lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def with_shared_starts(found: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Each conversation after a start taken from the first of its hundred.

    The first h turns come from conversation ``conv_id - conv_id % every`` (all if it has fewer, none if there is none),
    the others are the own ones after the first h, with h = crc32(id) % (most + 1).
    """
    source, h = F.col("conv_id") - F.col("conv_id") % every, F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    start = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("source"), F.slice("turns", 1, most).alias("start"))
    both = found.select("conv_id", "turns", source.alias("source"), h.cast("int").alias("h")).join(start, "source", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    taken = F.coalesce(F.slice("start", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(taken, own).alias("turns"))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads blocks of ids sorted by sequence and id; one row for each sequence, its ids hashed as they pass."""
    at, row, sha = None, None, None
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("seq", "sizes", "n", "least", "ids")]
        for seq, sizes, n, least, ids in zip(*columns, strict=True):
            if seq != at:
                if at is not None:
                    out.append((at, *row, sha.hexdigest()))
                at, row, sha = seq, [sizes, n, least], hashlib.sha256(ids.encode())
            else:
                row[1] += n
                row[2] = min(row[2], least)
                sha.update(b"," + ids.encode())
        yield _class_rows(out)
    if at is not None:
        yield _class_rows([(at, *row, sha.hexdigest())])


_CLASS = pa.schema([("seq", pa.binary()), ("sizes", pa.list_(pa.int32())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])


def _class_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_CLASS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CLASS, strict=True)], schema=_CLASS)


def _common(a: bytes, b: bytes) -> int:
    """Turns that both sequences start with."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[: TURN * middle] == b[: TURN * middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Forest:
    """The trie of sorted, distinct sequences; a node stands for a branching or ending prefix and the plain ones above it."""

    def __init__(self, seqs: list[bytes]):
        m = len(seqs)
        self.depth = [len(s) // TURN for s in seqs]
        self.first = list(range(m))
        self.parent = [-1] * m
        self.children = [0] * m
        links = [_common(a, b) for a, b in zip(seqs, seqs[1:], strict=False)]
        leader, top = list(range(m)), list(range(m))

        def find(x: int) -> int:
            while leader[x] != x:
                leader[x] = leader[leader[x]]
                x = leader[x]
            return x

        size = [1] * m
        for i in sorted(range(m - 1), key=lambda i: -links[i]):  # equal depths from left to right
            left, right = find(i), find(i + 1)
            node, other = top[left], top[right]
            if self.depth[node] > links[i]:  # else the left one ends or branches here already
                self.depth.append(links[i])
                self.first.append(self.first[node])
                self.parent.append(-1)
                self.children.append(1)
                self.parent[node] = node = len(self.depth) - 1
            self.parent[other] = node
            self.children[node] += 1
            if size[left] < size[right]:
                left, right = right, left
            leader[right] = left
            size[left] += size[right]
            top[left] = node


_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, size long, key binary, parent_key binary, boundary long"
)
_NODE_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("size", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("boundary", pa.int64())]
)


def _key(seq: bytes, depth: int) -> bytes:
    return hashlib.blake2b(seq[: TURN * depth], digest_size=16).digest()


def _nodes(table: pa.Table) -> pa.Table:
    """All nodes of one range.  Open ones, which a neighbouring range shares, have a ``key`` and sums over closed nodes only."""
    if not len(table):
        return _NODE_ARROW.empty_table()
    table = table.sort_by("seq")
    seqs = table.column("seq").to_pylist()
    left, right, part = (table.column(c)[0].as_py() for c in ("left", "right", "part"))
    tree = Forest(seqs)
    depth, first, parent = np.array(tree.depth), np.array(tree.first), np.array(tree.parent)
    sizes = table.column("sizes").combine_chunks()
    flat, start = sizes.flatten().to_numpy().astype(np.int64), sizes.offsets.to_numpy() - sizes.offsets[0].as_py()
    total = np.concatenate([[0], np.cumsum(flat)])

    n, least = np.zeros(len(depth), np.int64), np.full(len(depth), np.iinfo(np.int64).max)
    n[: len(seqs)], least[: len(seqs)] = table.column("n").to_numpy(), table.column("least").to_numpy()
    # as deep as a node's prefixes are shared across a boundary
    last = np.zeros(len(depth), bool)
    at = len(seqs) - 1
    while at >= 0:
        last[at], at = True, tree.parent[at]
    shared = np.maximum(np.where(first == 0, left, -1), np.where(last, right, -1))
    shared = np.minimum(shared, depth)
    above = np.where(parent >= 0, depth[parent], -1)  # the plain prefixes above a node belong to it
    closed_from = np.maximum(above, shared) + 1
    leaves = ((np.array(tree.children) == 0) & (closed_from <= depth)).astype(np.int64)
    closed_children = np.zeros(len(depth), np.int64)  # of the node's own depth
    below = np.zeros(len(depth), np.int64)  # saved by closed nodes under it
    for t in np.argsort(-depth, kind="stable").tolist():
        p = tree.parent[t]
        if p < 0:
            continue
        n[p] += n[t]
        least[p] = min(least[p], least[t])
        leaves[p] += leaves[t]
        closed_children[p] += closed_from[t] == above[t] + 1
        base = start[first[t]]
        own = total[base + depth[t]] - total[base + max(closed_from[t] - 1, 0)] if closed_from[t] <= depth[t] else 0
        below[p] += below[t] + (n[t] - 1) * own

    count = depth - above
    node = np.repeat(np.arange(len(depth)), count)
    d = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + above[node] + 1
    deepest = d == depth[node]
    is_open = d <= shared[node]
    base = start[first[node]]
    size = np.where(d > 0, total[base + d] - total[base + np.maximum(d - 1, 0)], 0)
    from_here = np.maximum(d, closed_from[node])  # closed depths of the node's own run from here down
    saved = below[node] + (n[node] - 1) * np.maximum(total[base + depth[node]] - total[base + np.maximum(from_here - 1, 0)], 0)
    inner = np.where(is_open, closed_from[node] == d + 1, True).astype(np.int64)  # the next plain prefix, if it is closed
    children = np.where(deepest, np.where(is_open, closed_children[node], np.array(tree.children)[node]), inner)
    top = d == above[node] + 1
    up = np.where(top, np.where(parent[node] >= 0, parent[node], node), node)
    parent_open = (d > 0) & (d - 1 <= shared[up])
    ends = np.array([*table.column("ends").to_pylist(), *[None] * (len(depth) - len(seqs))], object)
    ends = np.where(deepest, ends[node], None)

    rows = range(len(node))
    keys = [_key(seqs[first[node[i]]], int(d[i])) if is_open[i] else None for i in rows]
    parent_keys = [_key(seqs[first[node[i]]], int(d[i]) - 1) if parent_open[i] else None for i in rows]
    boundary = np.where(is_open & last[node] & (d <= right), part, -1)
    columns = [
        least[node], d, pa.array(least[up], mask=(d == 0) | parent_open), n[node], children, leaves[node], saved,
        pa.array(ends.tolist(), pa.string()), size, pa.array(keys, pa.binary()), pa.array(parent_keys, pa.binary()),
        pa.array(np.full(len(node), part), mask=boundary < 0),
    ]
    return pa.Table.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, _NODE_ARROW, strict=True)], schema=_NODE_ARROW)


def _shared_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns that the last sequence of a range has in common with the first of the next one."""
    for batch in batches:
        pairs = zip(batch.column("high").to_pylist(), batch.column("next").to_pylist(), strict=True)
        shared = pa.array([-1 if b is None else _common(a, b) for a, b in pairs], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("part"), shared], names=["part", "right"])


def _saved(n: str, size: str) -> Column:
    return (F.col(n) - 1) * F.col(size)


def prefix_trie(found: DataFrame) -> DataFrame:
    """The trie of the sequences of ``found`` (conv_id, turns): one row for each distinct start, the empty one included.

    conv_id is the least member, parent_conv_id its parent's; n_convs counts members, n_children children and
    n_leaves childless nodes in the subtree.  saved_tokens sums over the subtree the code points that copies of
    each node's last text repeat.  ends_sha256 is the digest of the sorted ids of members that end here, joined by commas.

    Conversations without turns end at the root.  Without conversations there is no root and no row.  Copies of
    one sequence meet as blocks of ids before anything else; only the digest of a hot sequence's ids, which
    SHA-256 takes in order, passes through one task as a stream.
    """
    rows = found.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["key"]), "")).alias("seq"),
        F.transform("turns", lambda x: x["size"]).alias("sizes"), F.floor(F.col("conv_id") / BLOCK).alias("block"),
    )
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = rows.groupBy("seq", "sizes", "block").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    classes = staged(blocks.repartition("seq").sortWithinPartitions("seq", "block").mapInArrow(
        _classes, "seq binary, sizes array<int>, n long, least long, ends string"
    ))

    amount = classes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("seq")), F.lit(0))).first()
    ranges = max(1, ceil(amount[0] / RANGE_ROWS), ceil(amount[1] / RANGE_BYTES))
    parts = staged(classes.repartitionByRange(ranges, "seq").withColumn("part", F.spark_partition_id()))
    by_part = Window.orderBy("part")  # one row for each range
    edges = parts.groupBy("part").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    edges = edges.select("part", "high", F.lead("low").over(by_part).alias("next")).mapInArrow(_shared_ends, "part int, right long")
    edges = edges.select("part", F.coalesce(F.lag("right").over(by_part), F.lit(-1)).alias("left"), "right")
    nodes = staged(parts.join(edges, "part").groupBy("part").applyInArrow(_nodes, _NODE))

    # open nodes, a few for each boundary: sums over the ranges that share them
    some = nodes.where("key IS NOT NULL")
    merged = some.groupBy("key", "depth", "parent_key", "size").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"), F.min("boundary").alias("home"),
    )
    merged = staged(merged)
    under = merged.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    # what open nodes save goes to all above them: along the boundary path where a node is at home
    path = some.where("boundary IS NOT NULL").select("key", "boundary", "depth")
    path = path.join(merged.select("key", "home", _saved("n_convs", "size").alias("own")), "key")
    down = Window.partitionBy("boundary").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("sum", F.sum(F.when(F.col("home") == F.col("boundary"), F.col("own")).otherwise(0)).over(down))
    path = path.groupBy("key").agg(F.sum("sum").alias("open_saved"))
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    opened = merged.join(under, "key", "left").join(path, "key").join(above, "parent_key", "left").select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs",
        (F.col("n_children") + F.coalesce("more", F.lit(0))).alias("n_children"), "n_leaves",
        (F.col("saved_tokens") + F.col("open_saved")).alias("saved_tokens"), "ends_sha256",
    )
    closed = nodes.where("key IS NULL")
    hung = closed.where("parent_key IS NOT NULL").join(above, "parent_key").withColumn("parent_conv_id", F.col("above"))
    every = closed.where("parent_key IS NULL").select(*result).union(hung.select(*result)).union(opened.select(*result))
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
