"""Token-id files: checksummed blocks of coded ids with the documents they belong to."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm import mixing
from sievework.llm import texts as tx
from sievework.llm import tokens as tk
from sievework.sources.stage import shared_folder, staged

#: A block: magic, ids, entries, bytes of the coded ids; then the entries; the coded ids; crc32 of all before.
_HEAD = struct.Struct("<4sIII")
_MAGIC = b"IDB3"
#: Pieces of texts that a worker remembers with their ids, about 150 bytes each.
REMEMBERED = 500_000
#: Text bytes whose pieces are looked up together: three times the usual, as larger batches repeat more.
BATCH_BYTES = 6_000_000
#: An entry is the part of one document that the block holds: the document's id and whether it has one, its number
#: and its first id's place in the file, its ids here, whether it begins here and whether it ends here.
_ENTRY = np.dtype(
    [("doc_id", "<i8"), ("has_id", "u1"), ("number", "<u8"), ("start", "<u8"), ("ids", "<u4"), ("begins", "u1"), ("ends", "u1")]
)


class BadBlock(ValueError):
    pass


def pack_block(entries: np.ndarray, count: int, coded: bytes) -> bytes:
    body = _HEAD.pack(_MAGIC, count, len(entries), len(coded)) + entries.tobytes() + coded
    return body + struct.pack("<I", zlib.crc32(body))


def open_block(data: bytes) -> tuple[np.ndarray, int, bytes]:
    """Entries, number of ids and coded ids of a block; anything amiss raises BadBlock."""
    if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise BadBlock("checksum of a block does not match")
    magic, count, n, size = _HEAD.unpack_from(data)
    at = _HEAD.size + n * _ENTRY.itemsize
    if magic != _MAGIC or at + size + 4 != len(data):
        raise BadBlock("not a block of this format")
    return np.frombuffer(data, _ENTRY, n, _HEAD.size), count, data[at:-4]


class _Stream:
    """The ids of one file on their way into blocks."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # id, first id's place, ids
        self.held = self.done = self.number = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.done + self.held, len(ids), self.number))
        self.number += 1
        self.ids.append(ids)
        self.held += len(ids)

    def blocks(self, last: bool) -> list[bytes]:
        """The whole blocks that the held ids fill, or all of them."""
        flat = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        end = len(flat) if last else len(flat) - len(flat) % mixing.BLOCK
        cuts = [flat[a : min(a + mixing.BLOCK, end)] for a in range(0, end, mixing.BLOCK)]
        coded = mixing.encode(cuts)
        entries: list[list[tuple]] = [[] for _ in cuts]
        keep = []
        for doc_id, start, n, number in self.docs:
            a, b = start - self.done, start - self.done + n
            for k in range(max(0, a) // mixing.BLOCK, -(-min(b, end) // mixing.BLOCK)):
                low, high = max(a, k * mixing.BLOCK), min(b, end, (k + 1) * mixing.BLOCK)
                if high > low:
                    entries[k].append((doc_id or 0, doc_id is not None, number, start, high - low, low == a, high == b))
            if b > end:
                keep.append((doc_id, start, n, number))
        self.docs, self.ids = keep, [flat[end:]]
        self.held, self.done = len(flat) - end, self.done + end
        return [pack_block(np.array(e, _ENTRY), len(c), z) for e, c, z in zip(entries, cuts, coded, strict=True)]


def _written(path: str, end_id: int):
    def run(batches):
        enc = tk.encoder(path, remembered=REMEMBERED)
        stream, number, part = _Stream(), 0, None
        end = np.array([end_id], np.uint32)

        def out(last):
            nonlocal number
            made = stream.blocks(last)
            for a in range(0, len(made), 512):
                some = made[a : a + 512]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(some), pa.int32()), pa.array(range(number, number + len(some)), pa.int64()), pa.array(some, pa.binary())],
                    names=["part", "block", "data"],
                )
                number += len(some)

        for batch, texts in tx.parts(batches, "text", BATCH_BYTES):
            part = batch.column("part")[0].as_py()
            ids, at = enc.ids(texts)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                stream.add(doc_id, np.concatenate([ids[a:b], end]))
            if stream.held >= mixing.LANES * mixing.BLOCK:
                yield from out(False)
        if part is not None:
            yield from out(True)

    return run


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every document, appends ``end_id``, and writes the ids in ascending id order.

    Documents are dealt by range of their id (and of a checksum and the place read, so that one id of very many
    rows spreads), sorted, encoded, and their ids cut into blocks of 1,024, each coded for itself.  ``folder`` holds
    one Parquet file of blocks per range; Spark's committer leaves only the files of finished tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.crc32(text.cast("binary")).alias("sum"), F.monotonically_increasing_id().alias("read"))
    order = ["doc_id", "sum", "read"]
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    dealt.mapInArrow(_written(path, end_id), "part int, block long, data binary").write.parquet(folder)


def _read(with_ids: bool):
    def pieces(rows):
        opened = [open_block(r[2]) for r in rows]
        ids = mixing.decode([z for _, _, z in opened], [n for _, n, _ in opened])
        for (part, block, _), (entries, _, _), got in zip(rows, opened, ids, strict=True):
            at = 0
            for e in entries:
                n = int(e["ids"])
                piece = got[at : at + n].tobytes()
                at += n
                doc = int(e["doc_id"]) if e["has_id"] else None
                yield (part, int(e["number"]), doc, int(e["start"]), block, n, zlib.crc32(piece), bool(e["begins"]), bool(e["ends"]), piece if with_ids else None)
            if at != len(got):
                raise BadBlock("entries and ids of a block differ")

    def table(rows):
        cols = list(zip(*pieces(rows), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _PIECE, strict=True)], schema=_PIECE)

    def run(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("part", "block", "data")), strict=True)
            while len(rows) >= mixing.LANES:
                yield table(rows[: mixing.LANES])
                rows = rows[mixing.LANES :]
        if rows:
            yield table(rows)

    return run


_PIECE = pa.schema(
    [("part", pa.int32()), ("number", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("block", pa.int64()), ("n", pa.int64()),
     ("crc", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("ids", pa.binary())]
)


def read_pieces(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The parts of documents that the blocks hold, decoded and checked; ``ids`` (little-endian, 32 bits) on demand."""
    kinds = "part int, number long, doc_id long, start long, block long, n long, crc long, begins boolean, ends boolean, ids binary"
    return spark.read.parquet(folder).select("part", "block", "data").mapInArrow(_read(with_ids), kinds)


def joined_crc(first: int, second: int, size: int) -> int:
    """crc32 of two runs of bytes from theirs; ``size`` is the second's."""
    zeros = bytes(size)
    return zlib.crc32(zeros, first) ^ zlib.crc32(zeros) ^ second


def _whole(batches):
    for batch in batches:
        crc, n = [], []
        for row in batch.column("parts").to_pylist():
            total, length = 0, 0
            for piece in sorted(row, key=lambda p: p["block"]):
                total = joined_crc(total, piece["crc"], 4 * piece["n"])
                length += piece["n"]
            crc.append(total)
            n.append(length)
        rest = [batch.column(c) for c in ("part", "doc_id", "start")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks are read in any order.  A document inside one block is whole at once; parts of others meet by (file, number)
    and their checksums are joined, so no ids are moved.
    """
    pieces = staged(read_pieces(spark, folder).drop("ids"))
    whole = pieces.where("begins AND ends").select("part", "doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    split = pieces.where("NOT (begins AND ends)").groupBy("part", "number").agg(
        F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.collect_list(F.struct("block", "crc", "n")).alias("parts")
    )
    split = split.drop("number").mapInArrow(_whole, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    shift = pieces.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return whole.union(split).join(F.broadcast(shift), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encoded_documents(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of ``docs`` to files in the shared folder and returns what the files say of each document.

    A null text counts as empty and is the end id alone.  Null ids come first; rows with equal ids are documents
    of their own, in the order of their checksums.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-ids")
    write_ids(docs, folder, path, end_id, id_col, text_col)
    return read_documents(spark, folder)
