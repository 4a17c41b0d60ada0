"""Token ids in compressed files: written in id order, read back document by document (operator 2).

A file holds blocks of range_coder.py, then a zlib-compressed table of its documents and blocks, then that table's place.
Each block can be read alone; damaged blocks are reported, never returned.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_BYTES, no_null, partitions, row_slices
from tessera.llm.encoding import encoder
from tessera.llm.range_coder import BLOCK_IDS, decode_block, encode_block
from tessera.llm.shards import ShardFile, commit, manifest, open_shard

_TAIL = struct.Struct("<QII8s")
_MAGIC = b"TOKFILE1"


class _Writer:
    def __init__(self, folder: str, number: int, vocabulary: int):
        self.file, self.number, self.vocabulary = ShardFile(folder, TaskContext.get().partitionId(), number, ".tok"), number, vocabulary
        self.held, self.n_held, self.blocks, self.docs, self.known, self.counts, self.n = [], 0, [], [], [], [], 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(pc.fill_null(doc_ids, 0).to_numpy())
        self.known.append(doc_ids.is_valid().to_numpy(zero_copy_only=False))
        self.counts.append(counts)
        self.n += len(ids)
        while len(ids):
            part, ids = np.split(ids, [BLOCK_IDS - self.n_held])
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == BLOCK_IDS:
                self._block()

    def _block(self) -> None:
        data = encode_block(np.concatenate(self.held), self.vocabulary)
        self.blocks.append(len(data))
        self.file.write(data)
        self.held, self.n_held = [], 0

    def close(self) -> pa.RecordBatch:
        if self.n_held:
            self._block()
        docs, known, counts = np.concatenate(self.docs).astype("<i8"), np.concatenate(self.known), np.concatenate(self.counts).astype("<i8")
        table = zlib.compress(b"".join([struct.pack("<QQI", len(docs), len(self.blocks), self.vocabulary), docs.tobytes(), np.packbits(known).tobytes(), counts.tobytes(), np.array(self.blocks, "<i8").tobytes()]))
        at = self.file.bytes
        self.file.write(table)
        self.file.write(_TAIL.pack(at, len(table), zlib.crc32(table), _MAGIC))
        name = self.file.close()
        return pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int64()), "number": pa.array([self.number], pa.int64()), "file": [name], "docs": pa.array([len(docs)], pa.int64()), "ids": pa.array([self.n], pa.int64()), "bytes": pa.array([self.file.bytes], pa.int64())})


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", roll_ids: int = 1 << 28) -> DataFrame:
    """Encodes whole texts and writes files for each range of ids; returns the manifest (shard, number, file, docs, ids, bytes).

    A new file begins once one holds roll_ids ids. A very long text is encoded whole, by the task that holds it, and its ids
    are written in blocks like any other.

    Rows are sorted by id (nulls first); rows with equal ids keep no set order among them. Null texts are empty: their one id
    is end_id. An empty table writes no files. Ids must be integers. Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, number = encoder(tokenizer), None, 0
        size = enc.library.get_vocab_size(with_added_tokens=True)
        for b in row_slices(batches, "__text", 2 * SLICE_BYTES):
            out = out or _Writer(folder, number, max(size, end_id + 1))
            out.add(b.column(0), *enc.encode(b.column(1).to_pylist(), end_id))
            if out.n >= roll_ids:
                yield out.close()
                out, number = None, number + 1
        if out:
            yield out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), no_null(text_col).alias("__text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "__id").sortWithinPartitions("__id")
    return commit(rows.mapInArrow(write, "shard long, number long, file string, docs long, ids long, bytes long"), folder)


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of each document in the files: start counts the ids of all documents before it, ids holds little-endian unsigned 32-bit ids."""
    before = F.sum("ids").over(Window.orderBy("shard", "number").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    files = manifest(spark, folder).select("shard", "file", F.coalesce(before, F.lit(0)).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from _documents(folder, row["file"], row["first"], id_col)

    return files.repartition(partitions(spark), "shard", "number").mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids binary")


def _documents(folder: str, name: str, first: int, id_col: str) -> Iterator[pa.RecordBatch]:
    with open_shard(folder, name) as f:
        f.seek(f.size() - _TAIL.size)
        at, size, crc, magic = _TAIL.unpack(f.read(_TAIL.size))
        f.seek(at)
        table = f.read(size)
        if magic != _MAGIC or zlib.crc32(table) != crc:
            raise ValueError(f"{name} is damaged")
        table = zlib.decompress(table)
        n, blocks, vocabulary = struct.unpack_from("<QQI", table)
        place = 20
        docs = np.frombuffer(table, "<i8", n, place)
        place += 8 * n
        known = np.unpackbits(np.frombuffer(table, np.uint8, -(-n // 8), place), count=n).astype(bool)
        place += -(-n // 8)
        counts = np.frombuffer(table, "<i8", n, place)
        sizes = np.frombuffer(table, "<i8", blocks, place + 8 * n)
        f.seek(0)
        held, starts, done = np.zeros(0, np.uint32), first + np.cumsum(counts) - counts, 0
        for size in sizes:
            held = np.concatenate([held, decode_block(f.read(int(size)), vocabulary)])
            ends = np.cumsum(counts[done:])
            whole = int(np.searchsorted(ends, len(held), side="right"))
            if whole:
                used = int(ends[whole - 1])
                offsets = np.concatenate([[0], 4 * ends[:whole]]).astype(np.int32)
                part = slice(done, done + whole)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[part], mask=~known[part]), pa.array(starts[part]), pa.array(counts[part]), pa.Array.from_buffers(pa.binary(), whole, [None, pa.py_buffer(offsets), pa.py_buffer(held[:used].astype("<u4"))])],
                    [id_col, "start", "n_tokens", "ids"],
                )
                held, done = held[used:], done + whole
        if done != n:
            raise ValueError(f"{name} is not whole")
