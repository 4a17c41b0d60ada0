"""Packing by power-of-two decomposition (operator 4): no padding, and no sequence crosses documents."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import no_null, row_slices
from tessera.llm.encoding import encoder

#: A shard's sequence ids begin at its number times this.
SHARD = 1 << 40


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as a sum: as many times the longest power of two as it holds, then the powers in the binary form of what is left."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_binary(docs: DataFrame, tokenizer: str, end_id: int, max_length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, bucket, sequence_id, offset): one row for each sequence.

    A document's ids, with end_id behind them, are cut into pieces whose lengths are powers of two, the longest first;
    each piece is a sequence of its own, so nothing is padded and offset is 0. Sequences of equal length belong to one
    bucket (log2 of the length), so that batches of one shape are read from one bucket: see write_buckets.
    ids holds little-endian unsigned 32-bit ids. sequence_id is unique; like monotonically_increasing_id it follows from
    the partition and the place in it: no shuffle, no count over the whole table, and a task that runs again gives the
    same ids. max_length must be a power of two.

    Texts are encoded whole, however long, each in one task. Null texts are empty: one piece that holds the end id. Repeated rows are packed each. An empty table gives no rows.
    Other columns of docs are not read.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    rows = docs.select(F.col(id_col), no_null(text_col).alias("__text"))
    head = rows.schema[id_col]
    schema = T.StructType([head, *(T.StructField(n, T.LongType()) for n in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("doc_tokens", "bucket", "sequence_id", "offset"))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, made = encoder(tokenizer), TaskContext.get().partitionId(), 0
        cuts: dict[int, list[int]] = {}
        for b in row_slices(batches, "__text"):
            ids, counts = enc.encode(b.column(1).to_pylist(), end_id)
            pieces = []
            for n in counts.tolist():
                if n not in cuts:
                    if len(cuts) > 100_000:
                        cuts.clear()
                    cuts[n] = binary_lengths(n, max_length)
                pieces.append(cuts[n])
            each = np.fromiter(map(len, pieces), np.int64, len(pieces))
            lengths = np.fromiter((x for p in pieces for x in p), np.int64, int(each.sum()))
            ends = np.cumsum(lengths)
            offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
            of = np.repeat(np.arange(len(pieces)), each)
            first = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(of)),
                    pa.array(ends - lengths - first[of]),
                    pa.array(lengths),
                    pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))]),
                    pa.array(counts[of]),
                    pa.array(np.log2(lengths).astype(np.int64)),
                    pa.array(shard * SHARD + made + np.arange(len(lengths))),
                    pa.array(np.zeros(len(lengths), np.int64)),
                ],
                [f.name for f in schema],
            )
            made += len(lengths)

    return rows.mapInArrow(pack, schema)


def write_buckets(sequences: DataFrame, path: str) -> DataFrame:
    """Sequences as Parquet, one folder for each length, for loaders that fill batches from one bucket at a time; returns the table there.

    Each task writes its own file into each folder: no shuffle, and no bucket, however large, is one task's."""
    sequences.write.partitionBy("bucket").parquet(path)
    columns = [f for f in sequences.schema if f.name != "bucket"]
    return sequences.sparkSession.read.schema(T.StructType([*columns, sequences.schema["bucket"]])).parquet(path)
