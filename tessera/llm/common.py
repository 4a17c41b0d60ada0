"""What the operators of this package share: the shared folder, written intermediate tables, and small Arrow helpers."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import new_dir, shared_dir, written

__all__ = ["SLICE_BYTES", "free_names", "hidden", "new_dir", "no_null", "partitions", "row_slices", "shared_dir", "text_slices", "written"]

#: Texts are handled in slices of about so many bytes, which bounds a task's memory whatever the rows' lengths.
SLICE_BYTES = 4 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, *names: str) -> None:
    """Raises where df has one of the names, in any case of letters, as Spark does not tell them apart."""
    taken = {c.lower() for c in df.columns}
    for n in names:
        if n.lower() in taken:
            raise ValueError(f"the table has a column {n}")


def hidden(df: DataFrame, *names: str) -> list[str]:
    """A name for each that no column of df has: for columns that an operator adds and drops again."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def no_null(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _cuts(values: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive values that hold about limit bytes at most; one longer value stands alone."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(values):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, stop - at
        at = stop


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """Consecutive texts (null: empty) in lists balanced by bytes; a longer text is a list of its own."""
    for at, n in _cuts(texts, limit):
        yield [t or "" for t in texts.slice(at, n).to_pylist()]


def row_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column's values hold about limit bytes at most (one longer value stands alone)."""
    for b in batches:
        for at, n in _cuts(b.column(b.schema.get_field_index(column)), limit):
            yield b.slice(at, n)
