"""A fluent wrapper: each method is one of the library's operators and returns a new frame. Nothing runs before an action, but for operators that number rows (enumerate_rows, skip, chunks, run_id and uniq without groups, series without a key): these sort and write the rows at the call."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import profile, relational
from tessera.operators.series import Series
from tessera.sources import files, schema

_RELATIONAL = ("select", "where", "enumerate_rows", "group_fold", "group_fold_parts", "unfold", "unfold_parts", "run_id", "uniq", "sum_by_keys", "first_values", "sort", "take", "skip", "top_n_by", "chunks", "add_sum_share", "flat_map", "map_batches", "map_rows", "having_columns", "dictionary")
_PROFILE = ("hist", "histograms", "stat", "aggregate", "unpivot", "meld_other", "smaller_types", "cumulated_by")


class Frame:
    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def read(cls, spark: SparkSession, path: str, **options) -> "Frame":
        return cls(files.read(spark, path, **options))

    @classmethod
    def empty(cls, spark: SparkSession, ddl: str) -> "Frame":
        return cls(spark.createDataFrame([], ddl))

    def join(self, right: "Frame | DataFrame", key: str | list[str], how: str = "left", **options) -> "Frame":
        return Frame(relational.join(self.df, right.df if isinstance(right, Frame) else right, key, how, **options))

    def add(self, *others: "Frame") -> "Frame":
        return Frame(relational.union(self.df, *(o.df for o in others)))

    def group_by(self, *keys: str, **aggregates) -> "Frame":
        return Frame(self.df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items())))

    def apply(self, function: Callable[[DataFrame], DataFrame]) -> "Frame":
        return Frame(function(self.df))

    def cast_to(self, ddl: str, errors: str | None = None) -> "Frame":
        return Frame(schema.cast_to(self.df, ddl, errors))

    def series(self, order: str, value: str, by: tuple[str, ...] = ()) -> Series:
        return Series(self.df, order, value, by)

    def write(self, path: str, **options) -> None:
        files.write(self.df, path, **options)

    def collect(self) -> list[dict]:
        return [r.asDict(True) for r in self.df.collect()]

    def example(self, n: int = 1, **equal) -> list[dict]:
        """A few rows, of those with the given values."""
        df = relational.where(self.df, **equal) if equal else self.df
        return [r.asDict(True) for r in df.take(n)]

    def show(self, n: int = 10) -> str:
        """The shape and the first rows, as a text."""
        rows = "\n".join(str(r) for r in self.example(n))
        return f"{self.shape()}\n{rows}"

    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.df.columns)

    def assert_not_empty(self) -> "Frame":
        if self.df.isEmpty():
            raise ValueError("the frame is empty")
        return self

    def to_pairs(self, key: str, value: str) -> "Frame":
        return Frame(relational.pairs(self.df, key, value))

    def count(self) -> int:
        return self.df.count()


def _method(function: Callable) -> Callable:
    def call(self: Frame, *args, **options) -> Frame:
        return Frame(function(self.df, *args, **options))

    call.__name__, call.__doc__ = function.__name__, function.__doc__
    return call


for _module, _names in ((relational, _RELATIONAL), (profile, _PROFILE)):
    for _name in _names:
        setattr(Frame, _name, _method(getattr(_module, _name)))
