"""Windowed aggregates for batch and streaming frames alike: with a watermark they end windows and drop state."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(df: DataFrame, time: str, late: str | None) -> DataFrame:
    return df.withWatermark(time, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, time: str, size: str, by: list[str], value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums in windows of a size (sliding if `slide` is given)."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = _marked(df, time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Sessions end after a gap without rows."""
    out = _marked(df, time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
