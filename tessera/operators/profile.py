"""Histograms, profiles and reshaping for exploratory analysis."""


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.basic import truthy


#: Reports of so many rows may be broadcast.
MOST_SENT = 10_000


def hist(df: DataFrame, *fields: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(field, value, count, share, total_count) of each value of each field, within categories if `by` is given. One pass for all fields."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("p")
    counts = df.select(*by, pairs).groupBy(*by, "p.field", "p.value").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*by, "field"))
    return counts.withColumn("total_count", total).withColumn("share", F.col("count") / F.col("total_count"))


def histograms(df: DataFrame, fields: list[str], most: int = 25) -> DataFrame:
    """The `most` commonest values of each field, ties by value: a report, not a filter."""
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.col("count").desc(), "value"))
    return hist(df, *fields).withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def stat(df: DataFrame, *fields: str, by: tuple[str, ...] = (), approximate: float | None = None) -> DataFrame:
    """A profile of each field: total, defined and nonzero counts with shares, and distinct values: exact ones, which move each row once a field, or by sketches of that relative error."""
    kinds = dict(df.dtypes)
    parts = []
    for f in fields:
        parts += [F.count(f).alias(f"{f}__defined"), F.sum(truthy(f, kinds[f] == "string").cast("bigint")).alias(f"{f}__nonzero"), (F.count_distinct(F.col(f)) if approximate is None else F.approx_count_distinct(f, approximate)).alias(f"{f}__uniq")]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_count"), *parts)
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}__defined").alias("defined_count"), F.coalesce(f"{f}__nonzero", F.lit(0)).alias("nonzero_count"), F.col(f"{f}__uniq").alias("uniq_count")) for f in fields))).alias("p")
    out = wide.select(*by, "total_count", rows).select(*by, "p.field", "total_count", "p.defined_count", "p.nonzero_count", "p.uniq_count")
    return out.withColumn("defined_share", F.col("defined_count") / F.col("total_count")).withColumn("nonzero_share", F.col("nonzero_count") / F.col("total_count"))


def aggregate(df: DataFrame, by: list[str], sums: list[str], ratios: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Sums by group, and ratios of two sums."""
    out = df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums))
    return out.withColumns({n: F.when(F.col(b) != 0, F.col(a) / F.col(b)) for n, (a, b) in (ratios or {}).items()})


def unpivot(df: DataFrame, keys: list[str], measures: list[str], name: str = "measure", value: str = "value") -> DataFrame:
    return df.unpivot(keys, measures, name, value)


def crop_value(c: str, low, high):
    return F.greatest(F.least(F.col(c), F.lit(high)), F.lit(low))


def bin_label(c: str, bounds: list):
    """The label of the value's bin: '-low', 'a-b' (a included, b not) or 'high+'."""
    out = F.lit(f"{bounds[-1]}+")
    for a, b in reversed(list(zip(bounds, bounds[1:], strict=False))):
        out = F.when(F.col(c) < b, F.lit(f"{a}-{b}")).otherwise(out)
    return F.when(F.col(c).isNull(), None).when(F.col(c) < bounds[0], F.lit(f"-{bounds[0]}")).otherwise(out)


def meld_other(df: DataFrame, field: str, n: int = 8, by: str | None = None, other: str = "other") -> DataFrame:
    """Values of field beyond the n largest become one. The n values are joined; up to MOST_SENT they are broadcast."""
    total = F.sum(by) if by else F.count(F.lit(1))
    top = df.groupBy(field).agg(total.alias("__t")).orderBy(F.col("__t").desc(), field).limit(n).select(F.col(field).alias("__top"))
    out = df.join(F.broadcast(top) if n <= MOST_SENT else top, F.col(field).eqNullSafe(F.col("__top")), "left")
    return out.withColumn(field, F.when(F.col("__top").isNotNull(), F.col(field).cast("string")).otherwise(other)).drop("__top")


def smaller_types(df: DataFrame) -> DataFrame:
    """64-bit numbers as 32-bit ones."""
    return df.select(*(F.col(c).cast({"bigint": "int", "double": "float"}.get(t, t)).alias(c) for c, t in df.dtypes))


def split_by_value(df: DataFrame, field: str, values: list) -> dict:
    return {v: df.filter(F.col(field).eqNullSafe(F.lit(v))) for v in values}


def cumulated_by(df: DataFrame, x: str, category: str, y: str, name: str = "cumulated") -> DataFrame:
    """Running sums of y over the categories of each x, the largest category first."""
    return df.withColumn(name, F.sum(y).over(Window.partitionBy(x).orderBy(F.col(category).desc()).rowsBetween(Window.unboundedPreceding, 0)))


