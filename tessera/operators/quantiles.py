"""Exact quantiles of groups of any size, by selection in passes.

A pass counts the values of each range that still holds a wanted rank in BINS equal parts, combined before the shuffle, and
goes on with the part that holds the rank, between its own least and largest value. Once a range holds few rows, they are
sorted. So a task holds counts or a bounded list, never a group; tables of values spread evenly take one pass for each
factor BINS, and none takes more than some 210, as a range of doubles can be cut in BINS parts no more often.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.names import hidden
from tessera.shared import written

#: Parts of a range; rows that are sorted at once; groups whose ranges are sent to all tasks (each some hundred bytes), beyond which rows are joined.
BINS, REST, SENT = 1024, 1 << 14, 20_000


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], bins: int = BINS, rest: int = REST, sent: int = SENT) -> DataFrame:
    """One row for each group (one in all without by): for each name the quantile of that share, interpolated between the two values next to it.

    Values are doubles; nulls and NaN do not count. A group without values has null quantiles; null keys are a group.
    """
    v, n, low, high, k, below, inside, keys = *hidden(df, "v", "n", "low", "high", "k", "below", "inside"), hidden(df, *(f"g{i}" for i in range(len(by) or 1)))
    x = F.col(value).cast("double")
    groups = [F.col(c).alias(g) for c, g in zip(by, keys, strict=True)] if by else [F.lit(0).alias(keys[0])]
    rows = df.select(*groups, F.when(~F.isnan(x), x).alias(v))
    stats = written(rows.groupBy(*keys).agg(F.count(v).alias(n), F.min(v).alias(low), F.max(v).alias(high)), "groups")
    few = stats.count() <= sent
    rows = rows.filter(F.col(v).isNotNull())
    place = lambda share: (F.col(n) - 1) * F.lit(share)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(s)), F.ceil(place(s))) for s in shares.values()))))
    #: A rank's value lies in [low, high], which holds so many rows; so many lie below.
    open_ = stats.filter(f"`{n}` > 0").select(*keys, F.explode(ranks).alias(k), low, high, F.lit(0).cast("long").alias(below), F.col(n).alias(inside))
    found = None
    while True:
        open_ = written(open_, "ranks")
        done = open_.filter((F.col(low) == F.col(high)) | (F.col(inside) <= rest))
        found = done if found is None else found.unionByName(done)
        open_ = open_.filter((F.col(low) < F.col(high)) & (F.col(inside) > rest))
        if open_.isEmpty():
            break
        ranges = open_.select(*keys, low, high).distinct()
        # Halves, as a whole range may be no double; where half of it is zero, its least value is one part and all others another.
        share = F.try_divide(F.col(v) / 2 - F.col(low) / 2, F.col(high) / 2 - F.col(low) / 2)
        part = F.least(F.coalesce(F.floor(share * bins), F.when(F.col(v) > F.col(low), 1).otherwise(0)), F.lit(bins - 1))
        counted = _in(rows, ranges, keys, v, low, high, few).groupBy(*keys, low, high, part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min(v).alias("a"), F.max(v).alias("b"))
        upto = Window.partitionBy(*keys, low, high).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as parts
        counted = counted.withColumn("upto", F.sum("c").over(upto))
        mine = hidden(open_, *keys, low, high)
        counted = counted.withColumnsRenamed(dict(zip([*keys, low, high], mine, strict=True)))
        held = (F.col(k) >= F.col(below) + F.col("upto") - F.col("c")) & (F.col(k) < F.col(below) + F.col("upto"))
        step = open_.join(counted, _same([*keys, low, high], mine) & held)
        open_ = step.select(*keys, k, F.col("a").alias(low), F.col("b").alias(high), (F.col(below) + F.col("upto") - F.col("c")).alias(below), F.col("c").alias(inside))
    found = written(found, "found")
    ranges = found.filter(F.col(low) < F.col(high)).select(*keys, low, high, below).distinct()
    lists = _in(rows, ranges, keys, v, low, high, few).groupBy(*keys, low, high, below).agg(F.sort_array(F.collect_list(v)).alias("sorted"))  # each at most `rest` values
    mine = hidden(found, *keys, low, high, below)
    lists = lists.withColumnsRenamed(dict(zip([*keys, low, high, below], mine, strict=True)))
    values = found.join(lists, _same([*keys, low, high, below], mine), "left")
    values = values.select(*keys, k, F.when(F.col(low) == F.col(high), F.col(low)).otherwise(F.get("sorted", (F.col(k) - F.col(below)).cast("int"))).alias(v))
    of = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(k, v))).alias("of"))  # two ranks for each share
    mine = hidden(stats, *keys)
    out = stats.join(of.withColumnsRenamed(dict(zip(keys, mine, strict=True))), _same(keys, mine), "left")

    def at(share: float) -> Column:
        a, b = F.col("of")[F.floor(place(share))], F.col("of")[F.ceil(place(share))]
        return F.when(F.col(n) > 0, a + (b - a) * (place(share) - F.floor(place(share))))

    return out.select(*(F.col(g).alias(c) for c, g in zip(by, keys, strict=False)), *(at(s).alias(name) for name, s in shares.items()))


def _in(rows: DataFrame, ranges: DataFrame, keys: list[str], v: str, low: str, high: str, few: bool) -> DataFrame:
    """The rows whose value lies in a range of their group. Few groups' ranges are sent to the rows, which do not move; with more groups both sides are dealt by group, and a hot one is split."""
    mine = hidden([rows, ranges], *keys)
    ranges = ranges.withColumnsRenamed(dict(zip(keys, mine, strict=True)))
    return rows.join(F.broadcast(ranges) if few else ranges.hint("merge"), _same(keys, mine) & F.col(v).between(F.col(low), F.col(high))).drop(*mine)
