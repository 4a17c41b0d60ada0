"""Series of many rows, cut into blocks: the same rows as windows give, costs that grow with the rows alone, and no window over a whole series."""

import random
import re
import time

import numpy as np
import pytest
from banded import spline_values
from pyspark.sql import functions as F

from tessera.operators import relational, scan, series
from tessera.operators.series import Series


def rows_of(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    """Series of 0 to 60 rows, one with a null key, with null values."""
    rng = random.Random(1)
    sizes = {"a": 60, "b": 1, "c": 17, None: 23, "d": 2}
    rows = [(k, i * 3 - n, rng.choice([None, 1.0, 2.0, 5.5, 7.0])) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "p string, o int, v double").repartition(5)


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_are_windows(table, block):
    by_window, by_block = (Series(table, "o", "v", ("p",), split, block) for split in (False, True))
    for f in (
        lambda s: s.sliding((-3, 0, 2)), lambda s: s.sliding((-2, 1), wrap=True), lambda s: s.smooth((-2, -1, 0, 1)), lambda s: s.smooth((-2, 2)), lambda s: s.smooth_simple(5), lambda s: s.smooth_simple(3, exclude_center=True),
        lambda s: s.smooth_multiple([3, 5]), lambda s: s.deviation((-1, 1), relative=True), lambda s: s.mark_extremes(), lambda s: s.mark_spikes(0.2), lambda s: s.smooth_spikes(0.2, (-1, 1)), lambda s: s.derivative(), lambda s: s.derivative(by_order=True),
        lambda s: s.shift(4), lambda s: s.shift(-2, 0.0), lambda s: s.norm(), lambda s: s.cumulated(), lambda s: s.is_sorted(), lambda s: s.crop(2, 1), lambda s: s.crop(0, 0), lambda s: s.drop_row(0), lambda s: s.drop_row(3),
        lambda s: s.intersect(s.with_df(table.filter("o % 2 = 0"))), lambda s: s.combine(s.with_df(s.shift(1, name="w")), lambda a, b: a - b),
        lambda s: series.brackets(s, table.select("p", (F.col("o") + 1).alias("q")), "q"), lambda s: series.nearest(s, table.select("p", (F.col("o") * 2).alias("q")), "q"), lambda s: series.interpolate(s, table.select("p", (F.col("o") / 2).alias("q")), "q"),
    ):
        assert rows_of(f(by_block)) == rows_of(f(by_window))
    assert rows_of(scan.runs(table, ["v"], ["o"], ("p",), size=block)) == rows_of(relational.run_id(table, ["v"], ["o"], ("p",)))
    assert rows_of(scan.uniq(table, ["v"], ["o"], ("p",), size=block)) == rows_of(relational.uniq(table, ["v"], ["o"], ("p",)))
    both = scan.Blocks(table, ("p",), ["o"], block).running({"low": ("min", F.col("v")), "high": ("max", F.col("v"))}, {"next": ("last", F.col("v"))})
    want = {}
    for r in table.collect():
        want.setdefault(r["p"], []).append((r["o"], r["v"]))
    for r in both.df.collect():
        seen = [v for o, v in want[r["p"]] if o <= r["o"] and v is not None]
        later = [v for o, v in sorted(want[r["p"]]) if o >= r["o"] and v is not None]
        assert (r["low"], r["high"], r["next"]) == (min(seen, default=None), max(seen, default=None), later[0] if later else None)


def test_asked_rows(spark):
    """Repeated rows, null keys, null places, repeated known rows and clashing names."""
    known = spark.createDataFrame([("x", 1, 1.0), ("x", 5, 3.0), ("x", 5, 2.0), ("x", None, 9.0), ("x", 7, None), (None, 2, 4.0)], "p string, k0 int, v double")
    asked = spark.createDataFrame([("x", 5, 0), ("x", 5, 0), ("x", 0, 0), ("x", 3, 0), ("x", 8, 0), ("x", None, 0), (None, 9, 0), ("y", 1, 0)], "p string, q int, __row int")
    want = [("x", 5, 0, 5, 3.0, 5, 3.0)] * 2 + [("x", 0, 0, None, None, 1, 1.0), ("x", 3, 0, 1, 1.0, 5, 2.0), ("x", 8, 0, 5, 3.0, None, None), ("x", None, 0, None, None, None, None), (None, 9, 0, 2, 4.0, None, None), ("y", 1, 0, None, None, None, None)]
    for split in (False, True):
        s = Series(known, "k0", "v", ("p",), split, 2)
        assert rows_of(series.brackets(s, asked, "q")) == sorted(want, key=repr)
        assert rows_of(series.brackets(s, asked.withColumnRenamed("__row", "k1"), "q", ("a", "b", "c", "d"))) == sorted(want, key=repr)
        with pytest.raises(ValueError, match="has a column k1"):
            series.brackets(s, asked.withColumnRenamed("__row", "k1"), "q")
        assert series.nearest(s, asked, "q").count() == series.interpolate(s, asked, "q").count() == len(want)


def test_a_long_series_takes_all_tasks(spark):
    n = 1_000_000
    known = spark.range(n).select((F.col("id") * 3).alias("k"), (F.col("id") * 6.0).alias("v"))
    asked = spark.range(n).select((F.col("id") * 3 + F.col("id") % 3).alias("q"))
    began = time.time()
    got = series.interpolate(Series(known, "k", "v", block=1 << 16), asked, "q")
    odd = got.filter((F.abs(F.col("value") - 2 * F.col("q")) > 1e-6) & (F.col("q") < 3 * n - 3)).count()
    assert odd == 0 and time.time() - began < 120
    tasks = got.select(F.spark_partition_id().alias("t")).groupBy("t").count().filter("count > 10000").count()
    assert tasks >= 4


def no_whole_window(df):
    """No window without a partition key but those over one row for each block or partition."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not [x for x in re.findall(r"Window \[.*", plan) if "__block" not in x and "__partition" not in x]


def test_plans(spark, table):
    s = Series(table, "o", "v")
    for df in (s.cumulated(), s.smooth(), s.smooth_simple(3), s.mark_spikes(0.2), s.shift(2), s.crop(1, 1), s.norm(), s.is_sorted(), scan.runs(table, ["v"], ["o"]), scan.uniq(table, ["v"], ["o"]), series.brackets(s, table.select(F.col("o").alias("q")), "q")):
        assert no_whole_window(df)


@pytest.mark.parametrize(("n", "block"), [(2000, 64), (2000, 1), (50, 3), (200_000, 16_384)])
def test_spline_of_many_blocks(spark, n, block):
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.uniform(0.5, 1.5, n)), rng.normal(size=n)
    at = np.concatenate([rng.uniform(x[0] - 1, x[-1] + 1, 500), x[:3], x[-3:]])
    s = Series(spark.createDataFrame([("s", *r) for r in zip(x.tolist(), y.tolist(), strict=True)], "p string, k double, v double").repartition(8), "k", "v", ("p",), True, block)
    got = {r["at"]: r["value"] for r in series.spline(s, spark.createDataFrame([("s", v) for v in at.tolist()], "p string, at double"), "at").collect()}
    have = np.array([np.nan if got[v] is None else got[v] for v in at.tolist()])
    assert np.allclose(have, spline_values(x, y, at), atol=1e-8, equal_nan=True)


def test_short_splines(spark):
    rng = np.random.default_rng(3)
    knots = {f"s{n}": (np.cumsum(rng.uniform(0.1, 3, n)), rng.normal(size=n)) for n in (1, 2, 3, 4, 5, 6, 9)}
    known = spark.createDataFrame([(p, float(a), float(b)) for p, (x, y) in knots.items() for a, b in zip(x, y, strict=True)] + [("s5", None, 1.0), ("s5", 2.0, None), ("s9", float(knots["s9"][0][2]), 99.0)], "p string, k double, v double")
    places = [(p, float(v)) for p, (x, _) in knots.items() for v in np.linspace(x[0] - 0.1, x[-1] + 0.1, 9)] + [("s4", None), ("none", 1.0)]
    for block in (2, 100):
        for r in series.spline(Series(known, "k", "v", ("p",), block=block), spark.createDataFrame(places, "p string, at double"), "at").collect():
            want = np.nan if r["at"] is None or r["p"] == "none" else spline_values(*knots[r["p"]], np.array([r["at"]]))[0]
            assert (r["value"] is None and np.isnan(want)) or abs(r["value"] - want) < 1e-9


def test_the_banded_solve_against_the_dense_system():
    rng = np.random.default_rng(2)
    for n in (4, 5, 6, 9, 40):
        x, y = np.cumsum(rng.uniform(0.1, 3, n)), rng.normal(size=n)
        h, slope = np.diff(x), np.diff(y) / np.diff(x)
        a, r = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2], r[i] = (h[i - 1], 2 * (h[i - 1] + h[i]), h[i]), 6 * (slope[i] - slope[i - 1])
        a[0, :3], a[-1, -3:] = (h[1], -h[0] - h[1], h[0]), (h[-1], -h[-2] - h[-1], h[-2])
        m = np.linalg.solve(a, r)
        at = rng.uniform(x[0], x[-1], 50)
        k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
        t, u = at - x[k], x[k + 1] - at
        want = (m[k] * u**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t
        assert np.allclose(spline_values(x, y, at), want)
