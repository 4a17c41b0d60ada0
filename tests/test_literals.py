"""Small literal cases of the operators and functions."""

import datetime
import math

from pyspark.sql import functions as F

from tessera.frame import Frame
from tessera.functions import dates, text
from tessera.functions.numeric import two_sided_p
from tessera.operators import relational, series
from tessera.sources import files, schema

D = datetime.date


def test_sequential_select(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    row = Frame(df).select("a", h="g", g="e", e="c").collect()[0]
    assert row == {"a": 1, "h": 3, "g": 3, "e": 3}


def test_join_overwrites(spark):
    left = spark.createDataFrame([(0, 0, 0), (None, 2, 7), (8, 9, None)], "x int, y int, z int")
    right = spark.createDataFrame([(1, 2, 3), (4, 2, None), (6, 0, None)], "x int, y int, z int")
    got = {r["y"]: r["x"] for r in relational.join(left, right, "y", right_is_uniq=True, last_by="x").collect()}
    assert got == {0: 6, 2: 4, 9: 8}
    assert relational.join(left, right, "y").count() == 4 and relational.join(left, right, "y", "inner").count() == 3


def test_fold_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 1, 11), (1, 2, None), (2, 3, 21)], "x int, n int, y int")
    got = {r["x"]: r["y"] for r in relational.group_fold(df, ["x"], ["y"], "n").collect()}
    assert got == {1: [11, None], 2: [21]}


def test_nearest_and_linear(spark):
    known = spark.createDataFrame([(D(2020, 1, 1), 10.0), (D(2021, 1, 1), 20.0)], "d date, v double")
    asked = spark.createDataFrame([(D(2019, 12, 1),), (D(2020, 2, 1),), (D(2020, 12, 1),), (D(2021, 12, 2),)], "q date")
    got = sorted((r["q"], r["nearest_key"].year, r["distance"]) for r in series.nearest(series.Series(known, "d", "v"), asked, "q").collect())
    assert [g[1:] for g in got] == [(2020, 31), (2020, 31), (2021, 31), (2021, 335)]
    known = spark.createDataFrame([(D(2019, 1, 1), 375.0), (D(2020, 1, 1), 10.0)], "d date, v double")
    asked = spark.createDataFrame([(D(2018, 12, 1),), (D(2019, 2, 1),), (D(2019, 12, 1),), (D(2020, 12, 2),)], "q date")
    assert [r["value"] for r in series.interpolate(series.Series(known, "d", "v"), asked, "q").orderBy("q").collect()] == [375, 344, 41, 10]


def test_smooth_simple(spark):
    df = spark.createDataFrame(list(enumerate([2.0, 5.0, 2.0, 8.0, 5.0])), "n int, v double")
    s = series.Series(df, "n", "v")
    assert [r["smoothed"] for r in s.smooth_simple(3).orderBy("n").collect()] == [2, 3, 5, 5, 5]
    assert [r["smoothed"] for r in s.smooth_simple(3, exclude_center=True).orderBy("n").collect()] == [2, 2, 6.5, 3.5, 5]
    assert s.smooth_spikes(0.1).count() == 5


def test_spline_meets_a_cubic(spark):
    known = spark.createDataFrame([(x, x**3 - x) for x in (0.0, 1.0, 2.0, 4.0, 7.0)], "x double, y double")
    asked = spark.createDataFrame([(0.5,), (3.0,), (6.5,), (8.0,)], "at double")
    got = {r["at"]: r["value"] for r in series.spline(series.Series(known, "x", "y"), asked, "at").collect()}
    assert got.pop(8.0) is None and all(abs(v - (at**3 - at)) < 1e-9 for at, v in got.items()) and len(got) == 3


def test_dates_and_text(spark):
    row = spark.range(1).select(
        dates.next_year_date(F.lit(D(2019, 12, 2)), 1).alias("a"), dates.next_year_date(F.lit(D(2019, 12, 2)), -2, True).alias("b"), dates.days_between(F.lit(D(2020, 1, 1)), F.lit(D(2020, 3, 8))).alias("c"),
        dates.yearly_dates(F.lit(D(2020, 8, 21)), D(2018, 5, 1), D(2022, 5, 1)).alias("d"), text.norm_text(F.lit("\t Абв 123 Gb\n")).alias("e"), dates.int_to_date(dates.date_to_int(F.lit(D(2024, 7, 15)), "week"), "week").alias("f"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["e"]) == (D(2020, 12, 2), D(2017, 11, 27), 67, "абв gb")
    assert row["d"] == [D(y, 8, 21) for y in (2018, 2019, 2020, 2021)] and row["f"] == D(2024, 7, 15)


def test_student_p():
    # With three degrees of freedom the distribution has a closed form.
    for t in (0.1, 0.5, 1.7, 4.0):
        x = t / 3**0.5
        assert abs(two_sided_p(t, 3) - (1 - 2 / math.pi * (x / (1 + x * x) + math.atan(x)))) < 1e-12
    assert abs(two_sided_p(2.0, 10) - 0.07338803) < 1e-7


def test_files_and_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2.5"), (2, "b", "x")], "page_id int, page_name string, conversion_rate string")
    for kind in ("parquet", "csv", "tsv", "json"):
        files.write(df, str(tmp_path / f"t.{kind}"))
        assert files.read(spark, str(tmp_path / f"t.{kind}")).count() == 2
    got = files.read_by_title(spark, str(tmp_path / "t.tsv")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 2.5), (2, "b", None)]
    lines = spark.createDataFrame([('{"a": "b"}',), ("abc",), ('{"d": "e"}',)], "line string")
    assert [r["_err"] for r in files.parse_json_lines(lines, "a string, d string").collect()] == [None, "JSONDecodeError", None]
    assert schema.differences(df, "page_id int, other int")["missing"] == ["other"] and schema.summary(df).count() == 3
