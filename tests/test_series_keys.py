"""Series operators without a series key, and those that no query covers."""

import datetime

from pyspark.sql import functions as F

from tessera.operators import series

D = datetime.date


def test_without_a_key(spark):
    dates = [(D(2020, m, 1), float(m)) for m in range(1, 13)] + [(D(2021, 1, 1), 13.0)]
    s = series.Series(spark.createDataFrame(dates, "d date, v double"), "d", "v")
    short = series.Series(s.df.limit(4), "d", "v")
    assert sorted(r["v"] for r in s.intersect(short).collect()) == [1, 2, 3, 4]
    asked = spark.createDataFrame([(D(2023, 6, 20),), (D(2019, 2, 10),), (D(2025, 6, 17),)], "q date")
    got = {r["q"]: r["base"] for r in series.base_dates(s, asked, "q").collect()}
    assert got == {D(2023, 6, 20): D(2020, 7, 1), D(2019, 2, 10): D(2020, 2, 1), D(2025, 6, 17): D(2020, 7, 1)}
    assert {r["base"] for r in series.base_dates(s, asked, "q", within=5, fallback=False).collect()} == {None}
    full = series.interpolated_windows(s, [-10, 10], lambda a: F.size(a), full=True)
    assert full.count() == 11
    ends = s.mutual_borders(short).first()
    assert (ends["first"], ends["last"]) == (min(r["d"] for r in short.df.collect()), max(r["d"] for r in short.df.collect()))
    assert sorted(r["v"] for r in s.drop_row(0).collect())[0] == 2
    assert s.distance(D(2020, 1, 31), absolute=False).orderBy("d").first()["distance"] == -30
