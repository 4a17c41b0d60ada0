"""Queries of the series operators that catalogue.py has not, with their SQL. The series: orders by month, for each priority."""

import datetime

from pyspark.sql import functions as F

from tessera.functions import arrays
from tessera.operators import series
from tessera.plans.catalogue import _BY, _monthly, big, big_column, many, query
from tessera.operators.series import Series

_N = f"SELECT *, row_number() OVER (PARTITION BY p ORDER BY d) AS n, count(*) OVER (PARTITION BY p) AS c, min(d) OVER (PARTITION BY p) AS low, max(d) OVER (PARTITION BY p) AS high FROM ({_BY})"


def _priority(t, name: str) -> Series:
    s = _monthly(t)
    return s.with_df(s.df.filter(F.col("p") == name))


@query(f"SELECT p, d, v, [lag(v) OVER w, v, lead(v) OVER w] AS window FROM ({_BY}) WINDOW w AS (PARTITION BY p ORDER BY d)")
def ser_sliding(t):
    return _monthly(t).sliding()


@query(f"SELECT p, d, v, [CASE WHEN n = 1 THEN last_value(v) OVER w WHEN n = 2 THEN last_value(v) OVER w2 ELSE lag(v, 2) OVER o END, v] AS window FROM ({_N}) WINDOW o AS (PARTITION BY p ORDER BY d), w2 AS (PARTITION BY p ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), w AS (PARTITION BY p ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE NO OTHERS)".replace("CASE WHEN n = 1 THEN last_value(v) OVER w WHEN", "CASE WHEN n = 1 THEN nth_value(v, c - 1) OVER w WHEN"))
def ser_sliding_wrapped(t):
    return _monthly(t).sliding((-2, 0), wrap=True)


@query(f"SELECT p, d, v, COALESCE(lag(v) OVER w, 0) + v AS applied FROM ({_BY}) WINDOW w AS (PARTITION BY p ORDER BY d)")
def ser_apply_window(t):
    return _monthly(t).apply_window(arrays.array_sum, (-1, 0))


@query(f"WITH a AS (SELECT p, d, v, CASE WHEN n <= 1 OR n > c - 1 THEN v ELSE (sum(v) OVER (PARTITION BY p ORDER BY d ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) / 3 END AS s, n, c FROM ({_N})) SELECT p, d, v, CASE WHEN n <= 2 OR n > c - 2 THEN s ELSE (sum(s) OVER (PARTITION BY p ORDER BY d ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) / 5 END AS smoothed FROM a")
def ser_smooth_multiple(t):
    return _monthly(t).smooth_multiple([3, 5])


@query(f"SELECT p, d, v, CASE WHEN v > b AND v >= f AND abs((v - m) / m) > 0.05 THEN m ELSE v END AS smoothed FROM (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS f, (lag(v) OVER w + lead(v) OVER w) / 2 AS m FROM ({_BY}) WINDOW w AS (PARTITION BY p ORDER BY d))")
def ser_smooth_spikes(t):
    return _monthly(t).smooth_spikes(0.05, (-1, 1))


@query(f"SELECT p, d, v, round(v / avg(v) OVER (PARTITION BY p), 9) AS normed, lag(v, 3, 0.0) OVER (PARTITION BY p ORDER BY d) AS shifted FROM ({_BY})")
def ser_norm_shift(t):
    s = _monthly(t)
    return s.with_df(s.shift(3, 0.0)).norm().withColumn("normed", F.round("normed", 9))


@query(f"SELECT p, d, v / w AS ratio FROM (SELECT p, d, v, v + row_number() OVER (PARTITION BY p ORDER BY d) AS w FROM ({_BY}))")
def ser_divide(t):
    s = _monthly(t)
    other = s.df.withColumn("w", F.col("v") + F.row_number().over(s.window))
    return s.combine(Series(other, "d", "w", ("p",)), lambda a, b: a / b, "ratio")


@query(f"SELECT p, d, v - w AS gap FROM (SELECT p, d, v, n::DOUBLE AS w FROM ({_N}))")
def ser_subtract(t):
    s = _monthly(t)
    return s.combine(Series(s.df.withColumn("w", F.row_number().over(s.window).cast("double")), "d", "w", ("p",)), lambda a, b: a - b, "gap")


@query(f"SELECT p, first(d ORDER BY v, d) AS arg_min, first(d ORDER BY v DESC, d) AS arg_max FROM ({_BY}) GROUP BY 1")
def ser_arg_extremes(t):
    return _monthly(t).arg_extremes()


@query(f"SELECT p, bool_and(ok) AS is_sorted FROM (SELECT p, COALESCE(lag(v) OVER (PARTITION BY p ORDER BY d) <= v, true) AS ok FROM ({_BY})) GROUP BY 1")
def ser_is_sorted(t):
    return _monthly(t).is_sorted()


@query(f"SELECT p, d, v, 'in' AS side FROM ({_BY}) WHERE d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' UNION ALL SELECT p, d, v, 'out' FROM ({_BY}) WHERE NOT d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def ser_period(t):
    s, low, high = _monthly(t), datetime.date(1996, 1, 1), datetime.date(1996, 12, 31)
    return s.span(low, high).withColumn("side", F.lit("in")).unionByName(s.span(low, high, inside=False).withColumn("side", F.lit("out")))


@query(f"SELECT p, d, v FROM ({_N}) WHERE n > 2 AND n <= c - 3 AND n <> 9")
def ser_crop_drop(t):
    s = _monthly(t)
    cropped = s.with_df(s.crop(2, 3))
    return cropped.drop_row(6)


@query(f"SELECT p, d, v FROM ({_N}) WHERE n <= (SELECT count(*) FROM (SELECT DISTINCT date_trunc('year', o_orderdate) FROM orders))")
def ser_intersect(t):
    s = _monthly(t)
    years = s.df.select("p", F.trunc("d", "year").alias("d")).distinct().withColumn("v", F.lit(1.0))
    return s.intersect(Series(years, "d", "v", ("p",)))


@query("SELECT d, sum(v) AS total, avg(v) AS mean, list(v ORDER BY v) AS vals FROM (" + _BY + ") GROUP BY 1")
def ser_by_order(t):
    s = _monthly(t)
    flat = Series(s.df, "d", "v")
    got = flat.by_order("sum").withColumnRenamed("v", "total").join(flat.by_order("mean").withColumnRenamed("v", "mean"), "d")
    return got.join(flat.by_order("list").withColumnRenamed("v", "vals"), "d")


@query(f"SELECT p, d, v, 'first' AS part FROM ({_N}) WHERE d <= low + INTERVAL 1 YEAR UNION ALL SELECT p, d, v, 'last' FROM ({_N}) WHERE d >= high - INTERVAL 1 YEAR UNION ALL SELECT p, d, v, 'inner' FROM ({_N}) WHERE d BETWEEN low + 100 AND high - 50")
def ser_years(t):
    s = _monthly(t)
    parts = {"first": s.first_year(), "last": s.last_year(), "inner": s.crop_days(100, 50)}
    return parts["first"].withColumn("part", F.lit("first")).unionByName(parts["last"].withColumn("part", F.lit("last"))).unionByName(parts["inner"].withColumn("part", F.lit("inner")))


@query(f"SELECT p, CAST(date_trunc('year', d) AS DATE) AS d, avg(v) AS v FROM ({_BY}) GROUP BY 1, 2")
def ser_round_to(t):
    return _monthly(t).round_to("year")


@query(f"SELECT p, d + 10 AS shifted, CAST(d + INTERVAL 1 YEAR AS DATE) AS later, ((year(d) - 2010) * 12 + month(d))::BIGINT AS month_no, round(year(d) + (dayofyear(d) - 1) / 365, 9) AS years, year(d) AS y, v FROM ({_BY})")
def ser_dates_mapped(t):
    s = _monthly(t)
    key = lambda df, name: df.select("p", F.col("d").alias(name), "v")
    base = s.df.select("p", "v", F.col("d").alias("at"))
    out = key(s.shift_dates(10), "shifted").withColumn("at", F.date_sub("shifted", 10))
    out = out.join(key(s.yearly_shift(), "later").drop("v").withColumn("at", F.add_months("later", -12)), ["p", "at"]).join(base.drop("v"), ["p", "at"])
    ints = s.to_int("month").select("p", big(F.col("d")).alias("month_no")).withColumn("at", F.add_months(F.lit(datetime.date(2009, 12, 1)), F.col("month_no").cast("int")))
    years = s.to_years(decimal=False)
    assert dict(years.dtypes)["d"] == "int"
    decimal = s.with_df(s.df.withColumn("at", F.col("d"))).to_years().select("p", "at", F.round("d", 9).alias("years"))
    return out.join(ints, ["p", "at"]).join(decimal, ["p", "at"]).withColumn("y", big(F.year("at"))).drop("at")


@query(f"WITH b AS (SELECT p, min(d) AS lo, max(d) AS hi FROM ({_BY}) GROUP BY 1), y AS (SELECT p, min(d) AS lo, max(d) AS hi FROM ({_BY}) WHERE d BETWEEN DATE '1995-05-01' AND DATE '1997-02-01' GROUP BY 1) SELECT b.p, greatest(b.lo, y.lo) AS first, least(b.hi, y.hi) AS last FROM b JOIN y USING (p)")
def ser_mutual_borders(t):
    s = _monthly(t)
    return s.mutual_borders(s.with_df(s.span(datetime.date(1995, 5, 1), datetime.date(1997, 2, 1))))


@query(f"SELECT p, d, abs(date_diff('day', DATE '1996-07-04', d)) AS fixed, (SELECT min(abs(date_diff('day', x.d, y.d))) FROM ({_BY}) y WHERE y.p = x.p AND month(y.d) IN (1, 8)) AS nearest FROM ({_BY}) x")
def ser_distance(t):
    s = _monthly(t)
    some = s.with_df(s.df.filter(F.month("d").isin(1, 8)))
    return big_column(s.distance(datetime.date(1996, 7, 4), name="fixed").join(s.distance(some, name="nearest"), ["p", "d"]), "fixed", "nearest")


_ASKED = f"SELECT p, d + 9 AS q FROM ({_BY})"


def _asked(s: Series):
    return s.df.select("p", F.date_add("d", 9).alias("q"))


@query(f"WITH k AS ({_BY}), a AS ({_ASKED}) SELECT a.p, a.q, k0.d AS k0, k0.v AS v0, k1.d AS k1, k1.v AS v1 FROM a ASOF LEFT JOIN k k0 ON a.p = k0.p AND a.q >= k0.d ASOF LEFT JOIN k k1 ON a.p = k1.p AND a.q <= k1.d")
def ser_two_nearest(t):
    s = _monthly(t)
    return series.brackets(s, _asked(s), "q")


@query(f"WITH k AS ({_BY}), a AS ({_ASKED}) SELECT a.p, a.q, round(CASE WHEN k1.d IS NULL THEN k0.v ELSE k0.v + (k1.v - k0.v) * date_diff('day', k0.d, a.q) / date_diff('day', k0.d, k1.d) END, 9) AS value FROM a ASOF LEFT JOIN k k0 ON a.p = k0.p AND a.q >= k0.d ASOF LEFT JOIN k k1 ON a.p = k1.p AND a.q <= k1.d")
def ser_value_at(t):
    s = _monthly(t)
    return series.value_at(s, _asked(s), "q").withColumn("value", F.round("value", 9))


@query(f"WITH k AS ({_BY}), g AS (SELECT p, CAST(unnest(generate_series(CAST(date_trunc('week', lo) AS DATE), hi, INTERVAL 7 DAY)) AS DATE) AS d FROM (SELECT p, min(d) AS lo, max(d) AS hi FROM k GROUP BY 1)) SELECT g.p, g.d, round(CASE WHEN k0.d IS NULL THEN k1.v WHEN k1.d IS NULL OR k0.d = k1.d THEN k0.v ELSE k0.v + (k1.v - k0.v) * date_diff('day', k0.d, g.d) / date_diff('day', k0.d, k1.d) END, 9) AS v FROM g ASOF LEFT JOIN k k0 ON g.p = k0.p AND g.d >= k0.d ASOF LEFT JOIN k k1 ON g.p = k1.p AND g.d <= k1.d")
def ser_resample(t):
    return series.resample(_monthly(t), "week").withColumn("v", F.round("v", 9))


@query(f"WITH k AS ({_BY}), e AS (SELECT p, max(d) AS hi FROM k GROUP BY 1), g AS (SELECT p, hi, CAST(unnest(generate_series(hi, hi + INTERVAL 18 MONTH, INTERVAL 1 MONTH)) AS DATE) AS d FROM e), a AS (SELECT *, CASE WHEN d <= hi + INTERVAL 12 MONTH THEN 1 ELSE 2 END AS y FROM g WHERE d > hi AND d <= DATE '2003-01-01') SELECT a.p, a.d, round(k.v * pow(1.1, a.y), 6) AS v FROM a JOIN k ON k.p = a.p AND k.d = CAST(a.d - to_years(a.y) AS DATE) WHERE a.d <= a.hi + INTERVAL 18 MONTH")
def ser_extrapolate(t):
    s = _monthly(t)
    ends = s.borders().withColumnRenamed("last", "hi")
    got = series.extrapolate_by_yoy(s, 0.1, datetime.date(2003, 1, 1)).withColumn("v", F.round("v", 6))
    return got.join(ends.select("p", "hi"), "p").filter(F.col("d") <= F.add_months("hi", 18)).select("p", "d", "v")


@query(f"WITH k AS ({_BY}), w AS (SELECT p, d, v, lead(d) OVER o AS d1, lead(v) OVER o AS v1, lag(d) OVER o AS d0, lag(v) OVER o AS v0 FROM k WINDOW o AS (PARTITION BY p ORDER BY d)) SELECT p, d, round((CASE WHEN d0 IS NULL THEN v WHEN d - 10 <= d0 THEN v0 ELSE v0 + (v - v0) * (date_diff('day', d0, d) - 10) / date_diff('day', d0, d) END + v + CASE WHEN d1 IS NULL THEN v ELSE v + (v1 - v) * 10 / date_diff('day', d, d1) END) / 3, 6) AS value FROM w")
def ser_interpolated_windows(t):
    return series.interpolated_windows(_monthly(t), [-10, 0, 10], arrays.array_mean).withColumn("value", F.round("value", 6))


@query(f"WITH k AS ({_BY}), b AS (SELECT p, min(d) AS lo, max(d) AS hi FROM k GROUP BY 1), a AS (SELECT p, DATE '2003-03-15' AS q, lo, hi FROM b), c AS (SELECT a.p, q, CAST(q - to_years(y::INT) AS DATE) AS day, y FROM a, range(0, 14) r(y) WHERE q - to_years(y::INT) BETWEEN lo AND hi) SELECT p, q, first(d ORDER BY y, gap, d) AS base FROM (SELECT c.p, c.q, c.y, k.d, abs(date_diff('day', c.day, k.d)) AS gap FROM c JOIN k ON k.p = c.p) WHERE gap <= 31 GROUP BY 1, 2")
def ser_base_dates(t):
    s = _monthly(t)
    asked = s.borders().select("p", F.lit(datetime.date(2003, 3, 15)).alias("q"))
    return series.base_dates(s, asked, "q")


@query(f"WITH k AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS d, COUNT(*)::DOUBLE AS v FROM orders GROUP BY 1), e AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS q, COUNT(*)::DOUBLE AS b FROM orders GROUP BY 1), i AS (SELECT e.q, e.b, CASE WHEN k1.d IS NULL OR k0.d = k1.d THEN k0.v ELSE k0.v + (k1.v - k0.v) * date_diff('day', k0.d, e.q) / date_diff('day', k0.d, k1.d) END AS lin, k0.d AS d0, k1.d AS d1 FROM e ASOF LEFT JOIN k k0 ON e.q >= k0.d ASOF LEFT JOIN k k1 ON e.q <= k1.d) SELECT q, round(CASE WHEN base <> 0 THEN lin * b / base END, 6) AS value FROM (SELECT i.*, CASE WHEN d1 IS NULL OR d0 = d1 THEN b0.b ELSE b0.b + (b1.b - b0.b) * date_diff('day', d0, i.q) / date_diff('day', d0, d1) END AS base FROM i LEFT JOIN e b0 ON b0.q = i.d0 LEFT JOIN e b1 ON b1.q = i.d1)")
def ser_weighted(t):
    count = lambda scale, name: t("orders").groupBy(F.trunc("o_orderdate", scale).alias(name)).agg(many().cast("double").alias("v"))
    yearly, monthly = Series(count("year", "d"), "d", "v"), Series(count("month", "d"), "d", "v")
    asked = monthly.df.select(F.col("d").alias("q"))
    return series.weighted_interpolation(yearly, monthly, asked, "q").withColumn("value", F.round("value", 6))
