"""Queries over series that no single task holds: scans by blocks, as-of joins and runs without a key, over whole tables."""

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational, scan, series
from tessera.operators.quantiles import quantiles
from tessera.operators.series import Series
from tessera.plans.catalogue import _BY, _monthly, many, query
from tessera.sources.buckets import merge_join, write_bucketed

_LINES = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey"
_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


@query(f"SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER ({_LINES} ROWS UNBOUNDED PRECEDING) AS cumulated, max(l_extendedprice) OVER ({_LINES} ROWS UNBOUNDED PRECEDING) AS record, count(*) OVER ({_LINES} ROWS UNBOUNDED PRECEDING) AS n FROM lineitem")
def scan_running(t):
    """Running sums, records and numbers over all lines, without a key."""
    rows = t("lineitem").select(*_ORDER, "l_quantity", "l_extendedprice")
    got = scan.Blocks(rows, (), _ORDER).running({"cumulated": ("sum", F.col("l_quantity")), "record": ("max", F.col("l_extendedprice")), "n": ("sum", F.lit(1).cast("long"))})
    return got.df.select("l_orderkey", "l_linenumber", "l_quantity", "cumulated", "record", "n")


@query(f"SELECT run, l_returnflag, COUNT(*) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, MIN(l_shipdate) AS first_ship FROM (SELECT *, sum(c) OVER ({_LINES} ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, CASE WHEN l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER ({_LINES}) THEN 1 ELSE 0 END AS c FROM lineitem)) GROUP BY 1, 2")
def scan_group_runs(t):
    """Runs of equal return flags in order of shipping, without a key."""
    rows = t("lineitem").select(*_ORDER, "l_returnflag", "l_extendedprice")
    return scan.group_runs(rows, ["l_returnflag"], _ORDER, n=many(), total=F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), first_ship=F.min("l_shipdate"))


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS p, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 OR event_type IS DISTINCT FROM p")
def scan_uniq(t):
    return relational.uniq(t("events"), ["event_type"], ["ts", "event_id"]).select("event_id", "event_type")


@query(f"SELECT l_orderkey, l_linenumber, lag(l_quantity, 2) OVER w AS two_back, lead(l_quantity) OVER w AS next, avg(l_quantity) OVER (PARTITION BY l_returnflag {_LINES} ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS mean FROM lineitem WINDOW w AS (PARTITION BY l_returnflag {_LINES})")
def scan_neighbours(t):
    """Neighbours and moving means in three long series, cut into blocks."""
    rows = t("lineitem").select(*_ORDER, "l_returnflag", "l_quantity")
    got = scan.Blocks(rows, ("l_returnflag",), _ORDER).near(3, 1, {"two_back": lambda w: F.lag("l_quantity", 2).over(w), "next": lambda w: F.lead("l_quantity").over(w), "mean": lambda w: F.avg("l_quantity").over(w.rowsBetween(-3, 1))})
    return got.df.select("l_orderkey", "l_linenumber", "two_back", "next", "mean")


@query("WITH k AS (SELECT ts, event_id, value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL), l AS (SELECT ts, max(value) AS v FROM k GROUP BY 1) SELECT e.event_id, k0.ts AS k0, k0.v AS v0, k1.ts AS k1 FROM (SELECT event_id, ts FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN l k0 ON e.ts >= k0.ts ASOF LEFT JOIN l k1 ON e.ts <= k1.ts")
def scan_asof(t):
    """The purchases around every other event: one series without a key."""
    events = t("events")
    known = Series(events.filter(F.col("event_type") == "purchase"), "ts", "value")
    asked = events.filter(F.col("event_type") != "purchase").select("event_id", F.col("ts").alias("at"))
    return series.brackets(known, asked, "at").select("event_id", "k0", "v0", "k1")


@query(f"SELECT p, d, v, sum(v) OVER w AS cumulated, lag(v, 3, 0.0) OVER (PARTITION BY p ORDER BY d) AS shifted FROM ({_BY}) WINDOW w AS (PARTITION BY p ORDER BY d ROWS UNBOUNDED PRECEDING)")
def scan_hot_series(t):
    """Keyed series cut into blocks, as hot ones are."""
    s = _monthly(t)
    split = lambda df: Series(df, s.order, s.value, s.by, split=True)
    return split(split(s.df).cumulated()).shift(3, 0.0)


_KNOWN = "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, COUNT(*)::DOUBLE AS v FROM orders GROUP BY 1, 2"


@query(f"WITH k AS ({_KNOWN}), a AS (SELECT p, CASE WHEN month(d) = 3 THEN NULL ELSE d + 9 END AS q FROM k UNION ALL SELECT p, d + 9 FROM k WHERE month(d) < 3), n AS (SELECT COALESCE(p, '') AS p, d, v FROM k) SELECT a.p, a.q, k0.d AS nearest_before FROM a ASOF LEFT JOIN n k0 ON COALESCE(a.p, '') = k0.p AND a.q >= k0.d")
def ser_asked_rows(t):
    """Rows asked for twice, null series keys and null dates: all stay."""
    s = _monthly(t)
    s = s.with_df(s.df.withColumn("p", F.when(F.col("p") != "1-URGENT", F.col("p"))))
    asked = s.df.select("p", F.when(F.month("d") != 3, F.date_add("d", 9)).alias("q")).unionByName(s.df.filter(F.month("d") < 3).select("p", F.date_add("d", 9).alias("q")))
    return series.brackets(s, asked, "q").select("p", "q", F.col("k0").alias("nearest_before"))


@query(f"WITH k AS ({_BY}), b AS (SELECT p, min(d) AS lo, max(d) AS hi FROM k GROUP BY 1), a AS (SELECT p, DATE '2003-03-15' AS q, lo, hi FROM b UNION ALL SELECT p, DATE '2003-03-15', lo, hi FROM b UNION ALL SELECT p, NULL, lo, hi FROM b), c AS (SELECT DISTINCT a.p, q, CAST(q - to_years(y::INT) AS DATE) AS day FROM a, range(0, 14) r(y) WHERE q - to_years(y::INT) BETWEEN lo AND hi), f AS (SELECT p, q, max(day) AS day FROM c GROUP BY 1, 2), g AS (SELECT f.p, f.q, f.day, first(k.d ORDER BY abs(date_diff('day', f.day, k.d)), k.d) AS base FROM f JOIN k USING (p) GROUP BY 1, 2, 3) SELECT a.p, a.q, g.base, round(date_diff('day', g.base, a.q) / 365)::INT AS years FROM a LEFT JOIN g ON g.p = a.p AND g.q = a.q")
def ser_base_dates_far(t):
    """No date lies within 0 days: the nearest one counts all the same. Rows asked for twice or with a null date stay."""
    s = _monthly(t)
    one = s.borders().select("p", F.lit(datetime.date(2003, 3, 15)).alias("q"))
    asked = one.unionByName(one).unionByName(one.withColumn("q", F.lit(None).cast("date")))
    return series.base_dates(s, asked, "q", within=0, increment="years")


@query("SELECT l_returnflag AS p, CAST(l_shipdate AS DATE) AS d, l_orderkey, l_linenumber, avg(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY CAST(l_shipdate AS DATE) RANGE BETWEEN INTERVAL 15 DAY PRECEDING AND INTERVAL 15 DAY FOLLOWING) AS smoothed FROM lineitem")
def ser_smooth_days_rows(t):
    """A range of days over series with many rows a day: days are summed before windows see them."""
    rows = t("lineitem").select(F.col("l_returnflag").alias("p"), F.to_date("l_shipdate").alias("d"), "l_orderkey", "l_linenumber", "l_quantity")
    return Series(rows, "d", "l_quantity", ("p",)).smooth_days(30).drop("l_quantity")


@query("SELECT l_returnflag, median(l_extendedprice) AS middle, quantile_cont(l_extendedprice, 0.25) AS low, quantile_cont(l_extendedprice, 0.9) AS high FROM lineitem GROUP BY 1")
def group_exact_quantiles(t):
    """Exact quantiles of three hot groups, by selection: lists of 1,000 values at most."""
    return quantiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", {"middle": 0.5, "low": 0.25, "high": 0.9}, rest=1000)


@query("SELECT median(value) AS middle, quantile_cont(value, 0.99) AS high FROM events")
def exact_quantiles_of_all(t):
    return quantiles(t("events"), [], "value", {"middle": 0.5, "high": 0.99}, rest=100)


@query("SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) - 1 AS n, l_partkey, l_quantity FROM lineitem")
def group_fold_parts(t):
    """Three hot keys folded in parts of 1,000 rows and unfolded in order."""
    rows = t("lineitem").select("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").alias("line"), "l_partkey", "l_quantity")
    parts = relational.group_fold_parts(rows, ["l_returnflag"], ["l_partkey", "l_quantity"], "line", size=1000)
    return relational.unfold_parts(parts, ["l_partkey", "l_quantity"], size=1000)


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def merge_join_buckets(t):
    """Orders with their lines from two bucketed tables: neither side moves for the join."""
    spark = SparkSession.active()
    left = write_bucketed(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 16)
    right = write_bucketed(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity"), "o_orderkey", 16)
    return merge_join(spark, left, right, "o_orderkey")


@query("SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1")
def merge_join_grouped(t):
    """The last order of each customer and their number, from one bucketed table: groups and the join follow its buckets."""
    spark = SparkSession.active()
    orders = write_bucketed(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", 16)
    return merge_join(spark, orders, orders, "o_custkey", "inner", right_is_uniq=True, last_by="o_orderkey").groupBy("o_custkey").agg(many().alias("n"), F.max("o_orderkey").alias("last"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity >= 20 THEN (l_quantity - 20) % 7 ELSE l_quantity % 3 END AS left_over FROM lineitem")
def udf_map_batches(t):
    """A function over whole columns, a batch at a time."""

    def run(b: pa.RecordBatch) -> pa.Table:
        q = b.column("l_quantity").to_numpy()
        return pa.table({c: b.column(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")} | {"left_over": np.where(q >= 20, (q - 20) % 7, q % 3)})

    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return relational.map_batches(rows, run, "l_orderkey long, l_linenumber int, l_partkey long, left_over double")
