"""One query for each operator, with the DuckDB SQL of the same result. Queries read whole tables."""

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import arrays, basic, dates, numeric, text
from tessera.operators import profile, relational, series
from tessera.operators.terms import Term, degrees, edges
from tessera.sources import schema
from tessera.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers function(t), where t(name) reads a table, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def money(c):
    """Sums of money in decimals, so that their order does not matter."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def many(c=None):
    return F.count(F.lit(1) if c is None else c)


big = lambda c: c.cast("bigint")


# Flagship and projections


@query("SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS mean_price FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 10 GROUP BY c_mktsegment")
def flagship_segment_stats(t):
    rows = t("lineitem").filter("l_quantity >= 10").select("l_orderkey", "l_extendedprice")
    rows = rows.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rows = rows.join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("c_mktsegment").agg(many().alias("n"), money("l_extendedprice").alias("revenue")).withColumn("mean_price", F.col("revenue") / F.col("n"))


@query("SELECT * FROM nation")
def scan_nation(t):
    return t("nation")


@query("SELECT l_orderkey AS order_id, l_linenumber AS line, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def select_alias_expr(t):
    return relational.select(t("lineitem"), order_id="l_orderkey", line="l_linenumber", net=(lambda p, d: F.col(p) * (1 - F.col(d)), "l_extendedprice", "l_discount"))


@query("SELECT o_orderkey, a, a * 2 AS b, a * 2 + 1 AS c FROM (SELECT o_orderkey, o_custkey + 1 AS a FROM orders)")
def select_sequential(t):
    return relational.select(t("orders"), "o_orderkey", c=("b", lambda b: F.col(b) + 1), b=("a", lambda a: F.col(a) * 2), a=("o_custkey", lambda k: F.col(k) + 1))


@query("SELECT *, p_size * 2 AS double_size FROM part")
def select_star_add(t):
    return relational.select(t("part"), "*", double_size=("p_size", lambda c: F.col(c) * 2))


@query("SELECT * EXCLUDE (p_retailprice, p_type) FROM part")
def select_drop(t):
    return relational.select(t("part"), "*", "-p_retailprice", "-p_type")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30")
def filter_eq_and_callable(t):
    return relational.where(t("lineitem"), l_returnflag="R", l_quantity=lambda c: basic.at_least(c, 30)).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount <> 0")
def filter_truthy_field(t):
    return relational.where(t("lineitem"), "l_discount").select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_in(t):
    return t("orders").filter(basic.is_in("o_orderstatus", ["F", "P"])).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def filter_not_in(t):
    return t("orders").filter(basic.not_in("o_orderstatus", ["F", "P"])).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size > 5 AND p_size < 15")
def filter_between_excl(t):
    return t("part").filter(basic.between("p_size", 5, 15)).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT (o_orderpriority = '1-URGENT' OR o_totalprice > 300000)")
def filter_logic(t):
    return t("orders").filter(basic.always(basic.maybe(basic.equal("o_orderstatus", "F"), basic.more_than("o_totalprice", 100000)), basic.never(basic.equal("o_orderpriority", "1-URGENT"), basic.more_than("o_totalprice", 300000)))).select("o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders")
def enumerate_orders(t):
    return big_column(relational.enumerate_rows(t("orders").select("o_orderkey"), "o_orderkey", field="n"), "n")


@query("SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n FROM lineitem")
def enumerate_lineitem(t):
    return big_column(relational.enumerate_rows(t("lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", field="n"), "n")



def big_column(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# Joins

@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def join_inner(t):
    right = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return relational.join(t("customer").select("c_custkey", "c_name"), right, "c_custkey", "inner")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def join_left(t):
    right = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return relational.join(t("customer").select("c_custkey", "c_name"), right, "c_custkey", "left")


@query("SELECT o_custkey AS c_custkey, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') RIGHT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def join_right(t):
    right = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return relational.join(t("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name"), right, "c_custkey", "right")


@query("SELECT COALESCE(c_custkey, o_custkey) AS c_custkey, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def join_full(t):
    right = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return relational.join(t("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name"), right, "c_custkey", "full")


@query("SELECT a.id, COALESCE(b.k, a.k) AS k, b.o_orderkey FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS k FROM customer) a JOIN (SELECT DISTINCT CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey FROM orders WHERE o_orderkey % 40 = 0) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(t):
    left = t("customer").select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END").alias("k"))
    right = t("orders").filter("o_orderkey % 40 = 0").select(F.expr("CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END").alias("k"), "o_orderkey")
    return relational.join(left, right, "k", "inner")


@query("SELECT n_nationkey AS k, CASE WHEN s.k IS NULL THEN n_name ELSE s.name END AS name, s.balance FROM nation LEFT JOIN (SELECT s_nationkey AS k, MAX(s_name) AS name, MAX(s_acctbal) AS balance FROM supplier WHERE s_nationkey < 12 GROUP BY 1) s ON n_nationkey = s.k")
def join_overwrite(t):
    right = t("supplier").filter("s_nationkey < 12").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("name"), F.max("s_acctbal").alias("balance"))
    return relational.join(t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), right, "k", "left", map_side=True)


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON c_custkey = o_custkey")
def join_right_uniq_last(t):
    right = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return relational.join(t("customer").select("c_custkey", "c_name"), right, "c_custkey", "left", right_is_uniq=True, last_by="o_orderkey")


@query("SELECT c_custkey, c_name, NULL::BIGINT AS o_orderkey FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') UNION ALL SELECT o_custkey, NULL, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING')")
def join_xor(t):
    right = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return relational.join(t("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name"), right, "c_custkey", "xor")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t):
    return relational.semi(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", anti=True)


# Groups


@query("SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS mean_quantity, MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship, median(l_quantity) AS median_quantity, COUNT(*) AS n FROM lineitem GROUP BY 1")
def group_sum_avg_min_max_median(t):
    return t("lineitem").groupBy("l_returnflag").agg(money("l_extendedprice").alias("total"), (money("l_quantity") / many()).alias("mean_quantity"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.median("l_quantity").alias("median_quantity"), many().alias("n"))


@query("SELECT o_orderpriority, COUNT(DISTINCT k) + MAX(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS n_uniq FROM (SELECT o_orderpriority, nullif(o_custkey % 10, 0) AS k FROM orders) GROUP BY 1")
def group_count_uniq(t):
    rows = t("orders").select("o_orderpriority", F.nullif(F.col("o_custkey") % 10, F.lit(0)).alias("k"))
    return rows.groupBy("o_orderpriority").agg(big(numeric.count_uniq("k")).alias("n_uniq"))


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n, l_partkey, l_suppkey FROM lineitem")
def group_fold_unfold(t):
    folded = relational.group_fold(t("lineitem"), ["l_orderkey"], ["l_partkey", "l_suppkey"], "l_linenumber")
    return big_column(relational.unfold(folded, ["l_partkey", "l_suppkey"]), "n")


@query("SELECT user_id, run, event_type, COUNT(*) AS n FROM (SELECT *, SUM(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS c FROM events)) GROUP BY 1, 2, 3")
def group_runs(t):
    runs = relational.run_id(t("events"), ["event_type"], ["ts", "event_id"], ("user_id",))
    return big_column(runs.groupBy("user_id", "run", "event_type").agg(many().alias("n")), "run")


@query("SELECT l_returnflag, l_linestatus, CAST(SUM(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY 1, 2")
def sum_by_keys(t):
    return relational.sum_by_keys(t("lineitem"), ["l_returnflag", "l_linestatus"], ["l_linenumber"])


@query("SELECT o_custkey, arg_min(k, o_orderkey) FILTER (k <> 0) AS k FROM (SELECT *, o_orderkey % 4 AS k FROM orders) GROUP BY 1")
def first_values(t):
    return relational.first_values(t("orders").withColumn("k", F.col("o_orderkey") % 4), ["k"], "o_orderkey", ("o_custkey",))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def uniq_consecutive(t):
    return relational.uniq(t("events"), ["event_type"], ["ts", "event_id"], ("user_id",)).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def uniq_everywhere(t):
    return relational.uniq(t("events"), ["user_id", "event_type"], ["ts", "event_id"], everywhere=True).select("event_id", "user_id", "event_type")


@query("SELECT l_returnflag, CAST(ROUND(corr(l_quantity, l_extendedprice), 9) AS DOUBLE) AS r, CAST(ROUND(var_pop(l_quantity), 6) AS DOUBLE) AS v FROM lineitem GROUP BY 1")
def corr_var(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(numeric.corr("l_quantity", "l_extendedprice"), 9).alias("r"), F.round(numeric.var("l_quantity"), 6).alias("v"))


#: The tail beyond |t| by Simpson's rule, over a unit interval that stands for all of it.
_T_TEST = """
    WITH g AS (SELECT event_type, count(value) AS n, (avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))) AS t FROM events GROUP BY 1),
    i AS (SELECT event_type, y, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w, n - 1 AS v, abs(t) + y / (1 - y) AS x FROM g, (SELECT i, i / 4001 AS y FROM range(0, 4001) r(i))),
    p AS (SELECT event_type, 2 * sum(w * exp(lgamma((v + 1) / 2) - lgamma(v / 2) - (v + 1) / 2 * ln(1 + x * x / v)) / sqrt(v * pi()) / ((1 - y) * (1 - y))) / 4001 / 3 AS p FROM i GROUP BY 1)
    SELECT event_type, round(t, 6) AS t, n, round(p, 6) AS p, round(greatest(CASE WHEN p > 0 THEN log10(p) ELSE -10 END, -10) * sign(t), 4) AS log_p FROM g JOIN p USING (event_type)"""


@query(_T_TEST)
def t_test(t):
    """The p-value of Student's t of each event type's values against 50."""
    rows = t("events").groupBy("event_type").agg(numeric.t_statistic("value", 50).alias("t"), many("value").alias("n"))
    out = rows.withColumn("p", numeric.p_value("t", "n")).withColumn("log_p", numeric.p_log_sign("p", "t"))
    return out.withColumns({c: F.round(c, d) for c, d in (("t", 6), ("p", 6), ("log_p", 4))})


# Order


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")
def sort_desc_take(t):
    return relational.sort(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", reverse=True).limit(20)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
def skip_offset(t):
    return relational.skip(t("orders").select("o_orderkey"), 100, "o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def tail(t):
    return relational.take(t("orders").select("o_orderkey"), -10, "o_orderkey")


@query("SELECT l_partkey, CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, l_partkey LIMIT 10")
def top_n_by(t):
    return relational.top_n_by(t("lineitem"), "l_partkey", "l_linenumber", 10)


# Sets and splits


@query("SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier")
def union_add(t):
    return relational.union(t("customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")), t("supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@query("SELECT c_custkey AS k, c_acctbal AS a, 0.0::DOUBLE AS b, 1 AS dataset FROM customer UNION ALL SELECT s_suppkey, 0.0::DOUBLE, s_acctbal, 2 FROM supplier")
def stack_missing_cols(t):
    return relational.stack({1: t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("a")), 2: t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("b"))})


@query("SELECT part, COUNT(*) AS n, MIN(o_orderkey) AS first_key FROM (SELECT o_orderkey, CASE WHEN n < 100 THEN 0 WHEN n < 250 THEN 1 ELSE 2 END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders)) GROUP BY 1")
def split_by_pos(t):
    parts = relational.split_by_positions(t("orders").select("o_orderkey"), [100, 250], "o_orderkey")
    return relational.union(*(p.withColumn("part", F.lit(i)) for i, p in enumerate(parts))).groupBy("part").agg(many().alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT o_totalprice > 150000 AS holds, COUNT(*) AS n FROM orders GROUP BY 1")
def split_by_func(t):
    no, yes = relational.split_by_condition(t("orders"), F.col("o_totalprice") > 150000)
    return relational.union(no.withColumn("holds", F.lit(False)), yes.withColumn("holds", F.lit(True))).groupBy("holds").agg(many().alias("n"))


@query("SELECT chunk, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high, COUNT(*) AS n FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS chunk FROM orders) GROUP BY 1")
def chunk_step(t):
    out = relational.chunks(t("orders").select("o_orderkey"), 64, "o_orderkey")
    return out.groupBy("chunk").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), many().alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity_sum AS DOUBLE) AS l_quantity_sum, l_quantity / l_quantity_sum AS l_quantity_share FROM (SELECT *, SUM(l_quantity) OVER (PARTITION BY l_orderkey) AS l_quantity_sum FROM lineitem)")
def add_sum_share(t):
    return relational.add_sum_share(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", ["l_orderkey"]).drop("l_quantity")


# Profiles


@query("SELECT field, value, COUNT(*) AS count, SUM(COUNT(*)) OVER (PARTITION BY field)::BIGINT AS total_count, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY field) AS share FROM (SELECT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY 1, 2")
def hist_status(t):
    return profile.hist(t("orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT c_mktsegment, 'o_orderstatus' AS field, o_orderstatus AS value, COUNT(*) AS count, SUM(COUNT(*)) OVER (PARTITION BY c_mktsegment)::BIGINT AS total_count, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY c_mktsegment) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus")
def hist_by_cat(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderstatus")
    return profile.hist(rows, "o_orderstatus", by=("c_mktsegment",))


@query("SELECT 'l_discount' AS field, COUNT(*) AS total_count, COUNT(l_discount) AS defined_count, COUNT(*) FILTER (l_discount <> 0) AS nonzero_count, COUNT(DISTINCT l_discount) AS uniq_count, COUNT(l_discount) / COUNT(*) AS defined_share, COUNT(*) FILTER (l_discount <> 0) / COUNT(*) AS nonzero_share FROM lineitem UNION ALL SELECT 'l_returnflag', COUNT(*), COUNT(l_returnflag), COUNT(*) FILTER (l_returnflag <> ''), COUNT(DISTINCT l_returnflag), COUNT(l_returnflag) / COUNT(*), COUNT(*) FILTER (l_returnflag <> '') / COUNT(*) FROM lineitem")
def stat_profile(t):
    return profile.stat(t("lineitem"), "l_discount", "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, measure, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem) UNPIVOT (value FOR measure IN (l_quantity, l_tax))")
def unpivot_measures(t):
    return profile.unpivot(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@query("WITH top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY COUNT(*) DESC, p_brand LIMIT 5) SELECT CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'other' END AS p_brand, COUNT(*) AS n FROM part GROUP BY 1")
def meld_other(t):
    return profile.meld_other(t("part").select("p_brand"), "p_brand", 5).groupBy("p_brand").agg(many().alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN '-10' WHEN p_size < 20 THEN '10-20' WHEN p_size < 40 THEN '20-40' ELSE '40+' END AS bin, GREATEST(LEAST(p_size, 30), 10) AS cropped FROM part")
def bin_value(t):
    return t("part").select("p_partkey", profile.bin_label("p_size", [10, 20, 40]).alias("bin"), profile.crop_value("p_size", 10, 30).alias("cropped"))


@query("SELECT l_returnflag, l_linestatus, CAST(SUM(l_linenumber) AS BIGINT) AS lines, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1, 2")
def aggregate_sums(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_linenumber").alias("lines"), money("l_quantity").alias("quantity"))


@query("SELECT o_orderstatus, m, SUM(n) OVER (PARTITION BY m ORDER BY o_orderstatus DESC)::BIGINT AS cumulated FROM (SELECT o_orderstatus, month(o_orderdate)::INTEGER AS m, COUNT(*) AS n FROM orders GROUP BY 1, 2)")
def cumulated_by_category(t):
    rows = t("orders").groupBy("o_orderstatus", F.month("o_orderdate").alias("m")).agg(many().alias("n"))
    return profile.cumulated_by(rows, "m", "o_orderstatus", "n").drop("n")


# Numbers and casts


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(trunc(l_extendedprice / 100) AS BIGINT) * 100 AS BIGINT) AS stepped, CASE WHEN l_discount > 0.05 THEN 1 WHEN l_discount < 0.05 THEN -1 ELSE 0 END AS s, CASE WHEN l_discount <> 0 THEN l_tax / l_discount ELSE -1 END AS ratio, CASE WHEN l_discount <> 0 AND l_tax <> 0 THEN (l_tax - l_discount) / l_discount END AS lifted, sqrt(l_quantity) AS root, abs(l_tax - l_discount) AS gap FROM lineitem")
def num_functions(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", numeric.round_to("l_extendedprice", 100).cast("bigint").alias("stepped"), F.when(F.col("l_discount") > 0.05, 1).when(F.col("l_discount") < 0.05, -1).otherwise(0).alias("s"), numeric.div("l_tax", "l_discount", -1.0).alias("ratio"), numeric.lift("l_discount", "l_tax").alias("lifted"), numeric.sqrt("l_quantity").alias("root"), numeric.diff("l_tax", F.col("l_discount"), absolute=True).alias("gap"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 WHEN c_acctbal < 0 THEN -1 WHEN c_acctbal = 0 THEN 0 END AS s, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) ELSE 0 END, 9) AS l, round_even(c_acctbal, 0) AS r FROM customer")
def num_sign_log_round(t):
    return t("customer").select("c_custkey", numeric.sign("c_acctbal").alias("s"), F.round(numeric.log("c_acctbal", default=0.0), 9).alias("l"), numeric.round_py("c_acctbal", 0).alias("r"))


@query("SELECT event_id, COALESCE(TRY_CAST(replace(replace(event_type, 'click', '12'), 'view', '7') AS INTEGER), 0) AS n, COALESCE(TRY_CAST(event_type AS DOUBLE), 0) AS d FROM events")
def cast_defaults(t):
    return t("events").select("event_id", basic.cast(F.replace(F.replace("event_type", F.lit("click"), F.lit("12")), F.lit("view"), F.lit("7")), "int").alias("n"), basic.cast("event_type", "double").alias("d"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'none' END AS status, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' ELSE 'other' END AS grp FROM orders")
def dict_and_groups(t):
    return t("orders").select("o_orderkey", basic.apply_dict("o_orderstatus", {"F": "done", "O": "open"}, "none").alias("status"), basic.detect_group("o_orderpriority", {"soon": ["1-URGENT", "2-HIGH"]}).alias("grp"))


# Text


@query("SELECT p_partkey, starts_with(p_name, 'a') AS a, ends_with(p_type, 'L') AS l, contains(p_name, 'e') AS e, CASE WHEN length(p_name) > 8 THEN substring(p_name, 1, 6) || '..' ELSE p_name END AS cropped FROM part")
def text_tests(t):
    return t("part").select("p_partkey", text.startswith("p_name", "a").alias("a"), text.endswith("p_type", "L").alias("l"), text.contains("p_name", "e").alias("e"), text.crop("p_name", 8).alias("cropped"))


@query("SELECT doc_id, trim(regexp_replace(replace(regexp_replace(translate(lower(text), chr(9) || 'ё', ' е'), '[^a-zа-я ]', '', 'g'), chr(10), ' '), ' {2,}', ' ', 'g'), ' ') AS norm FROM documents")
def norm_text(t):
    return t("documents").select("doc_id", text.norm_text("text").alias("norm"))


# Dates

_D = "CAST(o_orderdate AS DATE)"
_MONDAY = f"CAST(date_trunc('week', date_trunc('year', {_D})) AS DATE)"
_WEEK = f"(date_diff('day', {_MONDAY}, {_D}) // 7)"


@query(f"SELECT o_orderkey, CAST(date_trunc('month', {_D}) AS DATE) AS m, CAST(date_trunc('week', {_D}) AS DATE) AS w, CAST(date_trunc('year', {_D}) AS DATE) AS y, CAST({_D} + INTERVAL 1 MONTH AS DATE) AS next_month, CAST({_D} - INTERVAL 14 DAY AS DATE) AS two_weeks_before, strftime({_D}, '%d.%m.%Y') AS gost, date_diff('day', DATE '2000-01-01', {_D}) AS days FROM orders")
def date_rounding(t):
    d = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", dates.round_date(d, "month").alias("m"), dates.round_date(d, "week").alias("w"), dates.round_date(d, "year").alias("y"), dates.next_date(d, "month").alias("next_month"), dates.next_date(d, "week", -2).alias("two_weeks_before"), dates.to_gost(d).alias("gost"), big(dates.days_between(F.lit(datetime.date(2000, 1, 1)), d)).alias("days"))


@query(f"SELECT o_orderkey, date_diff('day', DATE '2009-12-28', {_D}) AS d, (year({_D}) - 2010) * 12 + month({_D}) AS m, year({_D}) - 2010 AS y, CASE WHEN {_WEEK} >= 52 THEN (year({_D}) + 1 - 2010) * 52 ELSE (year({_D}) - 2010) * 52 + {_WEEK} END AS w FROM orders")
def date_absolutes(t):
    d = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", *(big(dates.date_to_int(d, s)).alias(s[0]) for s in ("day", "month", "year", "week")))


@query("SELECT o_orderpriority, CAST(unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS DATE) AS d FROM (SELECT o_orderpriority, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY 1)")
def date_range_grid(t):
    """The months from the first to the last order of each priority."""
    ends = t("orders").groupBy("o_orderpriority").agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))
    return ends.select("o_orderpriority", F.explode(dates.date_range(F.col("lo"), F.col("hi"), "month")).alias("d"))


# Arrays, JSON, CSV


@query("SELECT l_orderkey, len(list_distinct(a)) AS n_uniq, a[1] AS first, a[-1] AS last, COALESCE(a[3], -1) AS third, len(list_filter(a, lambda x: x % 2 = 1)) AS odd FROM (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1)")
def array_functions(t):
    rows = relational.group_fold(t("lineitem"), ["l_orderkey"], ["l_linenumber"], "l_linenumber")
    a = "l_linenumber"
    return rows.select("l_orderkey", big(F.size(arrays.uniq(a))).alias("n_uniq"), arrays.first(a).alias("first"), arrays.last(a).alias("last"), arrays.elem_no(a, 2, -1).alias("third"), big(F.size(F.filter(a, lambda x: x % 2 == 1))).alias("odd"))


@query("SELECT vec_id, CAST(e[1] AS DOUBLE) AS head, len(list_filter(e, lambda x: x > 0)) AS n_positive, CAST(e[2] AS DOUBLE) AS shifted FROM (SELECT vec_id, embedding AS e FROM embeddings)")
def array_shift(t):
    e = "embedding"
    return t("embeddings").select("vec_id", arrays.first(e).cast("double").alias("head"), big(F.size(F.filter(e, lambda x: x > 0))).alias("n_positive"), F.get(arrays.shift_right(e, -1, F.lit(0).cast("float")), 0).cast("double").alias("shifted"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_loads(t):
    return t("events").select("event_id", text.json_loads("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, concat_ws(chr(9), event_id, event_type, user_id) AS line FROM events")
def csv_dumps(t):
    return t("events").select("event_id", text.csv_dumps("event_id", "event_type", "user_id").alias("line"))


# Series

_DAYS = "SELECT CAST(o_orderdate AS DATE) AS d, COUNT(*)::DOUBLE AS v FROM orders GROUP BY 1"
_BY = "SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, COUNT(*)::DOUBLE AS v FROM orders GROUP BY 1, 2"


def _monthly(t) -> series.Series:
    df = t("orders").groupBy(F.col("o_orderpriority").alias("p"), F.trunc("o_orderdate", "month").alias("d")).agg(many().cast("double").alias("v"))
    return series.Series(df, "d", "v", ("p",))


@query(f"SELECT p, d, v, avg(v) OVER (PARTITION BY p ORDER BY d ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed FROM ({_BY})")
def ser_smooth(t):
    return _monthly(t).smooth()


@query(f"SELECT p, d, v, CASE WHEN n <= 1 OR n > c - 1 THEN v ELSE s / 3 END AS smoothed FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d) AS n, count(*) OVER (PARTITION BY p) AS c, sum(v) OVER (PARTITION BY p ORDER BY d ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM ({_BY}))")
def ser_smooth_simple(t):
    return _monthly(t).smooth_simple(3)


@query(f"SELECT p, d, v, COALESCE((v > a AND v >= b) OR (v < a AND v <= b), false) AS extreme FROM (SELECT *, lag(v) OVER (PARTITION BY p ORDER BY d) AS a, lead(v) OVER (PARTITION BY p ORDER BY d) AS b FROM ({_BY}))")
def ser_extremes(t):
    return _monthly(t).mark_extremes()


@query(f"WITH x AS (SELECT *, lag(v, 2) OVER w AS a, lag(v) OVER w AS b, lead(v) OVER w AS c, lead(v, 2) OVER w AS e FROM ({_BY}) WINDOW w AS (PARTITION BY p ORDER BY d)), y AS (SELECT *, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(e, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (e IS NOT NULL)::INT, 0) AS s FROM x) SELECT p, d, v, COALESCE(v > b AND v >= c, false) AND COALESCE(abs(CASE WHEN s <> 0 THEN (v - s) / s END) > 0.3, false) AS spike FROM y")
def ser_spikes(t):
    return _monthly(t).mark_spikes(0.3)


@query(f"SELECT p, d, v, v - lead(v) OVER (PARTITION BY p ORDER BY d) AS derivative FROM ({_BY})")
def ser_derivative(t):
    return _monthly(t).derivative()


@query(f"SELECT p, min(d) AS first, max(d) AS last FROM ({_BY}) GROUP BY 1")
def ser_borders(t):
    return _monthly(t).borders()


@query(f"SELECT p, d, v, sum(v) OVER (PARTITION BY p ORDER BY d ROWS UNBOUNDED PRECEDING) AS cumulated FROM ({_BY})")
def ser_cumulated(t):
    return _monthly(t).cumulated()


@query(f"SELECT p, d, v, avg(v) OVER (PARTITION BY p ORDER BY d RANGE BETWEEN INTERVAL 45 DAY PRECEDING AND INTERVAL 45 DAY FOLLOWING) AS smoothed FROM ({_BY})")
def ser_span_days(t):
    return _monthly(t).smooth_days(90)


@query(f"WITH k AS ({_BY}), a AS (SELECT *, CAST(d - INTERVAL 1 YEAR AS DATE) AS y FROM k), i AS (SELECT a.p, a.d, a.v, CASE WHEN k0.d IS NULL OR k1.d IS NULL THEN NULL WHEN k0.d = k1.d THEN k0.v ELSE k0.v + (k1.v - k0.v) * date_diff('day', k0.d, a.y) / date_diff('day', k0.d, k1.d) END AS b FROM a ASOF LEFT JOIN k k0 ON a.p = k0.p AND a.y >= k0.d ASOF LEFT JOIN k k1 ON a.p = k1.p AND a.y <= k1.d) SELECT p, d, v, CASE WHEN v <> 0 AND b <> 0 THEN (v - b) / b END AS yoy FROM i")
def ser_yoy(t):
    return _monthly(t).yoy()


def _asked_months(t):
    """Each month from the one before the first order to the last one."""
    ends = t("orders").agg(F.add_months(F.trunc(F.min("o_orderdate"), "month"), -1).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return ends.select(F.explode(dates.date_range(F.col("lo"), F.col("hi"), "month")).alias("asked"))


@query(f"SELECT q AS asked, d AS nearest_key, v AS nearest_value, abs(date_diff('day', q, d)) AS distance FROM (SELECT q, d, v, row_number() OVER (PARTITION BY q ORDER BY abs(date_diff('day', q, d)), d) AS n FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS q FROM (SELECT date_trunc('month', min(o_orderdate)) - INTERVAL 1 MONTH AS lo, max(o_orderdate) AS hi FROM orders)), (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS d, COUNT(*)::DOUBLE AS v FROM orders GROUP BY 1)) WHERE n = 1")
def ser_nearest(t):
    yearly = t("orders").groupBy(F.trunc("o_orderdate", "year").alias("d")).agg(many().cast("double").alias("v"))
    asked = _asked_months(t)
    return big_column(series.nearest(series.Series(yearly, "d", "v"), asked, "asked"), "distance")


@query("WITH k AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS d, COUNT(*)::DOUBLE AS v FROM orders GROUP BY 1), q AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS asked FROM (SELECT date_trunc('month', min(o_orderdate)) - INTERVAL 1 MONTH AS lo, max(o_orderdate) AS hi FROM orders)) SELECT asked, CASE WHEN k0.d IS NULL THEN k1.v WHEN k1.d IS NULL OR k0.d = k1.d THEN k0.v ELSE k0.v + (k1.v - k0.v) * date_diff('day', k0.d, asked) / date_diff('day', k0.d, k1.d) END AS value FROM q ASOF LEFT JOIN k k0 ON asked >= k0.d ASOF LEFT JOIN k k1 ON asked <= k1.d")
def ser_linear_interp(t):
    yearly = t("orders").groupBy(F.trunc("o_orderdate", "year").alias("d")).agg(many().cast("double").alias("v"))
    asked = _asked_months(t)
    return series.interpolate(series.Series(yearly, "d", "v"), asked, "asked")


#: The tridiagonal system by recursion: elimination forward from the second knot, substitution back from the last but one.
_SPLINE = f"""
    WITH RECURSIVE k AS (SELECT p, d, v, date_diff('day', DATE '1970-01-01', d)::DOUBLE AS x, row_number() OVER (PARTITION BY p ORDER BY d) AS n, count(*) OVER (PARTITION BY p) AS c FROM ({_BY})),
    g AS (SELECT p, n, c, x - lag(x) OVER w AS h0, lead(x) OVER w - x AS h1, 6 * ((lead(v) OVER w - v) / (lead(x) OVER w - x) - (v - lag(v) OVER w) / (x - lag(x) OVER w)) AS r FROM k WINDOW w AS (PARTITION BY p ORDER BY n)),
    b AS (SELECT p, n, c, r, CASE WHEN n = 2 THEN 0 WHEN n = c - 1 THEN h0 - h1 * h1 / h0 ELSE h0 END AS low, CASE WHEN n = c - 1 THEN 0 WHEN n = 2 THEN h1 - h0 * h0 / h1 ELSE h1 END AS high,
        2 * (h0 + h1) + CASE WHEN n = 2 THEN h0 * (h0 + h1) / h1 ELSE 0 END + CASE WHEN n = c - 1 THEN h1 * (h0 + h1) / h0 ELSE 0 END AS mid FROM g WHERE n > 1 AND n < c),
    f AS (SELECT p, n, c, mid, high, r FROM b WHERE n = 2 UNION ALL SELECT b.p, b.n, b.c, b.mid - b.low / f.mid * f.high, b.high, b.r - b.low / f.mid * f.r FROM f JOIN b ON b.p = f.p AND b.n = f.n + 1),
    s AS (SELECT p, n, r / mid AS m FROM f WHERE n = c - 1 UNION ALL SELECT f.p, f.n, (f.r - f.high * s.m) / f.mid FROM s JOIN f ON f.p = s.p AND f.n = s.n - 1),
    j AS (SELECT k.p, k.n, k.d, k.x, k.v, m FROM k LEFT JOIN s ON s.p = k.p AND s.n = k.n),
    e AS (SELECT p, d, x, v, COALESCE(m, CASE WHEN n = 1 THEN ((lead(x, 2) OVER w - x) * lead(m) OVER w - (lead(x) OVER w - x) * lead(m, 2) OVER w) / (lead(x, 2) OVER w - lead(x) OVER w)
        ELSE ((x - lag(x, 2) OVER w) * lag(m) OVER w - (x - lag(x) OVER w) * lag(m, 2) OVER w) / (lag(x) OVER w - lag(x, 2) OVER w) END) AS m FROM j WINDOW w AS (PARTITION BY p ORDER BY n)),
    a AS (SELECT p, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS "at" FROM (SELECT p, min(d) AS lo, max(d) AS hi FROM k GROUP BY 1)),
    q AS (SELECT a.p, a."at", e0.v AS v0, e1.v AS v1, e0.m AS m0, e1.m AS m1, e1.x - e0.x AS h, date_diff('day', e0.d, a."at")::DOUBLE AS t, date_diff('day', a."at", e1.d)::DOUBLE AS u FROM a ASOF JOIN e e0 ON a.p = e0.p AND a."at" >= e0.d ASOF JOIN e e1 ON a.p = e1.p AND a."at" <= e1.d)
    SELECT p, "at", round(CASE WHEN h = 0 THEN v0 ELSE (m0 * u * u * u + m1 * t * t * t) / (6 * h) + (v0 / h - m0 * h / 6) * u + (v1 / h - m1 * h / 6) * t END, 4) AS value FROM q"""


@query(_SPLINE)
def ser_spline(t):
    """Cubic splines through each priority's months, by day."""
    s = _monthly(t)
    return series.spline(s, series.date_grid(s, "day").withColumnRenamed("d", "at"), "at").withColumn("value", F.round("value", 4))


# User functions, schemas, terms, windows


@query("SELECT p_partkey, unnest([p_size, p_size + 1]) AS s FROM part")
def udf_flat_map(t):
    return relational.flat_map(t("part").select("p_partkey", "p_size"), lambda r: [{"p_partkey": r["p_partkey"], "s": r["p_size"] + i} for i in range(2)], "p_partkey long, s int")


@query("SELECT p_partkey, upper(p_brand) AS brand FROM part")
def udf_map(t):
    return relational.map_rows(t("part").select("p_partkey", "p_brand"), lambda r: {"p_partkey": r["p_partkey"], "brand": r["p_brand"].upper()}, "p_partkey long, brand string")


@query("SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, TRY_CAST(c_mktsegment AS INTEGER) AS c_mktsegment, TRY_CAST(c_mktsegment AS INTEGER) IS NULL AS bad FROM customer")
def structure_cast(t):
    out = schema.cast_to(t("customer"), "c_custkey bigint, c_acctbal double, c_mktsegment int", "errors")
    return out.withColumn("bad", F.size("errors") > 0).drop("errors")


@query("SELECT s_suppkey AS supplier_id, n_name AS supplier_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def term_lookup(t):
    term = Term("nation")
    rows = t("supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("nation_id"))
    out = term.lookup(rows, t("nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation_name")), "id", "name")
    return out.select("supplier_id", F.col("nation_name").alias("supplier_name"))


@query("SELECT node, SUM(i)::BIGINT AS n_in, SUM(o)::BIGINT AS n_out FROM (SELECT s AS node, 0 AS i, 1 AS o FROM (SELECT DISTINCT 'c' || c_nationkey AS s, c_mktsegment AS t FROM customer) UNION ALL SELECT t, 1, 0 FROM (SELECT DISTINCT 'c' || c_nationkey AS s, c_mktsegment AS t FROM customer)) GROUP BY 1")
def graph_degrees(t):
    return degrees(edges(t("customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("s"), "c_mktsegment"), "s", "c_mktsegment"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2, 3")
def window_tumbling(t):
    out = windows.tumbling(t("events").withColumn("value", F.col("value").cast("decimal(18,2)")), "ts", "1 hour", ["event_type"], "value")
    return out.withColumn("total", F.col("total").cast("double"))


@query("SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 30 MINUTE AS \"end\", COUNT(*) AS n FROM (SELECT *, SUM(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, s")
def window_sessions(t):
    return windows.sessions(t("events"), "ts", "30 minutes", ["user_id"])


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def top_k_per_group(t):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return big_column(t("orders").withColumn("rank", n).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank"), "rank")


# The queries of further modules register themselves here.
from tessera.plans import function_queries, scan_queries, series_queries, source_queries  # noqa: E402, F401
