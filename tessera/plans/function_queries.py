"""Queries that group functions of one kind, over whole tables, with their SQL."""

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import arrays, basic, dates, numeric, text
from tessera.operators import profile, relational
from tessera.operators.terms import Term, entity_records
from tessera.plans.catalogue import big, many, money, query
from tessera.sources import schema

# Predicates and values


@query(
    "SELECT s_suppkey, 7 AS seven, s_name AS same, s_name IS NOT NULL AS has, s_name IS NULL AS none, s_acctbal IS NOT NULL AS some, s_acctbal <> 0 AS nonzero, s_name NOT IN ('None', '', '-') AS text_nonzero, s_nationkey <> 3 AS other, s_nationkey < 10 AS less, s_nationkey <= 10 AS upto,"
    " COALESCE(s_acctbal > 5000, false) AS more, s_nationkey <= s_suppkey AS up, s_nationkey >= s_suppkey AS down, NOT (s_acctbal > 0 AND s_acctbal < 5000) AS out, NOT (s_acctbal BETWEEN 0 AND 5000) AS out_or_on FROM supplier"
)
def predicates(t):
    return t("supplier").select(
        "s_suppkey", basic.const(7).alias("seven"), basic.same("s_name").alias("same"), basic.defined("s_name").alias("has"), basic.is_none("s_name").alias("none"), basic.not_none("s_acctbal", True).alias("some"), basic.nonzero("s_acctbal").alias("nonzero"), basic.nonzero("s_name", True).alias("text_nonzero"),
        basic.not_equal("s_nationkey", 3).alias("other"), basic.less_than("s_nationkey", 10).alias("less"), basic.less_than("s_nationkey", 10, True).alias("upto"), basic.safe_more_than("s_acctbal", 5000).alias("more"),
        basic.is_ordered("s_nationkey", "s_suppkey").alias("up"), basic.is_ordered("s_nationkey", "s_suppkey", reverse=True).alias("down"), basic.not_between("s_acctbal", 0, 5000).alias("out"), basic.not_between("s_acctbal", 0, 5000, True).alias("out_or_on"),
    )


@query("SELECT l_orderkey, l_linenumber, COALESCE(NULLIF(l_discount, 0), NULLIF(l_tax, 0), NULLIF(l_quantity, 0)) AS first_defined, CASE WHEN l_discount = 0 THEN -1 ELSE l_discount END AS safe FROM lineitem")
def acquire_first(t):
    df = t("lineitem")
    return df.select("l_orderkey", "l_linenumber", basic.acquire("l_discount", "l_tax", "l_quantity").alias("first_defined"), relational.safe_apply(F.nullif("l_discount", F.lit(0.0)), -1.0).alias("safe"))


@query(
    "SELECT event_id, NOT lower(trim(x)) IN ('false', 'no', '0', '0.0', 'none', 'null', '', '-') AS truth, COALESCE(NOT lower(trim(y)) IN ('false', 'no', '0', '0.0', 'none', 'null', '', '-'), false) AS any_truth, CASE WHEN event_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS said"
    " FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' No ' WHEN 1 THEN 'true' WHEN 2 THEN '-' WHEN 3 THEN '0.0' ELSE event_type END AS x, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '0' ELSE '1' END AS y FROM events)"
)
def booleans(t):
    n = F.col("event_id")
    x = F.when(n % 5 == 0, " No ").when(n % 5 == 1, "true").when(n % 5 == 2, "-").when(n % 5 == 3, "0.0").otherwise(F.col("event_type"))
    y = F.when(n % 3 == 0, None).when(n % 3 == 1, F.lit(0)).otherwise(F.lit(1))
    return t("events").select("event_id", basic.str_to_bool(x).alias("truth"), basic.any_to_bool(y).alias("any_truth"), basic.bool_text(n % 2 == 0).alias("said"))


@query(
    "SELECT o_orderkey, CAST(p AS DOUBLE) AS percent, CASE WHEN x >= 1e6 THEN printf('%.5fM', x / 1e6) WHEN x >= 1e3 THEN printf('%.5fK', x / 1e3) ELSE printf('%.5f', x) END AS short, lpad(printf('%+.2f', x), 12, ' ') AS shown, x AS parsed, -1.0 AS unparsed, true AS numeric, false AS name_numeric,"
    " rpad(substr(o_orderpriority, 1, 6), 6, ' ') AS cut FROM (SELECT *, o_totalprice AS x, round(o_custkey::DOUBLE / 4096 * 100, 0) AS p FROM orders) WHERE true"
)
def representations(t):
    x = F.col("o_totalprice")
    return t("orders").select(
        "o_orderkey", basic.percent(F.col("o_custkey") / 4096, 0).alias("percent"), basic.number(x, 5).alias("short"), basic.number_text(x, 2, plus=True, width=12).alias("shown"),
        basic.parse_number(F.concat(x.cast("string"), F.lit("$")), suffix="$").alias("parsed"), basic.parse_number("o_orderpriority", default=-1.0).alias("unparsed"),
        numeric.is_numeric(x.cast("string")).alias("numeric"), numeric.is_numeric("o_orderpriority").alias("name_numeric"), basic.aligned("o_orderpriority", 6, crop_to="").alias("cut"),
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_tax AS product, round_even(l_extendedprice / 1000, 0) AS thousands FROM lineitem")
def products(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", numeric.mult("l_quantity", F.col("l_tax")).alias("product"), numeric.round_py(F.col("l_extendedprice") / 1000).alias("thousands"))


@query("SELECT o_orderstatus, round_even(avg(o_custkey), 2) AS mean_key, COALESCE(avg(CASE WHEN o_custkey < 0 THEN 1.0 END), -1.0) AS no_mean FROM orders GROUP BY 1")
def means(t):
    return t("orders").groupBy("o_orderstatus").agg(numeric.mean("o_custkey", 2).alias("mean_key"), numeric.mean(F.when(F.col("o_custkey") < 0, 1.0), default=-1.0).alias("no_mean"))


# Dates

_D = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders"


def _dated(t):
    return t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))


@query(
    f"SELECT o_orderkey, strftime(d, '%d.%m.%Y') AS gost, strftime(d, '%Y-%m-%d') AS iso, d AS from_gost_long, d AS from_gost_short, d AS parsed, NULL::DATE AS bad, true AS is_iso, false AS gost_is_iso, true AS gost_is_gost, true AS either, false AS neither, strftime(d, '%Y-%m-%d 00:00') AS stamp FROM ({_D})"
)
def date_texts(t):
    gost, iso = dates.to_gost("d"), dates.iso("d")
    long = F.date_format("d", "dd.MM.yyyy")
    return _dated(t).select(
        "o_orderkey", gost.alias("gost"), iso.alias("iso"), dates.from_gost(gost).alias("from_gost_long"), dates.from_gost(F.when(F.year("d") >= 2000, F.date_format("d", "dd.MM.yy")).otherwise(long)).alias("from_gost_short"),
        dates.parse_date(iso).alias("parsed"), dates.parse_date(F.lit("no date")).alias("bad"), dates.is_iso_date(iso).alias("is_iso"), dates.is_iso_date(gost).alias("gost_is_iso"), dates.is_gost_date(gost).alias("gost_is_gost"),
        dates.is_date(gost, gost=True).alias("either"), dates.is_date(gost).alias("neither"), dates.formatted_datetime("d").alias("stamp"),
    )


_WEEKS = f"SELECT *, CASE WHEN w0 >= 52 THEN y0 + 1 ELSE y0 END AS y, CASE WHEN w0 >= 52 THEN 0 ELSE w0 END AS w FROM (SELECT *, year(d) AS y0, date_diff('day', CAST(date_trunc('week', date_trunc('year', d)) AS DATE), d) // 7 AS w0 FROM ({_D}))"


@query(
    f"SELECT o_orderkey, y::BIGINT AS y, w::BIGINT AS w, w::BIGINT AS week, CAST(date_trunc('week', make_date(y, 1, 1)) AS DATE) + (w * 7)::INT AS monday, ((y - 2010) * 52 + w)::BIGINT AS week_abs, (2010 + trunc(((y - 2010) * 52 + w) / 52.0))::BIGINT AS back_year, (((y - 2010) * 52 + w) - trunc(((y - 2010) * 52 + w) / 52.0) * 52)::BIGINT AS back_week, make_date(y, 1, 1) AS january FROM ({_WEEKS})"
)
def date_weeks(t):
    df = _dated(t).withColumn("yw", dates.year_and_week("d")).withColumn("n", dates.week_abs_of(F.col("yw.year"), F.col("yw.week")))
    back = dates.year_and_week_of_abs("n")
    return df.select(
        "o_orderkey", big(F.col("yw.year")).alias("y"), big(F.col("yw.week")).alias("w"), big(dates.week_no("d")).alias("week"), dates.date_from_year_and_week(F.col("yw.year"), F.col("yw.week")).alias("monday"),
        big(F.col("n")).alias("week_abs"), big(back["year"]).alias("back_year"), big(back["week"]).alias("back_week"), dates.date_from_year_and_month(F.col("yw.year"), 1).alias("january"),
    )


@query(
    f"SELECT o_orderkey, CAST(date_trunc('week', date_trunc('year', d)) AS DATE) AS start_monday, CAST(d + INTERVAL 1 YEAR AS DATE) AS next_year, CAST(date_trunc('week', d + INTERVAL 1 YEAR) AS DATE) AS next_year_monday, date_diff('day', DATE '1995-06-17', d) AS days, trunc(date_diff('day', DATE '1995-06-17', d) / 7.0)::BIGINT AS weeks, trunc(date_diff('day', DATE '1995-06-17', d) / 30.0)::BIGINT AS months,"
    " CASE WHEN month(d) = 2 THEN 28 WHEN month(d) IN (4, 6, 9, 11) THEN 30 ELSE 31 END::BIGINT AS in_month, year(d) + (dayofyear(d) - 1) / 365 AS decimal_year, d AS back, make_date(year(d), month(d), 1) AS month_back, make_date(year(d), 1, 1) AS year_back, year(d) AS year, month(d) AS month, day(d) AS day, isodow(d) - 1 AS weekday, 31::BIGINT AS month_days FROM (" + _D + ")"
)
def date_parts(t):
    parts, x = dates.date_fields("d"), F.lit(datetime.date(1995, 6, 17))
    return _dated(t).select(
        "o_orderkey", dates.year_start_monday("d").alias("start_monday"), dates.next_year_date("d").alias("next_year"), dates.next_year_date("d", 1, True).alias("next_year_monday"), big(dates.days_between(x, "d")).alias("days"), big(dates.int_between(x, "d", "week")).alias("weeks"), big(dates.int_between(x, "d", "month")).alias("months"),
        big(dates.days_in_month("d")).alias("in_month"), dates.year_decimal("d").alias("decimal_year"), dates.int_to_date(dates.day_abs("d"), "day").alias("back"), dates.int_to_date(dates.month_abs("d"), "month").alias("month_back"), dates.int_to_date(dates.year_abs("d"), "year").alias("year_back"),
        *(big(parts[k]).alias(k) for k in ("year", "month", "day", "weekday")), big(F.lit(dates.days_in_scale("month"))).alias("month_days"),
    )


@query(f"SELECT o_orderkey, list_transform(range(1993, 1998), lambda y: CAST(make_date(year(d), month(d), CASE WHEN month(d) = 2 AND day(d) = 29 THEN 28 ELSE day(d) END) + to_years((y - year(d))::INT) AS DATE)) AS same_days FROM ({_D})")
def date_yearly(t):
    plain = F.when((F.month("d") == 2) & (F.dayofmonth("d") == 29), F.date_sub("d", 1)).otherwise(F.col("d"))
    return _dated(t).select("o_orderkey", dates.yearly_dates(plain, datetime.date(1993, 1, 1), datetime.date(1997, 12, 31)).alias("same_days"))


@query("SELECT event_id, CASE WHEN s >= 86400 THEN (s // 86400)::VARCHAR || 'D' WHEN s >= 3600 THEN (s // 3600)::VARCHAR || 'h' WHEN s >= 60 THEN (s // 60)::VARCHAR || 'm' ELSE s::VARCHAR || 's' END AS short FROM (SELECT event_id, (event_id * 37) % 600000 AS s FROM events)")
def date_intervals(t):
    return t("events").select("event_id", dates.interval_text((F.col("event_id") * 37) % 600000).alias("short"))


# Arrays and texts

_LISTS = "SELECT o_orderkey, [o_orderkey % 7, 0, NULL, o_custkey % 5, o_orderkey % 3, o_custkey % 5] AS a, [o_custkey % 5, 2, o_orderkey % 3] AS b FROM orders"


def _lists(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t("orders").select("o_orderkey", F.array(k % 7, F.lit(0), F.lit(None), c % 5, k % 3, c % 5).alias("a"), F.array(c % 5, F.lit(2), k % 3).alias("b"))


@query(f"SELECT o_orderkey, a[2:4] AS part, a[2] AS second, list_filter(a, lambda x: x IS NOT NULL) AS known, list_filter(a, lambda x: x <> 0) AS nonzero, list_transform(list_filter(a, lambda x: x IS NOT NULL), lambda x: x::DOUBLE) AS numbers, array_to_string(b, ', ') AS text FROM ({_LISTS})")
def array_parts(t):
    a = "a"
    return _lists(t).select("o_orderkey", arrays.subsequence(a, 1, 4).alias("part"), arrays.second(a).alias("second"), arrays.values_not_none(a).alias("known"), arrays.nonzero_values(a).alias("nonzero"), arrays.numeric_values(a).alias("numbers"), basic.joined("b").alias("text"))


@query(f"SELECT o_orderkey, list_filter(k, lambda x: NOT list_contains(b, x)) AS minus, list_filter(k, lambda x: NOT list_contains(b, x)) AS a_only, list_filter(b, lambda x: NOT list_contains(k, x)) AS b_only, list_filter(k, lambda x: list_contains(b, x)) AS common FROM (SELECT *, list_filter(a, lambda x: x IS NOT NULL) AS k FROM ({_LISTS}))")
def array_compare(t):
    df = _lists(t).withColumn("k", arrays.values_not_none("a"))
    both = arrays.compare_lists("k", "b")
    return df.select("o_orderkey", arrays.list_minus("k", "b").alias("minus"), both["a_only"].alias("a_only"), both["b_only"].alias("b_only"), both["common"].alias("common"))


@query(f"WITH x AS (SELECT o_orderkey, unnest(list_filter(a, lambda x: x IS NOT NULL)) AS v FROM ({_LISTS})), c AS (SELECT o_orderkey, v, count(*) AS n FROM x GROUP BY 1, 2) SELECT o_orderkey, list(v ORDER BY v) AS vals, list(n ORDER BY v) AS counts, list(v ORDER BY n DESC, v)[1:2] AS best FROM c GROUP BY 1")
def array_hist(t):
    known = arrays.values_not_none("a")
    hist = arrays.hist_of(known)
    return _lists(t).select("o_orderkey", F.transform(hist, lambda x: x["value"]).alias("vals"), F.transform(hist, lambda x: x["count"]).alias("counts"), arrays.top(known, 2).alias("best"))


@query(f"SELECT o_orderkey, [b[1] * 2 + b[2] * b[1] + b[3] * b[2], b[1] * b[1] + b[2] * b[2] + b[3] * b[3]] AS products, list_sum(list_transform(list_zip(b, b), lambda p: CASE WHEN p[1] > 0 THEN p[1] ELSE 0 END))::DOUBLE AS positive FROM ({_LISTS})")
def array_shifted(t):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * F.coalesce(q, F.lit(2))), F.lit(0).cast("bigint"), lambda s, v: s + v)
    down = arrays.shifted("b", "b", dot, range(1, -1, -1))
    return _lists(t).select("o_orderkey", down.alias("products"), basic.pair_stat("b", "b", lambda x, y: arrays.array_sum(x), lambda v: v > 0).alias("positive"))


@query("SELECT c_custkey, c_name AS first, c_mktsegment AS second, '{\"k\":' || c_custkey || ',\"s\":\"' || c_mktsegment || '\"}' AS js, [c_nationkey] AS odd FROM customer")
def text_rows(t):
    df = t("customer").withColumn("row", F.format_string('"%s",%s', "c_name", "c_mktsegment"))
    fields = text.split_csv_row("row", 2)
    pairs = basic.pair_filter(F.array("c_nationkey"), F.array("c_custkey"), lambda v: v >= 0)
    return df.select("c_custkey", fields[0].alias("first"), fields[1].alias("second"), text.json_dumps(F.struct(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))).alias("js"), F.transform(pairs, lambda p: p["a"]).alias("odd"))


# Dictionaries, profiles, terms


@query("SELECT c_nationkey, max(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def dictionary_last(t):
    return relational.dictionary(relational.having_columns(t("customer"), "c_nationkey", "c_custkey"), "c_nationkey", "c_custkey")


@query("SELECT c_nationkey, list(c_custkey ORDER BY c_custkey) AS c_custkey FROM customer GROUP BY 1")
def dictionary_lists(t):
    return relational.dictionary(t("customer"), "c_nationkey", "c_custkey", of_lists=True)


@query("SELECT list(n_nationkey ORDER BY n_nationkey) AS n_nationkey, list(n_name ORDER BY n_nationkey) AS n_name FROM nation")
def transposed_nations(t):
    return relational.transposed(t("nation"), "n_nationkey", "n_name", order="n_nationkey")


@query("SELECT n_nationkey AS key, n_name AS value FROM nation")
def key_value_pairs(t):
    return relational.pairs(t("nation"), "n_nationkey", "n_name")


@query("SELECT 0 AS part, count(*) AS n FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT 1, count(*) FROM orders WHERE o_custkey % 3 = 1 UNION ALL SELECT 2, count(*) FROM orders WHERE o_custkey % 3 = 2")
def split_by_number(t):
    parts = relational.split_by_number(t("orders"), F.col("o_custkey") % 3, 3)
    return relational.union(*(p.agg(many().alias("n")).select(F.lit(i).alias("part"), "n") for i, p in enumerate(parts)))


@query("SELECT 'F' AS status, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'O', count(*) FROM orders WHERE o_orderstatus = 'O'")
def split_by_value(t):
    return relational.union(*(p.agg(many().alias("n")).select(F.lit(v).alias("status"), "n") for v, p in profile.split_by_value(t("orders"), "o_orderstatus", ["F", "O"]).items()))


@query(
    "SELECT * FROM (SELECT field, value, n AS count, sum(n) OVER (PARTITION BY field)::BIGINT AS total_count, n / sum(n) OVER (PARTITION BY field) AS share, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM"
    " (SELECT 'p_brand' AS field, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY 2)) WHERE r <= 5",
)
def histograms_top(t):
    out = profile.hist(t("part"), "p_brand", "p_size")
    top = profile.histograms(t("part"), ["p_brand", "p_size"], 5)
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.col("count").desc(), "value"))
    return top.join(out.select("field", "value"), ["field", "value"]).withColumn("r", big(rank))


@query(
    "SELECT o_orderstatus, 'o_custkey' AS field, count(*) AS total_count, count(o_custkey) AS defined_count, count(CASE WHEN o_custkey <> 0 THEN 1 END) AS nonzero_count, count(DISTINCT o_custkey) AS uniq_count, count(o_custkey) / count(*) AS defined_share, count(CASE WHEN o_custkey <> 0 THEN 1 END) / count(*) AS nonzero_share FROM orders GROUP BY 1"
)
def stat_by_status(t):
    return profile.stat(t("orders"), "o_custkey", by=("o_orderstatus",))


@query("SELECT l_returnflag, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS q, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS p, round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE / sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE, 4) AS mean_price FROM lineitem GROUP BY 1")
def aggregate_ratios(t):
    df = t("lineitem").select("l_returnflag", F.col("l_quantity").cast("decimal(18,2)").alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("p"))
    out = profile.aggregate(df, ["l_returnflag"], ["q", "p"])
    return out.select("l_returnflag", F.col("q").cast("double").alias("q"), F.col("p").cast("double").alias("p")).withColumn("mean_price", F.round(F.col("p") / F.col("q"), 4))


@query("SELECT s_suppkey::INT AS s_suppkey, s_name, s_nationkey, s_acctbal::FLOAT AS s_acctbal FROM supplier")
def smaller_numbers(t):
    return profile.smaller_types(t("supplier"))


@query("SELECT n_nationkey, n_regionkey || '.' || n_nationkey AS nation_key, n_nationkey::VARCHAR AS level, 'nation_name' AS column_of FROM nation")
def term_levels(t):
    nation, region = Term("nation", levels=("n_regionkey", "n_nationkey")), Term("region")
    nation.relate(region, "many_to_one", "one_to_many")
    assert [r["name"] for r in entity_records([nation, region])] == ["nation", "region"]
    return nation.add_key(t("nation")).select("n_nationkey", "nation_key", nation.level_id(1).alias("level"), F.lit(nation.column("name")).alias("column_of"))


@query("SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total FROM orders GROUP BY 1")
def group_by_key(t):
    return t("orders").groupBy("o_custkey").agg(money("o_totalprice").alias("total"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE ('0x' || substr(md5(o_custkey::VARCHAR), 1, 8))::BIGINT % 10 = 3")
def in_sample(t):
    """A tenth of the customers with all their orders, by a hash that DuckDB has too."""
    return t("orders").filter(basic.in_sample("o_custkey", 10, 3, basic.md5_number)).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, make_date(floor(x)::INT, 1, 1) + round((x - floor(x)) * 365)::INT AS day FROM (SELECT o_orderkey, year(o_orderdate) + o_orderkey % 365 / 365 AS x FROM orders)")
def date_from_decimal_year(t):
    x = F.year("o_orderdate") + F.col("o_orderkey") % 365 / 365
    return t("orders").select("o_orderkey", dates.date_from_year(x).alias("day"))


@query("SELECT 'c_custkey' AS \"column\", 'same' AS state, 'bigint' AS wanted, 'bigint' AS type, count(c_custkey) / count(*) AS defined_share FROM customer UNION ALL SELECT 'c_name', 'other type', 'int', 'string', count(c_name) / count(*) FROM customer UNION ALL SELECT 'c_phone', 'missing', 'string', NULL, NULL UNION ALL SELECT 'c_acctbal', 'unexpected', NULL, 'double', count(CASE WHEN c_acctbal > 0 THEN 1 END) / count(*) FROM customer")
def schema_comparison(t):
    rows = t("customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"))
    return schema.comparison(rows, "c_custkey bigint, c_name int, c_phone string")
