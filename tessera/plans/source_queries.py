"""Queries that write tables with the library's writers into the shared folder and read them back: sources and sinks over whole tables."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.frame import Frame
from tessera.operators.table_functions import map_ordered
from tessera.plans.catalogue import many, query
from tessera.shared import new_dir
from tessera.sources import files, schema
from tessera.sources.database import Database
from tessera.sources.jobs import Job, Operation
from tessera.sources.validation import quarantine
from tessera.streaming.sync import MultiSync, Sync


def _folder(name: str) -> str:
    return new_dir(SparkSession.active(), name)


def _back(df, kind: str, **options):
    path = f"{_folder('files')}.{kind}"
    files.write(df, path)
    return files.read(SparkSession.active(), path, **options)


@query("SELECT * FROM supplier")
def file_csv(t):
    df = t("supplier")
    return _back(df, "csv", schema=", ".join(f"{n} {k}" for n, k in df.dtypes))


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier")
def file_tsv_untyped(t):
    return _back(t("supplier").select("s_suppkey", "s_name", "s_nationkey"), "tsv")


@query("SELECT c_custkey AS cust_id, c_name AS cust_name, c_acctbal AS acct_sum, ['a', c_mktsegment] AS segment_names FROM customer")
def file_by_title(t):
    df = t("customer").select(F.col("c_custkey").cast("int").alias("cust_id"), F.col("c_name").alias("cust_name"), F.col("c_acctbal").alias("acct_sum"), F.to_json(F.array(F.lit("a"), "c_mktsegment")).alias("segment_names"))
    path = f"{_folder('files')}.tsv"
    files.write(df, path)
    return files.read_by_title(SparkSession.active(), path).withColumn("cust_id", F.col("cust_id").cast("long"))


@query("SELECT * FROM nation")
def file_json_lines(t):
    df = t("nation")
    return _back(df, "json", schema=", ".join(f"{n} {k}" for n, k in df.dtypes))


@query("SELECT * FROM part")
def file_orc(t):
    return _back(t("part"), "orc")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def file_partitioned(t):
    path = f"{_folder('files')}.parquet"
    files.write(t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, partition_by=("o_orderstatus",))
    return files.read(SparkSession.active(), path)


@query("SELECT p_name AS line FROM part")
def file_lines(t):
    return _back(t("part").select("p_name"), "txt")


@query("SELECT count(*) AS n, count(*) AS lines FROM part")
def file_line_count(t):
    spark, path = SparkSession.active(), f"{_folder('files')}.txt"
    files.write(t("part").select("p_name"), path)
    return files.read(spark, path).agg(many().alias("n")).withColumn("lines", F.lit(files.lines_count(spark, path)).cast("bigint"))


@query("SELECT r_regionkey, NULL AS _err FROM region UNION ALL SELECT NULL, 'JSONDecodeError' FROM region")
def file_json_errors(t):
    good, bad = t("region").select(F.to_json(F.struct("r_regionkey")).alias("line")), t("region").select(F.col("r_name").alias("line"))
    return files.parse_json_lines(good.unionByName(bad), "r_regionkey int")


@query("SELECT count(DISTINCT l_returnflag) AS files, true AS lengths FROM lineitem")
def file_listing(t):
    """The files of a table written in a folder for each return flag. One file each takes one task each, which writes the rows as they come and holds none back for a sort."""
    spark, path = SparkSession.active(), _folder("files")
    files.write(t("lineitem").select("l_returnflag", "l_quantity").repartition("l_returnflag"), path, "parquet", partition_by=("l_returnflag",), open_files=16)
    return files.listing(spark, path, "*.parquet", recursive=True).agg(many().alias("files"), F.bool_and(F.col("length") > 0).alias("lengths"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def job_run(t):
    spark, folder = SparkSession.active(), _folder("job")
    files.write(t("orders").select("o_orderpriority", "o_orderstatus"), f"{folder}/in.parquet")
    job = Job([
        Operation("filter", [f"{folder}/in.parquet"], f"{folder}/{{status}}.parquet", lambda df: df.filter(F.col("o_orderstatus") == "F")),
        Operation("count", [f"{folder}/{{status}}.parquet"], f"{folder}/counts.parquet", lambda df: df.groupBy("o_orderpriority").agg(many().alias("n"))),
    ])
    job.run(spark, status="f")
    return job.run(spark, status="f")["count"]


@query("SELECT 's_suppkey' AS \"column\", 'bigint' AS type, 1.0 AS defined_share UNION ALL SELECT 's_name', 'string', 1.0")
def schema_summary(t):
    return schema.summary(t("supplier").select("s_suppkey", "s_name"))


@query("SELECT n_regionkey, count(*) AS n, max(n_name) AS last FROM nation GROUP BY 1")
def frame_fluent(t):
    frame = Frame(t("nation")).apply(lambda df: df.filter(F.col("n_nationkey") >= 0)).assert_not_empty()
    assert frame.shape()[1] == len(frame.example()[0]) and frame.count() == len(frame.collect())
    return frame.group_by("n_regionkey", n=many(), last=F.max("n_name")).df


@query("SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def sync_incremental(t):
    """Orders that come in two parts: the second run takes in the files of the second part alone."""
    spark, folder = SparkSession.active(), _folder("sync")
    orders = t("orders")
    sync = Sync(f"{folder}/in", f"{folder}/out", ", ".join(f"{n} {k}" for n, k in orders.dtypes), lambda df: df.filter("o_orderstatus <> 'P'"))
    both, taken = MultiSync({"orders": sync}), []
    for odd in (0, 1):
        orders.filter(F.col("o_orderkey") % 2 == odd).write.mode("append").parquet(sync.source)
        taken.append(both.run(spark)["orders"])
    assert sum(taken) == orders.count() and sync.run(spark) == 0
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return sync.read(spark).groupBy("o_orderpriority").agg(many().alias("n"), F.min("o_orderkey").alias("first"), total.alias("total"))


@query("SELECT 'c_acctbal' AS field, count(*) FILTER (TRY_CAST(replace(c_acctbal::VARCHAR, '.5', 'x') AS DOUBLE) IS NULL) AS n FROM customer UNION ALL SELECT 'debt', count(*) FILTER (COALESCE(TRY_CAST(replace(c_acctbal::VARCHAR, '.5', 'x') AS DOUBLE), -1) < 0) FROM customer UNION ALL SELECT 'bad rows', count(*) FILTER (COALESCE(TRY_CAST(replace(c_acctbal::VARCHAR, '.5', 'x') AS DOUBLE), -1) < 0) FROM customer UNION ALL SELECT 'rows', count(*) FROM customer")
def validation_quarantine(t):
    """Customers with balances that are no numbers, or below zero: the numbers read back from the folders are those of the job's own report."""
    spark, path = SparkSession.active(), _folder("validated")
    rows = t("customer").select("c_custkey", "c_name", F.replace(F.col("c_acctbal").cast("string"), F.lit(".5"), F.lit("x")).alias("c_acctbal"))
    report = quarantine(rows, "c_custkey bigint, c_name string, c_acctbal double", path, {"debt": F.col("c_acctbal").try_cast("double") >= 0})
    bad = report.bad_rows(spark)
    counts = bad.select(F.explode("errors").alias("e")).groupBy(F.col("e.field").alias("field")).agg(many().alias("n"))
    assert {r["field"]: r["n"] for r in counts.collect()} == {k: n for k, n in report.errors.items() if n}
    total = lambda name, df: df.agg(many().alias("n")).select(F.lit(name).alias("field"), "n")
    return counts.unionByName(total("bad rows", bad)).unionByName(total("rows", report.good_rows(spark).select("c_custkey").unionByName(bad.select("c_custkey"))))


@query("WITH s AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, sum(l_quantity - 25) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)) SELECT l_suppkey, max(over) AS most FROM (SELECT l_suppkey, s - least(0, min(s) OVER (PARTITION BY l_suppkey ORDER BY l.l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)) AS over FROM s JOIN lineitem l USING (l_suppkey, l_orderkey, l_linenumber, l_partkey)) GROUP BY 1")
def udtf_stock(t):
    """The most that piled up for each supplier, where a stock takes in each line's quantity, gives out 25 and never falls below zero: each state needs the one before."""

    def step(state, rows):
        now, most = state
        for q in rows.column("l_quantity").to_numpy() - 25:
            now = max(0.0, now + q)
            most = max(most, now)
        return (now, most, rows.column("l_suppkey")[0].as_py()), None

    lines = t("lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    end = lambda s: pa.table({"l_suppkey": pa.array([s[2]], pa.int64()), "most": pa.array([s[1]])})
    return map_ordered(lines, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], lambda s, rows: step(s[:2], rows), "l_suppkey long, most double", lambda: (0.0, 0.0, None), end)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, count(*) OVER w - 1 AS n, sum(l_quantity) OVER w AS upto FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)")
def udtf_rows(t):
    """A row for each line, numbered and summed up by a function that keeps its state from batch to batch."""

    def step(state, rows):
        n, total = state
        upto = total + np.cumsum(rows.column("l_quantity").to_numpy())
        out = pa.table({c: rows.column(c) for c in ("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")} | {"n": pa.array(np.arange(n, n + rows.num_rows)), "upto": pa.array(upto)})
        return (n + rows.num_rows, float(upto[-1])), out

    lines = t("lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return map_ordered(lines, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], step, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, n long, upto double", lambda: (0, 0.0))


def _database() -> Database:
    """A new database of the kind that comes with Spark, in the memory of a local session."""
    return Database(SparkSession.active(), f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")


@query("SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS first FROM supplier WHERE s_suppkey > 3 GROUP BY 1")
def jdbc_upload(t):
    """Suppliers uploaded over an older table, whose rows stay as a backup; read in parallel ranges, and filtered by the database."""
    db, rows = _database(), t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    old = rows.filter("s_suppkey <= 3")
    assert db.upload(old, "suppliers") == old.count() and db.upload(rows, "suppliers") == rows.count()
    assert db.count("suppliers_bak") == old.count() and db.exists("suppliers") and not db.exists("suppliers_tmp_upload")
    back = db.read("suppliers", "s_suppkey", (0, 100), 4).filter("s_suppkey > 3")
    return back.groupBy("s_nationkey").agg(many().alias("n"), F.min("s_suppkey").alias("first"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_regionkey + 100, 'n' FROM nation")
def jdbc_insert(t):
    """A table that is created once, filled in batches of two kinds of rows, and read by a statement of the database."""
    db = _database()
    for _ in range(2):
        db.create("names", "id BIGINT, name VARCHAR(40)")
    assert db.insert(t("region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name")), "names") == 5
    db.insert(t("nation").select((F.col("n_regionkey") + 100).cast("bigint").alias("id"), F.lit("n").alias("name")), "names")
    return db.select("SELECT id, name FROM names").toDF("r_regionkey", "r_name").withColumn("r_regionkey", F.col("r_regionkey").cast("int"))
