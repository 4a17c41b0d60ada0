"""Files, jobs, schemas by name, the shared folder and database tables (an embedded database that comes with Spark)."""

import pytest
from pyspark.sql import functions as F

from tessera.frame import Frame
from tessera.operators import relational
from tessera.shared import qualified, shared_dir
from tessera.sources import files, jobs, schema


def test_types_by_a_part_of_the_name():
    want = {"page_id": "int", "hits_count": "int", "conversion_rate": "double", "hits_count_today": "int", "ctr_avg": "double", "hits_rate": "int", "user_ids": "array<string>", "is_new": "boolean", "name": "string", "value_hist": "map<string,double>", "widget": "string"}
    assert {n: schema.type_by_name(n) for n in want} == want


def test_jdbc_round_trip(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(1000).select(F.col("id").cast("int").alias("n"), (F.col("id") * 2.5).alias("x"))
    assert not files.table_exists(spark, url, "numbers", **driver)
    files.write_table(df, url, "numbers", **driver)
    got = files.read_table(spark, url, "numbers", "n", (0, 1000), 4, **driver)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 1000 and got.agg(F.sum("x")).first()[0] == 2.5 * 499_500
    assert got.filter("n < 10").count() == 10 and files.table_exists(spark, url, "numbers", **driver)
    assert [(n.lower(), t) for n, t in files.describe_table(spark, url, "numbers", **driver)] == [("n", "int"), ("x", "double")]
    assert files.safe_write_table(df.limit(10), url, "numbers", **driver) == 10
    assert files.read_table(spark, url, "numbers", **driver).count() == 10


def test_a_job_runs_again_after_a_failed_run(spark, tmp_path):
    source, target = f"{tmp_path}/in.parquet", f"{tmp_path}/out.parquet"
    spark.range(20).write.parquet(source)
    operation = jobs.Operation("double", [source], target, lambda df: df.selectExpr("id * 2 AS id"))
    (tmp_path / "out.parquet" / "_temporary").mkdir(parents=True)
    (tmp_path / "out.parquet" / "part-0.parquet").write_bytes(b"half a file")
    assert not jobs.committed(spark, target)
    assert operation.run(spark).count() == 20 and jobs.committed(spark, target)
    calls = []
    jobs.Operation("again", [source], target, lambda df: calls.append(df)).run(spark)
    assert not calls
    (tmp_path / "other.parquet").mkdir()
    (tmp_path / "other.parquet" / "kept.txt").write_text("someone's")
    with pytest.raises(Exception, match="already exists"):
        jobs.Operation("no", [source], f"{tmp_path}/other.parquet", lambda df: df).run(spark)


def test_lines_and_listings(spark, tmp_path):
    files.write(spark.createDataFrame([("a;b",), ("c",)], "line string").coalesce(1), f"{tmp_path}/x.txt")
    assert files.first_line(spark, f"{tmp_path}/x.txt") == "a;b" and [files.detect_delimiter(x) for x in ("a;b, c", "a b,c", "abc", "full name,age", "a, b", "a; b, c", "a b", "a;b\tc")] == [", ", ",", "\t", ",", ", ", "; ", " ", "\t"]
    assert files.listing(spark, f"{tmp_path}", "part-*.txt", recursive=True).count() == 1


def test_the_shared_folder_is_a_uri(spark):
    for given, want in (("/some/where/", "file:///some/where"), ("file:///a/b", "file:///a/b"), ("file:/a", "file:///a")):
        assert qualified(spark, given) == want
    assert shared_dir(spark) == shared_dir(spark)


def test_stack_keeps_nulls(spark):
    a = spark.createDataFrame([(1, None, "x")], "k int, v double, s string")
    b = spark.createDataFrame([(2, None)], "k int, t string")
    got = sorted(tuple(r[c] for c in ("k", "v", "s", "t", "dataset")) for r in relational.stack([a, b]).collect())
    assert got == [(1, None, "x", "", 0), (2, 0.0, "", None, 1)]


def test_functions_of_rows_keep_whole_numbers(spark):
    df = spark.createDataFrame([(1, 9_007_199_254_740_993), (2, None)], "k int, v long")
    got = Frame(df).map_rows(lambda r: {"k": r["k"], "v": r["v"]}, "k int, v long").collect()
    assert sorted((r["k"], r["v"]) for r in got) == [(1, 9_007_199_254_740_993), (2, None)]


def test_frame_reports(spark):
    f = Frame(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    assert f.shape() == (2, 2) and f.example(1, k=2) == [{"k": 2, "v": "b"}] and "'a'" in f.show() and f.to_pairs("k", "v").df.columns == ["key", "value"]
    with pytest.raises(ValueError):
        Frame.empty(spark, "a int").assert_not_empty()
