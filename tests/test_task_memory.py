"""Writes, offsets and runs whose tasks hold no more rows where a table grows."""

from pyspark.sql import functions as F

from tessera.operators import relational, scan
from tessera.plans.catalogue import QUERIES
from tessera.sources import files

SF = "/root/testdata/sf0.001"


def _written_plans(spark) -> list[str]:
    """Plans of the session's writes of files, in order."""
    plans = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [p for p in (plans.apply(i).physicalPlanDescription() for i in range(plans.size())) if "InsertIntoHadoopFsRelationCommand" in p]


def test_open_files_need_no_sort(spark, tmp_path):
    assert QUERIES["file_listing"](spark, SF).collect() == [(3, True)]
    assert "Sort" not in _written_plans(spark)[-1]
    rows = spark.range(1000).select((F.col("id") % 40).alias("k"), "id").coalesce(1)
    files.write(rows, f"{tmp_path}/few", "parquet", ("k",), open_files=7)
    assert files.listing(spark, f"{tmp_path}/few", "*.parquet", recursive=True).count() == 40
    assert sorted(map(tuple, files.read(spark, f"{tmp_path}/few", "parquet").select("k", "id").collect())) == sorted((i % 40, i) for i in range(1000))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_an_offset_leaves_rows_in_many_tasks(spark):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(5000).select(((F.col("id") * 7) % 5000).alias("k"), (F.col("id") % 3).alias("tie")).repartition(5)
        got = relational.skip(rows, 1700, "k")
        assert got.columns == ["k", "tie"] and [r["k"] for r in got.collect()] == list(range(1700, 5000))
        assert got.rdd.getNumPartitions() > 4
        ties = relational.skip(rows, 1700, "tie")
        assert [r["tie"] for r in ties.collect()] == sorted(i % 3 for i in range(5000))[1700:]
        assert relational.skip(rows, 0, "k").count() == 5000 and relational.skip(rows, 6000, "k").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_tasks_of_blocks_follow_the_rows(spark):
    """Settings that leave few partitions do not make long tasks."""
    conf = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 20_000
        rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("o")).withColumn("k", F.floor(F.col("o") / 7))
        place = relational.sorted_rows(rows, "o", place="p").select(F.shiftright("p", 33).alias("task"))
        assert place.distinct().count() > 2
        got = scan.runs(rows, ["k"], ["o"], size=128)
        by_task = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("run").alias("n"), F.max("run")).collect()]
        assert sum(by_task) == n and max(by_task) < n // 5
        assert {(r["k"], r["run"]) for r in got.collect()} == {(i, i + 1) for i in range(-(-n // 7))}
        assert scan.runs(rows.limit(0), ["k"], ["o"]).collect() == []
        assert {k: spark.conf.get(k) for k in conf} == conf
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
