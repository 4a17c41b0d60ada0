"""Joins that match nulls: rows without a key are one hot key, whose pairs are dealt to many tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import relational


def _null_safe(left, right, how):
    """Rows (k, a, b) in plain Python."""
    both = [(k, a, b) for k, a in left for j, b in right if k == j]
    lone_left = [(k, a, None) for k, a in left if k not in {j for j, _ in right}]
    lone_right = [(k, None, b) for k, b in right if k not in {j for j, _ in left}]
    return {"inner": both, "left": both + lone_left, "outer": both + lone_left, "right": both + lone_right, "full": both + lone_left + lone_right, "xor": lone_left + lone_right}[how]


@pytest.mark.parametrize("how", ["inner", "left", "outer", "right", "full", "xor"])
@pytest.mark.parametrize("nulls", [(0, 30), (30, 0), (1, 30), (30, 1), (40, 30)])
def test_null_keys_keep_every_row(spark, how, nulls):
    left = [(None, i) for i in range(nulls[0])] + [(None, 0)] * min(nulls[0], 2) + [(k, 100 + k) for k in (1, 1, 2, 3)]
    right = [(None, i) for i in range(nulls[1])] + [(k, 200 + i) for i, k in enumerate((1, 2, 2, 5))]
    got = relational.join(spark.createDataFrame(left, "k int, a int").repartition(3), spark.createDataFrame(right, "k int, b int"), "k", how)
    assert got.columns == ["k", "a", "b"] and Counter(map(tuple, got.collect())) == Counter(_null_safe(left, right, how))


def test_two_keys_of_which_one_is_null(spark):
    rows = [(k, j, i) for i, (k, j) in enumerate([(None, 1), (None, 2), (1, None), (None, None), (1, 1)] * 9)]
    left, right = spark.createDataFrame(rows, "k int, j int, a int"), spark.createDataFrame(rows, "k int, j int, b int")
    want = Counter((k, j, a, b) for k, j, a in rows for x, y, b in rows if (k, j) == (x, y))
    for how in ("inner", "left", "right"):
        assert Counter(map(tuple, relational.join(left, right, ["k", "j"], how).collect())) == want


@pytest.mark.parametrize(("how", "most"), [("inner", 0.2), ("left", 0.35), ("right", 0.35)])
def test_no_task_makes_all_pairs_of_null_keys(spark, how, most):
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        side = lambda c: spark.range(600).select(F.nullif(F.col("id") % 2, F.lit(0)).alias("k"), F.col("id").alias(c)).filter("k is null")
        by_task = [r["n"] for r in relational.join(side("a"), side("b"), "k", how).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
        assert sum(by_task) == 300 * 300 and max(by_task) < most * sum(by_task)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_files_of_all_pairs_of_null_keys_stay_small(spark, tmp_path, broadcast):
    side = lambda c, n: spark.range(n).select(F.nullif(F.col("id") % 4, F.lit(0)).alias("k"), (F.col("id") * 7_919_999).alias(c)).filter("k is null or k = 1 and id < 400")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        relational.join(side("a", 24_000), side("b", 16_000), "k", "inner").write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.filter("k is null").agg(F.count("*"), F.count_distinct("a"), F.count_distinct("b")).first() == (6000 * 4000, 6000, 4000)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.3 * out.count()


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "string", "struct<x: int>"])
def test_pairs_of_lists_of_null_keys_are_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(relational, "PACK", 3)
    monkeypatch.setattr(relational, "PACK_BUCKETS", 2)
    key = f"CAST(CASE WHEN id % 3 = 0 THEN NULL ELSE {'named_struct(\'x\', id % 5)' if 'struct' in kind else 'id % 5'} END AS {kind}) AS k"
    also = "CASE WHEN id % 2 = 0 THEN -0.0D WHEN id % 4 = 1 THEN double('nan') ELSE 1D END AS j"
    left = spark.range(60).selectExpr(key, also, "CAST(id % 7 AS INT) AS a", "map('m', id % 2) AS m")  # many equal rows
    right = spark.range(45).selectExpr(key, also, "id AS b").withColumn("j", F.expr("CASE WHEN j = 0 THEN 0D ELSE j END"))
    rows = lambda df: Counter(map(str, df.select(F.to_json(F.struct("k", "j", "a", "m", "b"), {"ignoreNullFields": "false"})).collect()))
    got = relational.join(left, right, ["k", "j"], "inner", right_is_distinct=True)
    assert [c.name for c in got.schema] == ["k", "j", "a", "m", "b"] and [c.dataType for c in got.schema][:2] == [c.dataType for c in right.schema][:2]
    l, r = left.alias("l"), right.alias("r")
    want = l.join(r, F.col("l.k").eqNullSafe(F.col("r.k")) & F.col("l.j").eqNullSafe(F.col("r.j"))).select("r.k", "r.j", "a", "m", "b")
    assert rows(got) == rows(want) and sum(rows(want).values()) > 200
