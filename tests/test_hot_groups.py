"""Quantiles, folds and merge joins of groups that no task could hold."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import relational
from tessera.operators.quantiles import quantiles
from tessera.sources.buckets import merge_join, write_bucketed


@pytest.mark.parametrize(("bins", "rest", "sent"), [(64, 3, 0), (1024, 50, 100)])
def test_quantiles(spark, bins, rest, sent):
    rng = random.Random(1)
    groups = {"a": [rng.random() for _ in range(301)], "b": [7.0] * 40, "c": [1.0], "d": [], None: [10.0 ** rng.randrange(-300, 300) for _ in range(60)], "e": [-1e308, 1e308, 0.0, 5e-324], "f": [float(rng.randrange(4)) for _ in range(100)]}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None, float("nan")]]
    shares = {"low": 0.0, "quarter": 0.25, "middle": 0.5, "most": 0.9, "high": 1.0}
    got = {r["g"]: r for r in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", shares, bins, rest, sent).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, share in shares.items():
            if vs:
                place = (len(vs) - 1) * share
                a, b = sorted(vs)[int(np.floor(place))], sorted(vs)[int(np.ceil(place))]
                assert got[g][name] == a + (b - a) * (place - np.floor(place))
            else:
                assert got[g][name] is None
    assert quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", shares).collect() == []


def test_the_median_of_one_large_group(spark):
    """Ten million different values in one group: no task gathers more than the counts and the last few rows."""
    n = 10_000_000
    rows = spark.range(n).select(F.lit("hot").alias("g"), ((F.col("id") * 7_368_787) % n).cast("double").alias("v"))
    assert quantiles(rows, ["g"], "v", {"middle": 0.5}).first()["middle"] == (n - 1) / 2


def test_fold_in_parts(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4800, "hot").when(F.col("id") < 4990, "warm").alias("k"), (5000 - F.col("id")).alias("o"), (F.col("id") * 2).alias("v"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("w"))
    parts = relational.group_fold_parts(rows, ["k"], ["v", "w"], "o", size=64)
    sizes = parts.select("k", "part", F.size("v").alias("n"), F.size("w").alias("m")).collect()
    assert max(r["n"] for r in sizes) == 64 and all(r["n"] == r["m"] for r in sizes) and len(sizes) == 75 + 3 + 1
    whole = relational.unfold(relational.group_fold(rows, ["k"], ["v", "w"], "o"), ["v", "w"])
    assert sorted(map(tuple, relational.unfold_parts(parts, ["v", "w"], size=64).select(*whole.columns).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


@pytest.mark.parametrize("how", ["left", "inner", "right", "full", "xor"])
def test_merge_join(spark, how):
    left = spark.createDataFrame([(k, f"l{i}", i) for i, k in enumerate([1, 1, 2, 3, None, 5])], "k int, a string, both int")
    right = spark.createDataFrame([(k, f"r{i}", 10 * i) for i, k in enumerate([1, 2, 2, None, 7])], "k int, b string, both int")
    got = merge_join(spark, write_bucketed(left, "k", 4), write_bucketed(right, "k", 4), "k", how)
    want = relational.join(left, right, "k", how, null_safe=False)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    plan = re.sub(r"(?s)== Initial Plan.*", "", got._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_groups_follow_buckets(spark):
    rows = spark.range(1000).select((F.col("id") % 37).alias("k"), F.col("id").alias("v"))
    table = write_bucketed(rows, "k", 8)
    got = merge_join(spark, table, table, "k", "inner", right_is_uniq=True, last_by="v").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("last"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(k, len(range(k, 1000, 37)), max(range(k, 1000, 37))) for k in range(37)]
