"""Windows over streams: the same rows as in batch, and late rows are dropped behind the watermark."""

import datetime

from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.operators import profile, relational
from tessera.streaming import windows

T = lambda m, s=0: datetime.datetime(2024, 1, 1, 10, m, s)
SCHEMA = "ts timestamp, user string, value double"
FIRST = [(T(0), "a", 1.0), (T(4), "a", 2.0), (T(7), "b", 5.0), (T(29), "a", 3.0)]
LATER = [(T(1), "a", 100.0), (T(26), "b", 4.0), (T(59), "b", 1.0)]


def stream(spark, tmp_path, build):
    source, out = tmp_path / "in", "windows_out"
    for k, rows in enumerate([FIRST, LATER]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        df = build(spark.readStream.schema(SCHEMA).parquet(str(source)))
        q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / out)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / out))


def test_tumbling_windows_of_a_stream(spark, tmp_path):
    build = lambda df: windows.tumbling(df, "ts", "10 minutes", ["user"], "value", late="5 minutes")
    got = {(r["start"].minute, r["user"]): (r["n"], r["total"]) for r in stream(spark, tmp_path, build).collect()}
    # The row of minute 1 comes 28 minutes late and is dropped; windows that the watermark has not passed are still open.
    assert got == {(0, "a"): (2, 3.0), (0, "b"): (1, 5.0), (20, "a"): (1, 3.0), (20, "b"): (1, 4.0)}


def test_sessions_of_a_stream(spark, tmp_path):
    build = lambda df: windows.sessions(df, "ts", "5 minutes", ["user"], late="5 minutes")
    got = sorted((r["start"].minute, r["end"].minute, r["user"], r["n"]) for r in stream(spark, tmp_path, build).collect())
    assert got == [(0, 9, "a", 2), (7, 12, "b", 1), (26, 31, "b", 1), (29, 34, "a", 1)]


def test_batch_windows_are_the_same(spark):
    df = spark.createDataFrame(FIRST, SCHEMA)
    assert windows.tumbling(df, "ts", "10 minutes", ["user"], "value").count() == 3
    assert windows.tumbling(df, "ts", "10 minutes", ["user"], "value", slide="5 minutes").agg(F.sum("n")).first()[0] == 8


def test_unique_right_side(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (1, None, "z"), (None, None, "n"), (2, None, "q")], "k int, at int, v string")
    got = {r["k"]: r["v"] for r in relational.join(left, right, "k", right_is_uniq=True, last_by="at").collect()}
    assert got == {1: "y", 2: "q", None: "n"}
    assert relational.join(left, right, "k", right_is_distinct=True).count() == 5


def test_sketches_beside_exact_numbers(spark):
    df = spark.range(10_000).select((F.col("id") % 1000).alias("x"))
    assert abs(df.agg(numeric.median("x", 10_000)).first()[0] - df.agg(numeric.median("x")).first()[0]) <= 1
    assert abs(profile.stat(df, "x", approximate=0.02).first()["uniq_count"] - 1000) < 80
