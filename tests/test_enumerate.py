"""Row numbers over tables that are wider than the order's columns, written whole."""

from pyspark.sql import functions as F

from tessera.operators import relational

SF = "/root/testdata/sf0.1"


def test_wide_tables_keep_every_row(spark, tmp_path):
    conf = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for name, order in (("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"])):
            rows = spark.read.parquet(f"{SF}/{name}.parquet")
            n = rows.count()
            out = relational.enumerate_rows(rows, *order, field="n")
            assert out.columns == [*rows.columns, "n"]
            out.write.parquet(str(tmp_path / name))
            got = spark.read.parquet(str(tmp_path / name))
            assert got.agg(F.count("n"), F.countDistinct("n"), F.min("n"), F.max("n")).first() == (n, n, 0, n - 1)
            ahead = got.select(F.struct("n", *order).alias("a")).join(got.select((F.col("n") - 1).alias("m"), F.struct(*order).alias("b")), F.col("a.n") == F.col("m"))
            assert ahead.filter(F.struct(*(F.col(f"a.{c}") for c in order)) > F.col("b")).count() == 0
            parts = relational.split_by_positions(rows, [1000, n // 2], *order)
            assert [p.count() for p in parts] == [1000, n // 2 - 1000, n - n // 2]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
