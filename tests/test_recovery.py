"""What is left when a job fails in the middle: uploads, syncs and validation, and table functions over keys of many batches."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators.table_functions import map_ordered
from tessera.operators.terms import Term
from tessera.sources.database import Database
from tessera.sources.validation import quarantine
from tessera.streaming.sync import MultiSync, Sync

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"jdbc:derby:{tmp_path}/db;create=true", driver=DRIVER)


def test_upload_keeps_the_old_table_until_the_names_change(spark, db, monkeypatch):
    old, new = spark.range(10).select(F.col("id").alias("n")), spark.range(25).select(F.col("id").alias("n"))
    assert not db.exists("numbers") and db.upload(old, "numbers") == 10 and db.exists("NUMBERS") and not db.exists("numbers_bak")
    good = db._renames
    monkeypatch.setattr(db, "_renames", lambda *pairs: [*good(*pairs[:1]), "RENAME TABLE nowhere TO numbers"])
    with pytest.raises(Exception, match="(?i)nowhere"):
        db.upload(new, "numbers")
    # The first rename was done and undone with the second; what was written aside is still there.
    assert db.count("numbers") == 10 and not db.exists("numbers_bak") and db.count("numbers_tmp_upload") == 25
    monkeypatch.undo()
    assert db.upload(new, "numbers") == 25 and db.count("numbers") == 25 and db.count("numbers_bak") == 10 and not db.exists("numbers_tmp_upload")
    with pytest.raises(Exception, match="(?i)division|zero"):
        db.upload(new.select((F.lit(1) / (F.col("n") - 7)).alias("n")), "numbers")
    monkeypatch.setattr(db, "count", lambda table: 20)
    with pytest.raises(ValueError, match="20 of 25"):
        db.upload(new, "numbers", max_error_rate=0.1)
    assert db.upload(new, "numbers", max_error_rate=0.2) == 20
    monkeypatch.undo()
    assert db.count("numbers") == 25
    with pytest.raises(Exception, match="(?i)nowhere"):
        db.execute("INSERT INTO numbers VALUES (99)", "INSERT INTO nowhere VALUES (1)")
    assert db.count("numbers") == 25 and db.read("numbers", "n", (0, 25), 3).filter("n > 20").count() == 4


def test_renames_by_database(spark):
    names = [("t", "t_bak"), ("t_tmp_upload", "t")]
    assert Database(spark, "jdbc:postgresql://h/d")._renames(*names) == ["ALTER TABLE t RENAME TO t_bak", "ALTER TABLE t_tmp_upload RENAME TO t"]
    assert Database(spark, "jdbc:clickhouse://h/d")._renames(*names) == ["RENAME TABLE t TO t_bak, t_tmp_upload TO t"]


def test_no_database_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)not found|nowhere"):
        Database(spark, f"jdbc:derby:{tmp_path}/nowhere", driver=DRIVER).exists("t")


def test_a_killed_batch_neither_loses_nor_doubles_rows(spark, tmp_path):
    broken = {"after": None}

    def function(df):
        if broken["after"] == "before writing":
            raise RuntimeError("lost")
        return df.withColumn("twice", F.col("id") * (2 if broken["after"] is None else F.raise_error(F.lit("lost")).cast("long")))

    sync = Sync(f"{tmp_path}/in", f"{tmp_path}/out", "id long", function, files_each=1)
    rows = lambda a, b: spark.range(a, b, 1, 1).write.mode("append").parquet(sync.source)
    rows(0, 10)
    assert sync.run(spark) == 10 and sync.run(spark) == 0
    rows(10, 15)
    rows(15, 20)
    for broken["after"] in ("before writing", "in a task"):
        with pytest.raises(Exception, match="lost"):
            sync.run(spark)
    # A batch that was written but not yet listed as done: its folder holds rows when it comes again.
    spark.range(10, 13).withColumn("twice", F.lit(0)).write.mode("overwrite").parquet(f"{sync.target}/batch=1")
    broken["after"] = None
    assert MultiSync({"a": sync}).run(spark)["a"] >= 10
    assert sorted(map(tuple, sync.read(spark).collect())) == [(i, 2 * i) for i in range(20)] and sync.run(spark) == 0


def test_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2.5", '["a"]', "x"), ("y", "z", "[", "x"), (None, None, None, None), ("3", "-1", '["b"]', "x")], "a string, b string, c string, d string")
    df = rows.repartition(2)
    report = quarantine(df, "a int, b double, c array<string>, d string", f"{tmp_path}/out", {"positive": F.coalesce(F.col("b").try_cast("double"), F.lit(1.0)) > 0})
    assert (report.rows, report.bad, report.errors) == (4, 2, {"a": 1, "b": 1, "c": 1, "d": 0, "positive": 1})
    assert report.message() == "4 rows, 2 valid; errors: a 1, b 1, c 1, positive 1"
    assert sorted(map(tuple, report.good_rows(spark).collect()), key=repr) == [(1, 2.5, ["a"], "x"), (None, None, None, None)]
    bad = {tuple(e["field"] for e in r["errors"]): r for r in report.bad_rows(spark).collect()}
    assert set(bad) == {("a", "b", "c"), ("positive",)} and [e["received"] for e in bad["a", "b", "c"]["errors"]] == ["y", "z", "["] and bad["a", "b", "c"]["a"] is None
    lacking = quarantine(rows.select("a"), "a int, e date", f"{tmp_path}/lacking")
    assert lacking.errors == {"a": 1, "e": 4} and lacking.bad == 4
    with pytest.raises(ValueError, match="errors"):
        quarantine(rows.withColumnRenamed("a", "Errors"), "b double", f"{tmp_path}/no")


def test_a_table_function_keeps_its_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(500).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("k"), (-F.col("id")).alias("o"))
        got = map_ordered(rows, ["k"], ["o"], lambda s, b: ((*s, *b.column("o").to_pylist()), None), "n int, ordered boolean", tuple, lambda s: pa.table({"n": pa.array([len(s)], pa.int32()), "ordered": [list(s) == sorted(s)]}))
        assert sorted(map(tuple, got.collect())) == [(125, True)] * 4
        assert map_ordered(rows.limit(0), ["k"], ["o"], lambda s, b: (s, None), "n int").collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lookup(spark):
    known = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (None, "none", 1), (2, None, 1)], "x_id int, x_name string, at int")
    rows = spark.createDataFrame([(1,), (None,), (2,), (3,)], "x_id int")
    look = lambda **o: {r["x_id"]: r["x_name"] for r in Term("x").lookup(rows, known, "id", "name", "?", **o).collect()}
    assert look(last_by="at") == {1: "a", None: "none", 2: "?", 3: "?"} and look() == {1: "b", None: "none", 2: "?", 3: "?"}
