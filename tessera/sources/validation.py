"""Validation in one pass: errors as data, bad rows kept apart, and counts from the job that writes them."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.names import free
from tessera.sources.schema import _schema, from_text

ERROR = "array<struct<field: string, expected: string, received: string>>"


def row_errors(df: DataFrame, schema: str, rules: dict[str, Column] | None = None) -> Column:
    """The row's errors as structs (field, expected, received): values that are none of the schema's type, and rules (name -> condition) that do not hold.

    A null is of any type; a rule that is null does not hold. A column that df lacks is an error of every row.
    """
    kinds, found = dict(df.dtypes), []
    for f in _schema(schema).fields:
        expected = f.dataType.simpleString()
        error = lambda received: F.struct(F.lit(f.name).alias("field"), F.lit(expected).alias("expected"), received.alias("received"))  # noqa: B023, E731
        if f.name not in kinds:
            found.append(error(F.lit(None).cast("string")))
        elif kinds[f.name] != expected:
            cast = from_text(f.name, f.dataType) if kinds[f.name] == "string" else F.col(f.name).try_cast(f.dataType)
            found.append(F.when(F.col(f.name).isNotNull() & cast.isNull(), error(F.col(f.name).cast("string"))))
    for name, condition in (rules or {}).items():
        found.append(F.when(~F.coalesce(condition, F.lit(False)), F.struct(F.lit(name).alias("field"), F.lit("rule").alias("expected"), F.lit(None).cast("string").alias("received"))))
    return F.filter(F.array(*found), lambda e: e.isNotNull()).cast(ERROR) if found else F.array().cast(ERROR)


@dataclass
class Report:
    """rows and bad: numbers of rows; errors: number of rows by field or rule."""

    path: str
    rows: int
    bad: int
    errors: dict[str, int]

    def good_rows(self, spark: SparkSession) -> DataFrame:
        return self._part(spark, True).drop("errors")

    def bad_rows(self, spark: SparkSession) -> DataFrame:
        """With their errors, which hold the values that did not fit."""
        return self._part(spark, False)

    def _part(self, spark: SparkSession, valid: bool) -> DataFrame:
        return spark.read.parquet(self.path).filter(F.col("valid") == valid).drop("valid")

    def message(self) -> str:
        odd = ", ".join(f"{k} {n}" for k, n in self.errors.items() if n)
        return f"{self.rows} rows, {self.rows - self.bad} valid" + (f"; errors: {odd}" if odd else "")


def quarantine(df: DataFrame, schema: str, path: str, rules: dict[str, Column] | None = None) -> Report:
    """Writes df by the schema, good and bad rows in folders of their own, and counts both in the same job.

    Values that do not fit are null in the bad rows, whose errors hold them. Counts are metrics observed on the way to the
    writer, so df is run once and nothing comes to the driver but one number for each field.
    """
    free(df, "errors", "valid")
    fields = _schema(schema).fields
    kinds = dict(df.dtypes)
    cast = lambda f: F.lit(None).cast(f.dataType) if f.name not in kinds else from_text(f.name, f.dataType) if kinds[f.name] == "string" and f.dataType.simpleString() != "string" else F.col(f.name).try_cast(f.dataType)
    out = df.withColumn("errors", row_errors(df, schema, rules)).select("errors", *(cast(f).alias(f.name) for f in fields)).withColumn("valid", F.size("errors") == 0)
    names = [*(f.name for f in fields), *(rules or {})]
    seen = Observation()
    counts = [F.count_if(F.exists("errors", lambda e: e["field"] == n)).alias(f"e{i}") for i, n in enumerate(names)]  # noqa: B023
    out.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("valid")).alias("bad"), *counts).write.partitionBy("valid").parquet(path)
    got = seen.get
    return Report(path, got["rows"], got["bad"], {n: got[f"e{i}"] for i, n in enumerate(names)})
