"""Readers and writers: text, JSON lines, CSV/TSV, Parquet, partitioned files and JDBC tables. All are Spark's own, so filters and columns reach the scan."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import settings
from tessera.sources.schema import from_text, schema_by_names

DELIMITERS = {"csv": ",", "tsv": "\t"}
#: What may stand between the fields of a line, the first that occurs decides.
LINE_DELIMITERS = ("\t", "; ", ", ", ";", ",", " ")


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, header: bool = True) -> DataFrame:
    """By the path's ending, or by kind: parquet, orc, csv, tsv, json (lines) or txt."""
    kind = kind or path.rstrip("/").removesuffix(".gz").rpartition(".")[2].lower()
    r = spark.read.schema(schema) if schema else spark.read
    if kind in DELIMITERS:
        return r.csv(path, sep=DELIMITERS[kind], header=header)
    if kind in ("json", "jsonl"):
        return r.json(path)
    if kind in ("parquet", "orc"):
        return r.format(kind).load(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_by_title(spark: SparkSession, path: str, kind: str = "tsv") -> DataFrame:
    """A file with a title row, typed by its column names; bad values are null."""
    raw = spark.read.csv(path, sep=DELIMITERS[kind], header=True)
    return raw.select(*(from_text(f"`{f.name}`", f.dataType).alias(f.name) for f in schema_by_names(raw.columns)))


def write(df: DataFrame, path: str, kind: str | None = None, partition_by: tuple[str, ...] = (), mode: str = "errorifexists", open_files: int = 0) -> None:
    """By the path's ending, or by kind. A task of a partitioned write sorts its rows by folder, unless so many files may stay open in it at once (it sorts from there on)."""
    if open_files:
        with settings(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(open_files)}):
            return write(df, path, kind, partition_by, mode)
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if kind in DELIMITERS:
        w.csv(path, sep=DELIMITERS[kind], header=True)
    elif kind in ("json", "jsonl"):
        w.json(path)
    elif kind in ("parquet", "orc"):
        w.format(kind).save(path)
    else:
        df.select(F.col(df.columns[0]).cast("string")).write.mode(mode).text(path)


def parse_json_lines(lines: DataFrame, schema: str, column: str = "line", errors: str = "_err") -> DataFrame:
    """Fields of JSON lines; lines that are none have null fields and a message."""
    got = F.from_json(F.col(column), f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    out = lines.withColumn("__j", got)
    names = [f.name for f in out.schema["__j"].dataType.fields if f.name != "__bad"]
    return out.select(*(F.col(f"__j.{n}").alias(n) for n in names), F.when(F.col("__j.__bad").isNotNull(), F.lit("JSONDecodeError")).alias(errors))


def read_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple = (), partitions: int = 1, **options: str) -> DataFrame:
    """A database table over JDBC; with a partition column in parallel ranges, so that no single task reads it all."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        r = r.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return r.load()


def write_table(df: DataFrame, url: str, table: str, batch: int = 1000, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=str(batch), **options).save()


def safe_write_table(df: DataFrame, url: str, table: str, least_share: float = 0.9, **options: str) -> int:
    """Replaces a table at once, by way of one written aside (see Database.upload); returns its rows."""
    from tessera.sources.database import Database

    return Database(df.sparkSession, url, **options).upload(df, table, max_error_rate=1 - least_share)


def table_exists(spark: SparkSession, url: str, table: str, **options: str) -> bool:
    """Whether there is the table; an error if the database cannot be asked."""
    from tessera.sources.database import Database

    return Database(spark, url, **options).exists(table)


def describe_table(spark: SparkSession, url: str, table: str, **options: str) -> list[tuple[str, str]]:
    """(column, type) of a database table."""
    return read_table(spark, url, table, **options).dtypes


def detect_delimiter(line: str, delimiters: tuple[str, ...] = LINE_DELIMITERS, default: str = "\t") -> str:
    """The first of the listed delimiters that occurs in the line; a tab if none does."""
    return next((d for d in delimiters if d in line), default)


def first_line(spark: SparkSession, path: str) -> str | None:
    rows = spark.read.text(path).take(1)
    return rows[0][0] if rows else None


def listing(spark: SparkSession, path: str, mask: str = "*", recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime) of the files under a folder whose names match; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", mask).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", "modificationTime")


def lines_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
