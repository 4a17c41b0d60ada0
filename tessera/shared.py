"""The folder that all executors share, tables written there, and settings for the time of a write."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a URI: spark.checkpoint.dir, on the default file system where it names none.

    Where it is unset, a local application takes one new temporary folder; on a cluster that is an error, as executors
    would not see one another's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _local_dir(spark.sparkContext.applicationId)
    return qualified(spark, at)


@lru_cache(maxsize=1)
def _local_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def qualified(spark: SparkSession, at: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}".rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: the lineage ends there, and lost executors cost nothing before it."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings within a block; what they were comes back after it."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
