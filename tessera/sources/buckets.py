"""Tables bucketed and sorted by key. What a merge of two sorted streams is elsewhere is here a join that reads both as they lie: no row moves."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import relational
from tessera.shared import new_dir


def write_bucketed(df: DataFrame, keys: str | list[str], buckets: int, table: str | None = None, path: str | None = None) -> str:
    """Writes df as a table of so many buckets by the keys, each one file sorted by them; returns the table's name (a new one if none is given).

    Rows are dealt as buckets are, so a task writes one bucket. Tables that are to be joined need the same keys, in the
    same order, and as many buckets; choose them so that a bucket fits a task. path: where the files go, a new folder of
    the shared one if none is given.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    table = table or f"bucketed_{uuid.uuid4().hex}"
    w = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    w.option("path", path or new_dir(df.sparkSession, "bucketed")).saveAsTable(table)
    return table


def merge_join(spark: SparkSession, left: str, right: str, keys: str | list[str], how: str = "left", right_is_uniq: bool = False, last_by: str | None = None) -> DataFrame:
    """relational.join of two bucketed tables by the keys of their buckets: a sort-merge join of each pair of buckets, without an exchange.

    Null keys match nothing here, as only plain equality follows buckets. right_is_uniq keeps the last right row of each
    key by last_by, bucket by bucket; otherwise right rows are taken as they are.
    """
    return relational.join(spark.table(left), spark.table(right).hint("merge"), keys, how, right_is_uniq, last_by, null_safe=False, right_is_distinct=True)
