"""Incremental sync: the rows of files that a source folder has not given before, once each, into a target folder.

Structured Streaming keeps the list of files done and deals the new ones into numbered batches (availableNow: it stops when
there are no more). A batch writes a folder of its own number, over what an earlier try of it left, so a batch that was
killed neither loses rows nor gives them twice.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Sync:
    """function(batch) gives the rows to be written for a batch of the source's rows. state: where the files done are listed, the target with _state unless given."""

    source: str
    target: str
    schema: str
    function: Callable[[DataFrame], DataFrame] = lambda df: df
    kind: str = "parquet"
    state: str | None = None
    files_each: int | None = None
    options: dict = field(default_factory=dict)

    def run(self, spark: SparkSession) -> int:
        """Takes in all new files; returns the number of their rows. State and target belong together: a new state starts from the first file, under batch number 0."""

        def put(batch: DataFrame, number: int) -> None:
            self.function(batch).write.mode("overwrite").parquet(f"{self.target}/batch={number}")

        given = spark.readStream.schema(self.schema).format(self.kind).options(**self.options)
        if self.files_each:
            given = given.option("maxFilesPerTrigger", self.files_each)
        query = given.load(self.source).writeStream.foreachBatch(put).option("checkpointLocation", self.state or f"{self.target}_state").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(p.numInputRows for p in query.recentProgress)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.target).drop("batch")


@dataclass
class MultiSync:
    """Several syncs by name; each goes on from where it stopped."""

    syncs: dict[str, Sync]

    def run(self, spark: SparkSession) -> dict[str, int]:
        return {name: s.run(spark) for name, s in self.syncs.items()}
