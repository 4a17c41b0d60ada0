"""Jobs: named operations from inputs to outputs, run where the output is not there yet."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.files import read, write


@dataclass
class Operation:
    """function(*inputs) gives the output's rows. Paths may hold {parameters}."""

    name: str
    inputs: list[str]
    output: str
    function: Callable[..., DataFrame]

    def run(self, spark: SparkSession, force: bool = False, **parameters) -> DataFrame:
        path = self.output.format(**parameters)
        if force or not committed(spark, path):
            # What a failed run left is written over; anything else that lies there is not.
            write(self.function(*(read(spark, p.format(**parameters)) for p in self.inputs)), path, mode="overwrite" if force or exists(spark, f"{path}/_temporary") else "errorifexists")
        return read(spark, path)


@dataclass
class Job:
    operations: list[Operation] = field(default_factory=list)

    def run(self, spark: SparkSession, force: bool = False, **parameters) -> dict[str, DataFrame]:
        return {o.name: o.run(spark, force, **parameters) for o in self.operations}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a run that ended well wrote the folder: Spark leaves a marker there when it commits."""
    return exists(spark, f"{path}/_SUCCESS")
