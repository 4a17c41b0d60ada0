"""Files that tasks write into a shared folder, in formats that Spark has no writer for.

A task writes under a temporary name that holds its attempt, renames the file when it is whole, and returns a row for it.
The rows, written by Spark's own committer, are the manifest: readers open what the manifest names and nothing else.
Names hold the shard, the number and a hash of the bytes: attempts that wrote the same bytes made the same file, and
attempts that did not never overwrite one another.
"""

import hashlib

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


class ShardFile:
    """One file of a task."""

    def __init__(self, folder: str, shard: int, number: int, suffix: str):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.start, self.suffix = f"{shard:06d}-{number:04d}", suffix
        self.temporary = f"{self.base}/.{self.start}-{TaskContext.get().taskAttemptId()}.tmp"
        self.out, self.bytes, self.sum = self.fs.open_output_stream(self.temporary), 0, hashlib.sha1()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)
        self.sum.update(data)

    def close(self) -> str:
        self.out.close()
        name = f"{self.start}-{self.sum.hexdigest()[:16]}{self.suffix}"
        path = f"{self.base}/{name}"
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            self.fs.move(self.temporary, path)
        else:  # another attempt wrote the same bytes
            self.fs.delete_file(self.temporary)
        return name


def open_shard(folder: str, name: str):
    fs, base = pafs.FileSystem.from_uri(folder)
    return fs.open_input_file(f"{base}/{name}")


def commit(rows: DataFrame, folder: str) -> DataFrame:
    """Runs the writing tasks and writes their rows as the manifest."""
    rows.write.parquet(f"{folder}/_manifest")
    return manifest(rows.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/_manifest")
