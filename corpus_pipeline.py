"""From raw documents to packed training sequences: five stages, each one of the operators of tessera.llm.

Each stage is defined for every table: null texts count as empty (and fail the quality rules), repeated rows are rows of
their own until near-dedup keeps one of them, ties go to the smallest id and then the smallest text hash, an empty table gives
an empty one, long texts are worked on whole, and columns beyond those of documents stay as they are.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.binary_packing import pack_binary
from tessera.llm.common import hidden, written
from tessera.llm.containment import with_contained
from tessera.llm.line_chunks import drop_repeated_chunks
from tessera.llm.near_copies import keep_one
from tessera.llm.queries import WORD_BPE
from tessera.llm.repetition import repetition_rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    name = hidden(docs, "rules")[0]
    return repetition_rules(docs, name=name).filter(F.col(name)["kept"]).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that stood earlier; n_chars follows the text."""
    name = hidden(docs, "dedup")[0]
    text = F.col(name)["text"]
    return drop_repeated_chunks(docs, name=name).withColumns({"n_chars": F.length(text).cast("long"), "text": text}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: candidates by fingerprints, links by a similarity of 0.8 in shingles of five words."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = hidden(docs, "items")[0]
    return with_contained(docs, items, name=name).filter(F.size(name) == 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences whose lengths are powers of two."""
    return pack_binary(docs, WORD_BPE, end_id=1, max_length=2048)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("packing", packing)]

#: SQL cannot express several of the stages; tests/llm/test_pipeline.py holds run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
