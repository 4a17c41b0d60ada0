"""The queries of this package's operators: thin calls with production parameters, over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.binary_packing import pack_binary, write_buckets
from tessera.llm.common import new_dir
from tessera.llm.containment import contained_items
from tessera.llm.conversation_trie import conversation_trie
from tessera.llm.gray_simhash import near_duplicates
from tessera.llm.license_automaton import scan_licences
from tessera.llm.line_chunks import drop_repeated_chunks
from tessera.llm.repetition import FIELDS, repetition_rules
from tessera.llm.site_style import extract_text
from tessera.llm.suffix_trees import drop_repeated_windows
from tessera.llm.token_counts import token_counts
from tessera.llm.token_files import read_token_files, write_token_files
from tessera.llm.warc_shards import read_warc, write_warc
from tessera.llm.whitening import whiten

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), folder, BYTE_BPE, end_id=0)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = pack_binary(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=1, max_length=2048)
    out = write_buckets(sequences, new_dir(spark, "buckets"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(F.col("repetition")[f].alias(f) for f in (*FIELDS, "base_failed", "kept")))


def op6_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), folder, min_revisit_bytes=0)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "dedup.text", "dedup.n_lines", "dedup.n_removed")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents")).drop("spans")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_windows(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "substrings.n_words", "substrings.n_removed", F.sha2("substrings.text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_site_style, op2_token_files, op3_gray_simhash, op4_binary_packing, op5_repetition, op6_containment, op7_token_counts, op8_warc, op9_line_chunks, op10_licences, op11_prefix_trie, op12_whitening, op13_suffix_trees)}
_WORDS = r"regexp_extract_all(lower(COALESCE(text, '')), '[\p{L}\p{N}]+')"
_SHINGLES = "unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s"

#: SQL has neither tokenizers, XXH64, context mixing, HTML nor eigenvectors; the other queries are tested against plain Python.
ORACLE_SQL: dict[str, str] = {
    "op6_containment": f"""
        WITH items AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        wanted AS (SELECT DISTINCT item_id, k, s FROM (SELECT item_id, k, {_SHINGLES} FROM items)),
        sizes AS (SELECT item_id, count(*) AS n FROM wanted GROUP BY 1),
        docs AS (SELECT doc_id, w, k FROM (SELECT doc_id, {_WORDS} AS w FROM documents), (SELECT DISTINCT k FROM items) WHERE len(w) >= k),
        held AS (SELECT DISTINCT doc_id, k, s FROM (SELECT doc_id, k, {_SHINGLES} FROM docs)),
        shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM held JOIN wanted USING (k, s) GROUP BY 1, 2)
        SELECT doc_id, item_id, n_shared, n AS n_shingles, n_shared / n AS containment FROM shared JOIN sizes USING (item_id) WHERE n_shared >= ceil(0.8 * n - 1e-9)""",
    "op8_warc": """
        WITH pages AS (SELECT page_id, COALESCE(html, '') AS t FROM pages),
        sums AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS kept FROM pages)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
            CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
        FROM sums""",
}
