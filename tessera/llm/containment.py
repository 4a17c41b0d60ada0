"""Benchmark decontamination (operator 6): size-partitioned MinHash containment search, verified by exact shingles.

A test item of n distinct shingles is contained in a document when at least ceil(0.8 n) of them occur there. Then at most
n - ceil(0.8 n) are missing, so of any n - ceil(0.8 n) + 1 shingles one occurs. The item's MinHash sketch holds that many:
those with the smallest hashes. Items are partitioned by size, for the sketch, the number of shared shingles that is
needed, and the least document that can hold it follow from n. A document is looked up shingle by shingle, so its length
costs no recall, and items that hit are verified word by word.

Items of up to BLOCK_BYTES together are sent to the executors, where each document is searched without a shuffle. More
items meet the documents in a join by shingle hash, and no item comes to the driver: see _joined.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tessera.llm.common import SLICE_BYTES, free_names, hidden, no_null, row_slices, text_slices, written

#: Words are runs of letters and digits in lower case, so case and punctuation hide no item.
_WORD = re.compile(r"[^\W_]+")
#: So many bytes of items are sent to the executors; more items are joined.
BLOCK_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each k words in a row."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + len(out)]) * _BASE
        out ^= out >> np.uint64(31)
    return out


def _shingles(words: list[str], k: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(k)), strict=False))


class _Item:
    """An item's shingles, how many of them are needed, and its sketch: the smallest hashes, one of which any document has that holds so many."""

    def __init__(self, text: str, words_each: int, least: float, hashed):
        words = words_of(text)
        self.k = min(words_each, len(words))
        self.shingles = _shingles(words, self.k) if self.k else set()
        self.n = len(self.shingles)
        self.need = math.ceil(least * self.n - 1e-9)
        self.sketch = np.unique(_shingle_hashes(hashed(words), self.k))[: self.n - self.need + 1] if self.n else np.zeros(0, np.uint64)


class _Size:
    """The items of one size class: those of 2^c to 2^(c+1) - 1 shingles, of one shingle length."""

    def __init__(self, k: int):
        self.k, self.hashes, self.items, self.least = k, [], [], 1 << 62

    def add(self, item: int, need: int, sketch: np.ndarray) -> None:
        self.hashes += sketch.tolist()
        self.items += [item] * len(sketch)
        self.least = min(self.least, need)

    def close(self) -> None:
        order = np.argsort(np.array(self.hashes, np.uint64), kind="stable")
        self.hashes, self.items = np.array(self.hashes, np.uint64)[order], np.array(self.items)[order]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> set[int]:
        if len(h) < self.least:
            return set()
        h = h[self.bitmap[(h >> np.uint64(44)).astype(np.int64)]]
        at = np.searchsorted(self.hashes, h)
        found = np.unique(h[(at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h)])
        a, b = np.searchsorted(self.hashes, found, "left"), np.searchsorted(self.hashes, found, "right")
        return {int(i) for x, y in zip(a, b, strict=True) for i in self.items[x:y]}


class ItemSearch:
    def __init__(self, texts: list[str], words_each: int, least: float):
        self.words, self.exact, sizes = _Hashes(), [], {}
        for number, text in enumerate(texts):
            item = _Item(text, words_each, least, self.hashed)
            self.exact.append((item.k, item.n, item.need, item.shingles))
            if item.n:
                sizes.setdefault((item.k, item.n.bit_length()), _Size(item.k)).add(number, item.need, item.sketch)
        self.sizes = list(sizes.values())
        for s in self.sizes:
            s.close()

    def hashed(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, its shingles that the text holds, its shingles) of each contained item."""
        words = words_of(text)
        h, by, out, own = self.hashed(words), {}, [], {}
        for s in self.sizes:
            if s.k not in by:
                by[s.k] = _shingle_hashes(h, s.k)
            for item in s.hits(by[s.k]):
                k, n, need, shingles = self.exact[item]
                if k not in own:
                    own[k] = _shingles(words, k)
                if (shared := len(shingles & own[k])) >= need:
                    out.append((item, shared, n))
        return sorted(out)


def with_contained(docs: DataFrame, items: DataFrame, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", name: str = "contained", words_each: int = 5, least: float = 0.8) -> DataFrame:
    """docs with an array column of that name added: (item id, n_shared, n_shingles) of each item whose shingles lie in the text to the share `least` or more.

    Shingles have words_each words; an item of fewer words is one shingle, and one without words is never found. Null texts
    are empty. Repeated items and rows are found each. name must not be a column of docs, in any case of letters; all its columns stay.
    An empty table of items finds nothing; an empty table of docs gives an empty one. Texts are searched whole, each in one task.

    The items' size is taken first, as one number. Up to BLOCK_BYTES they are sent to the executors; each row is searched
    alone then, with no shuffle. Beyond, items and documents meet in joins, and neither is sent anywhere whole. Both ways
    find the same items.
    """
    free_names(docs, name)
    rows = items.select(F.col(id_col).alias("id"), no_null(item_text).alias("text"))
    kind = T.ArrayType(T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_shared", T.LongType()), T.StructField("n_shingles", T.LongType())]))
    if (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BLOCK_BYTES:
        return _joined(docs, rows, text_col, name, kind, words_each, least)
    block = rows.orderBy("id", "text").collect()  # BLOCK_BYTES at most
    return docs.withColumn(name, _search([r["id"] for r in block], [r["text"] for r in block], kind, words_each, least)(no_null(text_col)))


def _joined(docs: DataFrame, items: DataFrame, text_col: str, name: str, kind: T.ArrayType, words_each: int, least: float) -> DataFrame:
    """with_contained for any number of items: sketches and the documents' shingles are joined by hash, and pairs that meet are verified.

    Texts are known by a hash of 128 bits, so equal documents and equal items are searched once. Shingle rows hold two
    numbers beside the hash; texts move only for documents that met an item.
    """
    key = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))
    items = items.withColumn("item", key("text"))
    texts = items.groupBy("item").agg(F.first("text").alias("text"))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        hashed = lambda words: np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        for b in row_slices(batches, "text"):
            got = [_Item(t, words_each, least, hashed) for t in b.column(1).to_pylist()]
            sizes = [len(x.sketch) for x in got]
            take = np.repeat(np.arange(len(got)), sizes)
            flat = np.concatenate([np.zeros(0, np.uint64), *(x.sketch for x in got)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), pa.array(np.repeat([x.k for x in got], sizes).astype(np.int32)), pa.array(flat)], ["item", "k", "hash"])

    of = "item struct<a: bigint, b: bigint>"
    sketch = written(texts.mapInArrow(sketches, f"{of}, k int, hash bigint"), "sketches")
    lengths = [r["k"] for r in sketch.select("k").distinct().collect()]  # words_each numbers at most

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in row_slices(batches, "text", SLICE_BYTES // 4):
            for i, t in enumerate(b.column(1).to_pylist()):
                words = words_of(t)
                h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                for k in lengths:
                    found = np.unique(_shingle_hashes(h, k)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(found), i))), pa.array(np.full(len(found), k, np.int32)), pa.array(found)], ["doc", "k", "hash"])

    rows = docs.select(key(no_null(text_col)).alias("doc"), no_null(text_col).alias("text"))
    met = rows.mapInArrow(shingles, "doc struct<a: bigint, b: bigint>, k int, hash bigint").join(sketch, ["k", "hash"]).select("doc", "item").distinct()
    met = written(met, "met")
    whole = rows.join(met.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("document"))
    pairs = met.join(texts, "item").join(whole, "doc").select("doc", "item", "document", "text")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "document"):
            out, last = [], (None, None, None)
            for i, (document, text) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                item = _Item(text, words_each, least, lambda words: np.zeros(len(words), np.uint64))
                if last[:2] != (document, item.k):
                    last = (document, item.k, _shingles(words_of(document), item.k))
                if (shared := len(item.shingles & last[2])) >= item.need:
                    out.append((i, shared, item.n))
            at, shared, n = (pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], [])))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), shared, n], ["doc", "item", "n_shared", "n_shingles"])

    held = pairs.mapInArrow(verified, f"doc struct<a: bigint, b: bigint>, {of}, n_shared bigint, n_shingles bigint")
    found = held.join(items.select("item", "id"), "item").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("id", "n_shared", "n_shingles"))).cast(kind).alias("found"))
    own = docs.withColumn(name, key(no_null(text_col)))
    doc_, found_ = hidden(own, "doc", "found")
    found = written(found, "found").withColumnsRenamed({"doc": doc_, "found": found_})
    out = own.join(found.hint("merge"), own[name] == found[doc_], "left")
    return out.withColumn(name, F.coalesce(F.col(found_), F.array().cast(kind))).drop(doc_, found_)


def _search(ids: list, texts: list[str], kind: T.ArrayType, words_each: int, least: float):
    @F.arrow_udf(kind)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = ItemSearch(texts, words_each, least)
        names = [f.name for f in kind.elementType]
        of = to_arrow(kind)
        for got in batches:
            yield pa.array([[dict(zip(names, (ids[i], shared, n), strict=True)) for i, shared, n in index.find(t)] for part in text_slices(got) for t in part], of)

    return search.asNondeterministic()


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment): a row for each document and item it contains."""
    out = with_contained(docs.select(F.col(doc_id), F.col(text_col).alias("__text")), items, item_id, "text", "__text", "__found")
    out = out.select(doc_id, F.explode("__found").alias("f")).select(doc_id, f"f.{item_id}", "f.n_shared", "f.n_shingles")
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
