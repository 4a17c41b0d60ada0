"""SimHash near-duplicates over a Gray-order hierarchical index (operator 3).

Any two fingerprints of 64 bits that differ in at most 3 bits agree on one of four 16-bit blocks, and, within the other
48 bits, on one of four 12-bit blocks. So each distinct fingerprint goes to 16 groups of equal 28 bits, and any two that
link meet in one of them. Within its groups a task sorts by Gray rank, so that neighbours differ in few bits, and builds
a hierarchy: a node holds the pattern of the bits that all below it share and that no node above it holds. A query adds up
the differences on the way down and leaves a whole node as soon as they exceed the limit. Tasks return a spanning forest of
their links, and a join of small tables finds the components.
"""

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tessera.llm.common import no_null, partitions, text_slices, written

BITS = 3
#: Children of a node; and the rows of a group beyond which it is split into parts, every two of which meet in one task.
FAN, SPLIT = 8, 8192
#: Query and node pairs held at once.
FRONT = 1 << 20


def shingle_hashes(text: str, words_each: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle in order, of the whole sequence if there are fewer words, none without words."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z alone, and exactly the white space x20 and x09-x0D
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - words_each + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(words_each)), strict=False)) if len(words) >= words_each else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)


def simhash(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: str) -> int:
    return simhash(shingle_hashes(text, 3))


@F.arrow_udf(T.LongType())
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        got = np.array([fingerprint(t) for part in text_slices(texts) for t in part], np.uint64)
        yield pa.array(got.view(np.int64), pa.int64())


def gray_rank(x: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """The hierarchy over groups of fingerprints; pairs() gives the pairs of one group within the limit."""

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        self.order = np.lexsort((gray_rank(prints), group))
        group, self.prints = group[self.order], prints[self.order]
        n = len(prints)
        shared, pattern, of = np.full(n, ~np.uint64(0)), self.prints, group
        first, last = np.arange(n), np.arange(n)
        #: From the leaves up: for each node the newly shared mask, the pattern, its children, and its last leaf.
        self.levels = []
        children = (np.zeros(n, np.int64), np.zeros(n, np.int64))
        while True:
            begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
            top = len(begins) == len(of)
            if top:
                self.levels.append([shared, pattern, *children, last])
                self.root = np.searchsorted(of, group)
                break
            place = np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
            heads = np.flatnonzero(place % FAN == 0)
            ends = np.append(heads[1:], len(of))
            ones = np.bitwise_and.reduceat(pattern | ~shared, heads)
            some = np.bitwise_or.reduceat(pattern & shared, heads)
            common = np.bitwise_and.reduceat(shared, heads) & ~(ones ^ some)
            above = np.repeat(common, ends - heads)
            self.levels.append([shared & ~above, pattern, *children, last])
            shared, pattern, of = common, ones & common, of[heads]
            children, last = (heads, ends), last[ends - 1]

    def pairs(self, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in sorted order) of two fingerprints that link, the smaller first."""
        n = len(self.prints)
        for at in range(0, n, FRONT // 16):
            q = np.arange(at, min(n, at + FRONT // 16))
            yield from self._down(len(self.levels) - 1, q, self.root[q], np.zeros(len(q), np.int64), bits)

    def _down(self, level: int, q, node, far, bits):
        mask, pattern, begin, end, last = self.levels[level]
        far = far + np.bitwise_count((self.prints[q] ^ pattern[node]) & mask[node])
        keep = (far <= bits) & (last[node] > q)
        q, node, far = q[keep], node[keep], far[keep]
        if not level:
            if len(q):
                yield q, node
            return
        sizes = end[node] - begin[node]
        for part in np.array_split(np.arange(len(q)), max(1, int(sizes.sum()) // FRONT + 1)):
            if len(part):
                s = sizes[part]
                below = np.repeat(begin[node[part]] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
                yield from self._down(level - 1, np.repeat(q[part], s), below, np.repeat(far[part], s), bits)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest of its set) after the sets of a and b are joined, pair by pair."""
    while True:
        x, y = labels[a], labels[b]
        odd = x != y
        if not odd.any():
            return labels
        a, b, x, y = a[odd], b[odd], x[odd], y[odd]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := labels[labels], labels):
            labels = up


def _forest(group: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that span the components within the groups, and the places of their first ends."""
    index = GrayIndex(group, prints)
    labels = np.arange(len(prints))
    for a, b in index.pairs():
        labels = join_labels(labels, a, b)
    odd = np.flatnonzero(labels != np.arange(len(labels)))
    return index.prints[odd], index.prints[labels[odd]], index.order[odd]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b, fp), sorted by the group's three columns, to links."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        key, a, b, fp = (np.concatenate(c) for c in zip(*held, strict=True))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        stop = len(key) if last else int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
        held.clear()
        if stop < len(key):
            held.append((key[stop:], a[stop:], b[stop:], fp[stop:]))
        group = np.cumsum(new[:stop])
        several = np.bincount(group)[group] > 1 if stop else np.zeros(0, bool)
        if several.any():
            x, y, at = _forest(group[several], fp[:stop][several].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key[:stop][several][at] >> 32), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["k", "a", "b"])

    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
            rows += batch.num_rows
            if rows >= 1 << 18:
                yield from flush(False)
                rows = sum(len(x[0]) for x in held)
    if held:
        yield from flush(True)


def _keys(fp):
    """The 16 group keys: the number of the group's blocks, then their 28 bits."""
    out = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        rest = F.lit(0).cast("long")
        for k, j in enumerate(j for j in range(4) if j != i):
            rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 16 * j).bitwiseAND(0xFFFF), 16 * k))
        for j in range(4):
            sub = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            out.append(F.lit((4 * i + j) << 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(sub))
    return F.array(*out)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the edges (a, b): root is the component's smallest node. Large-star and small-star steps, each a written table, until no edge changes."""
    seen = None
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v")
        edges = written(small.distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = now


def links(prints: DataFrame) -> DataFrame:
    """(k, a, b): links that span the components of the fingerprints (k, fp) of each number k."""
    # Each row becomes 16: as many tasks as partitions, however small the table is before.
    prints = prints.repartition(partitions(prints.sparkSession), "fp")
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"), "k").withColumn("key", F.col("key").bitwiseOR(F.shiftleft("k", 32))).drop("k")
    hot = written(keyed.groupBy("key").count().filter(F.col("count") > SPLIT).select("key", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts")), "hot")
    keyed = keyed.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    keyed = keyed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = keyed.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    return keyed.repartition(partitions(prints.sparkSession), "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_linked, "k long, a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of each row, and (fp, best) of each fingerprint: best is the first row of its component, as (id is null, id, hash of the text)."""
    spark = docs.sparkSession
    rows = written(docs.select(F.col(id_col).alias("id"), F.xxhash64(no_null(text_col)).alias("sum"), _fingerprints.asNondeterministic()(no_null(text_col)).alias("fp")), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "sum")).alias("first")), "prints")
    edges = links(prints.select(F.lit(0).cast("long").alias("k"), "fp")).select("a", "b")
    roots = components(edges)
    roots = written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    near = written(prints.join(roots, prints["fp"] == roots["node"]).select("fp", "root", "first"), "near")
    least = near.groupBy("root").agg(F.min("first").alias("least"))
    known = written(near.join(least, "root").select("fp", "least"), "components")
    return rows, prints.join(known, "fp", "left").select("fp", F.coalesce("least", "first").alias("best"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs.

    Fingerprints (see fingerprint()) link at 3 or fewer differing bits; component_id is the smallest id that is reachable
    over any number of links, the row's own included. Null texts are empty; texts without words have fingerprint zero and
    link like any other. Null ids come last (a component of null ids alone has a null component_id). Repeated rows are
    given each; an empty table gives none; other columns are not read. Texts are read whole, however long, each in one task.

    Copies meet in one grouping by fingerprint (combined before the shuffle); only distinct fingerprints are compared.
    Groups of more than SPLIT fingerprints are split into parts, every two of which meet in a task of their own.
    """
    rows, of = _grouped(docs, id_col, text_col)
    return rows.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id"))
