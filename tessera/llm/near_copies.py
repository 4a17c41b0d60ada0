"""Near copies of whole texts: candidates by fingerprints in the Gray-order index of operator 3, links by exact similarity.

One SimHash in 3 bits finds few texts of a similarity near 0.8. So a text has several fingerprints: that of all its shingles,
and one for each band, the SimHash of a few shingles that least hashes choose, which two texts share with the power of their
similarity. Fingerprints of a number that link in the index, over any number of links, are a cluster; clusters of the same
texts are one. Within a cluster every two texts are compared by their sets of shingles, so bands decide only who is
compared: at a similarity of 0.8 eight bands of four miss 1.5 % of pairs, at 0.85 0.3 %.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import hidden, no_null, partitions, row_slices, text_slices, written
from tessera.llm.gray_simhash import components, join_labels, links, shingle_hashes, simhash

#: Bands of a text and chosen shingles of a band.
BANDS, ROWS = 8, 4
#: Shingles, and texts, of a cluster beyond which it is split into parts, every two of which meet in one task.
SHINGLES, SPLIT = 1 << 21, 1 << 12
_GOLDEN = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prints(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The fingerprints of a text with these shingle hashes: that of all, then one for each band. A chosen shingle is the one of least hash times an odd number."""
    out = np.zeros(1 + bands, np.uint64)
    if len(h):
        factors = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(_GOLDEN)) | np.uint64(1)
        least = np.array([(h * f).min() for f in factors], np.uint64)
        out[0] = simhash(h)
        # Mixed, as all least values begin with zeros.
        ones = np.unpackbits(_mixed(least).astype(">u8").view(np.uint8)).reshape(bands, rows, 64).sum(1)
        out[1:] = np.packbits(2 * ones > rows, axis=1).view(">u8").ravel()
    return out


def _prints(words_each: int, bands: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def many(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = [prints(shingle_hashes(t, words_each), bands) for part in text_slices(texts) for t in part]
            flat = np.concatenate([np.zeros(0, np.uint64), *got]).view(np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * (1 + bands)), pa.array(flat))

    return many.asNondeterministic()


def _shingle_sets(words_each: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(of, text) to (of, n, shingles); a text that repeats stands side by side, and counts once."""
        last = None
        for b in row_slices(batches, "text"):
            of, out = [], []
            for o, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if o != last:
                    last = o
                    of.append(o)
                    out.append(np.unique(shingle_hashes(text or "", words_each)).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in out])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *out])))], ["of", "n", "shingles"])

    return sets


def alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that span the components of sets whose Jaccard similarity is so high; two empty sets are equal."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([np.zeros(0, np.int64), *sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    # Owners of each shingle stand together; a text's shingles point to where theirs begin and end.
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(flat))
    which = np.empty(len(flat), np.int64)
    which[order] = np.repeat(np.arange(len(begin)), end - begin)
    labels, at = np.arange(len(sets)), np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(sets)):
        mine = which[at[i] : at[i + 1]]
        b, n = begin[mine], (end - begin)[mine]
        others = owner[np.repeat(b - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        shared = np.bincount(others, minlength=len(sets))
        union = sizes + sizes[i] - shared
        near = np.flatnonzero(shared >= similarity * union - 1e-9)
        near = near[near < i]
        if len(near):
            labels = join_labels(labels, np.full(len(near), i), near)
    odd = np.flatnonzero(labels != np.arange(len(labels)))
    return odd, labels[odd]


def _compared(similarity: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cluster, a, b, of, shingles), sorted by the first three, to links (a, b) of texts."""
        key, of, sets = None, [], []

        def done() -> pa.RecordBatch:
            x, y = alike(sets, similarity)
            ids = np.array(of, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["a", "b"])

        for batch in batches:
            lists = batch.column(3)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            ends = ends - ends[0]
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for i, (k, o) in enumerate(zip(keys, batch.column(4).to_pylist(), strict=True)):
                if k != key:
                    if len(of) > 1:
                        yield done()
                    key, of, sets = k, [], []
                of.append(o)
                sets.append(flat[ends[i] : ends[i + 1]].copy())
        if len(of) > 1:
            yield done()

    return compared


def similar_texts(texts: DataFrame, docs: DataFrame, words_each: int, similarity: float, split: int, shingles: int) -> DataFrame:
    """Links (a, b) that span the groups of texts (of, prints, id); of docs (of, id, text) the rows of these ids are read."""
    spark = texts.sparkSession
    parts = partitions(spark)
    nodes = written(texts.select("of", F.posexplode("prints").alias("k", "fp")).select("of", F.col("k").cast("long").alias("k"), "fp", F.xxhash64("k", "fp").alias("node")), "nodes")
    node = lambda c: F.xxhash64(F.col("k").cast("int"), c)
    roots = components(links(nodes.select("k", "fp").distinct()).select(node("a").alias("a"), node("b").alias("b")))
    members = nodes.join(roots.hint("merge"), "node", "left").select(F.coalesce("root", "node").alias("cluster"), "of").distinct()
    members = written(members.withColumn("mark", F.xxhash64("of")), "members")
    # Bands often bring the same texts together: of clusters with the same members one is compared.
    same = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("mark").cast("decimal(38,0)")).alias("sum"), F.bit_xor("mark").alias("xor")).filter("n > 1")
    clusters = same.groupBy("n", "sum", "xor").agg(F.min("cluster").alias("cluster")).select("cluster")
    members = written(members.join(clusters.hint("merge"), "cluster").select("cluster", "of"), "clusters")
    wanted = members.select("of").distinct().join(texts.select("of", "id").hint("merge"), "of").withColumnsRenamed({"of": "text_of", "id": "lead"})
    sets = docs.join(wanted.hint("merge"), (F.col("of") == F.col("text_of")) & F.col("id").eqNullSafe(F.col("lead"))).select("of", "text").mapInArrow(_shingle_sets(words_each), "of long, n long, shingles array<long>")
    sets = written(sets, "shingles")
    sizes = members.join(sets.select("of", "n").hint("merge"), "of").groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / shingles), F.ceil(F.count(F.lit(1)) / split)).cast("int").alias("parts"))
    hot = written(sizes.filter("parts > 1"), "hot")
    rows = members.join(hot.hint("merge"), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("of"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "of")
    rows = rows.join(sets.hint("merge"), "of").select("cluster", "a", "b", "shingles", "of")
    return rows.repartition(parts, "cluster", "a", "b").sortWithinPartitions("cluster", "a", "b").mapInArrow(_compared(similarity), "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, similarity: float = 0.8, bands: int = BANDS, split: int = SPLIT, shingles: int = SHINGLES) -> DataFrame:
    """One row of docs for each group of near copies: that of the smallest id (nulls last), of equal ids that of the smallest text hash, of equal rows any one. All columns stay.

    Two texts link if they share a cluster and so high a Jaccard similarity of their sets of shingles of so many words
    (A-Z in lower case; a shorter text is one shingle); groups are what links reach. Null texts are empty; texts without
    words are one group. An empty table gives an empty one. Texts are read whole, however long, each in one task.

    Equal texts meet in one aggregate, combined before the shuffle. Clusters with more than `split` texts or `shingles`
    shingles are split into parts, every two of which meet in a task of their own, so no task holds a hot cluster.
    """
    own, id_, sum_, several, place = hidden(docs, "own", "id", "sum", "several", "place")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(no_null(text_col)).alias("of"), _prints(words_each, bands)(no_null(text_col)).alias("prints"))
    rows = rows.groupBy("of", "prints", "id").agg(F.count(F.lit(1)).alias("n"))
    texts = written(rows.groupBy("of", "prints").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", F.col("of").alias("sum"), "n")).alias("first")), "texts")
    whole = docs.select(F.xxhash64(no_null(text_col)).alias("of"), F.col(id_col).alias("id"), no_null(text_col).alias("text"))
    roots = components(similar_texts(texts.select("of", "prints", F.col("first.id").alias("id")), whole, words_each, similarity, split, shingles))
    known = texts.join(roots.withColumnRenamed("node", "of").hint("merge"), "of", "left").select(F.coalesce("root", "of").alias("root"), "first")
    best = known.groupBy("root").agg(F.min("first").alias("best"))
    best = written(best.select(F.col("best.id").alias(id_), F.col("best.sum").alias(sum_), (F.col("best.n") > 1).alias(several)), "kept")
    kept = docs.withColumn(own, F.xxhash64(no_null(text_col)))
    kept = kept.join(best.hint("merge"), (F.col(own) == F.col(sum_)) & F.col(id_col).eqNullSafe(F.col(id_)))
    # Only rows that repeat are numbered.
    first = F.row_number().over(Window.partitionBy(own, id_col).orderBy(own))
    repeated = kept.filter(F.col(several)).withColumn(place, first).filter(F.col(place) == 1).drop(place)
    return kept.filter(~F.col(several)).unionByName(repeated).select(*docs.columns)
