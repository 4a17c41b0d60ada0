"""Substring dedup by prefix-partitioned suffix trees over words (operator 13).

The trees hold a sparse set of suffixes. Of the short word sequences inside a window, the one of least hash is the window's
anchor; equal windows choose it at the same place, so a suffix that starts at no window's anchor is never needed. A suffix
goes to the group of its first GRAM words, its prefix, and comes with the words of the windows that chose it, on both
sides. A group that stands once holds no repeat and goes no further; groups are small enough for a task's memory. A prefix
that is too frequent for that is made as long as the window itself, where a tree is a single node and its size a count.

In a task a group's suffixes are split word by word, to the right and, for what stands before the anchor, to the left:
the classes of each depth are the nodes of the group's two suffix trees. A window of k words before its anchor is a pair
of nodes, k deep to the left and the rest deep to the right; if two suffixes share the pair, the window is repeated.
Words are compared as words, numbered within the task; only prefixes are chosen by hash.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest, xxh64_intdigest

from tessera.llm.common import free_names, hidden, partitions, row_slices, written

#: Words of a window and of a prefix; suffixes of a group at most; suffixes handled at once by a task.
WINDOW, GRAM, GROUP, HELD = 35, 8, 1 << 17, 1 << 15
#: An order of hashes: their first 36 bits, then the place.
_PLACE = np.uint64((1 << 28) - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _anchors(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, hash of the prefix) of each anchor, in order. Its windows reach to the next one's first."""
    if len(words) < window:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - gram + 1
    g = np.zeros(n, np.uint64)
    for i in range(gram):
        g = g * _FACTOR + h[i : i + n]
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    least, seen, width = (g & ~_PLACE) | np.arange(n, dtype=np.uint64), 1, window - gram + 1
    while 2 * seen <= width:
        least, seen = np.minimum(least[:-seen], least[seen:]), 2 * seen
    if seen < width:
        least = np.minimum(least[: len(least) - (width - seen)], least[width - seen :])
    at = (least & _PLACE).astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).astype(np.int32)
    return at[first], first, g[at[first]].view(np.int64)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *parts]), kind))


def _anchored(window: int, gram: int):
    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(t0, t1, id, bytes) to (t0, t1, id, words, at, first, gram)."""
        for b in row_slices(batches, "bytes"):
            words = [t.split() for t in b.column(3).to_pylist()]
            at, first, g = zip(*(_anchors(w, window, gram) for w in words), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(w) for w in words], pa.int64()), _lists(at, pa.int32()), _lists(first, pa.int32()), _lists(g, pa.int64())], ["t0", "t1", "id", "words", "at", "first", "gram"])

    return anchored


def _each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows as dictionaries; repeated rows stand side by side and count once."""
    last = None
    for b in row_slices(batches, "bytes"):
        for r in b.to_pylist():
            if r["aid"] == last:
                continue
            last = r["aid"]
            yield r


def _picked(r: dict, window: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(place, first window, last window, prefix, hot) of the anchors whose prefix repeats."""
    ends = [*(f - 1 for f in r["first"][1:]), r["words"] - window]
    for p in r["picks"]:
        i = p["i"]
        yield r["at"][i], r["first"][i], ends[i], r["gram"][i], p["hot"]


_CONTEXT = "gram long, aid long, at int, first int, last int, n int, around binary"


def _contexts(window: int):
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with their anchors to _CONTEXT rows: the words around an anchor, or none for windows that their own text repeats."""
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _CONTEXT.split(", ")])

        for r in _each_once(batches):
            words, equal = r["bytes"].split(), defaultdict(list)
            for at, first, last, g, hot in _picked(r, window):
                if not hot:
                    equal[at - first, last - first, b" ".join(words[first : last + window])].append((at, first, last, g))
            for (_, _, around), places in equal.items():
                n = 2 if len(places) > 1 or r["n"] > 1 else 1
                at, first, last, g = places[0]
                out.append((g, r["aid"], at, first, last, n, around))
                size += len(around)
                if len(places) > 1 and r["n"] == 1:
                    out += [(r["aid"] ^ (a << 20), r["aid"], 0, a, b, 0, None) for a, b in _merged([p[1:3] for p in places])]
                if size > 4 << 20 or len(out) > 1 << 15:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    return contexts


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges of window starts; those that touch become one."""
    out: list[list[int]] = []
    for first, last in ranges:
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


_HOT = "w0 long, w1 long, aid long, starts array<struct<first int, last int>>, n long"


def _hot_windows(window: int):
    def hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with their anchors to _HOT rows: a hash of 128 bits for each different window of hot anchors, with where it starts."""
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for r in _each_once(batches):
            words, found = r["bytes"].split(), defaultdict(list)
            for _, first, last, _, hot in _picked(r, window):
                if hot:
                    for s in range(first, last + 1):
                        found[xxh3_128_digest(b" ".join(words[s : s + window]))].append((s, s))
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            starts = [[{"first": a, "last": b} for a, b in _merged(v)] for v in found.values()]
            n = [2 if len(v) > 1 or r["n"] > 1 else 1 for v in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.full(len(n), r["aid"])), pa.array(starts, kind), pa.array(n, pa.int64())], ["w0", "w1", "aid", "starts", "n"])

    return hot_windows


def _split(cls: np.ndarray, room: np.ndarray, ids: np.ndarray, at: np.ndarray, step: int, depth: int, keep: range) -> dict[int, np.ndarray]:
    """The nodes of each depth in keep: the class of every suffix there, -1 for those that stand alone or end before."""
    nodes = {0: cls} if 0 in keep else {}
    active, vocabulary = np.flatnonzero(cls >= 0), int(ids.max(initial=0)) + 1
    for d in range(1, depth + 1):
        active = active[room[active] >= d]
        place = at[active] + (d - 1 if step > 0 else -d)
        _, of, counts = np.unique(cls[active].astype(np.int64) * vocabulary + ids[place], return_inverse=True, return_counts=True)
        several = counts[of] > 1
        active = active[several]
        cls = np.full(len(cls), -1, np.int32)
        cls[active] = of[several]
        if d in keep:
            nodes[d] = cls
        if not len(active):
            break
    return nodes


def _repeats(gram: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, around: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, window start) of the repeated windows of suffixes that stand for one text."""
    split = pc.split_pattern(around, " ")
    ids, begins = split.flatten().dictionary_encode().indices.to_numpy(), split.offsets.to_numpy()[:-1]
    left, right = at - first, last + window - at
    _, group, sizes = np.unique(gram, return_inverse=True, return_counts=True)
    group = np.where(sizes[group] > 1, group, -1).astype(np.int32)
    deepest = int(left.max(initial=0))
    to_right = _split(group, right, ids, begins + left, 1, window, range(window - deepest, window + 1))
    to_left = _split(group, left, ids, begins + left, -1, deepest, range(deepest + 1))
    suffixes, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(deepest + 1):
        if window - k not in to_right or k not in to_left:
            continue
        a, b = to_right[window - k], to_left[k]
        some = np.flatnonzero((a >= 0) & (b >= 0) & (at - last <= k) & (k <= left))
        _, of = np.unique(a[some].astype(np.int64) << 32 | b[some], return_inverse=True)
        found = some[(np.bincount(of, n[some], 0)[of] > 1) & (n[some] == 1)] if len(some) else some
        suffixes.append(found)
        starts.append(at[found].astype(np.int64) - k)
    return np.concatenate(suffixes), np.concatenate(starts)


def _runs(aid: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> pa.RecordBatch:
    """(aid, start, end) of words, from ranges of window starts; ranges that touch become one."""
    order = np.lexsort((first, aid))
    aid, first, last = aid[order], first[order], last[order]
    far = np.maximum.accumulate(last + (aid != np.roll(aid, 1)).cumsum() * (1 << 40)) & ((1 << 40) - 1) if len(aid) else last
    new = np.flatnonzero(np.concatenate([[True], (aid[1:] != aid[:-1]) | (first[1:] > far[:-1] + 1)])) if len(aid) else np.zeros(0, np.int64)
    end = far[np.append(new[1:], len(aid)) - 1] if len(aid) else far
    return pa.RecordBatch.from_arrays([pa.array(aid[new], pa.int64()), pa.array(first[new], pa.int32()), pa.array(end + window, pa.int32())], ["aid", "start", "end"])


def _trees(window: int, held_rows: int):
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """_CONTEXT rows, sorted by prefix, to the words that repeated windows cover."""
        held: list[pa.RecordBatch] = []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            gram = t.column("gram").to_numpy()
            stop = len(gram) if final else int(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))[-1])  # the last group may go on
            held[:] = t.slice(stop).to_batches()
            if not stop:
                return
            t = t.slice(0, stop)
            known = pc.is_null(t.column("around")).to_numpy()
            aid, at, first, last, n = (t.column(c).to_numpy().astype(np.int64) for c in ("aid", "at", "first", "last", "n"))
            trees = np.flatnonzero(~known)
            text = t.column("around").take(pa.array(trees)).cast(pa.large_binary()).combine_chunks()
            of, starts = _repeats(gram[:stop][trees], at[trees], first[trees], last[trees], n[trees], text, window)
            yield _runs(np.concatenate([aid[trees][of], aid[known]]), np.concatenate([starts, first[known]]), np.concatenate([starts, last[known]]), window)

        rows, most = 0, held_rows
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
                if rows >= most:
                    yield from flush(False)
                    rows = sum(x.num_rows for x in held)
                    most = max(held_rows, 2 * rows)  # a group that is not whole yet is not looked at for every batch
        if held:
            yield from flush(True)

    return trees


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])


@F.arrow_udf(_RESULT)
def _without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The words that stand in no span, joined by one space, with the numbers of all and of the others."""
    for texts, spans in batches:
        kept, total, gone = [], [], []
        for text, of in zip(texts, spans, strict=True):
            words = (text.as_py() or b"").split()
            n = len(words)
            for s in of.as_py() or ():
                words[s["start"] : s["end"]] = [None] * (min(n, s["end"]) - s["start"])
            rest = [w for w in words if w is not None] if of.is_valid else words
            kept.append(b" ".join(rest).decode("utf-8", "replace"))
            total.append(n)
            gone.append(n - len(rest))
        yield pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["text", "n_words", "n_removed"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, held: int = HELD) -> DataFrame:
    """(t0, t1, spans) for each different text with repeated windows: its hash in two longs, and the words that they cover as structs (start, end)."""
    if not 0 < gram <= window:
        raise ValueError("the prefix has at least one word and at most those of the window")
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.filter(text.isNotNull()).select(F.xxhash64(text).alias("t0"), F.xxhash64(F.lit(1), text).alias("t1"), F.col(id_col).alias("id"), text.cast("binary").alias("bytes"))
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_anchored(window, gram), f"t0 long, t1 long, id {id_type}, words long, at array<int>, first array<int>, gram array<long>")
    # Copies of a text are one text here: its row of the smallest id stands for all, and all its windows are repeated.
    texts = found.groupBy("t0", "t1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id")).alias("lead"), *(F.first(c).alias(c) for c in ("words", "at", "first", "gram")))
    texts = written(texts.filter(F.col("words") >= window).withColumn("aid", F.monotonically_increasing_id()), "anchors")
    counts = written(texts.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "prefixes")
    picks = texts.select("aid", F.posexplode("gram").alias("i", "gram")).join(counts.hint("merge"), "gram").groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("rows") > group).alias("hot")))).alias("picks"))
    leads = texts.join(picks.hint("merge"), "aid").withColumnsRenamed({"t0": "k0", "t1": "k1"})
    on = [rows["t0"] == leads["k0"], rows["t1"] == leads["k1"], rows["id"].eqNullSafe(leads["lead.id"])]
    around = rows.join(leads.hint("merge"), on).select("aid", "n", "words", "at", "first", "gram", "picks", "bytes")
    covered = around.mapInArrow(_contexts(window), _CONTEXT).repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_trees(window, held), "aid long, start int, end int")
    if counts.filter(F.col("rows") > group).limit(1).count():
        hot = written(around.filter(F.exists("picks", lambda p: p["hot"])).mapInArrow(_hot_windows(window), _HOT), "windows")
        often = hot.groupBy("w0", "w1").agg(F.sum("n").alias("all")).filter("all > 1").drop("all")
        starts = hot.join(often.hint("merge"), ["w0", "w1"]).select("aid", F.explode("starts").alias("s"))
        covered = covered.unionByName(starts.select("aid", F.col("s.first").alias("start"), (F.col("s.last") + window).alias("end")))
    spans = written(covered.groupBy("aid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")), "spans")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("words").cast("int").alias("end")))
    single = texts.filter("n = 1").join(spans.hint("merge"), "aid").select("t0", "t1", "spans")
    return single.unionByName(texts.filter("n > 1").select("t0", "t1", whole.alias("spans")))


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "substrings", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, held: int = HELD) -> DataFrame:
    """docs with a struct column of that name added: text (the kept words, joined by one space), n_words and n_removed.

    A word goes if a window of so many consecutive words over it also starts anywhere else, in any text or its own; all
    places of a repeated window go, the first too, and windows are those of the given texts. Words end at space, tab, line
    feed, vertical tab, form feed and carriage return. Null texts have no words; shorter texts than a window keep all.
    All rows and columns stay, repeated ones and those of null ids too; an empty table gives an empty one. name must not
    be a column of docs, in any case of letters. Texts are read whole, each in one task.

    gram is the least prefix; one that stands more than group times is made as long as the window. Only the hashes of
    anchors are shuffled at first, then the words around those that repeat, then the texts to be cut. A text that repeats
    words over and over gives its equal surroundings once, and equal texts are one.
    """
    free_names(docs, name)
    a, b, t0, t1, spans = hidden(docs.withColumn(name, F.lit(0)), "a", "b", "t0", "t1", "spans")
    found = repeated_spans(docs, id_col, text_col, window, gram, group, held).withColumnsRenamed({"t0": t0, "t1": t1, "spans": spans})
    text = F.col(text_col)
    out = docs.withColumn(a, F.xxhash64(text)).withColumn(b, F.xxhash64(F.lit(1), text))
    out = out.join(found.hint("merge"), (F.col(a) == F.col(t0)) & (F.col(b) == F.col(t1)) & text.isNotNull(), "left")
    return out.withColumn(name, _without.asNondeterministic()(text.cast("binary"), F.col(spans))).drop(a, b, t0, t1, spans)
