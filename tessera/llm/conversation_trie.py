"""The prefix trie of conversations, by way of their sorted order (operator 11).

Distinct conversations are sorted as sequences of turns. The prefix of d turns that starts at place i of that order is a
node of the trie; it reaches to the next place whose LCP (the turns that a conversation shares with the one before it) is
below d. So the nodes are the intervals of the Cartesian tree over the LCP array, one interval for all depths between two
LCP values, and every value of a node is a sum or minimum over its interval.

The order is cut into blocks of SIZE places. A block finds the nearest smaller values of its places with one stack, whose
entries stand for whole ranges of depths. Intervals that end in their block are done there. What comes in from the blocks
before, or is open at the end, is given as partial sums: depths up to the block's least LCP pass through it whole, those
between that and its first LCP end where the LCP first falls below them. An incoming part belongs to the last node of its
depth that a block before it left open, which a window over the few partial rows of each depth carries on.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import no_null, partitions, written
from tessera.operators.relational import enumerate_rows

#: Places of a block; ids joined to one piece of text; turns that a conversation can take from another.
SIZE, IDS, HEADS = 4096, 512, 8
#: Other than Spark's names of these columns, so that no id column clashes with them.
_PIECE = "block long, depth int, incoming boolean, partial boolean, start long, lowest long, n long, bytes long, own long, before long, kids long, leaves long, ends string, above long, pblock long, pdepth int, pincoming boolean"


def rebuilt(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, seq): each conversation's turns as structs (key, bytes), the first h of them from conversation id - id % 5; h = crc32(id) % 9."""
    role, text, c = no_null(role_col), no_null(text_col), F.col(conv_col).cast("long")
    # The role's length tells where the text begins, so equal keys are equal turns.
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = df.select(c.alias("id"), F.struct(F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")).alias("t")).filter(F.col("id").isNotNull())
    rows = turns.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"], t["bytes"])).alias("turns"))
    rows = written(rows, "conversations")
    heads = rows.filter("id % 5 = 0").select(F.col("id").alias("base"), F.slice("turns", 1, HEADS).alias("head"))
    both = rows.withColumn("base", F.col("id") - F.col("id") % 5).join(heads, "base", "left")
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % 9).cast("int")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, F.lit(0))).otherwise(F.slice("head", F.lit(1), h))
    return both.select("id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("seq"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, id), sorted, to pieces (mark, first, n, text) of so many ids at most."""
    mark, ids = None, []

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([mark]), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids))])], ["mark", "first", "n", "text"])

    for b in batches:
        for m, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (m != mark or len(ids) == IDS):
                yield piece()
                ids = []
            mark = m
            ids.append(i)
    if ids:
        yield piece()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, sorted, to (mark, lowest, n, ends): the hash runs over the pieces, so no list of a mark's ids is held."""
    mark = lowest = sha = None
    n = 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([mark]), pa.array([lowest], pa.int64()), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], ["mark", "lowest", "n", "ends"])

    for b in batches:
        for m, first, size, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if m != mark:
                if sha:
                    yield row()
                mark, lowest, n, sha = m, first, 0, hashlib.sha256()
            sha.update((b"," if n else b"") + text.encode())
            n += size
    if sha:
        yield row()


class _Block:
    """The stack over one block's places. prior: the conversation before its first one, later: that behind its last one, None where there is none."""

    def __init__(self, block: int, rows: list[dict], prior, later):
        self.block, self.rows, m = block, rows, len(rows)
        seqs = [r["seq"] for r in rows]
        self.sizes = [len(s) for s in seqs]
        before = [prior, *seqs]
        self.lcp = [-1 if a is None else _shared(a, b) for a, b in zip(before, [*seqs], strict=False)]
        after = [*self.lcp[1:], -1 if later is None else _shared(seqs[-1], later)]
        bytes_ = [np.concatenate([[0], np.cumsum([t["bytes"] for t in s], dtype=np.int64)]) for s in seqs]
        total = np.array([x[-1] for x in bytes_], np.int64)
        fresh = np.array([x[-1] - x[max(0, lcp)] for x, lcp in zip(bytes_, self.lcp, strict=True)], np.int64)
        n = np.array([r["n"] for r in rows], np.int64)
        sums = lambda v: np.concatenate([[0], np.cumsum(v, dtype=np.int64)])
        self.n, self.bytes, self.fresh = sums(n), sums(n * total), sums(fresh)
        self.leaves = sums([a < s for a, s in zip(after, self.sizes, strict=True)])
        self.total, self.upto = total, bytes_
        self.table = [np.array([r["lowest"] for r in rows], np.int64)]
        while (w := 1 << len(self.table)) <= m:
            last = self.table[-1]
            self.table.append(np.minimum(last[: m - w + 1], last[w // 2 : w // 2 + m - w + 1]))
        #: Ranges of depths (lo, hi] over places [start, end), with the number of the range that holds the parent of depth lo.
        self.ranges: list[list] = []

    def lowest(self, start: int, end: int) -> int:
        k = (end - start).bit_length() - 1
        return int(min(self.table[k][start], self.table[k][end - (1 << k)]))

    def run(self) -> None:
        # Entries: [start (None: incoming), lo, hi, children of the node of depth hi that start behind it, ranges whose parent that node is].
        stack = [[None, -1, self.lcp[0], 0, []]] if self.lcp[0] >= 0 else []

        def close(entry, lo: int, end: int, partial: bool) -> None:
            number = len(self.ranges)
            for child in entry[4]:
                self.ranges[child][6] = number
            self.ranges.append([entry[0], end, lo, entry[2], entry[3], partial or entry[0] is None, None])
            entry[3], entry[4] = 0, [number]

        for j, lcp in enumerate(self.lcp):
            while stack and stack[-1][2] > lcp:
                top = stack[-1]
                lo = max(top[1], lcp)
                close(top, lo, j, False)
                top[2] = lo
                if lo == top[1]:
                    stack.pop()
                    if stack:
                        stack[-1][4] += top[4]
            if stack:
                stack[-1][3] += 1
            if self.sizes[j] > lcp:
                stack.append([j, lcp, self.sizes[j], 0, []])
        while stack:
            top = stack.pop()
            close(top, top[1], len(self.lcp), True)
            if stack:
                stack[-1][4] += top[4]

    def pieces(self) -> dict[str, list]:
        self.run()
        out: dict[str, list] = {c.split()[0]: [] for c in _PIECE.split(", ")}
        lows = [self.lowest(r[0] or 0, r[1]) if r[1] > (r[0] or 0) else None for r in self.ranges]
        for (start, end, lo, hi, kids, partial, parent), low in zip(self.ranges, lows, strict=True):
            incoming, at = start is None, start or 0
            n, leaves, bytes_ = (int(s[end] - s[at]) for s in (self.n, self.leaves, self.bytes))
            # Bytes that count once: the first conversation's whole, then what each next one adds.
            own = int(self.fresh[end] - self.fresh[0]) if incoming else int(self.total[at] + self.fresh[end] - self.fresh[at + 1])
            for d in range(lo + 1, hi + 1):
                whole = not incoming and self.sizes[at] == d
                above, ref = None, (None, None, None)
                if not incoming and d:
                    if d - 1 > lo:
                        above, ref = (None, (self.block, d - 1, False)) if partial else (low, ref)
                    else:
                        of = self.ranges[parent]
                        above, ref = (None, (self.block, d - 1, of[0] is None)) if of[5] else (lows[parent], ref)
                values = (self.block, d, incoming, partial, None if incoming else self.rows[at]["place"], low, n, bytes_, own, None if incoming else int(self.upto[at][d - 1]) if d else 0, kids * (d == hi) + (not incoming and self.sizes[at] > d), leaves, self.rows[at]["ends"] if whole else None, above, *ref)
                for c, v in zip(out.values(), values, strict=True):
                    c.append(v)
        return out


def _shared(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x["key"] != y["key"]:
            break
        n += 1
    return n


def _pieces(rows: list[dict], size: int) -> pa.RecordBatch:
    """The pieces of one block, from its rows and those beside it; none for what lies behind the last place."""
    block = rows[0]["block"]
    inner = [r for r in rows if r["place"] // size == block]
    prior = next((r["seq"] for r in rows if r["place"] < block * size), None)
    later = next((r["seq"] for r in rows if r["place"] >= (block + 1) * size), None)
    got = _Block(block, inner, prior, later).pieces() if inner else {c.split()[0]: [] for c in _PIECE.split(", ")}
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(got[c.split()[0]], kinds[c.split()[1]]) for c in _PIECE.split(", ")], list(got))


def _blocks(size: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block and place."""
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and r["block"] != held[0]["block"]:
                    yield _pieces(held, size)
                    held = []
                held.append(r)
        if held:
            yield _pieces(held, size)

    return blocks


def prefix_trie(conversations: DataFrame, size: int = SIZE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of the trie of (id, seq), as rebuilt() gives them.

    A node is named by its depth and its smallest member, conv_id. An empty table has no nodes; one whose conversations
    have no turns has the root alone. Equal conversations are one place of the order: they are combined before the
    shuffle, and the hash over a node's own ids runs over sorted pieces of them, so no group is held as a list. A
    conversation's turns (40 bytes each) are one row.
    """
    spark = conversations.sparkSession
    mark = F.unhex(F.sha2(F.array_join(F.transform("seq", lambda t: F.hex(t["key"])), ","), 256))
    rows = written(conversations.withColumn("mark", mark), "marked")
    parts = partitions(spark)
    pieces = rows.select("mark", "id").repartitionByRange(parts, "mark", "id").sortWithinPartitions("mark", "id").mapInArrow(_joined, "mark binary, first long, n long, text string")
    ends = written(pieces.repartition(parts, "mark").sortWithinPartitions("mark", "first").mapInArrow(_digested, "mark binary, lowest long, n long, ends string"), "ends")
    seqs = rows.select("mark", "seq").distinct().join(ends, "mark")
    placed = enumerate_rows(seqs.drop("mark"), "seq", field="place")
    block = F.floor(F.col("place") / size)
    # A block sees the places beside it: its first LCP, and whether its last conversation is continued.
    seen = F.filter(F.array(block - F.when(F.col("place") % size == 0, 1), block, block + F.when(F.col("place") % size == size - 1, 1)), lambda b: b >= 0)
    spread = placed.withColumn("block", F.explode(seen)).repartition(parts, "block").sortWithinPartitions("block", "place")
    made = written(spread.select("block", "place", "seq", "n", "lowest", "ends").mapInArrow(_blocks(size), _PIECE), "pieces")

    partial = made.filter("partial")
    upto = Window.partitionBy("depth").orderBy("block", F.col("incoming").desc()).rowsBetween(Window.unboundedPreceding, 0)
    owned = written(partial.withColumn("owner", F.last("start", ignorenulls=True).over(upto)), "owned")
    first = lambda c: F.max(F.when(~F.col("incoming"), F.col(c))).alias(c)  # noqa: E731  one part of a node is its start
    whole = owned.groupBy("depth", "owner").agg(*(F.sum(c).alias(c) for c in ("n", "bytes", "own", "kids", "leaves")), F.min("lowest").alias("lowest"), *map(first, ("before", "ends", "above", "pblock", "pdepth", "pincoming")))
    whole = written(whole, "whole")
    named = owned.select("block", "incoming", "depth", "owner").join(whole.select("depth", "owner", "lowest"), ["depth", "owner"])
    named = named.select(F.col("block").alias("pblock"), F.col("depth").alias("pdepth"), F.col("incoming").alias("pincoming"), F.col("lowest").alias("found"))
    cols = ["lowest", "depth", "n", "bytes", "own", "before", "kids", "leaves", "ends", "above", "pblock", "pdepth", "pincoming"]
    nodes = made.filter("not partial").select(*cols).unionByName(whole.select(*cols))
    waiting = nodes.filter("pblock is not null").join(named, ["pblock", "pdepth", "pincoming"]).withColumn("above", F.col("found"))
    nodes = nodes.filter("pblock is null").select(*cols).unionByName(waiting.select(*cols))
    saved = F.col("bytes") - F.col("n") * F.col("before") - F.col("own") + F.col("before")
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.select(F.col("lowest").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"))


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """prefix_trie of the rebuilt conversations.

    Turns are ordered by turn, null first, equal ones by a hash of role and text; repeated rows are turns of their own.
    Null roles and texts are empty; rows with a null conversation id belong to no conversation and are left out. Long
    texts are hashed whole. Other columns are not read.
    """
    return prefix_trie(rebuilt(df, conv_col, turn_col, role_col, text_col))
