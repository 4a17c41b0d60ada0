"""Line dedup by content-defined chunks (operator 9).

A text's lines are cut into chunks where a rolling hash over line hashes says so. The hash sees the last WINDOW lines
alone, so an insertion moves no boundary but those beside it, and two texts that share a passage share its inner chunks.
A line of long_words words or more is a chunk by itself wherever it stands.

A short passage is rarely a chunk of its own, so the shortest run of lines that reaches long_words words from each first
line on, and the one that reaches them up to each last line, count as chunks too. These cover every line of a passage of
long_words words or more, and no other: lines up to the end of its last forward run lie in forward runs, those behind it
end a backward run that begins inside.

Chunks that repeat, in one text or over the whole table, stay at their first place (smallest id, then place) and go from
all others, once their bytes are compared.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tessera.llm.common import free_names, hidden, row_slices, written

#: A boundary lies after a line if the rolling hash is 0 modulo DIVISOR; chunks have at least LEAST lines and at most MOST.
WINDOW, DIVISOR, LEAST, MOST = 2, 2, 2, 64
#: The place of a whole text among the chunks that are compared.
WHOLE = -1
_MASK, _FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _defined(words: list[int], hashes: list[int], chunk_words: int, long_words: int) -> list[tuple[int, int]]:
    """(first line, lines) of each content-defined chunk that can count: several lines, or one long line; chunk_words words at least."""
    out, first, before, count = [], 0, 0, 0
    for i, h in enumerate(hashes):
        if words[i] >= long_words:
            if i > first + 1 and count >= chunk_words:
                out.append((first, i - first))
            out.append((i, 1))
            first, before, count = i + 1, 0, 0
            continue
        count += words[i]
        n = i + 1 - first
        # The rolling hash of the last two lines of a chunk.
        if n >= MOST or n >= LEAST and ((before * _FACTOR + h & _MASK) >> 32) % DIVISOR == 0:
            if count >= chunk_words:
                out.append((first, n))
            first, before, count = i + 1, 0, 0
        else:
            before = h
    if len(hashes) - first > 1 and count >= chunk_words:
        out.append((first, len(hashes) - first))
    return out


def _places(lines: list[str], hashes: list[int], chunk_words: int, long_words: int) -> list[tuple[int, int]]:
    """(first line, lines) of content-defined chunks and shortest runs, each once, in order."""
    words = [len(x.split()) for x in lines]
    total = np.concatenate([[0], np.cumsum(words)])
    if total[-1] < chunk_words:
        return []
    found = set(_defined(words, hashes, chunk_words, long_words))
    if total[-1] >= long_words:
        starts = np.flatnonzero(total[:-1] + long_words <= total[-1])
        found.update(zip(starts.tolist(), (np.searchsorted(total, total[starts] + long_words) - starts).tolist(), strict=True))
        ends = np.flatnonzero(total >= long_words)  # each the place behind a last line
        begins = np.searchsorted(total, total[ends] - long_words, side="right") - 1
        found.update(zip(begins.tolist(), (ends - begins).tolist(), strict=True))
    return sorted(found)


def _line_hashes(lines: list[str]) -> list[int]:
    return [xxh64_intdigest(x.encode("utf-8", "replace")) for x in lines]


def _run_hashes(hashes: list[int], places: list[tuple[int, int]]) -> list[int]:
    """A hash of each run of lines: equal lines give equal hashes, wherever they stand."""
    sums, powers = [0], [1]
    for h in hashes:
        sums.append(sums[-1] * _FACTOR + h & _MASK)
        powers.append(powers[-1] * _FACTOR & _MASK)
    # Mixed once more, as low bits of the sum see low bits of the lines' hashes alone.
    return [xxh64_intdigest((sums[i + n] - sums[i] * powers[n] & _MASK).to_bytes(8, "little"), n) - (1 << 63) for i, n in places]


def _hashed(chunk_words: int, long_words: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, key, text) to (id, key, first, lines, hash)."""
        for b in row_slices(batches, "text"):
            rows, at, n, h = [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                lines = text.split("\n")
                hashes = _line_hashes(lines)
                if found := _places(lines, hashes, chunk_words, long_words):
                    rows += [i] * len(found)
                    at += [first for first, _ in found]
                    n += [size for _, size in found]
                    h += _run_hashes(hashes, found)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(h, pa.int64())], ["id", "key", "first", "lines", "hash"])

    return hashed


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text, places) to (id, key, first, lines, hash, chunk)."""
    for b in row_slices(batches, "text"):
        rows, out = [], {"first": [], "lines": [], "hash": [], "chunk": []}
        for i, (text, places) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            lines = text.split("\n")
            for p in places:
                rows.append(i)
                for k in ("first", "lines", "hash"):
                    out[k].append(p[k])
                out["chunk"].append(text if p["first"] == WHOLE else "\n".join(lines[p["first"] : p["first"] + p["lines"]]))
        take = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(out["first"], pa.int32()), pa.array(out["lines"], pa.int32()), pa.array(out["hash"], pa.int64()), pa.array(out["chunk"], pa.string())], ["id", "key", "first", "lines", "hash", "chunk"])


@F.arrow_udf(T.StringType())
def _without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The text without the lines of the places; null where places is null."""
    for texts, places in batches:
        out = []
        for text, gone in zip(texts, places, strict=True):
            if not gone.is_valid:
                out.append(None)
                continue
            lines = text.as_py().split("\n")
            for p in gone.as_py():
                lines[p["first"] : p["first"] + p["lines"]] = [None] * p["lines"]
            out.append("\n".join(x for x in lines if x is not None))
        yield pa.array(out, pa.string())


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "dedup", chunk_words: int = 10, long_words: int = 50) -> DataFrame:
    """docs with a struct column of that name added: text (without the repeated chunks), n_lines and n_removed (lines).

    chunk_words: fewer words in several lines are chance, no passage; long_words: from so many on, every repeated run of lines counts.
    Of chunks with equal bytes the first stays: smallest id (nulls first), then smallest text hash, then place. A line goes
    if any chunk over it goes; an equal line of the same passage stands earlier then, and the earliest stays. Rows with
    equal id and equal text are one document here and get the same result. Null texts stay null, with 0 lines. All
    rows stay, texts that lose every line as empty ones; an empty table gives an empty one. Texts are cut whole, each in
    one task. name must not be a column of docs, in any case of letters; all its columns stay.

    Only chunk hashes are shuffled at first; then each document that holds a repeated hash is read again for the chunk's
    bytes. Equal hashes with other bytes are told apart by a second hash of the bytes, so each byte string's first place
    is found, and a chunk goes only after its bytes are compared with those kept. Groups are counted before the shuffle,
    and joins of hot chunks can be split, so no task holds a group. None of the joined tables has a proven bound, so none
    is broadcast: the plan is the same at every size.
    """
    free_names(docs, name)
    sum_, id_, key_, gone_, new_ = hidden(docs.withColumn(name, F.lit(0)), "sum", "id", "key", "gone", "new")
    key = F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    id_type = rows.schema["id"].dataType.simpleString()
    found = written(rows.mapInArrow(_hashed(chunk_words, long_words), f"id {id_type}, key long, first int, lines int, hash long").distinct(), "chunks")
    # Of equal texts the one of the smallest id stands for all: what it holds is the earliest of its bytes or repeats earlier ones,
    # and all chunks of the others repeat it. These are compared as whole texts, once, not chunk by chunk.
    held = found.select("id", "key").distinct()
    copies = written(held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id")).alias("lead")).filter("n > 1").drop("n"), "copies")
    leads = found.join(copies.hint("merge"), "key", "left").filter(F.col("lead").isNull() | F.col("id").eqNullSafe(F.col("lead.id"))).drop("lead")
    repeated = leads.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    places = leads.join(repeated.hint("merge"), "hash").select("id", "key", "first", "lines", "hash")
    wholes = held.join(copies.hint("merge"), "key").select("id", "key", F.lit(WHOLE).alias("first"), F.lit(0).alias("lines"), F.col("key").alias("hash"))
    places = places.unionByName(wholes).groupBy("id", "key").agg(F.collect_list(F.struct("first", "lines", "hash")).alias("places"))

    at = [rows["id"].eqNullSafe(places["id"]), rows["key"] == places["key"]]
    cut = rows.join(places.hint("merge"), at).select(rows["id"], rows["key"], "text", "places")
    cut = cut.mapInArrow(_cut_out, f"id {id_type}, key long, first int, lines int, hash long, chunk string")
    cut = written(cut.withColumn("bytes", F.xxhash64(F.lit(1), "chunk")), "repeated")
    # One aggregate finds each byte string's first place and keeps its bytes; the join then compares them with all others'.
    # It is a table of its own, so that both sides of the join are shuffled and a hot chunk's rows can be split; coalesce
    # keeps the comparison out of the join's keys.
    place, of = F.struct("id", "key", "first"), ["hash", "bytes"]
    kept = cut.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(place.alias("place"), "chunk")).alias("keep")).filter("n > 1")
    kept = written(kept.select(*of, "keep.place", F.col("keep.chunk").alias("kept")), "kept")
    gone = cut.join(kept.hint("merge"), of).filter(F.coalesce(F.col("chunk") == F.col("kept"), F.lit(False)) & ~place.eqNullSafe(F.col("place")))
    gone = written(gone.select("id", "key", "first", "lines"), "repeats")
    whole = gone.filter(F.col("first") == WHOLE).select(F.col("id").alias("i"), F.col("key").alias("k"))
    lines_of = found.join(whole.hint("merge"), found["id"].eqNullSafe(whole["i"]) & (found["key"] == whole["k"])).select("id", "key", "first", "lines")
    gone = gone.filter(F.col("first") != WHOLE).unionByName(lines_of)
    gone = written(gone.groupBy("id", "key").agg(F.collect_set(F.struct("first", "lines")).alias("gone")), "gone").withColumnsRenamed({"id": id_, "key": key_, "gone": gone_})
    out = docs.withColumn(sum_, key).join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(sum_) == F.col(key_)), "left")
    text, has = F.col(text_col), F.col(gone_).isNotNull()
    out = out.withColumn(new_, F.when(has, _without.asNondeterministic()(F.when(has, text), F.col(gone_))).otherwise(text))
    lines = F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long")
    # Chunks overlap: each adds its lines behind those of the chunks before it.
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    sums = F.aggregate(F.sort_array(gone_), start, lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0), p["first"] + p["lines"] - F.greatest(s["end"], p["first"]))).alias("n"), F.greatest(s["end"], p["first"] + p["lines"]).alias("end")))
    removed = F.coalesce(sums["n"], F.lit(0)).cast("long")
    return out.withColumn(name, F.struct(F.col(new_).alias("text"), F.when(text.isNull(), 0).otherwise(lines).alias("n_lines"), removed.alias("n_removed"))).drop(sum_, id_, key_, gone_, new_)
