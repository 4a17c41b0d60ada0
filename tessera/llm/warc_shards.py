"""WARC archives: deterministic sharded writer, and a reader (operator 8)."""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import no_null, partitions, row_slices, written
from tessera.llm.shards import ShardFile, commit, manifest, open_shard

#: Profile of revisits whose payload is the same, fixed by the WARC standard.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str) -> str:
    """The url with what may not stand in a header (white space, control signs, signs beyond ASCII) percent-encoded."""
    return quote(url.encode("utf-8", "replace"), safe="".join(map(chr, range(33, 127))))


def record_id(page_id: int | None, payload_sum: str, again: int) -> str:
    """A name-based UUID: of the page's id, its payload's hash, and how many rows with both stand before."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page_id} {payload_sum} {again}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_sum: str, again: int, refers_to: int | None, date: str) -> bytes:
    """A record with regenerated headers and digests. refers_to: None for a response, else the response's page_id."""
    block = _HTTP.format(len(payload)).encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, payload_sum, again)}",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {_uri(url)}"]),
        f"WARC-Payload-Digest: sha1:{_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{_sha1(block)}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        f"X-Payload-Length: {len(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: {record_id(refers_to, payload_sum, 0)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {_PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _edges(sizes: DataFrame, shards: int) -> list[int]:
    """Ids at which shards 1, 2, ... begin, so that each holds about as many bytes: the same for the same rows.

    The rows (id, size) are sorted by ranges of Spark's choice, which differ from run to run; but the bytes before each id,
    summed over the ranges and within them, do not, and they alone place the edges. One id for each edge comes to the driver.
    """
    spark = sizes.sparkSession
    by = sizes.filter("id is not null").groupBy("id").agg(F.sum("size").alias("size"))
    by = written(by.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()), "sorted-ids")
    parts = by.groupBy("part").agg(F.sum("size").alias("total"))
    upto = F.sum("total").over(Window.orderBy("part"))  # one row for each partition
    parts = parts.select("part", (upto - F.col("total")).alias("before"), F.max(upto).over(Window.partitionBy()).alias("all"))
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("id")) - F.col("size")
    starts = by.withColumn("inside", inside).join(F.broadcast(parts), "part")
    starts = starts.select("id", F.floor((F.col("before") + F.col("inside")) * shards / F.greatest(F.col("all"), F.lit(1))).alias("shard"))
    return sorted(r["id"] for r in starts.groupBy("shard").agg(F.min("id").alias("id")).filter("shard > 0").collect())


def _seats(spark: SparkSession, n: int) -> np.ndarray:
    """For each shard a number that Spark's hash puts into a partition of the shard's own, so that no task writes two shards and another none."""
    numbers = spark.range(32 * n).select(F.col("id").cast("int").alias("number")).withColumn("part", F.pmod(F.hash("number"), F.lit(n)))
    found = {r["part"]: r["number"] for r in numbers.groupBy("part").agg(F.min("number").alias("number")).collect()}  # n rows
    return np.array([found.get(i, i) for i in range(n)], np.int32)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = 256 << 20, min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 6, shards: int | None = None) -> DataFrame:
    """Writes each page as a record, one gzip member each; returns the manifest (shard, number, file, records, bytes, sha1).

    Records are sorted by page_id and dealt to shards (default: as many as shuffle partitions) at edges that depend on the
    rows alone; a new file begins where one exceeds roll_bytes. The same rows and number of shards give the same files, name
    by name and byte by byte: headers hold no clock, host or random ids. Payloads (UTF-8, null: empty) of at least
    min_revisit_bytes that are equal are kept once, at the largest page_id; the others become revisits of it. Rows that
    repeat that largest id, with the same payload, are responses as well. Null ids and urls have no header; a null id is a
    response only if no other row has its payload, else it revisits. Record ids are unique, repeated rows included.
    Equal payloads are told by SHA-256 and length, so that the SHA-1 of the format need not be trusted. A page is one record
    however long; an empty table gives no files. Other columns are not read.
    """
    spark = pages.sparkSession
    shards = shards or partitions(spark)
    html = no_null(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("sum"), F.octet_length(html).cast("long").alias("size"))
    # Only ids and sums are grouped and joined; the pages themselves move once, to their shard.
    known = written(rows.select("id", "sum", "size"), "page-sums")
    groups = known.filter(F.col("size") >= min_revisit_bytes).groupBy("sum", "size").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 and kept is not null")
    marks = written(known.join(groups, ["sum", "size"]).filter(~F.col("id").eqNullSafe(F.col("kept"))).select("id", "sum", "kept").distinct(), "revisits")
    edges, seats = np.array(_edges(known, shards), np.int64), _seats(spark, shards)

    @F.arrow_udf("struct<shard: int, seat: int>")
    def shard_of(ids: pa.Array) -> pa.Array:
        shard = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(edges, pc.fill_null(ids, 0).to_numpy(), side="right")).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(shard), pa.array(seats[shard])], ["shard", "seat"])

    both = rows.select("id", "sum", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("kept")).unionByName(marks.select("id", "sum", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit("").alias("html"), "kept"))
    both = both.withColumn("at", shard_of("id")).select("id", "sum", "kind", "url", "html", "kept", "at.shard", "at.seat")
    both = both.repartition(shards, "seat").sortWithinPartitions("shard", "id", "sum", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, now, number, count, mark, last, again = None, -1, 0, 0, (None, None, None), None, 0

        def closed() -> pa.RecordBatch:
            name = file.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int64()), "number": pa.array([number], pa.int64()), "file": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([file.bytes], pa.int64()), "sha1": [file.sum.hexdigest()]})

        for b in row_slices(batches, "html"):
            for id_, sum_, kind, url, text, kept, shard in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
                if kind == 0:
                    mark = (id_, sum_, kept)
                    continue
                again = again + 1 if (id_, sum_) == last else 0
                last = (id_, sum_)
                data = _gzip(record(id_, url, text.encode("utf-8", "replace"), sum_, again, mark[2] if mark[:2] == last else None, date), level)
                if file and (shard != now or file.bytes + len(data) > roll_bytes):
                    yield closed()
                    file, number, count = None, number + 1 if shard == now else 0, 0
                elif shard != now:
                    number = 0
                now = shard
                file = file or ShardFile(folder, shard, number, ".warc.gz")
                file.write(data)
                count += 1
        if file:
            yield closed()

    return commit(both.mapInArrow(write, "shard long, number long, file string, records long, bytes long, sha1 string"), folder)


def _members(f, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    z, out, held = zlib.decompressobj(31), [], b""
    while True:
        held = held or f.read(chunk)
        if not held:
            if out:
                raise ValueError("an archive ends inside a record")
            return
        out.append(z.decompress(held))
        held = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
        else:
            held = b""


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{_sha1(block)}":
        raise ValueError("a record does not match its block digest")
    payload = block.partition(b"\r\n\r\n")[2]
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and digest != _sha1(payload):
        raise ValueError("a record does not match its payload digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload if response else None, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "record_id": fields["WARC-Record-ID"]}


def read_warc(spark: SparkSession, folder: str, id_col: str = "page_id") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, record_id) of each record that the manifest's files hold; digests are checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with open_shard(folder, name) as f:
                    for data in _members(f):
                        rows.append(parse_record(data))
                        size += len(data)
                        if size > 4 << 20 or len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string())])
    files = manifest(spark, folder).select("file").repartition(partitions(spark), "file")
    return files.mapInArrow(read, "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string").withColumnRenamed("id", id_col)
