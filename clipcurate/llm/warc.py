"""Web archives: an index of byte ranges first, then files, then coalesced range reads of selected records."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipcurate.llm.common import materialize, sorted_groups

END = b"\r\n\r\n"
#: Partitions at most of an exchange by archive or by read.
MAX_PARTITIONS = 10_000
#: RFC 4648 letters, in the order of the digits of Spark's conv to base 32.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    h = F.sha1(payload)
    part = lambda at, n, to: F.lpad(F.conv(F.substring(h, at, n), 16, 32), to, "0")
    return F.translate(F.concat(part(1, 15, 12), part(16, 15, 12), part(31, 10, 8)), DIGITS, BASE32)


def _header(value: Column) -> Column:
    """A header's value: control characters, which would end the line, and spaces are percent-encoded."""
    out = F.coalesce(value, F.lit(""))
    for c in ("\r", "\n", "\0", "\t", " "):
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def _uuid(key: Column) -> Column:
    m = F.md5(key.cast("string"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12)), F.lit(">"))


def warc_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = 0) -> DataFrame:
    """``(page_id, url, digest, payload_bytes, refers_to, record)`` for each page; ``record`` is its WARC record as text.

    Of equal payloads (same SHA-1 and length) of at least ``least`` bytes, the one with the largest page_id is a response,
    the others are revisits of it without a body. Only digests and lengths are grouped; of these, only groups of two or
    more are joined back. A page_id that is repeated with one payload gives a response each time.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1").drop("n"), "payloads")
    rows = rows.join(groups, ["digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = rows.withColumn("refers_to", F.when(revisit, F.col("first")))
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _uuid(F.concat_ws("|", "page_id", "digest")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), _header(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Bytes: "), F.col("payload_bytes").cast("string"),
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT}\r\nWARC-Refers-To: "), _uuid(F.concat_ws("|", "first", "digest")), F.lit("\r\nX-Refers-To-Page-Id: "), F.col("first").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"), F.col("body"),
    )
    return rows.withColumn("body", body).withColumn("record", head).select("page_id", "url", "digest", "payload_bytes", "refers_to", "record")


def _gzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member of its own, so that it can be read alone."""
    for batch in batches:
        names = [c for c in batch.schema.names if c != "record"]
        for low in range(0, batch.num_rows, 256):
            b = batch.slice(low, 256)
            members = []
            for r in b.column("record").to_pylist():
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                members.append(z.compress(r.encode("utf-8", "surrogatepass") + END) + z.flush())
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(members, pa.binary())], names=[*names, "member"])


def _concatenate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for g in sorted_groups(batches, ["archive"]):
        yield pa.record_batch({"archive": g.column("archive")[:1].combine_chunks(), "value": pa.array([b"".join(g.column("member").to_pylist())], pa.binary())})


def write_warc(records: DataFrame, path: str, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write ``records`` as gzipped WARC files ``path/archive=N/*`` and, first, their index ``path-index``; returns the index.

    Index: ``(archive, offset, length, page_id, url, digest, payload_bytes)``. A record's archive is a hash of its id, digest
    and number among the records written, its place in it follows these; so records that repeat are spread, and offsets are running sums over one archive of about ``archive_bytes``, known
    before a byte of it is written. Then each archive's records are sorted the same way, put together in one task, and
    written by Spark's text writer, which commits whole files only, on whatever file system the path is. The writer ends
    each file with a zero byte, padding that gzip readers skip.
    """
    kinds = {"page_id": "long", "url": "string", "digest": "string", "payload_bytes": "long", "record": "string"}
    members = records.select(*kinds).mapInArrow(_gzip, ", ".join(f"{k} {v}" for k, v in kinds.items() if k != "record") + ", member binary")
    members = materialize(members.withColumn("rid", F.monotonically_increasing_id()), "members")
    size = F.octet_length("member").cast("long")
    total = members.agg(F.sum(size)).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    placed = members.withColumn("archive", F.pmod(F.xxhash64("page_id", "digest", "rid"), F.lit(archives)).cast("int")).withColumn("o", F.xxhash64("digest", "page_id"))
    parts, order = min(archives, MAX_PARTITIONS), ["o", "rid"]  # beyond, a task writes several archives, one after the other
    before = Window.partitionBy("archive").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    index = placed.select("archive", size.alias("length"), "page_id", "url", "digest", "payload_bytes", *order)
    index.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop(*order).write.parquet(f"{path}-index")
    ordered = placed.repartitionById(parts, F.col("archive") % parts).sortWithinPartitions("archive", *order).select("archive", "member")
    files = ordered.mapInArrow(_concatenate, "archive int, value binary").select("archive", F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\0").partitionBy("archive").text(path)
    return records.sparkSession.read.parquet(f"{path}-index")


def _files(spark, path: str) -> DataFrame:
    """``(archive, file)`` of the written archives, from Spark's own listing of their folders."""
    seen = spark.read.format("binaryFile").load(path)  # the content isn't read
    return seen.select(F.regexp_extract("path", r"archive=(\d+)/[^/]*$", 1).cast("int").alias("archive"), F.col("path").alias("file"))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a WARC record and the payload in its HTTP response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    for batch in batches:
        for r in batch.to_pylist():
            store, place = fs.FileSystem.from_uri(r["file"])
            with store.open_input_file(place) as f:
                data = memoryview(f.read_at(r["beyond"] - r["start"], r["start"]))
            out = []
            for x in r["records"]:
                a = x["offset"] - r["start"]
                fields, payload = parse_record(zlib.decompress(data[a : a + x["length"]], 31))
                kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Bytes"])
                if digest != x["digest"] or kind == "response" and (digest, size) != (base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)):
                    raise ValueError(f"record at {x['offset']} of {r['file']} is not what the index says")
                number = lambda k: int(fields[k]) if k in fields else None  # noqa: E731,B023
                out.append((number("X-Page-Id"), fields["WARC-Target-URI"], size, digest, kind, number("X-Refers-To-Page-Id"), payload if kind == "response" else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_records(index: DataFrame, path: str, gap: int = 64 << 10, most: int = 2 << 20) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)`` of the records that ``index`` (any
    selection of its rows) names, read back from the archives at ``path``.

    Wanted ranges of an archive are sorted; neighbours less than ``gap`` bytes apart become one read of about ``most``
    bytes at most (one record may be longer). Each read is a row that any task can do. A response whose payload doesn't
    have its digest fails the job; a revisit has no payload here, its sizes are those of the payload it refers to.
    """
    order = Window.partitionBy("archive").orderBy("offset", "length")
    end = F.col("offset") + F.col("length")
    near = index.select("archive", "offset", "length", "digest").withColumn("before", F.lag(end).over(order))
    apart = F.when(F.col("before").isNull() | (F.col("offset") - F.col("before") > gap), 1).otherwise(0)
    near = near.withColumn("run", F.sum(apart).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("slot", F.floor(F.col("offset") / most))
    reads = near.groupBy("archive", "run", "slot").agg(
        F.min("offset").alias("start"), F.max(end).alias("beyond"), F.array_sort(F.collect_list(F.struct("offset", "length", "digest"))).alias("records")
    )
    files = _files(index.sparkSession, path)
    rows = reads.join(files, "archive").select("file", "start", "beyond", "records")
    tasks = min(MAX_PARTITIONS, max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // (4 * most))))
    rows = rows.repartition(tasks, "file", "start")  # a row is small, but what it asks for isn't
    return rows.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
