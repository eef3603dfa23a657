"""WARC archives: a writer of one gzip member per record and a splittable reader.

Writing goes through Spark's own file writer (so it works on every file system that Spark writes, and its committer
survives lost executors). That writer ends each row with a separator; every member here ends in a zero byte, which is
left to the separator, so a file is a plain series of gzip members.

Reading cuts files into byte ranges. A task looks for the gzip magic from the start of its range, accepts a place only
if a member that decodes to a WARC header begins there, and owns the records that start inside its range; it reads the
last one past the range's end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, shared_dir, small_batches, table

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 32 << 20
_READ = 64 << 10
_EMIT = 4 << 20
#: An empty gzip member: it follows a record whose own last byte isn't zero (16 MB or more).
_PAD = bytes.fromhex("1f8b0800000000000003" + "0300" + "00" * 8)

SCHEMA = "path string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def _clean(value: str) -> str:
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def member(record_id: str, uri: str | None, kind: str, refers_to: str | None, digest: str, payload: bytes) -> bytes:
    """One record as a gzip member ending in a zero byte. A revisit has no payload of its own."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if kind == "revisit" else payload)
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    out = pack.compress("\r\n".join(head).encode() + b"\r\n\r\n") + pack.compress(body) + pack.compress(b"\r\n\r\n") + pack.flush()
    return out if out[-1] == 0 else out + _PAD


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        for record_id, uri, kind, refers_to, digest, payload in zip(*(batch.column(i) for i in range(6)), strict=True):
            out.append(member(record_id.as_py(), uri.as_py(), kind.as_py(), refers_to.as_py(), digest.as_py(), payload.as_py())[:-1])
            size += len(out[-1])
            if size > _EMIT:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_warc(records: DataFrame, path: str) -> None:
    """Write (record_id, target_uri, record_type, refers_to, payload_digest, payload binary) as archives below path."""
    small_batches(records.sparkSession)
    columns = ["record_id", "target_uri", "record_type", "refers_to", "payload_digest", "payload"]
    packed = records.select(*columns).mapInArrow(_members, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _open(path: str):
    """A seekable file: local ones directly, others through Arrow's file systems."""
    if path.startswith("file:"):
        from urllib.parse import unquote

        return open(unquote("/" + path[5:].lstrip("/")), "rb")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class _Window:
    """Bytes of a file from a moving place on."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(max(_READ, len(self.data)))
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _decode(window: _Window) -> tuple[bytes, int] | None:
    """The member at the window's start, decoded, and its length; None if none decodes there to a WARC record (or nothing, for a pad)."""
    unpack, out, used = zlib.decompressobj(31), [], 0
    seen = b""
    while True:
        if used == len(window.data) and not window.more():
            return None
        try:
            piece = unpack.decompress(window.data[used:])
        except zlib.error:
            return None
        used = len(window.data)
        out.append(piece)
        if len(seen) < 8:
            seen += piece[:8]
            if not b"WARC/1.0"[: len(seen)][:7] == seen[:7]:
                return None
        if unpack.eof:
            return b"".join(out), len(window.data) - len(unpack.unused_data)


def parse(raw: bytes) -> dict | None:
    """Header fields (lower-case names) and payload of a record; None if it is none."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        return None
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        block = rest[: int(fields["content-length"])]
    except (KeyError, ValueError):
        return None
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return fields | {"payload": block}


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of each record that starts in [start, end)."""
    window = _Window(file, start)
    while window.at < end:
        if len(window.data) < len(MAGIC) and not window.more() and len(window.data) < len(MAGIC):
            return
        found = window.data.find(MAGIC)
        if found < 0:
            window.drop(max(1, len(window.data) - len(MAGIC) + 1))
            continue
        window.drop(found)
        if window.at >= end:
            return
        got = _decode(window)
        if got is None:
            window.drop(1)
            continue
        raw, length = got
        record = parse(raw) if raw else None
        if record is not None:
            yield window.at, record
        window.drop(length)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for ranges in batches:
        for path, start, end in zip(*(ranges.column(i).to_pylist() for i in range(3)), strict=True):
            rows, size = [], 0
            with _open(path) as file:
                for at, r in records_in(file, start, end):
                    name = lambda k, r=r: r[k].strip("<>") if k in r else None
                    length = r.get("x-payload-length")
                    length = int(length) if length and length.isdigit() else len(r["payload"])
                    digest = r.get("warc-payload-digest", "").rpartition(":")[2] or hashlib.sha256(r["payload"]).hexdigest()
                    rows.append((path, at, name("warc-record-id"), r.get("warc-type"), r.get("warc-target-uri"), name("warc-refers-to"), digest, length, r["payload"]))
                    size += len(r["payload"])
                    if size > _EMIT:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of all archives below path, with SCHEMA. Files are listed by Spark and cut into ranges of range_bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    starts = F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "length", starts.alias("start")).select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    n = max(1, min(10_000, ranges.count()))
    return ranges.repartition(n).mapInArrow(_read, SCHEMA)


def archive_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Records of (page_id, url, html): of equal payloads of at least `least` bytes the smallest page_id is response, others revisit it.

    A null html is an empty payload. A null page_id is never referred to; it revisits a page that has an id, else it is a
    response. Repeated rows of the smallest page_id are all responses. Other columns are ignored.
    """
    pages = pages.select("page_id", F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("payload_digest", F.sha2("payload", 256))
    large = F.length("payload") >= least
    first = pages.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # small payloads match nothing, whatever they share; each gets a key of its own kind, so that they don't meet in a few tasks
    key = F.when(large, F.col("payload_digest")).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))
    joined = pages.withColumn("key", key).join(maybe_broadcast(first.withColumnRenamed("payload_digest", "key")), "key", "left")
    again = large & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(urn("page_id").alias("record_id"), "target_uri", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, urn("first_id")).alias("refers_to"), "payload_digest", "payload")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back, and describe each record. The digest of a response is taken from the bytes read."""
    path = shared_dir(spark, "warc")
    write_warc(archive_pages(table(spark, sf_dir, "pages")), path)
    read = read_warc(spark, path)
    page = lambda c: F.regexp_extract(F.col(c), r"^urn:page:(-?\d+)$", 1).try_cast("long")
    own = F.col("record_type") == "response"
    return read.select(
        page("record_id").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


QUERIES = {"op1_warc": op1_warc}

ORACLE = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
     f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.n >= 100 AND f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 100 AND p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
}
