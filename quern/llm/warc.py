"""Operator 8, WARC: seekable Zstandard bundles.

Records are grouped into frames that decompress independently. A bundle ends with a seek table in a skippable frame
(the public Zstandard seekable format), and the index maps record ids to frame and frame-relative offset, so that one
record costs one ranged read and one frame. Records with equal payloads of LEAST_REVISIT bytes or more share one
response, that with the largest page id; the others are revisits without a payload. Two-pass Bloom filtering finds
payloads that may repeat; only their rows shuffle.

Bundles are written to the shared folder under a name of the task's attempt, first a temporary one, and then moved. The
index is a table, whose write is the commit: bundles of attempts that it doesn't name are no part of the archive. Responses
are written before revisits, which so know the record they refer to.

Defined cases: null html is an empty payload; a null url is written as an empty target; rows with a null page id are
responses (or revisits of a row that has one) and read back with a null id; rows that repeat the largest page id of
their payload are all responses; an empty table writes no bundle; further columns of the input are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import attach, bloom_flag, repeated_bloom
from quern.session import materialise, scratch_path

LEAST_REVISIT = 1000
#: Uncompressed bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 28
LEVEL = 6
# fixed values of the seekable format
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "1970-01-01T00:00:00Z"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """Ids of records differ in their place in the archive even where page and payload are the same."""
    return uuid.UUID(hashlib.md5(f"{page_id}:{digest}:{place}".encode()).hexdigest()).urn


def render(page_id: int | None, url: str | None, payload: bytes | int, digest: str, place: str = "", refers_to: int | None = None, refers_id: str | None = None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit, which knows the size of its payload, with the page and
    the record id of the response."""
    target = "".join(c if c.isprintable() and not c.isspace() else urllib.parse.quote(c, safe="") for c in url or "")
    revisit = refers_id is not None
    size = payload if isinstance(payload, int) else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id, digest, place)}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{refers_id}>")
        head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place of a frame."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    end = stop + 4 + int(headers["Content-Length"])
    return headers, data[stop + 4 : end], end + 4


class _Bundle:
    """A bundle that is being written."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.stream = self.fs.open_output_stream(self.temporary)
        self.frames: list[tuple[int, int]] = []
        self.buffer = bytearray()
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if len(self.buffer) >= FRAME_BYTES:
            self.end_frame()
        at = (len(self.frames), len(self.buffer))
        self.buffer += record
        return at

    def end_frame(self) -> None:
        if self.buffer:
            packed = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress(bytes(self.buffer))
            self.stream.write(packed)
            self.frames.append((len(packed), len(self.buffer)))
            self.size += len(packed)
            self.buffer.clear()

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.stream.close()
        self.fs.move(self.temporary, self.path)


class BundleReader:
    """Reads frames and records of a bundle by ranged reads."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        self.entries = [*struct.iter_unpack("<II", self.file.read_at(8 * count, end - 9 - 8 * count))]
        self.starts = [0]
        for packed, _ in self.entries:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        packed, size = self.entries[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[k]), max_output_size=size)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


INDEX = "record_id string, bundle string, frame long, offset long, digest string, grouped boolean"


def _write(folder: str):
    """Writes the rows of a task to bundles of its own. A name holds a number of the attempt, so that one that runs again or
    beside another never touches a bundle of which the index was taken; the index that Spark commits says which count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, number, count, attempt = None, 0, 0, uuid.uuid4().hex
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows, out = batch.slice(first, 256).to_pylist(), []
                for r in rows:
                    place = f"{attempt}/{count}"
                    count += 1
                    if bundle is None:
                        bundle = _Bundle(f"{folder}/bundle-{r['part']:06d}-{number:04d}-{attempt}.warc.zst")
                        number += 1
                    payload = r["payload"] if r["refers_id"] is None else r["size"]
                    frame, offset = bundle.add(render(r["page_id"], r["url"], payload, r["digest"], place, r["refers_to"], r["refers_id"]))
                    out.append((record_id(r["page_id"], r["digest"], place), bundle.uri, frame, offset, r["digest"], r["grouped"]))
                    if bundle.size >= BUNDLE_BYTES:
                        bundle.close()
                        bundle = None
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=names)
        if bundle is not None:
            bundle.close()

    return run


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to, grouped): refers_to is null for responses, and grouped says whether another
    page has the same payload."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("long_enough", F.octet_length("payload") >= LEAST_REVISIT)
    keys = materialise(rows.where("long_enough").select("page_id", "digest"), "warc-keys")
    bloom = repeated_bloom(keys, "digest")
    groups = materialise(
        bloom_flag(keys, "digest", bloom, "maybe")
        .where("maybe")
        .groupBy("digest")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("size"))
        .where("size > 1"),
        "warc-groups",
    )
    flagged = bloom_flag(rows, "digest", bloom, "maybe").withColumn("maybe", F.col("maybe") & F.col("long_enough"))
    columns = ["page_id", "url", "payload", "digest"]
    sure = flagged.where("not maybe").select(*columns, F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("grouped"))
    met = attach(flagged.where("maybe").select(*columns), groups, "digest", "size", F.col("page_id"), keys.count())
    refers = F.when(F.coalesce(F.col("page_id") != F.col("response"), F.lit(True)), F.col("response"))
    return sure.unionByName(met.select(*columns, refers.alias("refers_to"), F.col("response").isNotNull().alias("grouped")))


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archive; the index comes back as (record_id, bundle, frame, offset).

    Responses are written first. Their ids are known from the index, so each revisit names the record that holds its payload;
    of several responses with one payload and page, the least id.
    """
    rows = with_revisits(pages, id_col, url_col, html_col)
    part = F.spark_partition_id().alias("part")
    none = F.lit(None).cast("string").alias("refers_id")
    first = rows.where("refers_to is null").select("page_id", "url", "payload", F.lit(0).alias("size"), "digest", "refers_to", "grouped", none, part)
    index = materialise(first.mapInArrow(_write(folder), INDEX), "warc-responses")
    held = index.where("grouped").groupBy("digest").agg(F.min("record_id").alias("refers_id"))
    again = rows.where("refers_to is not null").select("page_id", "url", F.octet_length("payload").alias("size"), "digest", "refers_to", "grouped")
    again = materialise(again, "warc-revisits")
    groups = again.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).join(held, "digest")
    named = attach(again, groups, "digest", "rows", F.col("page_id"), again.count())
    second = named.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "size", "digest", "refers_to", "grouped", "refers_id", part)
    revisits = materialise(second.mapInArrow(_write(folder), INDEX), "warc-index")
    return index.unionByName(revisits).select("record_id", "bundle", "frame", "offset")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            reader = BundleReader(uri)
            for k in range(len(reader.entries)):
                data, at, out = reader.frame(k), 0, []
                while at < len(data):
                    headers, block, at = parse(data, at)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    response = headers["WARC-Type"] == "response"
                    length = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
                    told = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
                    digest = hashlib.sha1(payload).hexdigest() if response else told
                    if digest != told or response and length != len(payload):
                        raise ValueError(f"{uri}, frame {k}: a payload doesn't match its digest")
                    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                    out.append((page and int(page), headers["WARC-Target-URI"], length, digest, headers["WARC-Type"], refers and int(refers), payload if response else None))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of the bundles of an index; payloads of responses are checked against their digests."""
    bundles = materialise(index.select("bundle").distinct(), "warc-bundles")
    # as many tasks as bundles: names are too short for tasks to be made by size
    return bundles.repartition(max(1, bundles.count()), "bundle").mapInArrow(
        _read,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_bundles(pages, scratch_path(spark, "warc"))
    return read_bundles(index).drop("payload", "url")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
FROM g
"""
