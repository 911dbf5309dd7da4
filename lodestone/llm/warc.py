"""WARC archives: a writer with revisit records and a splittable reader.

Writing: payloads are combined by their SHA-1; of each group the record with the smallest id is the response,
the others are revisits that refer to it (identical-payload-digest profile, HTTP headers only). Each task
writes one file of one gzip member per record, under a temporary name that is moved to its final one when it
is complete, so a retried or speculative task replaces its own file. Only files of the returned manifest count.

Reading: files are cut into byte ranges. A task scans its range for the gzip magic, accepts a position only if
the member there inflates to a WARC header, and owns the records that start inside its range; it reads past
the range's end to finish the last one. After a record the next is expected right behind it; if there is
none, scanning goes on. Only positions are kept in memory besides one record.

Paths may be of any file system that pyarrow.fs knows (file, hdfs, s3, gs).

Defined cases: null html is an empty payload; payloads of less than ``min_bytes`` are always responses; a null
id comes after all others, is written as ``null`` (the word as ``%6Eull``) and marked by ``null_id`` and ``null_refers`` when read; of rows that repeat the response's id and payload one is the
response, the others revisit it; ids of any type are percent-encoded in record ids and read as strings; an empty table
gives no files and an empty result; other columns are ignored. Copies of one payload meet as narrow rows only, in a
join on its digest that adaptive execution splits.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, ship

ship(__name__)

MAGIC, PROFILE = b"\x1f\x8b\x08", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
MANIFEST = "path string, bytes long, records long"


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Stands for a null id; the same word as an id is written with an escape.
NO_ID = "null"


def named(page_id: object) -> str:
    """An id as it stands in a record id."""
    return NO_ID if page_id is None else "%6Eull" if str(page_id) == NO_ID else quote(str(page_id), safe="")


def record(page_id: object, url: str | None, payload: bytes, refers_to: object, revisit: bool, date: str) -> bytes:
    """One gzip member with one record."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{named(page_id)}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{named(refers_to)}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` as WARC files below ``path``; the manifest (path, bytes, records) of what was written."""
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"))
    small = rows.where(F.octet_length("html") >= min_bytes).select("sha", "id")
    copies = small.groupBy("sha", "id").agg(F.count("*").alias("n"))  # repeated rows are combined here
    first = copies.groupBy("sha").agg(F.min("id").alias("first"), F.sum("n").alias("all")).where("all > 1").drop("all")
    again = materialize(copies.join(first, "sha").select(F.col("sha").alias("sha2"), F.col("id").alias("id2"), "first", (F.col("id").eqNullSafe(F.col("first")) & (F.col("n") > 1)).alias("tie")).where("tie or not (id2 <=> first)"))
    met = rows.join(again, (rows["sha"] == again["sha2"]) & rows["id"].eqNullSafe(again["id2"]), "left").select("id", "url", "html", "sha", "first", "tie", F.col("sha2").isNotNull().alias("revisit"))
    if not again.where("tie").isEmpty():
        ties = met.where("tie").withColumn("revisit", F.row_number().over(W.partitionBy("sha", "id").orderBy("url")) > 1)
        met = met.where("not coalesce(tie, false)").unionByName(ties)
    met = met.select("id", "url", "html", "first", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        files, base = fs.FileSystem.from_uri(path)
        name = f"{base.rstrip('/')}/part-{context.partitionId():06d}.warc.gz"
        temp = f"{name}.{context.taskAttemptId()}.tmp"
        count = size = 0
        out = None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("id", "url", "html", "first", "revisit")]
            for page_id, link, text, refers, revisit in zip(*columns, strict=True):
                member = record(page_id, link, text.encode(), refers, revisit, date)
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(temp)
                out.write(member)
                count, size = count + 1, size + len(member)
        if out is not None:
            out.close()
            files.move(temp, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())})

    return materialize(met.mapInArrow(run, MANIFEST))


class _Ahead:
    """Reads of a file at growing positions, in blocks."""

    def __init__(self, file: pa.NativeFile, size: int, block: int = 1 << 16):
        self.file, self.size, self.block, self.at, self.data = file, size, block, 0, b""

    def read(self, at: int) -> bytes:
        """Some bytes from position ``at``, empty at the end."""
        if not self.at <= at < self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(min(self.block, self.size - at))
        return self.data[at - self.at :] if at > self.at else self.data


def find_member(ahead: _Ahead, at: int, end: int) -> int | None:
    """The first position in [at, end) where a gzip member with a WARC header starts."""
    while at < end:
        data = ahead.read(at)
        if len(data) < 3 and at + len(data) < ahead.size:
            ahead.data = b""
            data = ahead.read(at)
        hit = data.find(MAGIC)
        if hit < 0:
            if at + len(data) >= ahead.size:
                return None
            at += max(1, len(data) - 2)  # the magic may lie across blocks
            continue
        at += hit
        if at >= end:
            return None
        if starts_record(ahead, at):
            return at
        at += 1
    return None


def starts_record(ahead: _Ahead, at: int) -> bool:
    unpack, out = zlib.decompressobj(31), b""
    try:
        while len(out) < 7 and not unpack.eof:
            data = ahead.read(at)
            if not data:
                return False
            at += len(data)
            out += unpack.decompress(data, 64)
    except zlib.error:
        return False
    return out.startswith(b"WARC/1.")


def inflate(ahead: _Ahead, at: int) -> tuple[bytes, int]:
    """The member's content and the position behind it."""
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        data = ahead.read(at)
        if not data:
            raise zlib.error("the file ends inside a member")
        out.append(unpack.decompress(data))
        at += len(data)
    return b"".join(out), at - len(unpack.unused_data)


def records(ahead: _Ahead, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, content) of the records that start in [start, end)."""
    at: int | None = start
    expected = False
    while at is not None and at < end:
        if not expected or ahead.read(at)[:3] != MAGIC:
            at = find_member(ahead, at, end)
            if at is None:
                return
        try:
            content, behind = inflate(ahead, at)
        except zlib.error:
            at, expected = at + 1, False
            continue
        if content.startswith(b"WARC/1."):
            yield at, content
        at, expected = behind, True


def parse(content: bytes) -> dict[str, object]:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    kind = fields.get("warc-type")
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    name = lambda x: x.strip("<>").removeprefix(URN) if x else None
    bare = lambda x: unquote(name(x)) if x else None
    full = kind == "response"
    return {
        "record_id": bare(fields.get("warc-record-id")),
        "record_type": kind,
        "url": fields.get("warc-target-uri"),
        "refers_to": bare(fields.get("warc-refers-to")),
        "payload": payload if full else None,
        "payload_bytes": len(payload) if full else int(inner.get("content-length", 0)),
        "payload_digest": digest32(payload) if full else claimed,
        "intact": not full or digest32(payload) == claimed,
        "null_id": name(fields.get("warc-record-id")) == NO_ID,
        "null_refers": name(fields.get("warc-refers-to")) == NO_ID,
    }


_FIELDS = {"record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "refers_to": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "intact": pa.bool_(), "path": pa.string(), "position": pa.int64(), "null_id": pa.bool_(), "null_refers": pa.bool_()}
RECORDS = "record_id string, record_type string, url string, refers_to string, payload binary, payload_bytes long, payload_digest string, intact boolean, path string, position long, null_id boolean, null_refers boolean"


def read_warc(manifest: DataFrame, root: str, split_bytes: int = 64 << 20, payload: bool = True) -> DataFrame:
    """All records of the files of ``manifest`` (path, bytes); ``root`` names their file system. ``payload=False`` leaves payloads out."""
    splits = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, size, start in zip(*(batch[c].to_pylist() for c in ("path", "bytes", "start")), strict=True):
                with files.open_input_file(path) as f:
                    rows: list[dict] = []
                    held = 0
                    for at, content in records(_Ahead(f, size), start, min(size, start + split_bytes)):
                        row = parse(content) | {"path": path, "position": at}
                        if not payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(content) if payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in _FIELDS.items()})
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in _FIELDS.items()})

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return splits.repartition(n).mapInArrow(run, RECORDS)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of existing archives below ``path``, listed without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("bytes"), F.lit(None).cast("long").alias("records"))
