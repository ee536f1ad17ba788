"""WARC archives: one gzip member for each record, read back in order.

Writing: the digests and the deduplication are DataFrame work on ids and digests only; each task then streams its pages
into archive files of bounded size in a folder that all executors share, under a name of its own attempt, and reports the
files that it finished. Only reported files are read, so a task that is lost and run again does no harm. Reading: the name
of an archive is one row; a sequential reader opens it as a stream and inflates it member by member, in small steps: as far
as the header, then as many bytes as the content length says, whose digest it verifies.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh_path, keyed, materialize, tidy

#: An archive is closed at about so many bytes; a larger record has one of its own.
ARCHIVE_BYTES = 16 << 20
#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT = 100
#: How many parts the records of one digest are dealt to where they meet the first record with it.
SALTS = 32
INFLATE_STEP, LEVEL = 1 << 16, 3
DATE = "2024-01-01T00:00:00Z"
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("archive", pa.string())])


class WarcError(ValueError):
    """The archive is not what it says."""


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that names the record with the payload."""
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    identity = "" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{identity}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {target}"] if url is not None else []
    block = payload if refers_to is None else b""
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member with no time stamp, so that equal records give equal bytes."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Member:
    """One gzip member of a stream, inflated as far as it is asked for."""

    def __init__(self, stream: BinaryIO, fed: bytes, step: int):
        self.stream, self.fed, self.step, self.z, self.held = stream, fed, step, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Inflates what `step` compressed bytes hold; False at the member's end."""
        if self.z.eof:
            return False
        self.fed = self.fed or self.stream.read(self.step)
        if not self.fed:
            raise WarcError("the last gzip member is cut short")
        try:
            self.held += self.z.decompress(self.fed)
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        self.fed = self.z.unused_data if self.z.eof else b""
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes before the mark, which is left out too."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                raise WarcError("no WARC header")
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise WarcError("the block is not as long as the header says")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def rest(self) -> bytes:
        """All that is left, which a record's end must be; more than that is not read on."""
        while len(self.held) <= 4 and self.more():
            pass
        return bytes(self.held)


def read_records(stream: BinaryIO, step: int = INFLATE_STEP) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and the block of each record, one gzip member after another.

    A member is inflated `step` compressed bytes at a time: as far as its header, then as far as the content length says,
    then to its end, which must follow. The block must have the digest that the header names.
    """
    fed = stream.read(step)
    while fed:
        member = _Member(stream, fed, step)
        first, *lines = member.until(b"\r\n\r\n").decode(errors="replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise WarcError("no WARC header")
        fields = {}
        for line in lines:
            name, colon, value = line.partition(":")
            if not colon:
                raise WarcError(f"not a header field: {line!r}")
            fields[name.strip().lower()] = value.strip()
        if not fields.get("content-length", "").isdecimal():
            raise WarcError("no content length")
        block = member.take(int(fields["content-length"]))
        if member.rest() != b"\r\n\r\n":
            raise WarcError("the block is not as long as the header says")
        if fields.get("warc-block-digest", "") != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise WarcError("the block does not have the digest that the header says")
        yield fields, block
        fed = member.fed or stream.read(step)


def _identity(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_archive(stream: BinaryIO) -> Iterator[tuple[int | None, str | None, str, int | None, int, str, bytes]]:
    """page_id, url, record type, refers_to, payload length, payload digest and stored payload of each record."""
    for fields, block in read_records(stream):
        kind = fields["warc-type"]
        digest, n = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
        if kind == "response" and (len(block) != n or fields["warc-block-digest"].removeprefix("sha256:") != digest):
            raise WarcError("a response whose payload is not the one it names")
        refers = _identity(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
        yield _identity(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, refers, n, digest, block


def assign(pages: DataFrame) -> DataFrame:
    """Adds payload_digest and refers_to: null for a response, else the smallest page_id with the same long payload."""
    seen = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("payload_digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"))
    long = seen.filter(F.col("payload_bytes") >= LEAST_REVISIT)
    first = long.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = long.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = salted.join(first, ["payload_digest", "salt"]).filter("page_id > first_id or page_id is null").select("page_id", "first_id", "payload_digest")
    return again


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page to archives under `folder`; returns the finished files: archive, records, bytes.

    Null html is an empty payload; html of any length is one record. Other columns are dropped. A page with a null page_id has an empty number in its record id and is never referred
    to. No rows: no archives. Of pages with equal page_id and payload one is the response, and the others revisit it only
    if their page_id is larger, so repeated rows are stored as they come.
    """
    spark = pages.sparkSession
    rows = keyed(pages, {"page_id": "page_id", "url": "url", "html": "html"}).select(F.col("page_id").cast("long"), "url", "html")
    again = assign(rows).filter("page_id is not null").select("page_id", "first_id", "payload_digest").distinct().withColumnRenamed("payload_digest", "again_digest")
    rows = rows.withColumn("payload_digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    joined = rows.filter("page_id is not null").join(again, (rows["page_id"] == again["page_id"]) & (F.col("payload_digest") == F.col("again_digest")), "left").select(rows["page_id"], "url", "html", "payload_digest", F.col("first_id").alias("refers_to"))
    rows = joined.unionByName(rows.filter("page_id is null").withColumn("refers_to", F.lit(None).cast("long")))  # these need no join

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _filesystem(folder)
        files.create_dir(at, recursive=True)
        out, name, size, n = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            urls, digests, refers = (batch.column(k).to_pylist() for k in (1, 3, 4))
            for page, url, payload, digest, refers_to in zip(batch.column(0).to_pylist(), urls, batch.column(2).cast(pa.binary()), digests, refers, strict=True):
                data = gzip_member(record_bytes(page, url, payload.as_py() or b"", digest, refers_to))
                if out is not None and size + len(data) > ARCHIVE_BYTES:
                    out.close()
                    done.append((name, n, size))
                    out = None
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{at}/{name}", compression=None)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            done.append((name, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return materialize(rows.mapInArrow(tidy(run), "archive string, records long, bytes long"), "warc-manifest")


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame | None = None, with_payload: bool = True) -> DataFrame:
    """The records of the archives in `folder` (those of the manifest, if given), in order within each archive.

    page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits), archive. A damaged
    archive raises WarcError.
    """
    if manifest is None:
        manifest = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _filesystem(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                held, size = [], 0
                with files.open_input_stream(f"{at}/{archive}", compression=None) as stream:
                    for page, url, kind, refers, n, digest, block in read_archive(stream):
                        held.append((page, url, kind, refers, n, digest, block if with_payload and kind == "response" else None, archive))
                        size += len(block) if with_payload else 64
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _RECORDS, strict=True)], schema=_RECORDS)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _RECORDS, strict=True)], schema=_RECORDS)

    found = manifest.select("archive").repartition(n, "archive")  # a row for each archive, which a task reads as a stream
    return found.mapInArrow(tidy(run), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string")


def round_trip(pages: DataFrame, folder: str | None = None, with_payload: bool = True) -> DataFrame:
    """Writes the pages and reads them back."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    manifest = write_warc(pages, folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string")
    return read_warc(spark, folder, manifest, with_payload)
