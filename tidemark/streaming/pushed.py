"""A pushed byte stream as a streaming source: its chunks are files, its offsets are bytes.

Whoever pushes writes each chunk once, under a name that tells where in the stream it begins and how long it is. An offset
is a number of bytes, always whole units (packets), wherever the chunks were cut; a batch's partitions are ranges of
units. So a batch that is run again after a failure reads the same bytes, and a restarted query goes on behind its
checkpoint. Chunks that a commit has passed can be deleted, as a buffer frees what was read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.session import add_sources
from tidemark.sources.media_sinks import file_system, save

ENDING = ".chunk"
SCHEMA = pa.schema([("n", pa.int64()), ("raw", pa.binary())])


def chunk_name(start, size):
    """The name (a column) of a chunk of so many bytes that begins at a byte of the stream."""
    return F.concat(F.lpad(start.cast("string"), 20, "0"), F.lit("-"), size.cast("string"), F.lit(ENDING))


def push(rows: DataFrame, path: str, start: str, data: str) -> None:
    """Adds chunks to a stream: a file for each row, by its first byte's place and its bytes. For data that Spark has; another
    program may as well write such files, each complete at once (by a rename)."""
    named = rows.select(chunk_name(F.col(start), F.octet_length(data)).alias("file"), F.col(data).alias("data"))
    save(named.filter(F.octet_length("data") > 0), [], "raw_files", path)


def chunks(path: str) -> list[tuple[int, int, str]]:
    """(first byte, end, path) of each chunk that is there, in order."""
    from pyarrow import fs

    system, root = file_system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    out = []
    for f in found:
        if f.base_name.endswith(ENDING) and f.type == fs.FileType.File:
            start, size = f.base_name.removesuffix(ENDING).split("-")
            out.append((int(start), int(start) + int(size), f.path))
    return sorted(out)


def reaches(found: list[tuple[int, int, str]], start: int) -> int:
    """How far the stream goes from a byte on without a hole."""
    at = start
    for first, end, _ in found:
        if first > at:
            break
        at = max(at, end)
    return at


class _Units(InputPartition):
    def __init__(self, start: int, end: int, parts: list[tuple[int, int, str]]):
        self.start, self.end, self.parts = start, end, parts


def read_range(system, parts: list[tuple[int, int, str]], start: int, end: int) -> bytes:
    """Bytes start to end of a stream from the chunks that hold them."""
    out = []
    i = max(0, bisect_right([p[0] for p in parts], start) - 1)
    while start < end:
        first, stop, path = parts[i]
        i += 1
        if stop <= start:
            continue
        with system.open_input_file(path) as f:
            f.seek(start - first)
            out.append(f.read(min(stop, end) - start))
        start = min(stop, end)
    return b"".join(out)


class PushedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.unit = options["path"], int(options.get("unit", 188))
        self.per, self.discard = int(options.get("unitsPerPartition", 100_000)), options.get("discard", "false").lower() == "true"
        self.batch = int(options.get("unitsPerRead", 10_000))

    def initialOffset(self) -> dict:
        found = chunks(self.path)
        return {"bytes": -(-found[0][0] // self.unit) * self.unit if found else 0}

    def latestOffset(self) -> dict:
        found = chunks(self.path)
        first = found[0][0] if found else 0
        return {"bytes": max(-(-first // self.unit), reaches(found, first) // self.unit) * self.unit}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found, step = chunks(self.path), self.per * self.unit
        if start["bytes"] < end["bytes"] and (not found or found[0][0] > start["bytes"] or reaches(found, found[0][0]) < end["bytes"]):
            raise ValueError(f"bytes from {start['bytes']} to {end['bytes']} are no longer there")
        ranges = ((a, min(a + step, end["bytes"])) for a in range(start["bytes"], end["bytes"], step))
        # The furthest end so far rises with the places, so both edges of a range are found by bisection.
        starts, ends = [c[0] for c in found], list(accumulate((c[1] for c in found), max))
        return [_Units(a, b, [c for c in found[bisect_right(ends, a) : bisect_left(starts, b)] if c[1] > a]) for a, b in ranges]

    def read(self, partition: _Units) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for a in range(partition.start, partition.end, self.batch * self.unit):
            b = min(a + self.batch * self.unit, partition.end)
            yield cut_units(read_range(system, partition.parts, a, b), a // self.unit, self.unit)

    def commit(self, end: dict) -> None:
        if self.discard:
            system, _ = file_system(self.path)
            for _, stop, path in chunks(self.path):
                if stop <= end["bytes"]:
                    system.delete_file(path)


def cut_units(data: bytes, first: int, unit: int) -> pa.RecordBatch:
    """Rows (n, raw) of units of one size, cut from one buffer without copying."""
    n = len(data) // unit
    offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(unit))
    raw = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int64()), raw], schema=SCHEMA)


class PushedSource(DataSource):
    """spark.readStream.format("pushed").option("unit", 188).load(path): n and raw of each whole unit of a pushed stream.

    Options: unit (bytes of a unit), unitsPerPartition, discard (true: chunks behind a committed offset are deleted). A
    stream with a hole goes as far as the hole until the chunk in it comes; bytes that were deleted before they were read are
    an error. A stream whose first chunk begins within a unit begins with the next whole one.
    """

    @classmethod
    def name(cls) -> str:
        return "pushed"

    def schema(self) -> str:
        return "n long, raw binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PushedReader(self.options)


def register(spark) -> None:
    add_sources(spark, PushedSource)
