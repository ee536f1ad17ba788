"""Reading what rows name: each row of a table tells a file, or a range of its bytes, and is read where the row lies.

The list of files is a table like any other, so it may be as long as it likes; no name goes through the driver. Paths are
those that pyarrow's file systems open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals
from tidemark.sources.media_sinks import file_system
from tidemark.streaming.pushed import cut_units

#: Bytes of a block, and units that one read takes.
BLOCK_BYTES, READ_UNITS = 1 << 20, 10_000
#: What is read is given on when it comes to so many rows or bytes: small files many at once.
GIVEN_ROWS, GIVEN_BYTES = 4096, 4 << 20


def _opened(name: str):
    system, at = file_system(name)
    try:
        return system.open_input_file(at)
    except FileNotFoundError as e:
        raise FileNotFoundError(f"[PATH_NOT_FOUND] Path does not exist: {name}") from e


def _read(rows: DataFrame, id_cols: list[str], path: str, start: str | None, end: str | None, out: str, pieces) -> DataFrame:
    """id columns and what pieces(file, from, to) yields, for each row."""
    asked = rows.select(*id_cols, F.col(path).alias("_path"), *[F.col(c).cast("long").alias(n) if c else F.lit(None).cast("long").alias(n) for c, n in ((start, "_from"), (end, "_to"))])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[: len(id_cols)])

    def given(batch: pa.RecordBatch, held: list[tuple[int, pa.RecordBatch]]) -> pa.RecordBatch:
        of = pa.array(np.repeat([i for i, _ in held], [made.num_rows for _, made in held]), pa.int32())
        made = pa.concat_batches([made for _, made in held])
        return pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns[: len(id_cols)]), *made.columns], names=[*id_cols, *made.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, first, last = (batch.column(len(id_cols) + i).to_pylist() for i in range(3))
            held, n_rows, n_bytes = [], 0, 0
            for i, name in enumerate(paths):
                if name is None:
                    continue
                with _opened(name) as f:
                    size = f.size()
                    for made in pieces(f, max(0, first[i] or 0), size if last[i] is None else min(last[i], size)):
                        held.append((i, made))
                        n_rows, n_bytes = n_rows + made.num_rows, n_bytes + made.nbytes
                        if n_rows >= GIVEN_ROWS or n_bytes >= GIVEN_BYTES:
                            yield given(batch, held)
                            held, n_rows, n_bytes = [], 0, 0
            if held:
                yield given(batch, held)

    return asked.mapInArrow(run, f"{kinds}{', ' if kinds else ''}{out}")


def blocks(rows: DataFrame, id_cols: list[str], path: str, start: str | None = None, end: str | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """id columns, at, data: the bytes of each row's file, or of its range [start, end), in blocks; at is a block's place in
    the file. A range is cut at the file's end; a null path reads nothing, a file that is not there is an error."""

    def pieces(f, a: int, b: int) -> Iterator[pa.RecordBatch]:
        f.seek(a)
        while a < b:
            data = f.read(min(block, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([data], pa.binary())], names=["at", "data"])
            a += len(data)

    return _read(rows, id_cols, path, start, end, "at long, data binary", pieces)


def units(rows: DataFrame, id_cols: list[str], path: str, unit: int = 188, start: str | None = None, end: str | None = None) -> DataFrame:
    """id columns, n, raw: the whole units of one size of each row's file, or of its range [start, end), whose first byte
    begins a unit."""

    def pieces(f, a: int, b: int) -> Iterator[pa.RecordBatch]:
        most = max(0, b - a) // unit
        for n in range(0, most, READ_UNITS):
            if not n:
                f.seek(a)
            yield cut_units(f.read((min(n + READ_UNITS, most) - n) * unit), n, unit)

    return _read(rows, id_cols, path, start, end, "n long, raw binary", pieces)


def texts(rows: DataFrame, id_cols: list[str], path: str) -> DataFrame:
    """id columns and text of each row's file, which must fit a row; an empty file is an empty text."""

    def pieces(f, a: int, b: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([f.read().decode(errors="replace")], pa.string())], names=["text"])

    return _read(rows, id_cols, path, None, None, "text string", pieces)


def contents(rows: DataFrame, id_cols: list[str], path: str) -> DataFrame:
    """id columns and content, the bytes of each row's file, which must fit a row; one that is not there is an error."""

    def pieces(f, a: int, b: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([f.read()], pa.binary())], names=["content"])

    return _read(rows, id_cols, path, None, None, "content binary", pieces)


def missing(asked: DataFrame, had: DataFrame, keys: list[str], beg: str = "beg", end: str = "end") -> DataFrame:
    """keys, beg, end: the parts of the asked ranges that a cache has not got, as disjoint ranges."""
    want, have = intervals.merge(asked, keys, beg, end), intervals.merge(had, keys, beg, end)
    edge = lambda df, a, b: df.select(*keys, F.explode(F.array(F.struct(F.col(beg).cast("long").alias("at"), F.lit(a).alias("want"), F.lit(b).alias("have")), F.struct(F.col(end).cast("long").alias("at"), F.lit(-a).alias("want"), F.lit(-b).alias("have")))).alias("e")).select(*keys, "e.*")
    edges = edge(want, 1, 0).unionByName(edge(have, 0, 1)).groupBy(*keys, "at").agg(F.sum("want").alias("want"), F.sum("have").alias("have"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = edges.withColumns({"_w": F.sum("want").over(so_far), "_h": F.sum("have").over(so_far), "_next": F.lead("at").over(w)})
    pieces = pieces.filter("_w > 0 and _h = 0 and _next is not null").select(*keys, F.col("at").alias(beg), F.col("_next").alias(end))
    return intervals.merge(pieces, keys, beg, end)


def fill(asked: DataFrame, had: DataFrame, keys: list[str], path: str, block: int = BLOCK_BYTES) -> DataFrame:
    """keys, at, data of the bytes that are asked for and not had: each row of `asked` has keys, beg, end and its file's path,
    of which a key has one. Only those bytes are read."""
    files = asked.groupBy(*keys).agg(F.first(path).alias("_file"))
    return blocks(missing(asked, had, keys).join(files, keys), keys, "_file", "beg", "end", block)
