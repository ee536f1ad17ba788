"""Things that the corpus operators share: tables, the shared folder, words, grouped streaming."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import clean_up, drop_path, fresh_path, materialize, materialize_at, release, shared_folder

#: Words are maximal runs of anything but a space and the characters 9 to 13.
WORD_SEPARATORS = "[\\x20\\x09-\\x0D]+"
_ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_text(rows: DataFrame) -> DataFrame:
    """Of the rows (doc_id, text, quality) one for each doc_id: that whose text has the least hash."""
    best = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "quality"))
    return rows.groupBy("doc_id").agg(best.alias("r")).select("doc_id", "r.text", "r.quality")


def ascii_lower(data: bytes) -> bytes:
    return data.translate(_ASCII_LOWER)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def grouped(batches: Iterator[pa.RecordBatch], key: list[str], work: Callable[[pa.Table], pa.Table | None], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """work() over each run of rows with equal key; the partition must be sorted by key. Holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            made = work(pa.Table.from_batches(held))
            held.clear()
            if made is not None and made.num_rows:
                yield from made.cast(out).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key]
        keys = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if keys[start] != last:
                yield from done()
                last = keys[start]
            held.append(batch.slice(start, i - start))
            start = i
    yield from done()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives free memory back: workers live on beside the executor's heap."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim:
            trim(0)

    return outer


def held(df: DataFrame) -> dict[str, str]:
    """A name for each column of df that no operator's own columns have."""
    return {c: f"_held_{i}" for i, c in enumerate(df.columns)}


def keyed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the columns named, renamed: extra columns with clashing names cannot disturb what follows."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


__all__ = ["WORD_SEPARATORS", "ascii_lower", "clean_up", "drop_path", "fresh_path", "grouped", "held", "keyed", "materialize", "materialize_at", "one_text", "release", "shared_folder", "table", "text_bytes", "tidy"]
