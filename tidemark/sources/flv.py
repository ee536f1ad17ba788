"""Flash video files: their tags as rows, and what the first bytes of audio and video tags say."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashes import read_number

#: Tag types and their names.
KINDS = {8: "audio", 9: "video", 18: "script"}
_TAGS = pa.schema([("n", pa.int64()), ("type", pa.int32()), ("ts_ms", pa.int64()), ("stream_id", pa.int32()), ("data", pa.binary()), ("whole", pa.bool_())])


def read_tags(content: bytes) -> Iterator[tuple[int, int, int, int, bytes, bool]]:
    """n, type, time, stream, data and whether all of it is there, of each tag; each header says where the next one is."""
    if content[:3] != b"FLV" or len(content) < 9:
        return
    at, n = int.from_bytes(content[5:9], "big") + 4, 0
    while at + 11 <= len(content):
        size, low, stream = (int.from_bytes(content[at + i : at + i + 3], "big") for i in (1, 4, 8))
        data = content[at + 11 : at + 11 + size]
        yield n, content[at] & 31, content[at + 7] << 24 | low, stream, data, len(data) == size
        at, n = at + 11 + size + 4, n + 1


def tags(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """id, n, type, ts_ms, stream_id, data, whole of each tag; a file that is none has no tags, a cut one a last tag that is
    not whole. A file is one row, so its tags are one task's work; files are many."""
    kind = dict(files.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column(1).to_pylist()):
                rows = list(read_tags(content or b""))
                if rows:
                    ids = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(rows))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TAGS, strict=True)]], names=["id", *_TAGS.names])

    out = files.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary")).mapInArrow(run, f"id {kind}, n long, type int, ts_ms long, stream_id int, data binary, whole boolean")
    return out.withColumnRenamed("id", id_col)


def tag_header(kind: Column, data: Column) -> Column:
    """struct<media, is_key, codec, sequence_header, offset_ms>: of an audio tag the sound format, of a video tag the codec, of
    AVC and AAC whether it is their configuration, and how much later a picture is shown."""
    first, second = read_number(data, 0, 1), read_number(data, 1, 1)
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    video, audio = kind == 9, kind == 8
    avc, aac = video & (first.bitwiseAND(F.lit(15)) == 7), audio & (F.shiftright(first, 4) == 10)
    shift = read_number(data, 2, 3)
    return F.struct(
        F.element_at(table, kind).alias("media"), (video & (F.shiftright(first, 4) == 1)).alias("is_key"), F.when(video, first.bitwiseAND(F.lit(15))).when(audio, F.shiftright(first, 4)).cast("int").alias("codec"),
        ((avc | aac) & (second == 0)).alias("sequence_header"), F.when(avc & (second == 1), F.when(shift >= 1 << 23, shift - (1 << 24)).otherwise(shift)).otherwise(F.lit(0)).cast("int").alias("offset_ms"),
    )
