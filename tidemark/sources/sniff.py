"""Protocol and format of a source, from its address, its first bytes, or its content type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats by extension and by content type, and the marks that files begin with.
EXTENSIONS = {"flv": "FLV", "mp4": "MP4", "m4v": "MP4", "mpa": "MP4", "m4a": "MP4", "m3u8": "M3U8", "ts": "TS", "mp3": "MP3", "aac": "AAC", "ffconcat": "FFCAT", "concat": "FFCAT", "ffcat": "FFCAT"}
CONTENT_TYPES = {"audio/mpeg": "MP3", "audio/mp3": "MP3", "audio/aac": "AAC", "video/mp4": "MP4", "video/m4v": "MP4", "audio/m4a": "MP4", "video/flv": "FLV", "video/hls": "M3U8", "video/m3u8": "M3U8"}
BEGINNINGS = {"#EXTM3U": "M3U8", "FLV": "FLV", "ffconcat": "FFCAT"}
BOXES = ("moov", "ftypmp42", "ftypisom", "ftypqt")
HEAD_BYTES = 1024


def protocol(url: Column) -> Column:
    """HTTP for http: and https:, RTMP, RTSP, else FILE; case counts for nothing."""
    low = F.lower(url)
    return F.when(low.rlike("^https?:"), "HTTP").when(low.startswith("rtmp:"), "RTMP").when(low.startswith("rtsp:"), "RTSP").otherwise("FILE")


def _by_table(key: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit("NONE"))


def _after_dot(text: Column) -> Column:
    return F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", -1)).otherwise(F.lit(""))


def format_by_address(url: Column) -> Column:
    """The format that the extension names, else NONE. With a query string (other than domain=) the extension before it
    counts as written; if it names none, or there is no query, the last extension counts in lower case, the concat names
    only as written."""
    bare = F.substring_index(url, "?domain=", 1)
    queried = (F.instr(url, "?domain=") == 0) & (F.instr(url, "?") > 0)
    strict = _by_table(_after_dot(F.substring_index(url, "?", 1)), EXTENSIONS)
    last = _after_dot(bare)
    folded = _by_table(F.lower(last), {k: v for k, v in EXTENSIONS.items() if v != "FFCAT"})
    concat = _by_table(last, {k: v for k, v in EXTENSIONS.items() if v == "FFCAT"})
    loose = F.when(folded != "NONE", folded).otherwise(concat)
    return F.when(queried & (strict != "NONE"), strict).otherwise(loose)


def format_by_content(content: Column, content_type: Column | None = None) -> Column:
    """The format that the first 1024 bytes show, else the one of the content type, else NONE. content: binary."""
    head = F.decode(F.substring(content.cast("binary"), 1, HEAD_BYTES), "ISO-8859-1")
    boxed = reduce(lambda a, b: a | b, [F.instr(head, x) > 0 for x in BOXES])
    found = F.when(F.lit(False), "")
    for mark, kind in BEGINNINGS.items():
        found = found.when(head.startswith(mark), kind)
    other = _by_table(content_type, CONTENT_TYPES) if content_type is not None else F.lit("NONE")
    return found.when(boxed, "MP4").otherwise(other)
