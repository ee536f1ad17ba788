"""Playlists: lines to segments and variants, with windows over line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.url import resolve

#: Bandwidths below this are taken as thousands.
SMALL_BANDWIDTH = 32 * 1024


def lines(playlists: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """playlist_id, line_no (blank lines do not count), text."""
    split = F.split(F.regexp_replace(text_col, "\r\n", "\n"), "\n", -1)
    kept = F.filter(split, lambda x: F.trim(x) != "")
    return playlists.select(F.col(id_col).alias("playlist_id"), F.posexplode(kept).alias("line_no", "text"))


def attributes(text: Column) -> Column:
    """The map of an attribute list; commas inside quotes do not split, quotes are taken off."""
    pairs = F.regexp_extract_all(text, F.lit(r'([A-Za-z0-9-]+=(?:"[^"]*"|[^,]*))'), F.lit(1))
    entry = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.regexp_replace(F.substring(p, F.instr(p, "=") + 1, F.length(p)), '^"|"$', "").alias("value"))
    return F.map_from_entries(F.transform(pairs, entry))


def _ordered() -> Window:
    return Window.partitionBy("playlist_id").orderBy("line_no")


def extended(parsed: DataFrame) -> DataFrame:
    """Only the playlists whose first line is exactly the mark of an extended one."""
    first = F.first("text").over(_ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return parsed.withColumn("_first", first).filter(F.trim("_first") == "#EXTM3U").drop("_first")


def segments(parsed: DataFrame, base: Column | None = None, ranges: bool = False) -> DataFrame:
    """playlist_id, seq, url, duration_ms, start_ms, discontinuity, ended of each media line.

    seq counts from the media sequence; a duration is whole milliseconds; start_ms is the sum of those before; a
    discontinuity belongs to the next segment; ended tells whether the end mark is in the playlist.

    With ranges also beg and end: the bytes [beg, end) of its file that the segment is, null where it is the whole file. A
    range without an offset begins where that of the segment before it ends, which must be one of the same file; one of which
    this leaves the beginning open is an error.
    """
    so_far = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("playlist_id")
    text = F.col("text")
    rows = extended(parsed)
    rows = rows.withColumn("_media", ~text.startswith("#"))
    rows = rows.withColumn("_group", F.coalesce(F.sum(F.col("_media").cast("int")).over(_ordered().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seconds = F.regexp_extract(text, r"^#EXTINF:\s*([0-9.]+)", 1)
    rows = rows.withColumn("_duration", F.when(seconds != "", F.floor(seconds.cast("decimal(20,6)") * 1000).cast("long")))
    rows = rows.withColumn("_cut", text.startswith("#EXT-X-DISCONTINUITY") & ~text.startswith("#EXT-X-DISCONTINUITY-SEQUENCE"))
    first = F.regexp_extract(text, r"^#EXT-X-MEDIA-SEQUENCE:\s*([0-9]+)", 1)
    rows = rows.withColumn("_first_seq", F.coalesce(F.max(F.when(first != "", first.cast("long"))).over(whole), F.lit(0)))
    rows = rows.withColumn("_ended", F.max(text.startswith("#EXT-X-ENDLIST")).over(whole)).withColumn("_master", F.max(text.startswith("#EXT-X-STREAM-INF")).over(whole))
    item = Window.partitionBy("playlist_id", "_group").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("duration_ms", F.last("_duration", True).over(item)).withColumn("discontinuity", F.max("_cut").over(item))
    if ranges:
        named = lambda m: F.regexp_extract(text, rf"^#EXT-X-BYTERANGE:\s*{m}", 1)
        size, at = named("([0-9]+)"), named("[0-9]+@([0-9]+)")
        asked = F.struct(size.cast("long").alias("size"), F.when(at != "", at.cast("long")).alias("at"))
        rows = rows.withColumn("_range", F.last(F.when(size != "", asked), True).over(item))
    media = rows.filter("_media and not _master").withColumn("_n", F.row_number().over(_ordered()))
    before = F.coalesce(F.sum("duration_ms").over(so_far) - F.coalesce("duration_ms", F.lit(0)), F.lit(0))
    url = F.trim(text)
    if ranges:
        media = _ranges(media, url)
    return media.select("playlist_id", (F.col("_first_seq") + F.col("_n") - 1).alias("seq"), (resolve(base, url) if base is not None else url).alias("url"), "duration_ms", before.alias("start_ms"), "discontinuity", F.col("_ended").alias("ended"), *(["beg", "end"] if ranges else []))


def _ranges(media: DataFrame, url: Column) -> DataFrame:
    """beg and end from _range, the size and offset that a segment has: a run of ranges begins with each offset."""
    size, at = F.col("_range.size"), F.col("_range.at")
    goes_on = size.isNotNull() & at.isNull() & (F.lag(url).over(_ordered()) == url) & F.lag(size).over(_ordered()).isNotNull()
    rows = media.withColumn("_starts", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_starts").over(_ordered().rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("playlist_id", "_run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.first(at).over(run) + F.sum(size).over(run))
    lost = F.raise_error(F.concat(F.lit("no offset for a byte range of "), url)).cast("long")
    return rows.withColumn("end", F.when(size.isNotNull(), F.coalesce("end", lost))).withColumn("beg", F.col("end") - size)


def variants(parsed: DataFrame, base: Column | None = None) -> DataFrame:
    """playlist_id, bandwidth, url, rung (by rising bandwidth, ties as they come). A variant without a bandwidth has that
    of the one before it; one below 32768 counts in thousands."""
    rows = extended(parsed)
    text = F.col("text")
    named = F.when(text.startswith("#EXT-X-STREAM-INF"), F.element_at(attributes(F.regexp_replace(text, "^[^:]*:", "")), "BANDWIDTH").cast("long"))
    scaled = F.when(named < SMALL_BANDWIDTH, named * 1024).otherwise(named)
    so_far = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bandwidth", F.last(scaled, True).over(so_far)).withColumn("_info", F.lag(text.startswith("#EXT-X-STREAM-INF")).over(_ordered()))
    got = rows.filter("_info").filter(~text.startswith("#"))
    url = F.trim(text)
    rank = F.row_number().over(Window.partitionBy("playlist_id").orderBy("bandwidth", "line_no")) - 1
    return got.select("playlist_id", "bandwidth", (resolve(base, url) if base is not None else url).alias("url"), rank.alias("rung"))


def refresh(parsed_segments: DataFrame, version: str) -> DataFrame:
    """Of a live playlist read again and again each segment once, as it was first seen."""
    first = F.min_by(F.struct("url", "duration_ms", "discontinuity"), version)
    return parsed_segments.groupBy("playlist_id", "seq").agg(first.alias("s"), F.min(version).alias(version)).select("playlist_id", "seq", "s.*", version)
