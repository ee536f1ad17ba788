"""From playlists to packets: each level's rows name the files that the next one reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import listed, playlist
from tidemark.sources.media_sinks import dealt


def variants(spark: SparkSession, path: str) -> DataFrame:
    """master, bandwidth, url, rung of each variant that the master playlists (a path or pattern) list. A playlist of segments
    among them is its own only variant, of bandwidth null and rung 0."""
    return _variants(spark.read.format("binaryFile").load(path).select(F.col("path").alias("master"), F.decode("content", "UTF-8").alias("text")))


def variants_of(masters: DataFrame, path: str) -> DataFrame:
    """variants() of master playlists that the rows of a table name (a column of paths): for more of them than a pattern should find."""
    return _variants(listed.texts(dealt(masters.select(F.col(path).alias("master")), "master"), ["master"], "master"))


def _variants(texts: DataFrame) -> DataFrame:
    lines = playlist.lines(texts, "master", "text")
    listed_ = playlist.variants(lines, F.regexp_replace("playlist_id", "^file:/+", "file:///"))
    plain = playlist.extended(lines).groupBy("playlist_id").agg(F.max(F.col("text").startswith("#EXT-X-STREAM-INF")).alias("_m")).filter("not _m")
    own = plain.select("playlist_id", F.lit(None).cast("long").alias("bandwidth"), F.regexp_replace("playlist_id", "^file:/+", "file:///").alias("url"), F.lit(0).alias("rung"))
    return listed_.unionByName(own).withColumnRenamed("playlist_id", "master")


def best_within(found: DataFrame, bandwidth: int) -> DataFrame:
    """Of each master's variants the highest one within a bandwidth, or the lowest one if all are above it."""
    fits = F.coalesce(F.col("bandwidth") <= bandwidth, F.lit(True))
    rank = F.row_number().over(Window.partitionBy("master").orderBy(fits.desc(), F.when(fits, -F.col("rung")).otherwise(F.col("rung"))))
    return found.withColumn("_r", rank).filter("_r = 1").drop("_r")


def segments(found: DataFrame, since: Column | None = None) -> DataFrame:
    """master, rung, seq, url, duration_ms, start_ms, discontinuity, ended, beg, end of the segments of each variant, beg and
    end null where a segment is a whole file; since leaves out those below a media sequence number, as a refresh does with what
    it has seen."""
    texts = listed.texts(dealt(found, "url"), ["master", "rung", "url"], "url")
    rows = playlist.segments(playlist.lines(texts.select(F.struct("master", "rung", "url").alias("id"), "text"), "id", "text"), F.col("playlist_id.url"), ranges=True)
    rows = rows.select("playlist_id.master", "playlist_id.rung", "seq", "url", "duration_ms", "start_ms", "discontinuity", "ended", "beg", "end")
    return rows if since is None else rows.filter(F.col("seq") >= since)


def packets(parts: DataFrame) -> DataFrame:
    """master, rung, seq, n, raw: the transport packets of each segment; n goes on from segment to segment, in steps that
    leave room for a segment's own. A segment, a file or the bytes [beg, end) of one, is one task's stream; segments are
    spread over all tasks."""
    ranges = {"start": "beg", "end": "end"} if {"beg", "end"} <= set(parts.columns) else {}
    rows = listed.units(dealt(parts, "master", "rung", "seq"), ["master", "rung", "seq"], "url", **ranges)
    return rows.withColumn("n", F.col("seq") * F.lit(1 << 32) + F.col("n"))
