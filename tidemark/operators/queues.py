"""Queues of bytes, samples and packets, read in portions that are not those they were written in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.transport import joined_bytes


def _spans(df: DataFrame, keys: list[str], order: str, size) -> DataFrame:
    """Adds _from and _to: where a row's bytes or samples lie among all of its key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_to", F.sum(size.cast("long")).over(w)).withColumn("_from", F.col("_to") - size.cast("long"))


def reblock(chunks: DataFrame, keys: list[str], order: str, data: str, n: int) -> DataFrame:
    """keys, block, data: the bytes of each key's chunks in blocks of n; the last may be shorter. A chunk is cut where it
    lies, and only the pieces of a block meet."""
    rows = _spans(chunks, keys, order, F.octet_length(data)).filter("_to > _from")
    rows = rows.select(*keys, F.col(order).alias("_o"), F.col(data).alias("_d"), "_from", F.explode(F.sequence(F.expr(f"_from div {n}"), F.expr(f"(_to - 1) div {n}"))).alias("block"), "_to")
    first, last = F.greatest(F.col("_from"), F.col("block") * n), F.least(F.col("_to"), (F.col("block") + 1) * n)
    piece = F.substring("_d", (first - F.col("_from") + 1).cast("int"), (last - first).cast("int"))
    return rows.select(*keys, "block", "_o", piece.alias("_p")).groupBy(*keys, "block").agg(joined_bytes("_o", "_p").alias("data"))


def peek(chunks: DataFrame, keys: list[str], order: str, data: str, at: int, n: int) -> DataFrame:
    """keys and data: the n bytes from place `at` of each key's queue, fewer at its end."""
    rows = _spans(chunks, keys, order, F.octet_length(data)).filter((F.col("_to") > at) & (F.col("_from") < at + n))
    first, last = F.greatest(F.col("_from"), F.lit(at)), F.least(F.col("_to"), F.lit(at + n))
    piece = F.substring(data, (first - F.col("_from") + 1).cast("int"), (last - first).cast("int"))
    return rows.select(*keys, F.col(order).alias("_o"), piece.alias("_p")).groupBy(*keys).agg(joined_bytes("_o", "_p").alias("data"))


def drain_times(packets: DataFrame, keys: list[str], order: str, pts: str, samples: str, n: int) -> DataFrame:
    """keys, portion, pts, duration: what n samples taken at a time from each key's packets have as time (that of the packet
    where they begin, plus the samples taken from it before; null if it has none) and as length, less at the end."""
    rows = _spans(packets, keys, order, F.col(samples)).filter("_to > _from")
    total = F.max("_to").over(Window.partitionBy(*keys))
    rows = rows.withColumn("_all", total).select(*keys, F.col(pts).alias("_t"), "_from", "_all", F.explode(F.when(F.expr(f"(_from + {n} - 1) div {n} <= (_to - 1) div {n}"), F.sequence(F.expr(f"(_from + {n} - 1) div {n}"), F.expr(f"(_to - 1) div {n}"))).otherwise(F.array().cast("array<bigint>"))).alias("portion"))
    return rows.select(*keys, "portion", (F.col("_t") + F.col("portion") * n - F.col("_from")).alias("pts"), F.least(F.lit(n).cast("long"), F.col("_all") - F.col("portion") * n).alias("duration"))


def backward(packets: DataFrame, keys: list[str], order: str, pts: str) -> DataFrame:
    """The packets whose time is not later than that of the packet before them."""
    before = F.lag(pts).over(Window.partitionBy(*keys).orderBy(order))
    return packets.withColumn("_before", before).filter(F.col("_before") >= F.col(pts)).drop("_before")


def ordered_unique(rows: DataFrame, keys: list[str], priority: str, arrival: str) -> DataFrame:
    """Rows by rising priority with their place in the queue; of rows with equal priority only the first to arrive is in it."""
    first = F.row_number().over(Window.partitionBy(*keys, priority).orderBy(arrival))
    kept = rows.withColumn("_first", first).filter("_first = 1").drop("_first")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(priority)).cast("long"))


def within_bytes(rows: DataFrame, keys: list[str], order: str, size: str, most: int) -> DataFrame:
    """The first rows of each key whose sizes together are at most so many bytes."""
    return _spans(rows, keys, order, F.col(size)).filter(F.col("_to") <= most).drop("_from", "_to")


def splice(old: DataFrame, new: DataFrame, keys: list[str], ts: str, is_key: str, switch_at: int) -> DataFrame:
    """A switch of quality: the old stream's rows until the new one's first key row at or after a time, and the new one's
    from there on, with quality 0 and 1. Without such a row the old stream goes on."""
    start = new.filter((F.col(ts) >= switch_at) & F.col(is_key)).groupBy(*keys).agg(F.min(ts).alias("_start"))
    kept = old.join(start, keys, "left").filter(F.col("_start").isNull() | (F.col(ts) < F.col("_start"))).withColumn("quality", F.lit(0))
    more = new.join(start, keys).filter(F.col(ts) >= F.col("_start")).withColumn("quality", F.lit(1))
    return kept.unionByName(more).drop("_start")


def due(timers: DataFrame, keys: list[str], at: str, tie: str, now: int) -> DataFrame:
    """The timers that are due by now, with their place in the order in which they fire: by time, then by tie."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(at, tie))
    return timers.filter(F.col(at) <= now).withColumn("place", place.cast("long"))


def delays(timers: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Adds delay: how long after the timer before it, in its key's order, a timer fires; the first one's is its own time."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    return timers.withColumn("delay", F.col(at) - F.coalesce(F.lag(at).over(w), F.lit(0)))
