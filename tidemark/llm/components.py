"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import drop_path, fresh_path, materialize_at

#: Of more links than this, whose least ids Spark would not send to all tasks by itself, an id that has more than one in
#: MOST_HUBS is a hub: so there are at most MOST_HUBS of them.
LARGE, MOST_HUBS = 250_000, 10_000


def connected_components(links: DataFrame, tag: str = "components") -> DataFrame:
    """links: long columns src and dst. Returns id and component (the smallest id reachable) for every id in a link.

    Each round is a table in the shared folder; the one before the last is dropped. Neither links nor components leave
    the executors. Self-links and nulls count for nothing.
    """
    spark = links.sparkSession
    pairs = links.filter("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    path = fresh_path(spark, tag)
    now = materialize_at(pairs, path)
    seen = _signature(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _join_least(both.filter("v > u"), least, seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        near = _join_least(large, lowest, seen[0])
        small = near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        following = fresh_path(spark, tag)
        now = materialize_at(small, following)
        drop_path(spark, path)
        path, before, seen = following, seen, _signature(now)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _join_least(pairs: DataFrame, least: DataFrame, n_pairs: int) -> DataFrame:
    """pairs with the m of their u. The few hubs are sent to all tasks, so their links stay where they are."""
    if n_pairs <= LARGE:
        return pairs.join(least.select("u", "m"), "u")
    most = n_pairs // MOST_HUBS
    hubs = F.broadcast(least.filter(F.col("n") > most).select("u", "m"))
    rest = pairs.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= most).select("u", "m"), "u")
    return rest.unionByName(pairs.join(hubs, "u").select(*rest.columns))


def _signature(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("long"))).first())
