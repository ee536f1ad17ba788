"""Sets of half-open ranges [beg, end)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(ranges: DataFrame, keys: list[str], beg: str = "beg", end: str = "end") -> DataFrame:
    """The union of each key's ranges as disjoint ranges with a gap between them; touching ones become one. Empty and
    reversed ranges count for nothing."""
    w = Window.partitionBy(*keys).orderBy(beg, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.filter(F.col(beg) < F.col(end)).withColumn("_new", F.when(F.col(beg) <= reach, 0).otherwise(1))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(beg).alias(beg), F.max(end).alias(end)).drop("_island")


def coverage(ranges: DataFrame, keys: list[str], beg: str = "beg", end: str = "end") -> DataFrame:
    """Of each key the covered length and the number of disjoint ranges."""
    return merge(ranges, keys, beg, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(beg)).alias("covered"), F.count("*").alias("n_ranges"))


def gaps(ranges: DataFrame, keys: list[str], beg: str = "beg", end: str = "end") -> DataFrame:
    """What lies between a key's disjoint ranges."""
    nxt = F.lead(beg).over(Window.partitionBy(*keys).orderBy(beg))
    return merge(ranges, keys, beg, end).withColumn("_next", nxt).filter("_next is not null").select(*keys, F.col(end).alias(beg), F.col("_next").alias(end))


def has(ranges: DataFrame, asked: DataFrame, keys: list[str], beg: str = "beg", end: str = "end") -> DataFrame:
    """Whether each asked range lies wholly inside one of the key's merged ranges: column `had`."""
    have = merge(ranges, keys, beg, end).select(*keys, F.col(beg).alias("_v"), F.lit(0).alias("_side"), F.col(end).alias("_reach"), F.lit(None).cast("long").alias("_end"))
    want = asked.select(*keys, F.col(beg).alias("_v"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_reach"), F.col(end).cast("long").alias("_end"))
    w = Window.partitionBy(*keys).orderBy("_v", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = have.unionByName(want).withColumn("_so_far", F.last("_reach", True).over(w)).filter("_side = 1")
    return found.select(*keys, F.col("_v").alias(beg), F.col("_end").alias(end), F.coalesce(F.col("_end") <= F.col("_so_far"), F.lit(False)).alias("had"))
