"""Sinks that show what a stream holds: a line for each packet, a checksum of all of it; and a merged stream for writing."""

from __future__ import annotations

import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODULUS = 65521
#: Fixed value: the flag of a key packet, which is not shown.
KEY_FLAG = 1


@F.pandas_udf(T.LongType())
def _adler_from_0(data: pd.Series) -> pd.Series:
    return data.map(lambda x: zlib.adler32(bytes(x), 0), na_action="ignore").astype("Int64")


def packet_line(stream: Column, dts: Column, pts: Column, duration: Column, data: Column, flags: Column) -> Column:
    """stream, dts, pts, duration, size and the Adler checksum (from 0) of a packet; flags too unless it is a plain key."""
    line = F.format_string("%d, %10d, %10d, %8d, %8d, 0x%08x", stream, dts.cast("long"), pts.cast("long"), duration.cast("long"), F.octet_length(data), _adler_from_0(data))
    return F.when(flags == KEY_FLAG, line).otherwise(F.concat(line, F.lit(", F=0x"), F.hex(flags)))


def stream_checksum(packets: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """keys and checksum: the Adler checksum (from 1) of all packets' bytes in order, as 8 hex digits.

    The two sums of a stream follow from those of its packets and their lengths, so packets are read where they lie, and
    what is summed along a stream is three numbers for each.
    """
    sums = packets.select(*keys, F.col(order).alias("_o"), F.octet_length(data).cast("long").alias("_n"), _adler_from_0(F.col(data)).alias("_s"))
    sums = sums.withColumn("_a", F.col("_s") % 65536).withColumn("_b", F.shiftright("_s", 16))
    before = F.coalesce(F.sum("_a").over(Window.partitionBy(*keys).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    sums = sums.withColumn("_t", (F.col("_b") + F.col("_n") % MODULUS * (before % MODULUS)) % MODULUS)
    a, b = (F.sum("_a") + 1) % MODULUS, F.sum("_t") % MODULUS
    return sums.groupBy(*keys).agg(F.lower(F.lpad(F.hex(b * 65536 + a), 8, "0")).alias("checksum"))


def mux(streams: list[DataFrame], keys: list[str], ts: str, tie: str, is_key: str, key_stream: int = 0) -> DataFrame:
    """The packets of all streams of each key in the order of time, then input, then tie: seq, input_idx. Nothing is written
    before the first key packet of `key_stream`; without one nothing is."""
    both = reduce(DataFrame.unionByName, [s.filter(F.col(ts).isNotNull()).withColumn("input_idx", F.lit(i)) for i, s in enumerate(streams)])
    start = F.min(F.when((F.col("input_idx") == key_stream) & F.col(is_key), F.col(ts))).over(Window.partitionBy(*keys))
    kept = both.withColumn("_start", start).filter(F.col(ts) >= F.col("_start")).drop("_start")
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(ts, "input_idx", tie)).cast("long"))
