"""Real-time packets and addresses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashes import read_number
from tidemark.functions.timemath import unwrap
from tidemark.operators.folds import fold
from tidemark.sources.bitstreams import prefixed
from tidemark.sources.transport import joined_bytes


def packet_header(raw: Column) -> Column:
    """struct<version, marker, payload_type, sequence, ts, source, payload>: padding and the lists of sources are skipped; an
    extension header is too."""
    first, second = read_number(raw, 0, 1), read_number(raw, 1, 1)
    start = 12 + first.bitwiseAND(F.lit(15)) * 4
    extended = first.bitwiseAND(F.lit(0x10)) != 0
    start = (start + F.when(extended, read_number(raw, start.cast("int") + 2, 2) * 4 + 4).otherwise(F.lit(0))).cast("int")
    size = F.octet_length(raw)
    padding = F.when(first.bitwiseAND(F.lit(0x20)) != 0, F.conv(F.hex(F.substring(raw, size, F.lit(1))), 16, 10).cast("int")).otherwise(F.lit(0))
    payload = F.substring(raw, start + 1, F.greatest(F.lit(0), size - start - padding))
    return F.struct(F.shiftright(first, 6).cast("int").alias("version"), (second >= 128).alias("marker"), second.bitwiseAND(F.lit(127)).cast("int").alias("payload_type"), read_number(raw, 2, 2).cast("int").alias("sequence"), read_number(raw, 4, 4).alias("ts"), read_number(raw, 8, 4).alias("source"), payload.alias("payload"))


def frames(packets: DataFrame, keys: list[str], arrival: str, raw: str) -> DataFrame:
    """keys, n, ts, frame, packets, whole: the payloads of each frame, which ends with its marker, in the order of their
    sequence numbers, which wrap at 65536 and may arrive a little out of order. whole: no number is missing inside it."""
    rows = packets.select(*keys, F.col(arrival).alias("_at"), packet_header(F.col(raw)).alias("h")).select(*keys, "_at", "h.*")
    rows = unwrap(rows, "sequence", ["_at"], keys, 1 << 16).withColumnRenamed("unwrapped", "_seq").dropDuplicates([*keys, "_seq"])
    w = Window.partitionBy(*keys).orderBy("_seq")
    ended = F.coalesce(F.sum(F.col("marker").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("n", ended).groupBy(*keys, "n").agg(F.min("ts").alias("ts"), joined_bytes("_seq", "payload").alias("frame"), F.count("*").alias("packets"), (F.max("_seq") - F.min("_seq") + 1).alias("_span"), F.max("marker").alias("_end"))
    return out.select(*keys, "n", "ts", "frame", "packets", (F.col("_end") & (F.col("_span") == F.col("packets"))).alias("whole"))


class Reorder:
    """A buffer that gives packets in the order of their numbers and waits for a missing one only so long.

    A state is (next number, packets that wait, packets given so far); a packet that waits is (number, arrival, values). The
    one with the lowest number goes out when it is next, or when it has waited for the threshold; numbers below it are then
    lost, and a packet that comes with one of them, or with one that was given already, is late. Numbers wrap at 65536 and
    are taken as the nearest to the next one.
    """

    start = (None, (), 0)

    def __init__(self, threshold_us: int):
        self.threshold = threshold_us

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        """row: arrival, number, then the packet's values."""
        arrival, number, *values = row
        state, out = self._due(state, arrival)
        due, waiting, n = state
        number = number if due is None else due + ((number - due + 0x8000) % 0x10000 - 0x8000)
        due = number if due is None else due
        if number < due or any(w[0] == number for w in waiting):
            return (due, waiting, n), [*out, (None, number, False, True, arrival, *values)]
        waiting = (*waiting, (number, arrival, tuple(values)))
        state, more = self._due((due, waiting, n), arrival)
        return state, [*out, *more]

    def _due(self, state: tuple, now: int | None) -> tuple[tuple, list[tuple]]:
        """Gives what is next or has waited long enough by now (None: for ever)."""
        due, waiting, n = state
        out, left = [], sorted(waiting)
        while left:
            number, arrival, values = left[0]
            late = arrival + self.threshold
            if number != due and now is not None and late > now:
                break
            given = max(arrival, out[-1][4] if out else arrival) if number == due else late
            out.append((n, number, number != due, False, given, *values))
            due, n = number + 1, n + 1
            left.pop(0)
        return (due, tuple(left), n), out

    def end(self, state: tuple) -> list[tuple]:
        return self._due(state, None)[1]


PACKETS = "n long, number long, lost boolean, late boolean, given_us long, marker boolean, ts long, payload binary"


def reordered(packets: DataFrame, keys: list[str], arrival_us: str, tie: str, raw: str, threshold_us: int = 100_000) -> DataFrame:
    """keys, n, number, lost, late, given_us, marker, ts, payload of each packet: n is its place in what is given, in the order
    of numbers; lost tells that numbers before it were given up; a late one (or one that came twice) has no n.

    Arrivals are read in order of time and tie; a packet waits at most the threshold, by the clock of arrivals. One exchange on
    the keys; a task holds a batch and the packets that wait. streaming.stateful.fold_in_order takes the same step.
    """
    rows = packets.select(*keys, F.col(arrival_us).cast("long").alias("_at"), F.col(tie).alias("_tie"), packet_header(F.col(raw)).alias("h")).select(*keys, "_at", "_tie", F.col("h.sequence").cast("long").alias("_number"), "h.marker", "h.ts", "h.payload")
    work = Reorder(threshold_us)
    return fold(rows, keys, ["_at", "_tie"], ["_at", "_number", "marker", "ts", "payload"], work.start, work.step, PACKETS, work.end)


def video_units(given: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, k, ts, unit, whole: the H.264 units that reordered() packets carry: alone, several in one packet (type 24), or one
    in several (type 28). n is a unit's first packet and k its place there. A unit of which a piece is missing comes out
    with whole false and the pieces before the gap; pieces without their first one are left out, as are empty packets."""
    p = F.col("payload")
    rows = given.filter(F.col("n").isNotNull() & (F.octet_length(p) > 0)).withColumn("_t", read_number(p, 0, 1).bitwiseAND(F.lit(31)))
    alone = rows.filter("_t between 1 and 23").select(*keys, "n", F.lit(0).alias("k"), "ts", p.alias("unit"), F.lit(True).alias("whole"))
    several = rows.filter("_t = 24").select(*keys, "n", "ts", F.posexplode(_aggregated(p)).alias("k", "unit"))
    several = several.select(*keys, "n", "k", "ts", "unit", F.lit(True).alias("whole")).filter(F.octet_length("unit") > 0)
    cut = rows.filter("_t = 28 and octet_length(payload) >= 2").withColumn("_f", read_number(p, 1, 1))
    w = Window.partitionBy(*keys).orderBy("n")
    cut = cut.withColumn("_first", F.col("_f") >= 128).withColumn("_g", F.sum(F.col("_first").cast("long")).over(w)).filter("_g > 0")
    group = Window.partitionBy(*keys, "_g").orderBy("n")
    place = F.row_number().over(group) - 1
    broken = (F.col("n") != F.first("n").over(group) + place) | (F.col("lost") & ~F.col("_first"))  # another packet or a gap before it
    cut = cut.withColumn("_b", F.max(broken).over(group.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_last", (F.col("_f").bitwiseAND(F.lit(64)) != 0) & ~F.col("_b"))
    head = F.unhex(F.lpad(F.hex(read_number(p, 0, 1).bitwiseAND(F.lit(0xE0)) + F.col("_f").bitwiseAND(F.lit(31))), 2, "0"))
    part = F.expr("substring(payload, 3, octet_length(payload))")
    cut = cut.filter("not _b").withColumn("_p", F.when(F.col("_first"), F.concat(head, part)).otherwise(part))
    joined = cut.groupBy(*keys, "_g").agg(F.min("n").alias("n"), F.min_by("ts", "n").alias("ts"), joined_bytes("n", "_p").alias("unit"), F.max("_last").alias("whole"))
    return alone.unionByName(several).unionByName(joined.select(*keys, "n", F.lit(0).alias("k"), "ts", "unit", "whole"))


def _aggregated(payload: Column) -> Column:
    @F.pandas_udf("array<binary>")
    def run(packets: pd.Series) -> pd.Series:
        return packets.map(lambda d: list(prefixed(bytes(d)[1:], 2)))

    return run(payload)


def stream_address(url: Column) -> Column:
    """struct<protocol, host, port, app, path> of an rtmp address; null without :// or a host. The port is 0 where none is
    given. app is the first two parts of the path (of ondemand/... the first alone), path the rest; with ?slist= app is all
    of it."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/:]*)", 1)
    port = F.regexp_extract(rest, r"^[^/:]*:(\d+)", 1)
    number = F.when(port == "", F.lit(0)).otherwise(port.cast("int"))
    tail = F.when(F.instr(rest, "/") > 0, F.regexp_replace(rest, r"^[^/]*/", "")).otherwise(F.lit(""))
    listed, on_demand = tail.rlike(r"\?.*slist="), tail.startswith("ondemand/")
    two = F.regexp_extract(tail, r"^([^/]*(?:/[^/]*)?)", 1)
    short = F.regexp_extract(tail, r"^([^/]*)/[^/]*$", 1)
    app = F.when(listed, tail).when(on_demand, "ondemand").when(F.length(F.regexp_replace(tail, "[^/]", "")) == 1, short).otherwise(two)
    path = F.when(listed, F.regexp_extract(tail, r"slist=([^&]*)", 1)).otherwise(F.regexp_replace(F.substring(tail, F.length(app) + 1, F.length(tail)), "^/", ""))
    known = F.when(scheme.isin("rtmp", "rtmpt", "rtmps", "rtmpe", "rtmfp", "rtmpte", "rtmpts"), scheme).otherwise(F.lit("rtmp"))
    return F.when((F.instr(url, "://") > 0) & (rest != ""), F.struct(known.alias("protocol"), host.alias("host"), F.when(number > 65535, 0).otherwise(number).alias("port"), app.alias("app"), path.alias("path")))
