"""State with event-time timers: each key's rows are taken in the order of their times, whatever order they came in.

Rows wait in the state store until the watermark has passed them; a timer at the earliest one's time wakes the key. They
then go, in order, through a step that holds one state, as folds.fold() does with rows that lie in a table. So the result
is that of the fold over all rows, for any cut of the stream into batches in which no row comes later than the watermark
allows. What lies within that delay of the newest row waits for later rows.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the process that readies a query's state has not got this module's path
Step = Callable[[Any, tuple], tuple[Any, list[tuple]]]
#: Fixed value: the state store that processors with timers ask for.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    def __init__(self, waiting: T.StructType, names: list[str], key: str, start: Any, step: Step, ttl_ms: int | None):
        self.waiting, self.names, self.key, self.start, self.step, self.ttl = waiting, names, key, start, step, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.waiting)
        self.state = handle.getValueState("state", "value binary", self.ttl)
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [tuple(None if pd.isna(v) else v for v in r) for df in rows for r in df[self.waiting.names].itertuples(index=False, name=None)]
        self.rows.appendList(came)
        self._wake(min(r[0] for r in came))
        yield pd.DataFrame()

    def _wake(self, us: int) -> None:
        at = us // 1000 + (us % 1000 > 0)
        now = self.alarm.get()[0] if self.alarm.exists() else None
        if now is not None and now <= at:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, wait = [], []
        for r in self.rows.get():
            (ready if r[0] <= passed else wait).append(tuple(r))
        self.alarm.clear()
        if wait:
            self.rows.put(wait)
            self._wake(min(r[0] for r in wait))
        else:
            self.rows.clear()
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self.start
        out = []
        for r in sorted(ready, key=lambda r: r[:2]):
            state, made = self.step(state, r[2:])
            out += [(key[0], *m) for m in made]
        self.state.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=[self.key, *self.names])

    def close(self) -> None:
        pass


def fold_in_order(stream: DataFrame, key: str, ts: str, tie: str, columns: list[str], start: Any, step: Step, out: str, late: str, ttl_ms: int | None = None, at: str | None = None) -> DataFrame:
    """key and `out` of the rows that the steps make along each key's rows by (ts, tie): step(state, values of `columns`)
    gives the next state and rows. ts is a timestamp, tie a long; late is how long a row may come after a newer one of any
    key. With `at` (a timestamp not before ts) a row's turn comes at that time instead. With ttl_ms the state of a key that
    has had no row for so long is forgotten. Null times are left out."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, late).select(F.col(key), F.col(ts).alias("row_ts"), F.unix_micros(at or ts).alias("row_us"), F.col(tie).cast("long").alias("row_tie"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    waiting = T.StructType(rows.schema.fields[2:])
    kind = dict(stream.dtypes)[key]
    names = [f.split()[0] for f in out.split(", ")]
    processor = InOrder(T.StructType([T.StructField(f.name, f.dataType, True) for f in waiting]), names, key, start, step, ttl_ms)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {out}", "Append", "EventTime")


def switch(stream: DataFrame, key: str, ts: str, tie: str, source: str, is_key: str, switch_at: int, late: str) -> DataFrame:
    """key, tie, source of the rows that a switch of quality lets through, as queues.splice() does: those of source 0 until
    the first key row of source 1 at or after a time (microseconds), and those of source 1 from there on."""

    def step(over: bool, row: tuple) -> tuple[bool, list[tuple]]:
        us, n, which, starts = row
        over = over or (which == 1 and bool(starts) and us >= switch_at)
        return over, [(n, which)] if (which == 1) == over else []

    rows = stream.withColumn("_at", F.unix_micros(ts)).withColumn("_n", F.col(tie).cast("long")).withColumn("_w", F.col(source).cast("long")).withColumn("_k", F.col(is_key).cast("boolean"))
    # Of one time the new stream's rows go first, so that its key row ends the old one there.
    rows = rows.withColumn("_order", F.when(F.col("_w") == 1, F.when(F.col("_k"), 0).otherwise(1)).otherwise(2) * F.lit(1 << 60) + F.col("_n"))
    return fold_in_order(rows, key, ts, "_order", ["_at", "_n", "_w", "_k"], False, step, f"{tie} long, {source} long", late)


def timers(stream: DataFrame, key: str, ts: str, timer: str, fires: str, late: str) -> DataFrame:
    """key, timer, place of the timers that fire, in the order in which they do (by time, then number), counted for each key.

    A row sets a timer (a long) at its time ts to fire at a later time; set again before it has fired, it fires at the new
    time only; a null `fires` takes it back. A time not after the row's own fires at once. Setting comes before firing at
    one time.
    """
    events = F.array(F.struct(F.col(ts).alias("at"), F.lit(0).cast("long").alias("side")), F.struct(F.greatest(ts, fires).alias("at"), F.lit(1).cast("long").alias("side")))
    rows = stream.withColumn("_set", F.unix_micros(ts)).withColumn("_e", F.explode(F.filter(events, lambda e: (e["side"] == 0) | F.col(fires).isNotNull())))
    rows = rows.select(key, ts, F.col(timer).cast("long").alias("_t"), "_set", F.col("_e.at").alias("_at"), F.col("_e.side").alias("_side")).withColumn("_order", F.col("_side") * F.lit(1 << 60) + F.col("_t"))

    def step(state: tuple[dict, int], row: tuple) -> tuple[tuple[dict, int], list[tuple]]:
        (set_at, place), (t, when, side) = state, row
        if side == 0:
            return ({**set_at, t: when}, place), []
        if set_at.get(t) != when:  # set again or taken back meanwhile
            return state, []
        return ({k: v for k, v in set_at.items() if k != t}, place + 1), [(t, place + 1)]

    return fold_in_order(rows, key, ts, "_order", ["_t", "_set", "_side"], ({}, 0), step, f"{timer} long, place long", late, at="_at")
