"""Structured Streaming forms of the operators; each gives what its batch form gives when the input has ended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.storage import fresh_path

LATE = "1 hour"


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the parquet files under a folder; files_per_trigger limits a batch as a full buffer limits a source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs until the input has ended, then returns what was written: parquet in the shared folder for append, the last
    whole result for complete, or nothing but `each` batch's effects."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is not None:
        query = writer.foreachBatch(each).start()
    elif mode == "complete":
        query = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out)).start()
    else:
        query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if each is None else spark.createDataFrame([], stream.schema)


def sample_windows(events: DataFrame, ts: str, every: str, keys: list[str], size: str, late: str = LATE) -> DataFrame:
    """Tumbling records; a row later than the watermark counts for nothing."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every), *keys).agg(F.count("*").alias("n_events"), F.sum(size).alias("bytes")).select(*keys, F.col("window.start").alias("start"), "n_events", "bytes")


def sliding_speed(events: DataFrame, ts: str, length: str, every: str, size: str, late: str = LATE) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, every)).agg(F.sum(size).alias("bytes")).select(F.col("window.start").alias("start"), "bytes")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str = LATE) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n_events")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def segments_once(refreshes: DataFrame, ts: str, keys: list[str], late: str = LATE) -> DataFrame:
    """Each segment of a live playlist once, however often it is listed."""
    return refreshes.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def pair_within(left: DataFrame, right: DataFrame, on: str, ts: str, within: str, late: str = LATE) -> DataFrame:
    """Stream-stream join: rows of both sides with the key whose times are at most so far apart."""
    a = left.withWatermark(ts, late).select(F.col(on), *[F.col(c).alias(f"l_{c}") for c in left.columns if c != on])
    b = right.withWatermark(ts, late).select(F.col(on).alias("_on"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != on])
    near = F.expr(f"r_{ts} >= l_{ts} - interval {within} and r_{ts} <= l_{ts} + interval {within}")
    return a.join(b, (F.col(on) == F.col("_on")) & near).drop("_on")


def step(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Every n-th row of each key, counted across batches; rows of a key must come in order from batch to batch."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        got = pd.concat(list(frames)).sort_values(order)
        at = seen + pd.RangeIndex(len(got))
        state.update((seen + len(got),))
        yield got[at % n == 0]

    return rows.groupBy(key).applyInPandasWithState(run, ", ".join(f"`{c}` {t}" for c, t in kind.items()), "seen long", "append", GroupStateTimeout.NoTimeout)


def keep_last(rows: DataFrame, key: str, order: str, value: str, marker: str) -> DataFrame:
    """As-of in a stream: rows whose marker is 0 set a key's value, rows whose marker is 1 get the last one set."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        got = pd.concat(list(frames)).sort_values([order, marker])
        found = []
        for v, m in zip(got[value], got[marker], strict=True):
            last = v if m == 0 else last
            found.append(last)
        state.update((None if last is None else float(last),))
        got["last_value"] = pd.array(found, dtype="Float64")
        yield got[got[marker] == 1]

    return rows.groupBy(key).applyInPandasWithState(run, ", ".join(f"`{c}` {t}" for c, t in kind.items()) + ", last_value double", "last double", "append", GroupStateTimeout.NoTimeout)


def push(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """The caller's side of a pushed source: the rows become the next files of the folder that read() streams from."""
    rows.write.mode("append").parquet(path)


def first_known(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds first_<value>: the first value known so far, as a pushed source's format is that of its first header."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(f"first_{value}", F.first(value, ignorenulls=True).over(w))


def spool(records: DataFrame, path: str, batch: str) -> None:
    """Keeps records that could not be sent, under the name of their batch; spooling a batch again replaces it."""
    records.write.mode("overwrite").parquet(f"{path}/unsent/batch={batch}")


def resend(spark: SparkSession, path: str, send: Callable[[DataFrame], None]) -> list[str]:
    """Hands each spooled batch that was not sent yet to send(), and notes it as sent when that has returned. A batch whose
    send() fails stays, and those after it wait."""
    from tidemark.storage import file_names

    done = []
    sent = set(file_names(spark, f"{path}/sent"))
    for name in sorted(set(file_names(spark, f"{path}/unsent")) - sent):
        send(spark.read.parquet(f"{path}/unsent/{name}"))
        spark.range(0).write.mode("overwrite").parquet(f"{path}/sent/{name}")
        done.append(name.removeprefix("batch="))
    return done


def replay_rates(log: DataFrame, rungs: list[tuple[int, int]], key: str, strict_reference: bool = True) -> DataFrame:
    """The bitrate rule along a stream of downloads: key, n, stream_id, bitrate, changed; the state of a key goes on from
    batch to batch. log: key and the columns that abr.replay() takes; a key's downloads come in order from batch to batch."""
    from tidemark.operators import abr

    ids, rates = [s for s, _ in rungs], [int(b) for _, b in rungs]
    kind = dict(log.dtypes)[key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = abr.State(*state.get) if state.exists else abr.State()
        got = pd.concat(list(frames)).sort_values("n")
        out = []
        for n, *measure in got[abr.LOG].itertuples(index=False):
            now, changed = abr.decide(now, rates, *map(int, measure), strict_reference)
            out.append((k[0], n, ids[now.at], rates[now.at], changed))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=[key, "n", "stream_id", "bitrate", "changed"])

    rows = log.select(key, *[F.col(c).cast("long").alias(c) for c in abr.LOG])
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, n long, stream_id int, bitrate long, changed boolean", "at long, n_changes long, last_change long", "append", GroupStateTimeout.NoTimeout)
