"""Playback telemetry: names, sessions, pairs of events, windows, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import EVENT_NAMES


def event_name(event_id: Column) -> Column:
    """The event's name, empty for an unknown id."""
    table = F.create_map(*[F.lit(x) for pair in EVENT_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(table, event_id.cast("int")), F.lit(""))


def is_live(duration_ms: Column) -> Column:
    return duration_ms <= 0


def clone_source(df: DataFrame) -> DataFrame:
    """Source rows with `live` taken from the duration."""
    return df.withColumn("live", is_live(F.col("duration_ms")))


def keyed_groups(df: DataFrame, order: list[str], keys: list[str], is_key: Column, ts: str, size: str) -> DataFrame:
    """Groups that a key row starts: gop, rows, size, first and last time. Rows ahead of the first key are group 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("gop", F.sum(is_key.cast("long")).over(w)).groupBy(*keys, "gop").agg(F.count("*").alias("n_rows"), F.sum(size).alias("bytes"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))


def paired(df: DataFrame, order: list[str], keys: list[str], starts: Column, ends: Column, ts: str, columns: list[str]) -> DataFrame:
    """Each start with the next end of its key: columns, ts, end_ts (null if none comes). A start ahead of another start
    has the same end."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("end_ts", F.min(F.when(ends, F.col(ts))).over(w)).filter(starts).select(*keys, *columns, ts, "end_ts")


def sample_records(df: DataFrame, ts_us: str, interval_us: int, keys: list[str], size: str, lag: Column, fail: Column) -> DataFrame:
    """Tumbling windows: rows, bytes, how often playback lagged and failed."""
    start = F.expr(f"({ts_us} div {interval_us}) * {interval_us}")
    return df.groupBy(*keys, start.alias("start_us")).agg(F.count("*").alias("n_events"), F.sum(size).alias("bytes"), F.sum(lag.cast("int")).cast("long").alias("buffering_count"), F.sum(fail.cast("int")).cast("long").alias("n_fail"), F.max(size).alias("max_bytes"))


def last_seconds(df: DataFrame, ts_us: str, size: str, seconds: int, keys: list[str]) -> DataFrame:
    """Bytes of the last so many seconds at every row, its own included, and their whole rate a second."""
    w = Window.partitionBy(*keys).orderBy(ts_us).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("bytes_in", F.sum(size).over(w)).withColumn("speed", F.expr(f"bytes_in div {seconds}"))


def sessions_by_gap(df: DataFrame, ts_us: str, tie: str, gap_us: int, keys: list[str]) -> DataFrame:
    """Sessions for events without a session id: a pause of more than the gap starts the next one."""
    w = Window.partitionBy(*keys).orderBy(ts_us, tie)
    new = F.coalesce((F.col(ts_us) - F.lag(ts_us).over(w) > gap_us).cast("long"), F.lit(0))
    marked = df.withColumn("_new", new)
    return marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new").groupBy(*keys, "session").agg(F.count("*").alias("n_events"), F.min(ts_us).alias("start_us"), F.max(ts_us).alias("end_us"))


def download_speed(df: DataFrame, keys: list[str], size: str, ms: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(size).alias("bytes"), F.sum(ms).alias("download_ms")).withColumn("bytes_per_s", F.expr("case when download_ms > 0 then bytes * 1000 div download_ms end"))


def text_record(columns: list[str]) -> Column:
    """key=value, joined by tabs; a null value is empty."""
    return F.concat_ws("\t", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def parse_text_record(record: Column) -> Column:
    return F.str_to_map(record, F.lit("\t"), F.lit("="))


def json_record(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


#: What a playback's measurements are called in playback_records().
FRAMES = ("video_frame", "audio_frame", "video_drop", "audio_drop", "video_render", "audio_render")


def playback_records(df: DataFrame, ts_us: str, interval_us: int, keys: list[str], kind: str, value: str, took_ms: str) -> DataFrame:
    """The sampling record of each key and interval that has measurements: start_ms, end_ms, buffering, buffering_count,
    video_fps, video_drops, audio_fps, audio_drops, video_render_fps, audio_render_fps, video_buffer, audio_buffer, bytes,
    download_ms, video_bitrate, audio_bitrate, report_ms.

    A row has a kind: one of FRAMES (value: its bytes), buffer_start, buffer_end, video_buffer, audio_buffer (value: what is
    in it) or download (value: bytes; took_ms: how long). Rates are by the second and bitrates in bits a second over the
    whole interval, buffers are means, report_ms is the last measurement's time; buffering is the state at the interval's
    end, which an earlier interval may have left. Other kinds count for report_ms alone.
    """
    k, v, seconds = F.col(kind), F.col(value), interval_us / 1_000_000
    n = lambda name: F.sum((k == name).cast("long"))
    total = lambda name: F.coalesce(F.sum(F.when(k == name, v)), F.lit(0)).cast("long")
    turn = F.when(k.isin("buffer_start", "buffer_end"), F.struct(F.col(ts_us).alias("at"), (k == "buffer_start").alias("on")))
    start = F.expr(f"({ts_us} div {interval_us}) * {interval_us}")
    rows = df.groupBy(*keys, start.alias("_start")).agg(
        F.max(turn)["on"].alias("_turn"), n("buffer_start").alias("buffering_count"), *[n(x).alias(f"_{x}") for x in FRAMES], F.avg(F.when(k == "video_buffer", v)).alias("video_buffer"),
        F.avg(F.when(k == "audio_buffer", v)).alias("audio_buffer"), total("download").alias("bytes"), F.coalesce(F.sum(F.when(k == "download", F.col(took_ms))), F.lit(0)).cast("long").alias("download_ms"),
        total("video_frame").alias("_video"), total("audio_frame").alias("_audio"), F.expr(f"max({ts_us}) div 1000").alias("report_ms"),
    )
    w = Window.partitionBy(*keys).orderBy("_start").rowsBetween(Window.unboundedPreceding, 0)
    rate = lambda name: (F.col(f"_{name}") / seconds).alias(f"{name.replace('_frame', '')}_fps")
    bits = lambda name: F.floor(F.col(f"_{name}") * 8 / seconds).cast("long").alias(f"{name}_bitrate")
    return rows.select(
        *keys, F.expr("_start div 1000").alias("start_ms"), F.expr(f"(_start + {interval_us}) div 1000").alias("end_ms"), F.coalesce(F.last("_turn", True).over(w), F.lit(False)).alias("buffering"), "buffering_count",
        rate("video_frame"), F.col("_video_drop").alias("video_drops"), rate("audio_frame"), F.col("_audio_drop").alias("audio_drops"), rate("video_render"), rate("audio_render"), "video_buffer", "audio_buffer",
        "bytes", "download_ms", bits("video"), bits("audio"), "report_ms",
    )
