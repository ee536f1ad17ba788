"""Registered queries over the given tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import hashes, maps, timemath, url, windows
from tidemark.operators import abr, intervals, stats, sync, telemetry, timeline
from tidemark.schema import micros
from tidemark.sources import playlist, scripts, sniff, subtitles, transport
from tidemark.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with us (microseconds) and cents (the value in hundredths, a whole number)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", micros(e, "ts").alias("us"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), "props")


E_SQL = "e as (select event_id, epoch_us(ts) as us, user_id, event_type, cast(round(value * 100) as bigint) as cents, props from events)"
TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"""with {E_SQL}, t as (select e.*, case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as input_idx from e where us is not null)
select row_number() over (order by us, input_idx, event_id) as seq, cast(input_idx as integer) as input_idx, event_id, us from t""")
def interleave_events(spark, sf_dir):
    """The streams of the five event types, which lie in one table."""
    e = events(spark, sf_dir).select("event_id", "us", "event_type")
    which = F.coalesce(*[F.when(F.col("event_type") == t, i) for i, t in enumerate(TYPES)])
    return timeline.merge_tagged(e, "us", which, "event_id").select("seq", "input_idx", "event_id", "us")


@query(f"with {E_SQL} select 0 as item, event_id, us from e where event_type = 'click' union all select 1, event_id, us + 2592000000000 from e where event_type = 'view'")
def concat_items(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "us", "event_type")
    return timeline.concatenate([e.filter("event_type = 'click'"), e.filter("event_type = 'view'")], "us", [2592000000000, 0]).select("item", "event_id", "us")


@query(f"with {E_SQL} select user_id, event_id, seq from (select *, row_number() over (partition by user_id order by us, event_id) as seq from e) where (seq - 1) % 5 = 0")
def framestep_events(spark, sf_dir):
    return timeline.step(events(spark, sf_dir), ["us", "event_id"], 5, ["user_id"]).select("user_id", "event_id", "seq")


@query(f"with {E_SQL} select event_id, user_id, us from e where us >= 1705276800000000 and event_type <> 'view'")
def seek_and_disable(spark, sf_dir):
    return timeline.seek(events(spark, sf_dir), "us", 1705276800000000).filter("event_type <> 'view'").select("event_id", "user_id", "us")


@query(f"with {E_SQL} select user_id, arg_min(event_id, (us, event_id)) as event_id, min(us) as us from e where us >= 1705276800000000 group by user_id")
def first_frame_after(spark, sf_dir):
    return timeline.first_at_or_after(events(spark, sf_dir), "us", 1705276800000000, "event_id", ["user_id"]).select("user_id", "event_id", "us")


@query(f"""with {E_SQL}, p as (select *, row_number() over (partition by user_id order by us, event_id) as seq, count(*) over (partition by user_id) as n from e)
select a.user_id, a.seq, a.us, b.event_id, b.cents from p a join p b on a.user_id = b.user_id and b.seq = a.n - a.seq + 1""")
def reverse_events(spark, sf_dir):
    return timeline.reverse(events(spark, sf_dir).select("user_id", "us", "event_id", "cents").withColumn("key_id", F.col("event_id")), ["us", "key_id"], ["event_id", "cents"], ["user_id"]).select("user_id", "seq", "us", "event_id", "cents")


@query(f"""with {E_SQL}, p as (select *, row_number() over (partition by user_id order by us, event_id) as seq from e),
q as (select *, (seq - 1) // 3 as batch, (seq - 1) % 3 as place, count(*) over (partition by user_id, (seq - 1) // 3) as n from p)
select a.user_id, a.seq, a.us, b.event_id from q a join q b on a.user_id = b.user_id and a.batch = b.batch and b.place = case when a.n < 3 then a.place when a.place = 0 then 0 when a.place = 1 then 2 else 1 end""")
def shuffle_events(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "us", "event_id").withColumn("key_id", F.col("event_id"))
    return timeline.permute(e, ["us", "key_id"], ["event_id"], "0 2 1", ["user_id"]).select("user_id", "seq", "us", "event_id")


@query(f"""with {E_SQL}, p as (select *, row_number() over (partition by user_id order by us, event_id) as seq from e), b as (select user_id, (seq - 1) // 8 as batch, count(*) as n_real, list(cents order by seq) as l from p group by 1, 2)
select user_id, batch, n_real, array_to_string(list_concat(l, [0 for x in range(8 - len(l))]), ',') as samples from b""")
def rebatch_events(spark, sf_dir):
    got = timeline.rebatch(events(spark, sf_dir), ["us", "event_id"], "cents", 8, ["user_id"])
    return got.select("user_id", "batch", "n_real", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@query(f"""with {E_SQL}, p as (select user_id, cents, row_number() over (partition by user_id order by us, event_id) as seq from e), n as (select user_id, count(*) as n from p group by 1)
select user_id, seq, cents, false as padded from p union all select user_id, unnest(range(n + 1, 101)) as seq, 0, true from n where n < 100""")
def pad_events(spark, sf_dir):
    return timeline.pad_tail(events(spark, sf_dir), ["us", "event_id"], "cents", ["user_id"], whole_rows=100).select("user_id", "seq", "cents", "padded")


@query(f"with {E_SQL} select user_id, event_id, lag(cents, 3, 0) over (partition by user_id order by us, event_id) as delayed from e")
def delay_line(spark, sf_dir):
    return timeline.delay(events(spark, sf_dir), ["us", "event_id"], "cents", 3, ["user_id"]).select("user_id", "event_id", "delayed")


@query(f"""with {E_SQL}, a as (select *, row_number() over (order by us, event_id) as seq from e where event_type = 'click'), b as (select *, row_number() over (order by us, event_id) as seq from e where event_type = 'view')
select seq, a.event_id, b.event_id as r_event_id from a join b using (seq)""")
def zip_streams(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "us", "event_type")
    return timeline.zip_streams(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["us", "event_id"]).select("seq", "event_id", "r_event_id")


ASOF = """p as (select * from e where event_type = 'purchase'), v as (select * from e where event_type = 'view')"""


@query(f"with {E_SQL}, {ASOF} select p.event_id, p.user_id, p.us, v.event_id as s_event_id, v.us as s_us from p asof left join v on p.user_id = v.user_id and p.us >= v.us")
def asof_sync(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    got = sync.asof(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "us", "event_id", ["event_id"])
    return got.select("event_id", "user_id", "us", "s_event_id", "s_us")


@query(f"""with {E_SQL}, {ASOF}, x as (select user_id, max(us) as end_us from v group by 1)
select p.event_id, p.user_id, v.event_id as s_event_id from p asof join v on p.user_id = v.user_id and p.us >= v.us join x on x.user_id = p.user_id where p.us <= x.end_us""")
def asof_sync_stop(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    return sync.asof(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "us", "event_id", ["event_id"], before="stop", after="stop").select("event_id", "user_id", "s_event_id")


@query(f"""with {E_SQL}, {ASOF}, x as (select user_id, max(us) as end_us from v group by 1)
select p.event_id, p.user_id, case when p.us <= x.end_us then v.event_id end as s_event_id from p asof left join v on p.user_id = v.user_id and p.us >= v.us left join x on x.user_id = p.user_id""")
def asof_sync_null(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    return sync.asof(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "us", "event_id", ["event_id"], after="null").select("event_id", "user_id", "s_event_id")


@query(f"""with {E_SQL}, {ASOF} select p.event_id, case when p.us - v.us <= 3600000000 then v.event_id end as s_event_id from p asof left join v on p.user_id = v.user_id and p.us >= v.us""")
def asof_within(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    return sync.within(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "us", "event_id", ["event_id"], 3600000000).select("event_id", "s_event_id")


@query(f"""with {E_SQL}, {ASOF} select p.event_id, p.user_id, p.us, (select max(v.us) from v where v.user_id = p.user_id and v.us <= p.us) as below_at, (select min(v.us) from v where v.user_id = p.user_id and v.us >= p.us) as above_at from p""")
def tree_neighbours(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    return sync.neighbours(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "us", "event_id").select("event_id", "user_id", "us", "below_at", "above_at")


@query("select n_nationkey, n_name, r_name from nation left join region on n_regionkey = r_regionkey")
def keyed_lookup(spark, sf_dir):
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return sync.lookup(table(spark, sf_dir, "nation"), region, ["n_regionkey"]).select("n_nationkey", "n_name", "r_name")


@query(f"""with {E_SQL}, s as (select user_id, cents - 16000 as v from e)
select user_id, count(*) as n_samples, cast((sum(cast(v as hugeint) * v) + count(*) // 2) // count(*) as bigint) as mean_power, max(abs(v)) as max_volume from s group by 1""")
def histogram_levels(spark, sf_dir):
    return stats.volume(events(spark, sf_dir).withColumn("v0", F.col("cents") - 16000), "v0", ["user_id"]).select("user_id", "n_samples", "mean_power", "max_volume")


@query(f"""with {E_SQL}, s as (select cents - 16000 as v from e), h as (select cast(floor(case when v = 0 then 91.0 else -10 * log10(v * v / 1073741824.0) end) as integer) as db, count(*) as n from s group by 1),
c as (select *, coalesce(sum(n) over (order by db rows between unbounded preceding and 1 preceding), 0) as b, sum(n) over () as t from h) select db, n from c where b = 0 or b < t // 1000""")
def level_bins(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v0", F.col("cents") - 16000).withColumn("one", F.lit(1))
    return stats.level_bins(e, "v0", ["one"]).select("db", "n")


@query(f"""with {E_SQL}, h as (select us // 3600000000 as hour, count(*) as n, sum(case when cents < 1000 then 1 else 0 end) as k from e group by 1)
select hour, n, cast(k * 100 // n as bigint) as percent, cast(case when k * 100 // n >= 50 then k * 100 // n end as bigint) as mark from h""")
def blackframe_annotate(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("hour", F.expr("us div 3600000000"))
    return stats.annotate_share(e, ["hour"], F.col("cents") < 1000, 50).select("hour", "n", "percent", "mark")


@query(f"""with {E_SQL} select user_id, min(case when event_type = 'click' then us end) as x_min, max(case when event_type = 'click' then us end) as x_max, min(case when event_type = 'click' then cents end) as y_min, max(case when event_type = 'click' then cents end) as y_max from e group by 1""")
def bounding_box(spark, sf_dir):
    return stats.bounding_box(events(spark, sf_dir), ["user_id"], "us", "cents", F.col("event_type") == "click")


@query("""with p as (select vec_id, (row_number() over (order by vec_id) - 1) // 100 as batch, embedding from embeddings),
x as (select batch, vec_id, unnest(range(len(embedding))) as k, cast(unnest(embedding) as double) as x from p), m as (select batch, k, avg(x) as mean from x group by 1, 2),
s as (select x.batch, vec_id, round(sum((mean - x) * (mean - x)), 9) as sse from x join m using (batch, k) group by 1, 2)
select batch, arg_min(vec_id, (sse, vec_id)) as vec_id, count(*) as n_rows from s group by 1""")
def thumbnail_embeddings(spark, sf_dir):
    return stats.representative(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", "vec_id", 100, [])


@query("""with b as (select vec_id as entry, embedding as c from embeddings where vec_id % 20 = 0), d as (select v.vec_id, entry, 0.5 * list_dot_product(cast(c as double[]), cast(c as double[])) - list_dot_product(cast(embedding as double[]), cast(c as double[])) as distance from embeddings v, b)
select vec_id, rank, entry from (select vec_id, entry, cast(row_number() over (partition by vec_id order by distance, entry) as integer) as rank from d) where rank <= 3""")
def knn_embeddings(spark, sf_dir):
    """Every vector's three nearest entries of a codebook that grows with the table: its rows whose id 20 divides."""
    v = table(spark, sf_dir, "embeddings")
    return stats.nearest_rows(v, v.filter("vec_id % 20 = 0"), 3, "vec_id", "embedding").select("vec_id", "rank", "entry")


@query("""with d as (select v.vec_id, b.vec_id as entry, 0.5 * list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[])) - list_dot_product(cast(v.embedding as double[]), cast(b.embedding as double[])) as distance from embeddings v, embeddings b where v.vec_id % 20 = 0)
select vec_id, rank, entry from (select vec_id, entry, cast(row_number() over (partition by vec_id order by distance, entry) as integer) as rank from d) where rank <= 3""")
def knn_all_embeddings(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return stats.nearest_rows(v.filter("vec_id % 20 = 0"), v, 3, "vec_id", "embedding").select("vec_id", "rank", "entry")


@query(f"""with {E_SQL}, p as (select user_id, cents, row_number() over (partition by user_id order by us, event_id) as seq from e)
select a.user_id, cast(k as integer) as lag, sum(cast(a.cents as bigint) * b.cents)::bigint as product from (select unnest(range(5)) as k) join p a on true left join p b on a.user_id = b.user_id and b.seq = a.seq - k group by 1, 2""")
def autocorr_events(spark, sf_dir):
    return stats.autocorrelation(events(spark, sf_dir), ["us", "event_id"], "cents", ["user_id"], 4).select("user_id", "lag", "product")


@query(f"""with {E_SQL} select event_id, user_id, min(cents) over w as run_min, max(cents) over w as run_max, cast(sum(cents) over w as bigint) as run_sum, count(*) over w as run_n from e window w as (partition by user_id order by us, event_id rows unbounded preceding)""")
def bench_running(spark, sf_dir):
    return stats.running(events(spark, sf_dir), ["us", "event_id"], "cents", ["user_id"]).select("event_id", "user_id", "run_min", "run_max", "run_sum", "run_n")


@query("select vec_id, cast(floor(list_sum([x * x for x in cast(embedding as double[])]) * 1000000) as bigint) as energy_ppm, cast(case when embedding[1] > 0.1 then 3 when embedding[1] > 0 then 2 when embedding[1] > -0.1 then 1 else 0 end as integer) as level from embeddings")
def vector_kernels(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    return v.select("vec_id", F.floor(stats.dot(F.col("x"), F.col("x")) * 1000000).alias("energy_ppm"), stats.quantise(F.element_at("embedding", 1).cast("double"), [-0.1, 0.0, 0.1]).alias("level"))


@query(f"""with {E_SQL}, g as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by us, event_id rows unbounded preceding) as gop from e)
select user_id, cast(gop as bigint) as gop, count(*) as n_rows, cast(sum(cents) as bigint) as bytes, min(us) as start_ts, max(us) as end_ts from g group by 1, 2""")
def gop_sessions(spark, sf_dir):
    return telemetry.keyed_groups(events(spark, sf_dir), ["us", "event_id"], ["user_id"], F.col("event_type") == "signup", "us", "cents")


@query(f"""with {E_SQL}, w as (select *, min(case when event_type <> 'error' then us end) over (partition by user_id order by us, event_id rows between 1 following and unbounded following) as end_ts from e) select user_id, event_id, us, end_ts from w where event_type = 'error'""")
def lag_intervals(spark, sf_dir):
    return telemetry.paired(events(spark, sf_dir), ["us", "event_id"], ["user_id"], F.col("event_type") == "error", F.col("event_type") != "error", "us", ["event_id"]).select("user_id", "event_id", "us", "end_ts")


@query(f"""with {E_SQL} select event_type, us // 86400000000 * 86400000000 as start_us, count(*) as n_events, cast(sum(cents) as bigint) as bytes, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as buffering_count, cast(sum(case when cents > 20000 then 1 else 0 end) as bigint) as n_fail, max(cents) as max_bytes from e group by 1, 2""")
def sample_windows(spark, sf_dir):
    return telemetry.sample_records(events(spark, sf_dir), "us", 86400000000, ["event_type"], "cents", F.col("event_type") == "error", F.col("cents") > 20000)


KINDS = [*telemetry.FRAMES, "buffer_start", "buffer_end", "video_buffer", "audio_buffer", "download"]


@query(f"""with {E_SQL}, m as (select user_id, us, cents, event_id % 90 as took, {KINDS!r}[event_id % 11 + 1] as kind from e),
g as (select user_id, us // 3600000000 * 3600000000 as s, max(case when kind like 'buffer%' then (us * 2 + cast(kind = 'buffer_start' as integer)) end) as turn, count(*) filter (kind = 'buffer_start') as buffering_count, count(*) filter (kind = 'video_frame') as vf, count(*) filter (kind = 'audio_frame') as af, count(*) filter (kind = 'video_drop') as video_drops, count(*) filter (kind = 'audio_drop') as audio_drops,
count(*) filter (kind = 'video_render') as vr, count(*) filter (kind = 'audio_render') as ar, avg(cents) filter (kind = 'video_buffer') as video_buffer, avg(cents) filter (kind = 'audio_buffer') as audio_buffer, coalesce(sum(cents) filter (kind = 'download'), 0) as bytes, coalesce(sum(took) filter (kind = 'download'), 0) as download_ms,
coalesce(sum(cents) filter (kind = 'video_frame'), 0) as vb, coalesce(sum(cents) filter (kind = 'audio_frame'), 0) as ab, max(us) // 1000 as report_ms from m group by 1, 2)
select user_id, s // 1000 as start_ms, s // 1000 + 3600000 as end_ms, coalesce(last_value(turn ignore nulls) over (partition by user_id order by s rows unbounded preceding) % 2 = 1, false) as buffering, buffering_count, vf / 3600 as video_fps, video_drops, af / 3600 as audio_fps, audio_drops, vr / 3600 as video_render_fps, ar / 3600 as audio_render_fps,
video_buffer, audio_buffer, cast(bytes as bigint) as bytes, cast(download_ms as bigint) as download_ms, cast(vb * 8 // 3600 as bigint) as video_bitrate, cast(ab * 8 // 3600 as bigint) as audio_bitrate, report_ms from g""")
def playback_records(spark, sf_dir):
    """The events as measurements of eleven kinds, a record for each user and hour."""
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.col("event_id") % 11 + 1).cast("int"))
    m = events(spark, sf_dir).select("user_id", "us", "cents", (F.col("event_id") % 90).alias("took"), kind.alias("kind"))
    return telemetry.playback_records(m, "us", 3_600_000_000, ["user_id"], "kind", "cents", "took")


@query(f"""with {E_SQL}, w as (select event_id, cast(sum(cents) over (partition by user_id order by us range between 86399999999 preceding and current row) as bigint) as bytes_in from e) select event_id, bytes_in, bytes_in // 86400 as speed from w""")
def speed_last_n(spark, sf_dir):
    return telemetry.last_seconds(events(spark, sf_dir), "us", "cents", 86400, ["user_id"]).select("event_id", "bytes_in", "speed")


@query(f"""with {E_SQL}, m as (select *, case when us - lag(us) over (partition by user_id order by us, event_id) > 43200000000 then 1 else 0 end as n from e), s as (select *, sum(n) over (partition by user_id order by us, event_id rows unbounded preceding) as session from m)
select user_id, cast(session as bigint) as session, count(*) as n_events, min(us) as start_us, max(us) as end_us from s group by 1, 2""")
def gap_sessions(spark, sf_dir):
    return telemetry.sessions_by_gap(events(spark, sf_dir), "us", "event_id", 43200000000, ["user_id"])


@query(f"""with {E_SQL}, p as (select user_id, event_id, us, row_number() over (partition by user_id order by us, event_id) as seq, case when event_id % 3 = 0 then us end as ts from e),
g as (select *, last_value(case when ts is not null then seq end ignore nulls) over b as aq, last_value(ts ignore nulls) over b as a_ts, first_value(case when ts is not null then seq end ignore nulls) over f as bq, first_value(ts ignore nulls) over f as b_ts from p
window b as (partition by user_id order by seq rows between unbounded preceding and current row), f as (partition by user_id order by seq rows between current row and unbounded following))
select user_id, event_id, case when ts is not null then ts when a_ts is not null and b_ts is not null then a_ts + (b_ts - a_ts) // (bq - aq) * (seq - aq) end as filled_ts from g""")
def ts_interpolate(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.when(F.col("event_id") % 3 == 0, F.col("us")))
    return timeline.interpolate_times(e, ["us", "event_id"], "ts", ["user_id"]).select("user_id", "event_id", "filled_ts")


@query(f"""with {E_SQL}, p as (select *, row_number() over w as seq, lag(us, 5) over w as a, lag(us, 1) over w as b, lag(us, 4) over w as c from e window w as (partition by user_id order by us, event_id))
select user_id, seq, us as ts, cast(case when seq <= 6 then us * 8 else max(case when seq = 6 then us * 8 end) over (partition by user_id) + sum(case when seq > 6 then (a - b) * 3 + (us - c) * 5 else 0 end) over (partition by user_id order by seq rows unbounded preceding) end as bigint) as new_ts from p""")
def dejudder_times(spark, sf_dir):
    return timeline.smooth_jitter(events(spark, sf_dir), ["us", "event_id"], "us", ["user_id"], 4)


@query(f"""with {E_SQL}, r as (select user_id, us as beg, us + cents * 1000000 as end_ from e), m as (select *, case when beg <= max(end_) over (partition by user_id order by beg, end_ rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from r where beg < end_),
i as (select *, sum(n) over (partition by user_id order by beg, end_ rows unbounded preceding) as isl from m), u as (select user_id, isl, min(beg) as beg, max(end_) as end_ from i group by 1, 2)
select user_id, cast(sum(end_ - beg) as bigint) as covered, count(*) as n_ranges from u group by 1""")
def coverage_ranges(spark, sf_dir):
    r = events(spark, sf_dir).select("user_id", F.col("us").alias("beg"), (F.col("us") + F.col("cents") * 1000000).alias("end"))
    return intervals.coverage(r, ["user_id"])


@query("""select page_id, regexp_extract(url, '^(.*?)://', 1) as protocol, split_part(split_part(regexp_replace(url, '^https?://', ''), '/', 1), ':', 1) as host, cast(case when starts_with(url, 'https://') then 443 else 80 end as integer) as port,
regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '^/', '') as path, coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), '') as fragment, coalesce(nullif(regexp_extract(url, '[?]([^#]*)', 1), ''), '') as query from pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    s = url.split_url(u)
    return table(spark, sf_dir, "pages").select("page_id", url.protocol(u).alias("protocol"), url.host(u).alias("host"), url.port(u).alias("port"), url.path(u).alias("path"), s["fragment"].alias("fragment"), s["query"].alias("query"))


@query("""with h as (select page_id, split_part(url, '?', 1) as h from pages) select page_id, upper(substr(list_extract(string_split(h, '.'), -1), 1, 16)) as ext from h""")
def url_ext(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.extension(F.col("url")).alias("ext"))


@query("select page_id, url_encode(url) as escaped, url as back from pages")
def url_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.escape("url").alias("escaped"), url.unescape(url.escape("url")).alias("back"))


@query("""with x as (select page_id, url, split_part(url, '?', 1) as b from pages) select page_id, 'HTTP' as protocol, case when list_extract(string_split(b, '.'), -1) in ('mp4', 'm4v') then 'MP4' else 'NONE' end as format, 'NONE' as content_format from x""")
def source_format(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", sniff.protocol(F.col("url")).alias("protocol"), sniff.format_by_address(F.col("url")).alias("format"), sniff.format_by_content(F.col("html")).alias("content_format"))


@query("select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256 from documents")
def hash_docs(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[hashes.hash_by_name(n, t).alias(n) for n in ("md5", "sha1", "sha256")])


#: CRC-32 by its shift register, eight steps for each byte.
CRC_STEPS = "list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(d, lambda x: [cast(x as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)"


@query(f"""with d as (select item_id, hex(encode(text)) as h from benchmark), b as (select item_id, [cast(('0x' || h[2 * i + 1:2 * i + 2]) as integer) for i in range(cast(len(h) // 2 as bigint))] as d from d)
select item_id, lower(printf('%08x', cast(xor({CRC_STEPS}, 4294967295) as bigint))) as crc32, list_reduce(list_prepend(cast(5381 as bigint), [cast(x as bigint) for x in d]), lambda a, x: (a * 33 + x) % 4294967296) as djb2 from b""")
def benchmark_sums(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", hashes.hash_by_name("crc32", t).alias("crc32"), hashes.djb2_hash(t).alias("djb2"))


@query("""with u as (select conv_id, turn, text from conversations where role = 'user'), a as (select conv_id, turn, text from conversations where role = 'assistant')
select u.conv_id, u.turn, (select min(a.turn) from a where a.conv_id = u.conv_id and a.turn > u.turn) as answer_turn from u""")
def answered_turns(spark, sf_dir):
    """Each turn of a user with the next answer of its conversation, if one comes."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    got = telemetry.paired(c, ["turn"], ["conv_id"], F.col("role") == "user", F.col("role") == "assistant", "turn", ["conv_id"])
    return got.select("conv_id", "turn", F.col("end_ts").alias("answer_turn"))


@query()
def checksum_docs(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[hashes.hash_by_name(n, t).alias(n) for n in ("crc32", "adler32", "murmur3", "sha512")], hashes.djb2_hash(t).alias("djb2"))


@query(f"""with {E_SQL} select event_id, cast(case when us % 33333 >= 16667 then us // 33333 + 1 else us // 33333 end as bigint) as frames, cast(us * 9 // 100 as bigint) as ticks_down, cast((us * 9 + 99) // 100 as bigint) as ticks_up from e""")
def rescale_pts(spark, sf_dir):
    us = F.col("us")
    return events(spark, sf_dir).select("event_id", timemath.rescale(us, 1, 33333).alias("frames"), timemath.rescale(us, 9, 100, "down").alias("ticks_down"), timemath.rescale(us, 9, 100, "up").alias("ticks_up"))


@query(f"""with {E_SQL}, c as (select event_id, user_id, us, us * 9 // 100 % 8589934592 as pts from e), d as (select *, (pts - lag(pts) over w + 8589934592) % 8589934592 as d from c window w as (partition by user_id order by us, event_id))
select event_id, pts, cast(sum(case when d is null then pts when d >= 4294967296 then d - 8589934592 else d end) over (partition by user_id order by us, event_id rows unbounded preceding) as bigint) as unwrapped from d""")
def unwrap_pts(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("pts", F.expr("us * 9 div 100 % 8589934592"))
    return timemath.unwrap(e, "pts", ["us", "event_id"], ["user_id"]).select("event_id", "pts", "unwrapped")


@query(f"with {E_SQL} select event_id, concat_ws(chr(9), 'event_id=' || event_id, 'user_id=' || user_id, 'event_type=' || event_type, 'cents=' || cents) as record from e")
def telemetry_tsv(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", telemetry.text_record(["event_id", "user_id", "event_type", "cents"]).alias("record"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.none') as nothing from events")
def json_props(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", maps.json_get(p, "$.k").cast("long").alias("k"), maps.json_get(p, "$.none").alias("nothing"))


@query("select page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), null) as page from pages")
def map_lookup(spark, sf_dir):
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", maps.lookup(maps.parse(q), "PAGE").alias("page"))


@query(f"""with recursive {E_SQL}, log as (select user_id, row_number() over (partition by user_id order by us, event_id) as n, cents * 1000 as measured, cents % 4000 as transfer, event_id * 37 % 30000 as buffer from e),
k as (select cast([400000, 1200000, 2500000, 5000000] as bigint[]) as rates),
s(user_id, n, spot, changes, last, changed) as (select distinct user_id, cast(0 as bigint), 1, 0, cast(0 as bigint), false from log
  union all select user_id, n, case when go then want else spot end, case when go then changes + 1 else changes end, case when go then n * 4000 else last end, go from (
    select *, measured > 0 and want <> spot and case when rates[want] > rates[spot] then n * 4000 >= last + 20000 and transfer * (rates[want] // rates[spot]) * 11 // 10 <= buffer
      when rates[want] < rates[spot] then not (buffer > 18000 and rates[spot] * 8000 < measured) else true end as go
    from (select s.user_id, log.n, s.spot, s.changes, s.last, log.measured, log.transfer, log.buffer, k.rates,
      greatest(1, len(list_filter(k.rates, lambda b: b * 13 <= log.measured * 10 and b < case when s.changes = 0 then 3000000 else 10000000 end))) as want
      from s join log on log.user_id = s.user_id and log.n = s.n + 1, k)))
select user_id, n, cast(spot - 1 as integer) as stream_id, cast(rates[spot] as bigint) as bitrate, changed from s, k where n > 0""")
def abr_replay(spark, sf_dir):
    e = events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    log = e.select("user_id", n.alias("n"), (F.col("cents") * 1000).alias("measured"), (F.col("cents") % 4000).alias("transfer_ms"), (n * 4000).alias("start_ms"), (F.col("event_id") * 37 % 30000).alias("buffer_ms"))
    return abr.replay(log, [(0, 400_000), (1, 1_200_000), (2, 2_500_000), (3, 5_000_000)], ["user_id"])


def _playlists(spark, sf_dir):
    """A playlist for each user, made of their events in order."""
    line = F.concat(F.lit("#EXTINF:"), F.format_string("%d.%03d", F.expr("cents div 1000").cast("int"), (F.col("cents") % 1000).cast("int")), F.lit(",\n/seg/"), F.col("event_id").cast("string"), F.lit(".ts"))
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", line.alias("l")))), lambda x: x["l"]), "\r\n").alias("body"))
    return rows.select("user_id", F.concat(F.lit("#EXTM3U\r\n#EXT-X-MEDIA-SEQUENCE:7\r\n\r\n"), "body", F.lit("\n#EXT-X-ENDLIST\n")).alias("text"))


@query(f"""with {E_SQL} select cast(user_id as bigint) as playlist_id, 6 + row_number() over w as seq, 'http://a.example/seg/' || event_id || '.ts' as url, cents as duration_ms, cast(coalesce(sum(cents) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start_ms, false as discontinuity, true as ended from e window w as (partition by user_id order by us, event_id)""")
def m3u8_segments(spark, sf_dir):
    return playlist.segments(playlist.lines(_playlists(spark, sf_dir), "user_id", "text"), F.lit("http://a.example/live/x.m3u8"))


@query(f"""with {E_SQL} select event_id, true as ok, event_id % 8192 as pid, event_id % 16 as continuity, event_type = 'signup' as unit_start, 4 as data_offset, 184 as data_size from e""")
def ts_packets(spark, sf_dir):
    e = events(spark, sf_dir)
    flags = F.when(F.col("event_type") == "signup", 0x4000).otherwise(0) + F.col("event_id") % 8192
    hexed = F.concat(F.lit("47"), F.lpad(F.hex(flags), 4, "0"), F.lpad(F.hex(16 + F.col("event_id") % 16), 2, "0"), F.repeat(F.lit("AA"), 184))
    h = transport.packet_header(F.col("raw"))
    rows = transport.packets(e.select("event_id", F.unhex(hexed).alias("content")), "content", ["event_id"]).select("event_id", h.alias("h"))
    return rows.select("event_id", F.col("h.ok").alias("ok"), F.col("h.pid").cast("long").alias("pid"), F.col("h.continuity").cast("long").alias("continuity"), F.col("h.unit_start").alias("unit_start"), F.col("h.data_offset").alias("data_offset"), F.col("h.data_size").alias("data_size"))


@query(f"with {E_SQL} select user_id, cents // 100 % 8 as channel, count(*) as n from e group by 1, 2")
def channel_split(spark, sf_dir):
    e = events(spark, sf_dir)
    arrays = e.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.expr("cents div 100 % 8") == i, F.lit(1))).alias("planes"))
    return timeline.explode_channels(arrays, "planes").filter("sample = 1").groupBy("user_id", F.col("channel").cast("long").alias("channel")).agg(F.count("*").alias("n"))


@query(f"with {E_SQL} select event_type, sum(cents)::bigint as bytes, sum(cents % 97)::bigint as download_ms, case when sum(cents % 97) > 0 then (sum(cents) * 1000 // sum(cents % 97))::bigint end as bytes_per_s from e group by 1")
def download_speed(spark, sf_dir):
    return telemetry.download_speed(events(spark, sf_dir).withColumn("ms", F.col("cents") % 97), ["event_type"], "cents", "ms")


@query(f"with {E_SQL} select event_id, cast(round(cents * (0.5 - 0.5 * cos(2 * pi() * (event_id % 64) / 63))) as bigint) as hann_cents from e")
def window_coefficients(spark, sf_dir):
    """The events' values in frames of 64 ids under a window."""
    return events(spark, sf_dir).select("event_id", F.round(F.col("cents") * windows.coefficient("hann", F.col("event_id") % 64, 64)).cast("long").alias("hann_cents"))


@query(f"with {E_SQL} select event_type, us // 86400000000 * 86400000000 as start_us, count(*) as n_events, cast(sum(cents) as bigint) as bytes from e group by 1, 2")
def stream_sample_windows(spark, sf_dir):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    e = spark.readStream.schema(schema.replace("ts timestamp", "ts timestamp_ntz")).parquet(f"{sf_dir}/events.parquet*")
    e = e.withColumn("us", micros(e, "ts")).select("event_type", F.timestamp_micros("us").alias("t"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    day = e.groupBy("event_type", F.expr("unix_micros(t) div 86400000000 * 86400000000").alias("start_us")).agg(F.count("*").alias("n_events"), F.sum("cents").alias("bytes"))
    return streams.run_to_end(day, "complete")


#: Commands of the scripts that users' events become; one is none.
WORDS = ["open", "seek", "play", "pause", "pasue"]


@query(f"""with {E_SQL}, p as (select *, row_number() over (partition by user_id order by us, event_id) as i from e)
select cast(user_id as varchar) || '.tst' as file, cast(2 * i as bigint) as line_no, 'day' || (us // 86400000000) as section, case when event_id % 3 = 0 then 'URL' else 'ACTION' end as key,
case when event_id % 3 = 0 then 'http://a.example/v.mp4?t=' || cents else list_extract(['open', 'seek', 'play', 'pause', 'pasue'], cast(event_id % 5 + 1 as integer)) || ':' || cents || ':a:b' end as value,
case when event_id % 3 <> 0 then list_extract(['open', 'seek', 'play', 'pause', 'pasue'], cast(event_id % 5 + 1 as integer)) end as cmd, case when event_id % 3 <> 0 then cents end as at_ms, case when event_id % 3 <> 0 then 'a:b' end as args, case when event_id % 3 <> 0 then event_id % 5 < 4 end as known from p""")
def script_actions(spark, sf_dir):
    """A script for each user: a section for each event's day, and below it an address or an action."""
    e = events(spark, sf_dir)
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")).cast("long")
    cmd = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("event_id") % 5 + 1).cast("int"))
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" URL = http://a.example/v.mp4?t="), F.col("cents"))).otherwise(F.concat(F.lit("ACTION="), cmd, F.lit(":"), F.col("cents"), F.lit(":a:b")))
    rows = e.select(F.concat(F.col("user_id").cast("string"), F.lit(".tst")).alias("file"), i.alias("i"), F.concat(F.lit("[day"), F.expr("us div 86400000000"), F.lit("]")).alias("head"), line.alias("line"))
    return scripts.parse(rows.select("file", (F.col("i") * 2 - 1).alias("i"), F.posexplode(F.array("head", "line")).alias("k", "text")).select("file", (F.col("i") + F.col("k")).cast("long").alias("line_no"), "text"))


@query(f"""with {E_SQL}, p as (select *, row_number() over (partition by user_id order by us, event_id) as i from e)
select cast(user_id as bigint) as file_id, cast(i - 1 as integer) as n, i * 4000 + cents % 1000 as start_ms, i * 4000 + 2500 as end_ms, event_type || chr(10) || 'no. ' || event_id as text from p""")
def subtitle_cues(spark, sf_dir):
    """A subtitle file for each user, a cue for each event."""
    clock = lambda ms: F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("int"), (F.floor(ms / 60_000) % 60).cast("int"), (F.floor(ms / 1000) % 60).cast("int"), (ms % 1000).cast("int"))
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")).cast("long")
    cue = F.concat(F.col("i").cast("string"), F.lit("\r\n"), clock(F.col("i") * 4000 + F.col("cents") % 1000), F.lit(" --> "), clock(F.col("i") * 4000 + 2500), F.lit("\r\n"), "event_type", F.lit("\r\nno. "), F.col("event_id").cast("string"), F.lit("\r\n"))
    rows = events(spark, sf_dir).withColumn("i", i).select("user_id", "i", cue.alias("cue"))
    files = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "cue"))), lambda x: x["cue"]), "\r\n").alias("text"))
    return subtitles.blocks(files, "user_id", "text").withColumn("file_id", F.col("file_id").cast("long"))


@query(f"""with {E_SQL}, {ASOF}, f as (select user_id, arg_min(event_id, us) as first_id from v group by 1)
select p.event_id, coalesce(v.event_id, f.first_id) as s_event_id from p asof left join v on p.user_id = v.user_id and p.us >= v.us left join f on f.user_id = p.user_id""")
def asof_sync_infinity(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    return sync.asof(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "us", "event_id", ["event_id"], before="infinity").select("event_id", "s_event_id")


@query(f"with {E_SQL}, p as (select *, row_number() over (partition by user_id order by us, event_id) as seq from e) select user_id, (seq - 1) // 4 as batch, count(*) as n_real, array_to_string(list(event_id order by seq), ',') as tile from p group by 1, 2")
def tile_events(spark, sf_dir):
    got = timeline.tile(events(spark, sf_dir), ["us", "event_id"], "event_id", 4, ["user_id"])
    return got.select("user_id", "batch", "n_real", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("tile"))


@query(f"with {E_SQL} select user_id, event_id from (select *, row_number() over (partition by user_id order by us, event_id) as seq from e) where (seq - 1) % 2 = 1")
def field_events(spark, sf_dir):
    return timeline.pick_field(events(spark, sf_dir), ["us", "event_id"], 1, ["user_id"]).select("user_id", "event_id")


@query("select vec_id, cast(field as integer) as field, array_to_string([cast(floor(x * 1000) as bigint) for x, i in cast(embedding as double[]) if (i - 1) % 2 = field], ',') as part from embeddings, (select unnest([0, 1]) as field)")
def separate_fields(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return timeline.separate_fields(v, "embedding").select("vec_id", "field", F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("string")), ",").alias("part"))


@query(f"""with {E_SQL}, r as (select user_id, us as beg, us + cents * 1000000 as end_ from e), m as (select *, case when beg <= max(end_) over (partition by user_id order by beg, end_ rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from r where beg < end_),
i as (select *, sum(n) over (partition by user_id order by beg, end_ rows unbounded preceding) as isl from m), u as (select user_id, isl, min(beg) as beg, max(end_) as end_ from i group by 1, 2), g as (select user_id, end_ as beg, lead(beg) over (partition by user_id order by beg) as nxt from u)
select user_id, beg, nxt as "end" from g where nxt is not null""")
def range_gaps(spark, sf_dir):
    r = events(spark, sf_dir).select("user_id", F.col("us").alias("beg"), (F.col("us") + F.col("cents") * 1000000).alias("end"))
    return intervals.gaps(r, ["user_id"])


@query(f"""with {E_SQL}, r as (select user_id, us as beg, us + cents * 100000000 as end_ from e where event_type <> 'click'), q as (select event_id, user_id, us as beg, us + 60000000 as end_ from e where event_type = 'click'),
m as (select *, case when beg <= max(end_) over (partition by user_id order by beg, end_ rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from r where beg < end_), i as (select *, sum(n) over (partition by user_id order by beg, end_ rows unbounded preceding) as isl from m),
u as (select user_id, min(beg) as beg, max(end_) as end_ from i group by user_id, isl)
select q.user_id, q.beg, q.end_ as "end", exists (select 1 from u where u.user_id = q.user_id and u.beg <= q.beg and q.end_ <= u.end_) as had from q""")
def had_download(spark, sf_dir):
    e = events(spark, sf_dir)
    have = e.filter("event_type != 'click'").select("user_id", F.col("us").alias("beg"), (F.col("us") + F.col("cents") * 100000000).alias("end"))
    asked = e.filter("event_type = 'click'").select("user_id", F.col("us").alias("beg"), (F.col("us") + 60000000).alias("end"))
    return intervals.has(have, asked, ["user_id"])


@query("""with p as (select vec_id, cast(embedding as double[]) as x from embeddings)
select a.vec_id, cast(round(list_sum([power(a.x[i] - b.x[i], 2) for i in range(1, 65)]) * 1000000) as bigint) as ssd_ppm, cast(round(list_sum([abs(a.x[i] - b.x[i]) for i in range(1, 65)]) * 1000) as bigint) as sad_k from p a join p b on b.vec_id = a.vec_id - 1""")
def vector_errors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    both = v.join(v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return both.select("vec_id", F.round(stats.squared_error(F.col("x"), F.col("y")) * 1000000).cast("long").alias("ssd_ppm"), F.round(stats.absolute_error(F.col("x"), F.col("y")) * 1000).cast("long").alias("sad_k"))


@query(f"""with {E_SQL}, p as (select cast(user_id as double) as a, cast(event_id % 97 as double) as b, cast(cents as double) as y from e), m as (select sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as byy from p)
select 'user_id' as term, cast(round((ay * bb - byy * ab) / (aa * bb - ab * ab) * 1000) as bigint) as coefficient_k from m union all select 'rest', cast(round((byy * aa - ay * ab) / (aa * bb - ab * ab) * 1000) as bigint) from m""")
def least_squares_fit(spark, sf_dir):
    fit = stats.least_squares(events(spark, sf_dir).withColumn("rest", F.col("event_id") % 97), "cents", ["user_id", "rest"])
    return spark.createDataFrame([(t, round(c * 1000)) for t, c in zip(["user_id", "rest"], fit, strict=True)], "term string, coefficient_k long")


@query("""with x as (select vec_id, i, cast(embedding[i] as double) as v from embeddings, lateral (select unnest(range(1, 65)) as i)), m as (select i, avg(v) as mean from x group by i),
c as (select a.i, b.i as j, avg(a.v * b.v) - any_value(ma.mean) * any_value(mb.mean) as c from x a join x b on a.vec_id = b.vec_id join m ma on ma.i = a.i join m mb on mb.i = b.i group by 1, 2)
select cast(64 as integer) as axes, cast(round(sum(case when i = j then c end) * 1000000) as bigint) as variance_ppm, cast(round(sum(c * c) * 1000000) as bigint) as squares_ppm, true as falling, true as at_right_angles from c""")
def principal_variance(spark, sf_dir):
    """The principal axes of all 64 dimensions: their variances add up to the trace, their squares to those of the covariances,
    largest first, and the axes stand at right angles."""
    v = table(spark, sf_dir, "embeddings").select(*[F.element_at("embedding", i).cast("double").alias(f"x{i}") for i in range(1, 65)])
    found = stats.principal_components(v, v.columns)
    values, axes = [x for x, _ in found], [a for _, a in found]
    falling = all(a >= b for a, b in zip(values[:-1], values[1:]))
    right = all(abs(sum(x * y for x, y in zip(axes[i], axes[j])) - (i == j)) < 1e-9 for i in range(64) for j in range(64))
    return spark.createDataFrame([(len(values), round(sum(values) * 1_000_000), round(sum(x * x for x in values) * 1_000_000), falling, right)], "axes int, variance_ppm long, squares_ppm long, falling boolean, at_right_angles boolean")


@query(f"""with recursive {E_SQL}, c as (select event_type, count(*) as n from e group by 1),
h(heap, next, hits) as (select list({{'n': n, 'k': k, 'of': [event_type]}} order by n, k), 5, cast([] as varchar[]) from (select *, row_number() over (order by event_type) - 1 as k from c)
  union all select list_sort(list_append(heap[3:], {{'n': heap[1].n + heap[2].n, 'k': next, 'of': list_concat(heap[1].of, heap[2].of)}})), next + 1, list_concat(hits, heap[1].of, heap[2].of) from h where len(heap) > 1)
select t as event_type, cast(count(*) as integer) as bits from (select unnest(hits) as t from h where len(heap) = 1) group by 1""")
def prefix_codes(spark, sf_dir):
    counts = {r["event_type"]: r["n"] for r in events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")).collect()}  # the alphabet: five types
    return spark.createDataFrame(sorted(stats.code_lengths(counts).items()), "event_type string, bits int")


@query(f"""with recursive {E_SQL}, p as (select user_id, cents, row_number() over (partition by user_id order by us, event_id) as seq from e),
l as (select a.user_id, k, sum(cast(a.cents * b.cents as double)) as r from (select unnest(range(5)) as k) join p a on true join p b on a.user_id = b.user_id and b.seq = a.seq - k group by 1, 2),
q as (select user_id, list(r order by k) as r from l group by 1),
s(user_id, r, i, a, err) as (select user_id, r, 1, cast([] as double[]), r[1] from q where len(r) = 5
  union all select user_id, r, i + 1, list_append([a[j] - f * a[i - j] for j in range(1, i)], f), err * (1 - f * f) from (select *, case when err = 0 then 0 else (r[i + 1] - coalesce(list_sum([a[j] * r[i - j + 1] for j in range(1, i)]), 0)) / err end as f from s where i <= 4))
select user_id, cast(round(a[1] * 1000) as bigint) as a1, cast(round(a[2] * 1000) as bigint) as a2, cast(round(a[3] * 1000) as bigint) as a3, cast(round(a[4] * 1000) as bigint) as a4 from s where i = 5""")
def linear_prediction(spark, sf_dir):
    lags = stats.autocorrelation(events(spark, sf_dir), ["us", "event_id"], "cents", ["user_id"], 4)
    rows = lags.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", F.col("product").cast("double").alias("p")))), lambda x: x["p"]).alias("r"))
    a = stats.linear_prediction(F.col("r"), 4)
    return rows.filter(F.size(F.filter("r", lambda x: x.isNotNull())) == 5).select("user_id", *[F.round(F.element_at(a, i) * 1000).cast("long").alias(f"a{i}") for i in (1, 2, 3, 4)])


@query(f"with {E_SQL} select event_id, cast(least(32767, greatest(-32767, trunc((cents - 16000) * 2.5))) as integer) as scaled from e")
def scale_volume(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", stats.scale_volume(F.col("cents") - 16000, 250).alias("scaled"))


@query(f"""with {E_SQL}, p as (select *, row_number() over (partition by user_id order by us, event_id) as seq from e),
q as (select *, (seq - 1) // 30 as batch, (seq - 1) % 30 + 1 as place, row_number() over (partition by user_id, (seq - 1) // 30 order by md5('7|' || user_id || '|' || seq), seq) as drawn from p)
select a.user_id, a.seq, a.us, b.event_id from q a join q b on a.user_id = b.user_id and a.batch = b.batch and b.drawn = a.place""")
def random_emit(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "us", "event_id").withColumn("key_id", F.col("event_id"))
    return timeline.random_in_batches(e, ["us", "key_id"], ["event_id"], 30, 7, ["user_id"]).select("user_id", "seq", "us", "event_id")


@query(f"""with {E_SQL}, p as (select *, row_number() over w - 1 as n, lead(us) over w is null as last from e window w as (partition by user_id order by us, event_id))
select user_id, n, us as ts, cast(case when last then 7 else 7 + event_id % 64 end as integer) as size, last from p""")
def adts_frames(spark, sf_dir):
    """A frame for each event; a chunk ends with a frame's header and begins with the rest of the one before it."""
    e = events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    size = 7 + F.col("event_id") % 64
    head = F.concat(F.lit("FFF150"), F.lpad(F.hex(size.cast("long") * 32 + 0x1F + F.lit(0x80 << 16)), 6, "0"), F.lit("FC"))
    rest = F.repeat(F.lit("00"), (F.lag("event_id", 1, 0).over(w) % 64).cast("int"))
    rows = e.select("user_id", F.row_number().over(w).alias("i"), "us", F.unhex(F.concat(F.when(F.row_number().over(w) > 1, rest).otherwise(F.lit("")), head)).alias("data"))
    return transport.split_frames(rows, ["user_id"], "i", "us", "data").select("user_id", "n", "ts", F.octet_length("frame").alias("size"), "last")


PTS_SQL = "us * 9 // 100 % 8589934592"


def _clock_hex(pts, mark):
    """A 33-bit clock as five bytes in hex."""
    part = lambda by, of: F.pmod(F.floor(pts / by), F.lit(of))
    numbers = [F.lit(mark) + part(1 << 30, 8) * 2 + 1, part(1 << 22, 256), part(1 << 15, 128) * 2 + 1, part(1 << 7, 256), part(1, 128) * 2 + 1]
    return F.concat(*[F.lpad(F.hex(x.cast("long")), 2, "0") for x in numbers])


@query(f"""with {E_SQL} select event_id, event_id % 7 <> 0 as ok, cast(case when event_id % 7 <> 0 then 224 end as integer) as stream_id, cast(case when event_id % 7 <> 0 then 20 end as integer) as packet_length, cast(case when event_id % 7 <> 0 then {PTS_SQL} end as bigint) as pts,
cast(case when event_id % 7 <> 0 and event_id % 2 = 0 then {PTS_SQL} // 2 end as bigint) as dts, cast(case when event_id % 7 <> 0 then case when event_id % 2 = 0 then 10 else 5 end end as integer) as header_length,
cast(case when event_id % 7 <> 0 then case when event_id % 2 = 0 then 19 else 14 end end as integer) as data_offset, cast(case when event_id % 7 <> 0 then case when event_id % 2 = 0 then 7 else 12 end end as integer) as payload_size from e""")
def pes_headers(spark, sf_dir):
    pts = F.expr("us * 9 div 100 % 8589934592")
    two = F.col("event_id") % 2 == 0
    body = F.concat(F.when(F.col("event_id") % 7 == 0, F.lit("000000")).otherwise(F.lit("000001")), F.lit("E0001480"), F.when(two, F.lit("C00A")).otherwise(F.lit("8005")), _clock_hex(pts, 0x20), F.when(two, _clock_hex(F.floor(pts / 2), 0x10)).otherwise(F.lit("")), F.repeat(F.lit("AB"), 12))
    return transport.pes_headers(events(spark, sf_dir).select("event_id", F.unhex(body).alias("data")), "data", ["event_id"])


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id) as seq from events) where (seq - 1) % 5 = 0")
def stream_every_nth(spark, sf_dir):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_id", "event_type")
    return streams.run_to_end(streams.step(e, "user_id", "event_id", 5))


from tidemark import bitstream_queries as _bitstreams  # noqa: E402, F401  registers its queries here, as does the next
from tidemark import format_queries as _more  # noqa: E402, F401
from tidemark import scan_queries as _scans  # noqa: E402, F401
from tidemark import stream_queries as _streams  # noqa: E402, F401
