"""Registered queries of written media files, listed and pushed sources, and state with timers; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.format_queries import _hex, _ordered
from tidemark.operators import timeline
from tidemark.queries import E_SQL, SQL, events, query
from tidemark.sources import bitstreams, hls, listed, media_sinks, readers
from tidemark.storage import fresh_path, materialize_at
from tidemark.streaming import pushed, stateful
from tidemark.streaming import queries as streams

FAR = "2200-01-01"


def _written(rows, order, name, spark, tag):
    """Writes the rows as files of a format into a new folder and returns its path."""
    path = fresh_path(spark, tag)
    media_sinks.save(rows, order, name, path)
    return path


def _user_of(file):
    return F.regexp_extract(file, r"u(-?\d+)[^/]*$", 1).cast("long")


@query(f"""with {E_SQL} select user_id, row_number() over (partition by user_id order by us, event_id) - 1 as n, cast(case when event_id % 2 = 0 then 9 else 8 end as integer) as type, cast(us // 1000 % 4294967296 as bigint) as ts_ms, props as data, true as whole from e""")
def flv_written(spark, sf_dir):
    """A flash file for each user, written and read back."""
    e = events(spark, sf_dir)
    rows = e.select(F.concat(F.lit("u"), "user_id", F.lit(".flv")).alias("file"), "us", "event_id", F.when(F.col("event_id") % 2 == 0, 9).otherwise(8).alias("type"), F.expr("us div 1000").alias("ts_ms"), F.col("props").cast("binary").alias("data"))
    path = _written(rows, ["us", "event_id"], "flv", spark, "flash")
    return readers.open_source(spark, path, "FLV").select(_user_of("file").alias("user_id"), "n", "type", "ts_ms", F.decode("data", "UTF-8").alias("data"), "whole")


@query(f"""with {E_SQL} select user_id, row_number() over (partition by user_id order by us, event_id) - 1 as n, cast(7 + len(props) as integer) as size, cast(event_id % 13 as integer) as rate_index, cast(1 + event_id % 7 as integer) as channels, props as payload from e""")
def adts_written(spark, sf_dir):
    """An audio file for each user, written from packets and their configuration, and parsed back."""
    n = F.col("event_id")
    config = F.unhex(_hex(F.lit(2 * 2048) + (n % 13) * 128 + (1 + n % 7) * 8, 4))
    rows = events(spark, sf_dir).select(F.concat(F.lit("u"), "user_id", F.lit(".aac")).alias("file"), "us", "event_id", config.alias("config"), F.col("props").cast("binary").alias("payload"))
    path = _written(rows, ["us", "event_id"], "adts", spark, "audio")
    chunks = listed.blocks(spark.read.format("binaryFile").load(path).select("path"), ["path"], "path", block=100)
    got = bitstreams.audio_frames(chunks.withColumn("user_id", _user_of("path")), ["user_id"], "at", "at", "data", "ADTS")
    return got.select("user_id", "n", "size", F.col("rate").alias("rate_index"), "channels", F.decode(F.expr("substring(frame, 8, size)"), "UTF-8").alias("payload"))


@query(f"""with {E_SQL}, f as (select user_id, event_type, string_agg(props, '' order by us, event_id) as content from e group by 1, 2) select cast(row_number() over (order by user_id, event_type) - 1 as integer) as item, user_id, event_type, content from f""")
def concatenated_files(spark, sf_dir):
    """Files of the same names in a folder for each event type, and a list that names them all."""
    e = events(spark, sf_dir)
    name = F.concat("event_type", F.lit("/u"), "user_id", F.lit(".bin"))
    parts = e.select(name.alias("file"), "us", "event_id", F.col("props").cast("binary").alias("data"))
    names = e.select("user_id", "event_type").distinct().select(F.lit("all.ffconcat").alias("file"), F.col("user_id").alias("us"), F.dense_rank().over(_one_by("user_id", "event_type")).cast("long").alias("event_id"), F.concat(F.lit("file '"), name, F.lit("'\n")).cast("binary").alias("data"))
    path = _written(parts.unionByName(names), ["us", "event_id"], "raw_files", spark, "parts")
    got = readers.open_source(spark, f"{path}/all.ffconcat")
    return got.select("item", _user_of("file").alias("user_id"), F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("event_type"), F.decode("content", "UTF-8").alias("content"))


def _one_by(key, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


@query(f"with {E_SQL} select row_number() over (order by event_id) - 1 as n, event_id, cents from e")
def pushed_packets(spark, sf_dir):
    """Packets of 32 bytes pushed in chunks of 1,000: the first run ends at the hole after the first chunk, a second run from the
    same checkpoint reads the rest."""
    pushed.register(spark)
    media_sinks.register(spark)
    path, out, checkpoint = (fresh_path(spark, t) for t in ("pushed", "stream", "stream-checkpoint"))
    e = events(spark, sf_dir).select("event_id", "cents")
    placed = timeline.positions(e, ["event_id"], parts=int(spark.conf.get("spark.sql.shuffle.partitions"))).select(((F.col("seq") - 1) * 32).alias("at"), F.concat(F.lpad(F.col("event_id").cast("string"), 16, "0"), F.lpad(F.col("cents").cast("string"), 16, "0")).alias("text"))
    cut = placed.select("at", "text", F.explode(F.sequence(F.expr("at div 1000"), F.expr("(at + 31) div 1000"))).alias("chunk"))
    first, last = F.greatest(F.col("at"), F.col("chunk") * 1000), F.least(F.col("at") + 32, (F.col("chunk") + 1) * 1000)
    cut = cut.select("chunk", F.struct("at", F.substring("text", (first - F.col("at") + 1).cast("int"), (last - first).cast("int")).alias("p")).alias("r"))
    data = cut.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["p"]), "").cast("binary").alias("data")).select((F.col("chunk") * 1000).alias("start"), "chunk", "data")
    for part in ("chunk % 2 = 0", "chunk % 2 = 1"):
        pushed.push(data.filter(part), path, "start", "data")
        stream = spark.readStream.format("pushed").option("unit", 32).option("unitsPerPartition", 1000).load(path)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("n long, raw binary").parquet(out).withColumn("t", F.decode("raw", "UTF-8"))
    return got.select("n", F.substring("t", 1, 16).cast("long").alias("event_id"), F.substring("t", 17, 16).cast("long").alias("cents"))


def _live(rows, key, ts):
    """The rows as a stream that a far row of no user ends, so that the watermark passes all of them."""
    spark = rows.sparkSession
    end = rows.limit(1).select(*[F.lit(-1).cast("long").alias(c) if c == key else F.lit(FAR).cast("timestamp").alias(c) if c == ts else F.col(c) for c in rows.columns])
    path = fresh_path(spark, "live")
    materialize_at(rows.unionByName(end), path)
    return streams.read(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), 1_000_000)


@query(SQL["spliced_streams"])
def switched_stream(spark, sf_dir):
    """spliced_streams over a stream, with state and timers."""
    e = events(spark, sf_dir).filter("event_type in ('click', 'view')").select("user_id", F.timestamp_micros("us").alias("at"), "event_id", F.when(F.col("event_type") == "view", 1).otherwise(0).cast("long").alias("quality"), (F.col("cents") % 3 == 0).alias("is_key"))
    got = streams.run_to_end(stateful.switch(_live(e, "user_id", "at"), "user_id", "at", "event_id", "quality", "is_key", 1705276800000000, "1 hour"))
    return got.filter("user_id >= 0").select("user_id", "event_id", F.col("quality").cast("int").alias("quality"))


@query(f"""with {E_SQL}, t as (select user_id, event_id // 2 % 50 as timer, us, case when event_type <> 'error' then us + cents * 1000000 end as fires, lead(us) over (partition by user_id, event_id // 2 % 50 order by us, event_id) as again from e)
select user_id, cast(timer as bigint) as timer, row_number() over (partition by user_id order by fires, timer) as place from t where fires is not null and (again is null or again > fires)""")
def fired_timers(spark, sf_dir):
    """Fifty timers of each user, set by its events, set again before they fire, and taken back by errors."""
    e = events(spark, sf_dir)
    fires = F.when(F.col("event_type") != "error", F.timestamp_micros(F.col("us") + F.col("cents") * 1000000))
    rows = e.select("user_id", F.timestamp_micros("us").alias("at"), F.expr("event_id div 2 % 50").alias("timer"), fires.alias("fires"))
    got = streams.run_to_end(stateful.timers(_live(rows, "user_id", "at"), "user_id", "at", "timer", "fires", "1 hour"))
    return got.filter("user_id >= 0")


@query(f"""with {E_SQL}, d as (select *, us // 86400000000 as day from e), s as (select *, dense_rank() over (partition by user_id order by day) - 1 as seq from d)
select user_id, case when user_id % 2 = 0 then 1 else 0 end as rung, 5 + seq as seq, row_number() over (partition by user_id, seq order by us, event_id) - 1 as k, event_id, 'packet' as kind from s where 5 + seq >= 6""")
def hls_packets(spark, sf_dir):
    """For each user a master playlist of two qualities, their playlists, and a segment of packets for each day: the better
    quality within a bandwidth, from its second segment on, as packets. Segments are byte ranges of one file for each user and
    quality, as a file (a block of disk) for each would take many times its packets; of every tenth user one is its own file."""
    users = events(spark, sf_dir).select("user_id", "us", "event_id")
    # Dealt by users, the rows of a file lie together; packets and lines are made where they are written, and never exchanged.
    e = users.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id").withColumn("seq", F.dense_rank().over(_one_by("user_id", F.expr("us div 86400000000"))) + 4)
    own = (F.col("user_id") % 10 == 0) & (F.col("seq") == 7)
    name = lambda folder, ending: F.concat(F.lit(f"{folder}u"), "user_id", F.lit(ending))
    media = lambda folder, tag: F.when(own, F.concat(name(folder, f"{tag}-s"), "seq", F.lit(".ts"))).otherwise(name(folder, f"{tag}.ts"))
    data = e.select(F.explode(F.array(*[F.struct(media(*d).alias("file"), F.lit(k).alias("kind")) for d, k in ((("", "-lo"), "00"), (("hi/", ""), "01"))])).alias("x"), "us", "event_id").select("x.file", "us", "event_id", "x.kind", F.lit(None).cast("string").alias("text"))
    size = F.col("packets") * 188
    days = e.groupBy("user_id", "seq").agg(F.count("*").alias("packets")).withColumn("end", F.sum(F.when(own, 0).otherwise(size)).over(_one_by("user_id", "seq")))
    line = lambda file, text: F.struct(file.alias("file"), text.alias("text"))
    first = F.col("seq") == 5
    place = F.when(own, F.lit("")).otherwise(F.concat(F.lit("#EXT-X-BYTERANGE:"), size, F.lit("@"), F.col("end") - size, F.lit("\n")))
    item = lambda tag: F.concat(F.when(first, F.lit("#EXTM3U\n#EXT-X-VERSION:4\n#EXT-X-MEDIA-SEQUENCE:5\n")).otherwise(F.lit("")), F.lit("#EXTINF:86400,\n"), place, media("", tag), F.lit("\n"))
    low = F.when(F.col("user_id") % 2 == 0, F.lit("400000")).otherwise(F.lit("600000"))
    high = F.when(F.col("user_id") % 2 == 0, F.lit("500000")).otherwise(F.lit("900000"))
    variants = F.concat(F.lit("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH="), high, F.lit("\n"), name("hi/", ".m3u8"), F.lit("\n#EXT-X-STREAM-INF:BANDWIDTH="), low, F.lit("\n"), name("", "-lo.m3u8"), F.lit("\n"))
    lines = F.array(line(name("", "-lo.m3u8"), item("-lo")), line(name("hi/", ".m3u8"), item("")), F.when(first, line(name("", ".m3u8"), variants)))
    lists = days.select(F.explode(lines).alias("x"), "seq").filter("x is not null").select("x.file", F.col("seq").cast("long").alias("us"), F.lit(0).cast("long").alias("event_id"), F.lit(None).cast("string").alias("kind"), "x.text")
    packet = F.unhex(F.concat(F.lit("47010110"), "kind", _hex(F.col("event_id"), 16), F.repeat(F.lit("FF"), 175)))
    placed = data.unionByName(lists).sortWithinPartitions("file", "us", "event_id")
    path = _written(placed.select("file", F.coalesce(F.col("text").cast("binary"), packet).alias("data")), None, "raw_files", spark, "hls")
    chosen = hls.best_within(hls.variants_of(users.select("user_id").distinct().select(name(f"{path}/", ".m3u8").alias("master")), "master"), 500_000)
    got = hls.packets(hls.segments(chosen, F.lit(6)))
    user = F.regexp_extract("master", r"u(-?\d+)\.m3u8$", 1).cast("long")
    kind = F.when((F.hex(F.substring("raw", 5, 1)).cast("int") == F.col("rung")) & (F.octet_length("raw") == 188), F.lit("packet")).otherwise(F.lit("another quality's"))
    return got.select(user.alias("user_id"), F.col("rung"), F.col("seq"), (F.col("n") % (1 << 32)).alias("k"), F.conv(F.hex(F.substring("raw", 6, 8)), 16, 10).cast("long").alias("event_id"), kind.alias("kind"))


@query(f"""with {E_SQL}, s as (select user_id, string_agg(props, '' order by us, event_id) as content from e group by 1), a as (select distinct user_id, unnest(range(event_id * 7 % 400, event_id * 7 % 400 + 50)) as p from e), h as (select distinct user_id, unnest(range(event_id * 13 % 500, event_id * 13 % 500 + 5)) as p from e where event_type = 'click'),
m as (select a.user_id, a.p, a.p - row_number() over (partition by a.user_id order by a.p) as g from a join s using (user_id) where p < len(content) and not exists (select 1 from h where h.user_id = a.user_id and h.p = a.p)), r as (select user_id, min(p) as place, count(*) as n from m group by user_id, g)
select user_id, place as at, substr(content, cast(place + 1 as bigint), n) as data from r join s using (user_id)""")
def cache_fill(spark, sf_dir):
    """A file for each user, of which clicks have read some ranges and all events ask for others: what is missing is read."""
    e = events(spark, sf_dir)
    rows = e.select(F.concat(F.lit("u"), "user_id", F.lit(".bin")).alias("file"), "us", "event_id", F.col("props").cast("binary").alias("data"))
    path = _written(rows, ["us", "event_id"], "raw_files", spark, "cached")
    n = F.col("event_id")
    asked = e.select("user_id", (n * 7 % 400).alias("beg"), (n * 7 % 400 + 50).alias("end"), F.concat(F.lit(f"{path}/u"), "user_id", F.lit(".bin")).alias("path"))
    had = e.filter("event_type = 'click'").select("user_id", (n * 13 % 500).alias("beg"), (n * 13 % 500 + 5).alias("end"))
    return listed.fill(asked, had, ["user_id"], "path").select("user_id", "at", F.decode("data", "UTF-8").alias("data"))


@query(f"""with {E_SQL}, p as (select *, row_number() over (partition by user_id order by us, event_id) as i from e) select user_id, kind, i - 1 as n, i * 4000 + cents % 1000 as start_ms, i * 4000 + 2500 as end_ms, event_type || chr(10) || 'no. ' || event_id as text from p, (values ('srt'), ('vtt')) k(kind)""")
def subtitles_written(spark, sf_dir):
    """Numbered and plain subtitle files for each user, written and read back by their formats."""
    i = F.row_number().over(_ordered()).cast("long")
    e = events(spark, sf_dir).withColumn("i", i)
    out = None
    for kind, name in (("srt", "srt"), ("vtt", "webvtt")):
        rows = e.select(F.concat(F.lit("u"), "user_id", F.lit(f".{kind}")).alias("file"), "i", (F.col("i") * 4000 + F.col("cents") % 1000).alias("start_ms"), (F.col("i") * 4000 + 2500).alias("end_ms"), F.concat("event_type", F.lit("\nno. "), "event_id").alias("text"))
        path = _written(rows, ["i"], name, spark, kind)
        got = readers.open_source(spark, path, kind).select(_user_of("file_id").alias("user_id"), F.lit(kind).alias("kind"), F.col("n").cast("long").alias("n"), "start_ms", "end_ms", "text")
        out = got if out is None else out.unionByName(got)
    return out
