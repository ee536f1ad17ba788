"""More registered queries: formats, sinks, queues and column functions over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import hashes, maps, timemath, url, windows
from tidemark.operators import queues, stats, sync, telemetry
from tidemark.queries import ASOF, E_SQL, PTS_SQL, _clock_hex, events, query, table
from tidemark.schema import EVENT_NAMES
from tidemark.sources import flv, playlist, rtp, sinks, sniff, transport
from tidemark.streaming import queries as streams


def _hex(number, digits):
    return F.lpad(F.hex(number.cast("long")), digits, "0")


def _ordered(*columns):
    return Window.partitionBy("user_id").orderBy(*(columns or ("us", "event_id")))


def _section(digits):
    """A pointer of 0, a section's bytes in hex, and its checksum."""
    body = F.lit(digits) if isinstance(digits, str) else digits
    return F.concat(F.lit("00"), body, _hex(hashes.crc32_mpeg(F.unhex(body)), 8))


def _transport_stream(spark, sf_dir):
    """A stream for each user: its two tables, a packet of no listed stream, and for each event a unit of two packets."""
    e = events(spark, sf_dir).select("user_id", "us", "event_id", F.row_number().over(_ordered()).alias("i"))
    pts = F.expr("us * 9 div 100 % 8589934592")
    packet = lambda pid, start, body, i: F.rpad(F.concat(F.lit("47"), F.lpad(F.hex(F.lit(pid) + F.lit(0x4000 if start else 0)), 4, "0"), _hex(16 + i % 16, 2), body), 376, "FF")
    # A unit's first packet holds its header and eight bytes, its second the rest, behind an adaptation field.
    head = F.concat(F.lit("000001E000008080"), F.lit("05"), _clock_hex(pts, 0x20), F.lit("AA"), _hex(F.col("event_id") % 256, 2))
    first = F.concat(F.lit("474100"), _hex(48 + F.col("i") % 16, 2), _hex(F.lit(183 - 16), 2), F.lit("00"), F.repeat(F.lit("FF"), 166), head)
    rest = 1 + F.col("event_id") % 40
    second = F.concat(F.lit("470100"), _hex(48 + F.col("i") % 16, 2), _hex(183 - rest, 2), F.lit("00"), F.repeat(F.lit("FF"), (182 - rest).cast("int")), F.repeat(F.lit("BB"), rest.cast("int")))
    units = e.select("user_id", F.posexplode(F.array(first, second)).alias("k", "h"), (F.col("i") * 10).alias("n")).select("user_id", (F.col("n") + F.col("k")).cast("long").alias("n"), "h")
    users = e.select("user_id").distinct()
    pat = packet(0, True, _section("00B011" + "0001C10000" + "0000E010" + "0001F000"), F.lit(0))
    pmt = packet(0x1000, True, _section("02B019" + "0001C10000" + "E100" + "F000" + "1BE100F002" + "0A04" + "0FE101F000"), F.lit(0))
    other = packet(0x1F0, True, F.lit("000001E0"), F.lit(0))
    tables = users.select("user_id", F.posexplode(F.array(pat, pmt, other)).alias("n", "h")).select("user_id", F.col("n").cast("long").alias("n"), "h")
    return tables.unionByName(units).select("user_id", "n", F.unhex("h").alias("raw"))


@query(f"""with {E_SQL} select user_id, 1 as program, 256 as pid, 27 as stream_type, row_number() over (partition by user_id order by us, event_id) - 1 as k, cast({PTS_SQL} as bigint) as pts, 'AA' || printf('%02X', event_id % 256) || repeat('BB', cast(1 + event_id % 40 as integer)) as payload from e""")
def ts_demux(spark, sf_dir):
    got = transport.demux(_transport_stream(spark, sf_dir), ["user_id"])
    return got.select("user_id", "program", "pid", "stream_type", "k", "pts", F.hex("payload").alias("payload"))


@query("select user_id, 1 as program, pid, kind as stream_type from (select distinct user_id from events), (values (256, 27), (257, 15)) t(pid, kind)")
def ts_programs(spark, sf_dir):
    return transport.elementary_streams(_transport_stream(spark, sf_dir), ["user_id"])


@query(f"""with {E_SQL}, p as (select user_id, event_id, us, row_number() over (partition by user_id order by us, event_id) as i, count(*) over (partition by user_id) as n from e)
select user_id, i - 1 as n, us as ts, cast(4 + 1 + 20 + case when i < n then 1 else 0 end as integer) as size, event_id % 3 = 0 as is_key, i = n as last from p""")
def picture_frames(spark, sf_dir):
    """A picture for each event; a chunk holds the end of the one before it, then a start code and the next one's beginning."""
    begin = F.concat(F.lit("00000001"), F.when(F.col("event_id") % 3 == 0, F.lit("65")).otherwise(F.lit("41")), F.repeat(F.lit("7F"), 20))
    rows = events(spark, sf_dir).select("user_id", "us", F.row_number().over(_ordered()).alias("i"), begin.alias("b"))
    rows = rows.select("user_id", "us", "i", F.unhex(F.concat(F.when(F.col("i") > 1, F.lit("EE")).otherwise(F.lit("")), "b")).alias("data"))
    return transport.split_pictures(rows, ["user_id"], "i", "us", "data").select("user_id", "n", "ts", F.octet_length("frame").alias("size"), "is_key", "last")


@query(f"""with {E_SQL}, p as (select *, row_number() over (partition by user_id order by us, event_id) - 1 as n from e)
select user_id, n, us // 1000 % 4294967296 as ts_ms, case when event_id % 2 = 0 then 'video' else 'audio' end as media, event_id % 6 = 0 as is_key, cast(case when event_id % 2 = 0 then 7 else 10 end as integer) as codec, cast(case when event_id % 2 = 0 then event_id % 1000 - 500 else 0 end as integer) as offset_ms, cast(case when event_id % 2 = 0 then 5 else 2 end + event_id % 50 as integer) as size from p""")
def flv_tags(spark, sf_dir):
    ms = F.expr("us div 1000 % 4294967296")
    shift = F.pmod(F.col("event_id") % 1000 - 500, F.lit(1 << 24))
    video = F.concat(F.when(F.col("event_id") % 6 == 0, F.lit("17")).otherwise(F.lit("27")), F.lit("01"), _hex(shift, 6))
    body = F.concat(F.when(F.col("event_id") % 2 == 0, video).otherwise(F.lit("AF01")), F.repeat(F.lit("00"), (F.col("event_id") % 50).cast("int")))
    size = F.length(body) / 2
    tag = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("09")).otherwise(F.lit("08")), _hex(size, 6), _hex(ms % (1 << 24), 6), _hex(F.floor(ms / (1 << 24)), 2), F.lit("000000"), body, _hex(size + 11, 8))
    rows = events(spark, sf_dir).select("user_id", F.struct("us", "event_id", tag.alias("t")).alias("r")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["t"]), "").alias("h"))
    files = rows.select("user_id", F.unhex(F.concat(F.lit("464C5601050000000900000000"), "h")).alias("content"))
    got = flv.tags(files, "user_id", "content").withColumn("h", flv.tag_header(F.col("type"), F.col("data")))
    return got.select("user_id", "n", "ts_ms", "h.media", "h.is_key", "h.codec", "h.offset_ms", F.octet_length("data").alias("size"))


@query(f"""with {E_SQL}, p as (select *, row_number() over (partition by user_id order by us, event_id) as i, count(*) over (partition by user_id) as n from e), f as (select *, (i - 1) // 3 as k from p)
select user_id, k as n, min(us // 1000000 % 4294967296) filter ((i - 1) % 3 = 0) as ts, string_agg(printf('%02X', event_id % 256), '' order by i) as frame, count(*) as packets, count(*) = 3 as whole from f group by user_id, k""")
def rtp_frames(spark, sf_dir):
    """Packets of a frame for each three events, numbered across the wrap, in which neighbours change places."""
    i = F.row_number().over(_ordered()).cast("long")
    e = events(spark, sf_dir).select("user_id", "us", "event_id", i.alias("i"))
    time = F.first("us").over(Window.partitionBy("user_id", F.expr("(i - 1) div 3")).orderBy("i"))
    header = F.concat(F.lit("80"), F.when(F.col("i") % 3 == 0, F.lit("E0")).otherwise(F.lit("60")), _hex((F.col("i") + 65530) % 65536, 4), _hex(F.expr("t div 1000000 % 4294967296"), 8), F.lit("00000007"))
    rows = e.withColumn("t", time).select("user_id", F.when((F.col("i") % 5 == 0), F.col("i") * 2 - 3).otherwise(F.col("i") * 2).alias("at"), F.unhex(F.concat(header, _hex(F.col("event_id") % 256, 2))).alias("raw"))
    return rtp.frames(rows, ["user_id"], "at", "raw").select("user_id", "n", "ts", F.hex("frame").alias("frame"), "packets", "whole")


BYTES = "[cast(('0x' || h[2 * i + 1:2 * i + 2]) as integer) for i in range(cast(len(h) // 2 as bigint))]"


@query(f"""with {E_SQL}, x as (select *, hex(encode(props)) as h from e), b as (select *, {BYTES} as d from x), s as (select *, list_sum(d) % 65521 as a, list_sum([d[i] * (len(d) - i + 1) for i in range(1, len(d) + 1)]) % 65521 as b from b)
select event_id, printf('%d, %10d, %10d, %8d, %8d, 0x%08x', cast(user_id as integer), us, us + 40, 40, cast(len(d) as integer), cast(b * 65536 + a as bigint)) || case when event_id % 2 = 1 then '' else ', F=0x0' end as line from s""")
def packet_lines(spark, sf_dir):
    us = F.col("us")
    return events(spark, sf_dir).select("event_id", sinks.packet_line(F.col("user_id").cast("int"), us, us + 40, F.lit(40), F.col("props").cast("binary"), F.col("event_id") % 2).alias("line"))


@query(f"""with {E_SQL}, x as (select user_id, string_agg(hex(encode(props)), '' order by us, event_id) as h from e group by 1), b as (select user_id, {BYTES} as d from x)
select user_id, lower(printf('%08x', cast((list_sum([d[i] * (len(d) - i + 1) for i in range(1, len(d) + 1)]) + len(d)) % 65521 * 65536 + (list_sum(d) + 1) % 65521 as bigint))) as checksum from b""")
def stream_checksums(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.struct("us", "event_id").alias("o"), F.col("props").cast("binary").alias("d"))
    return sinks.stream_checksum(rows, ["user_id"], "o", "d")


@query("""with d as (select doc_id, hex(encode(text)) as h from documents), b as (select doc_id, """ + BYTES + """ as d from d)
select doc_id, list_reduce(list_prepend(cast(5381 as bigint), [cast(x as bigint) for x in d]), lambda a, x: (a * 33 + x) % 4294967296) as djb2, lower(printf('%08x', cast((list_sum([d[i] * (len(d) - i + 1) for i in range(1, len(d) + 1)]) + len(d)) % 65521 * 65536 + (list_sum(d) + 1) % 65521 as bigint))) as adler32 from b""")
def byte_sums(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", hashes.djb2_hash(t).alias("djb2"), hashes.hash_by_name("adler32", t).alias("adler32"))


@query(f"""with {E_SQL}, k as (select user_id, min(us) filter (event_type = 'purchase' and cents % 2 = 0) as start from e where event_type in ('purchase', 'view') group by 1),
p as (select e.*, case event_type when 'purchase' then 0 else 1 end as input_idx from e join k using (user_id) where event_type in ('purchase', 'view') and us >= start)
select user_id, row_number() over (partition by user_id order by us, input_idx, event_id) as seq, cast(input_idx as integer) as input_idx, event_id from p""")
def mux_from_key(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "us", "event_id", "event_type", (F.col("cents") % 2 == 0).alias("is_key"))
    return sinks.mux([e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'")], ["user_id"], "us", "event_id", "is_key").select("user_id", "seq", "input_idx", "event_id")


@query(f"""with {E_SQL}, x as (select user_id, string_agg(props, '' order by us, event_id) as s from e group by 1)
select user_id, k as block, substr(s, cast(k * 100 + 1 as bigint), 100) as data from (select user_id, s, unnest(range((len(s) - 1) // 100 + 1)) as k from x)""")
def fifo_blocks(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.struct("us", "event_id").alias("o"), F.col("props").cast("binary").alias("d"))
    return queues.reblock(rows, ["user_id"], "o", "d", 100).select("user_id", "block", F.decode("data", "UTF-8").alias("data"))


@query(f"with {E_SQL}, x as (select user_id, string_agg(props, '' order by us, event_id) as s from e group by 1) select user_id, substr(s, 31, 45) as data from x")
def fifo_peek(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.struct("us", "event_id").alias("o"), F.col("props").cast("binary").alias("d"))
    return queues.peek(rows, ["user_id"], "o", "d", 30, 45).select("user_id", F.decode("data", "UTF-8").alias("data"))


@query(f"""with {E_SQL}, p as (select user_id, case when event_id % 4 > 0 then us end as pts, cents % 3000 as n, sum(cents % 3000) over (partition by user_id order by us, event_id rows unbounded preceding) as till from e), q as (select *, till - n as since, max(till) over (partition by user_id) as total from p where n > 0),
r as (select *, unnest(range(cast((since + 1023) // 1024 as bigint), cast((till - 1) // 1024 + 1 as bigint))) as portion from q)
select user_id, portion, cast(pts + portion * 1024 - since as bigint) as pts, cast(least(1024, total - portion * 1024) as bigint) as duration from r""")
def drained_samples(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.struct("us", "event_id").alias("o"), F.when(F.col("event_id") % 4 > 0, F.col("us")).alias("pts"), (F.col("cents") % 3000).alias("n"))
    return queues.drain_times(rows, ["user_id"], "o", "pts", "n", 1024)


@query(f"""with {E_SQL}, f as (select *, row_number() over (partition by user_id, cents % 50 order by us, event_id) as k from e) select user_id, event_id, cents % 50 as priority, row_number() over (partition by user_id order by cents % 50) as place from f where k = 1""")
def unique_queue(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", (F.col("cents") % 50).alias("priority"), F.struct("us", "event_id").alias("o"))
    return queues.ordered_unique(rows, ["user_id"], "priority", "o").select("user_id", "event_id", "priority", "place")


@query(f"with {E_SQL}, s as (select *, sum(cents) over (partition by user_id order by us, event_id rows unbounded preceding) as t from e) select user_id, event_id from s where t <= 100000")
def first_bytes(spark, sf_dir):
    return queues.within_bytes(events(spark, sf_dir).withColumn("o", F.struct("us", "event_id")), ["user_id"], "o", "cents", 100_000).select("user_id", "event_id")


@query(f"with {E_SQL}, s as (select *, lag(cents) over (partition by user_id order by us, event_id) as b from e) select user_id, event_id from s where b >= cents")
def backward_times(spark, sf_dir):
    return queues.backward(events(spark, sf_dir).withColumn("o", F.struct("us", "event_id")), ["user_id"], "o", "cents").select("user_id", "event_id")


@query(f"""with {E_SQL}, o as (select * from e where event_type = 'click'), n as (select * from e where event_type = 'view'), s as (select user_id, min(us) as since from n where us >= 1705276800000000 and cents % 3 = 0 group by 1)
select o.user_id, o.event_id, 0 as quality from o left join s using (user_id) where since is null or us < since union all select n.user_id, n.event_id, 1 from n join s using (user_id) where us >= since""")
def spliced_streams(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "us", "event_id", "event_type", (F.col("cents") % 3 == 0).alias("is_key"))
    return queues.splice(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id"], "us", "is_key", 1705276800000000).select("user_id", "event_id", "quality")


@query(f"""with {E_SQL}, {ASOF}, c as (select user_id, us as c_us, event_id as c_id from e where event_type = 'click'), m as (select user_id, max(us) as v_end from v group by 1)
select p.user_id, p.us, p.event_id as "0_event_id", case when p.us <= m.v_end then v.event_id end as "1_event_id", c.c_id as "2_event_id" from p asof left join v on p.user_id = v.user_id and p.us >= v.us asof join c on p.user_id = c.user_id and p.us >= c.c_us left join m on m.user_id = p.user_id""")
def aligned_inputs(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "us", "event_id", "event_type")
    parts = [e.filter(F.col("event_type") == t) for t in ("purchase", "view", "click")]
    got = sync.align(parts, ["user_id"], "us", "event_id", ["event_id"], before=["null", "null", "stop"], after=["infinity", "null", "infinity"])
    return got.select("user_id", "us", "0_event_id", "1_event_id", "2_event_id")


@query(f"""with {E_SQL}, x as (select event_id, us, cents, event_id % 60 + 1 as d from e) select event_id, gcd(us, cents) as g, cast(us // gcd(us, d * 1000) as bigint) as num, cast(d * 1000 // gcd(us, d * 1000) as bigint) as den, case when us * 3 < cents * 90000000 then -1 when us * 3 > cents * 90000000 then 1 else 0 end as earlier,
cast(floor(log2(cents + 1)) as integer) as bits, printf('%02d:%02d:%02d:%02d', event_id // 90000 % 24, event_id // 1500 % 60, event_id // 25 % 60, event_id % 25) as code, event_id as frame, strftime(make_timestamp(us), '%a, %d %b %Y %H:%M:%S GMT') as gmt,
cast(d * 60000 + (cents % 60) * 1000 + (cents % 100) * 10 as bigint) as lyric, cast(cents + (us % 10000 - 500) * 2 - 7 as bigint) as clock, cast(case when abs(cents % 200 - 100) > 50 then true else false end as boolean) as resets from x""")
def time_functions(spark, sf_dir):
    """`code` begins again after a day; `frame` is told from the text whose hours go on."""
    us, cents, n = F.col("us"), F.col("cents"), F.col("event_id")
    d = n % 60 + 1
    lowest = timemath.reduce(us, d * 1000)
    code = timemath.timecode(n, 25)
    tag = F.format_string("[%02d:%02d.%02d]x", d.cast("int"), (cents % 60).cast("int"), (cents % 100).cast("int"))
    return events(spark, sf_dir).select(
        "event_id", timemath.gcd_of(us, cents).alias("g"), lowest["num"].alias("num"), lowest["den"].alias("den"), timemath.compare_times(us, 3, 90000, cents, 1000, 1).alias("earlier"), timemath.log2_floor(cents + 1).cast("int").alias("bits"),
        code.alias("code"), timemath.parse_timecode(timemath.timecode(n, 25, day=False), 25).alias("frame"), timemath.gmt_text(F.timestamp_micros("us")).alias("gmt"), timemath.lyric_time(tag).alias("lyric"),
        timemath.media_clock(cents, us % 10000, F.lit(500), F.lit(2), F.lit(7)).alias("clock"), timemath.clock_resets(cents % 200, F.lit(100), F.lit(1.0)).alias("resets"),
    )


@query(f"""with {E_SQL}, x as (select event_id, event_id % 9 + 1 as a, cents % 11 + 1 as b, event_id % 7 + 1 as c, cents % 5 + 1 as d from e), y as (select *, a * d + c * b as pn, b * d as pd, a * d - c * b as mn, a * c as tn, a * d as dn, b * c as dd from x)
select event_id, pn // gcd(pn, pd) as sum_num, pd // gcd(pn, pd) as sum_den, cast(case when mn = 0 then 0 else sign(mn) * (abs(mn) // gcd(mn, pd)) end as bigint) as diff_num, pd // gcd(mn, pd) as diff_den, tn // gcd(tn, pd) as mul_num, pd // gcd(tn, pd) as mul_den, dn // gcd(dn, dd) as div_num, dd // gcd(dn, dd) as div_den from y""")
def rational_arithmetic(spark, sf_dir):
    n, cents = F.col("event_id"), F.col("cents")
    a = F.struct((n % 9 + 1).alias("num"), (cents % 11 + 1).alias("den"))
    b = F.struct((n % 7 + 1).alias("num"), (cents % 5 + 1).alias("den"))
    e = events(spark, sf_dir).select("event_id", a.alias("a"), b.alias("b"))
    made = {"sum": timemath.add, "diff": timemath.subtract, "mul": timemath.multiply, "div": timemath.divide}
    e = e.select("event_id", *[f(F.col("a"), F.col("b")).alias(k) for k, f in made.items()])
    return e.select("event_id", *[F.col(f"{k}.{p}").alias(f"{k}_{p}") for k in made for p in ("num", "den")])


@query(f"with {E_SQL} select event_id, cast(floor((sin(cents) + pi()) * 1000 / (1 + abs(cents - 20000))) as bigint) as value_k from e")
def expression_values(spark, sf_dir):
    got = timemath.expression("(sin(v) + PI) * 1000 / (1 + abs(v - 20000))", {"v": "cents"})
    return events(spark, sf_dir).select("event_id", F.floor(got).alias("value_k"))


@query(f"""with {E_SQL}, x as (select event_id, user_id, us // 1000 as t, us // 1000 - lag(us // 1000) over (partition by user_id order by us, event_id) as gap from e)
select user_id, event_id, cast(case when (t * 441 * 2 // 10 + 1) // 2 is null then null else (t * 882 + 10) // 20 end as bigint) as out_ts from x""")
def rescaled_times(spark, sf_dir):
    """Milliseconds as ticks of 44,100 a second: a finer unit than the source's loses nothing, so each is its own rescaling."""
    e = events(spark, sf_dir).select("user_id", "us", "event_id", F.expr("us div 1000").alias("t"), F.lit(0).alias("d"))
    return timemath.rescale_delta(e, "t", "d", ["us", "event_id"], ["user_id"], (1, 1000), (1, 44100), (1, 44100)).select("user_id", "event_id", "out_ts")


@query(f"""with {E_SQL}, x as (select event_id, cents, props, printf('%04X%08X', cents % 65536, event_id) as h from e)
select event_id, upper(hex(encode(props))) as hexed, to_base64(encode(props)) as b64, props as back, cast(event_id // 16 % 4096 as bigint) as bits, cents % 100 as golomb, cast(case when cents % 100 % 2 = 1 then (cents % 100 + 1) // 2 else -(cents % 100 // 2) end as bigint) as signed, event_id & 5 = 5 as flags, cast(event_id as double) / 8 as number from x""")
def byte_functions(spark, sf_dir):
    n, props = F.col("event_id"), F.col("props")
    word = F.unhex(F.concat(_hex(F.col("cents") % 65536, 4), _hex(n, 8)))
    code = F.bin(F.col("cents") % 100 + 1)
    bits = F.concat(F.repeat(F.lit("0"), F.length(code) - 1), code, F.lit("0101"))
    golomb = hashes.exp_golomb_at(bits)["value"]
    k = F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")))
    exact = F.when(F.pow(F.lit(2.0), k) > n, k - 1).when(F.pow(F.lit(2.0), k + 1) <= n, k + 1).otherwise(k)
    fraction = ((n / F.pow(F.lit(2.0), exact) - 1) * (1 << 52)).cast("long")
    number = F.when(n > 0, F.unhex(F.concat(_hex((exact - 3 + 1023) * 16 + F.floor(fraction / (1 << 48)), 4), _hex(fraction % (1 << 48), 12)))).otherwise(F.unhex(F.lit("0" * 16)))
    return events(spark, sf_dir).select(
        "event_id", F.hex(props).alias("hexed"), hashes.base64_text(props).alias("b64"), F.decode(hashes.from_base64(hashes.base64_text(props)), "UTF-8").alias("back"), hashes.read_bits(word, 32, 12).alias("bits"),
        golomb.alias("golomb"), hashes.signed_golomb_of(golomb).alias("signed"), hashes.all_flags(n, 5).alias("flags"), hashes.double_of(number).alias("number"),
    )


@query("""with x as (select page_id, url, 'rtmp' || case when page_id % 2 = 0 then 's' else '' end || '://h' || page_id || case when page_id % 3 = 0 then ':' || (page_id % 70000) else '' end || '/live/a' || case when page_id % 5 = 0 then '' else '/k' || page_id end as r, (page_id % 300) || '.1.2.3' as ip from pages)
select page_id, case when page_id % 2 = 0 then 'rtmps' else 'rtmp' end as protocol, 'h' || page_id as host, cast(case when page_id % 3 = 0 and page_id % 70000 <= 65535 then page_id % 70000 else 0 end as integer) as port, case when page_id % 5 = 0 then 'live' else 'live/a' end as app, case when page_id % 5 = 0 then 'a' else 'k' || page_id end as path,
page_id % 300 < 256 as ipv4, case when page_id % 300 < 256 then cast(page_id % 300 as bigint) * 16777216 + 66051 end as number, 'http' || substr(url, 5) as same, upper(substr(url, 1, 4)) || substr(url, 5) as shouted from x""")
def address_functions(spark, sf_dir):
    n = F.col("page_id")
    text = n.cast("string")
    address = F.concat(F.lit("rtmp"), F.when(n % 2 == 0, "s").otherwise(""), F.lit("://h"), text, F.when(n % 3 == 0, F.concat(F.lit(":"), (n % 70000).cast("string"))).otherwise(""), F.lit("/live/a"), F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("/k"), text)))
    ip = F.concat((n % 300).cast("string"), F.lit(".1.2.3"))
    parts = table(spark, sf_dir, "pages").select("page_id", "url", rtp.stream_address(address).alias("a"), url.is_ipv4(ip).alias("ipv4"), url.ipv4_number(ip).alias("number"))
    return parts.select("page_id", "a.protocol", "a.host", "a.port", "a.app", "a.path", "ipv4", "number", url.escape_non_ascii(F.col("url")).alias("same"), url.change_case(F.col("url"), 4, True).alias("shouted"))


@query("with n as (select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in EVENT_NAMES.items()) + """) t(i, name)) select event_id, coalesce(name, '') as name, event_id % 3 - 1 <= 0 as live, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' as record, case when event_id % 300 > 100 then event_id % 300 end as slow from events left join n on i = event_id % 12""")
def telemetry_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ms", F.col("event_id") % 300)
    slow = stats.slow_calls(e, "ms").select("event_id", F.col("ms").alias("slow"))
    return e.join(slow, "event_id", "left").select("event_id", telemetry.event_name(F.col("event_id") % 12).alias("name"), telemetry.is_live(F.col("event_id") % 3 - 1).alias("live"), telemetry.json_record(["event_id", "user_id", "event_type"]).alias("record"), "slow")


COSINE_SQL = " union all ".join(f"select '{name}' as name, {' + '.join(f'{(-1) ** k * a!r} * cos({2 * k} * pi() * i / 63)' for k, a in enumerate(terms))} as w, i from range(64) t(i)" for name, terms in windows.COSINES.items())
OTHER_SQL = {
    "bartlett": "1 - abs((i - 31.5) / 31.5)", "welch": "1 - power((i - 31.5) / 31.5, 2)", "sine": "sin(pi() * i / 63)", "bhann": "0.62 - 0.48 * abs(i / 63.0 - 0.5) - 0.38 * cos(2 * pi() * i / 63)",
    "lanczos": "sin((2 * i / 63.0 - 1) * pi()) / ((2 * i / 63.0 - 1) * pi())", "gauss": "exp(-0.5 * power((i - 31.5) / (0.4 * 31.5), 2))", "tukey": "case when abs(i - 31.5) < 0.3 * 31.5 then 1 else 0.5 * (1 + cos(pi() * (abs(i - 31.5) - 0.3 * 31.5) / (0.7 * 31.5))) end",
}


@query(f"""with w as ({COSINE_SQL} union all {' union all '.join(f'select {chr(39)}{k}{chr(39)}, {v}, i from range(64) t(i)' for k, v in OTHER_SQL.items())})
select vec_id, name, cast(round(sum(cast(embedding[i + 1] as double) * w) * 10000) as bigint) as weighed from embeddings, w where len(embedding) = 64 group by 1, 2""")
def all_windows(spark, sf_dir):
    """Each vector's 64 numbers under every window."""
    term = lambda name: lambda x, k: x * windows.coefficient(name, k, 64)
    total = lambda name: F.aggregate(F.transform(F.col("embedding").cast("array<double>"), term(name)), F.lit(0.0), lambda a, x: a + x)
    shapes = F.array(*[F.struct(F.lit(name).alias("name"), F.round(total(name) * 10000).cast("long").alias("weighed")) for name in [*windows.COSINES, *OTHER_SQL]])
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select("vec_id", F.explode(shapes).alias("s")).select("vec_id", "s.name", "s.weighed")


@query(f"with {E_SQL} select event_type as kind, make_timestamp(us // 86400000000 * 86400000000) as start, count(*) as n_events, cast(sum(cents) as bigint) as bytes from e group by 1, 2")
def stream_tumbling(spark, sf_dir):
    e = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{sf_dir}/events.parquet*")
    e = e.select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("t"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    got = streams.run_to_end(streams.sample_windows(e, "t", "1 day", ["kind"], "cents", "400 days"), "complete")
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""with x as (select page_id, html, page_id % 4 as k from pages) select page_id, case k when 0 then 'M3U8' when 1 then 'FLV' when 2 then 'MP4' else 'NONE' end as by_content, case k when 0 then 'M3U8' when 1 then 'FLV' when 2 then 'MP4' else 'AAC' end as by_type,
case k when 0 then 'RTMP' when 1 then 'RTSP' when 2 then 'FILE' else 'HTTP' end as protocol, case page_id % 5 when 0 then 'TS' when 1 then 'MP4' when 2 then 'NONE' when 3 then 'M3U8' else 'FFCAT' end as by_address from x""")
def sniffed_sources(spark, sf_dir):
    n = F.col("page_id") % 4
    start = F.when(n == 0, F.lit("#EXTM3U\n")).when(n == 1, F.lit("FLV\x01")).when(n == 2, F.lit("\x00\x00\x00\x18ftypisom")).otherwise(F.lit(""))
    content = F.concat(start, F.translate("html", "#", "x"))
    scheme = F.when(n == 0, F.lit("RTMP://h/a")).when(n == 1, F.lit("rtsp://h/a")).when(n == 2, F.lit("/h/a")).otherwise(F.lit("https://h/a"))
    five = F.col("page_id") % 5
    name = F.when(five == 0, F.lit("/a/b.TS")).when(five == 1, F.lit("http://h/b.m4a?t=1.x")).when(five == 2, F.lit("http://h/b.M4A?t=1.x")).when(five == 3, F.lit("http://h/b.m3u8?domain=x.y")).otherwise(F.lit("l.ffconcat"))
    return table(spark, sf_dir, "pages").select("page_id", sniff.format_by_content(content).alias("by_content"), sniff.format_by_content(content, F.lit("audio/aac")).alias("by_type"), sniff.protocol(scheme).alias("protocol"), sniff.format_by_address(name).alias("by_address"))


@query(f"""with {E_SQL}, p as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as i, 20000 + event_id * 97 % 40000 as b from e), s as (select *, case when b < 32768 then b * 1024 else b end as bandwidth from p)
select cast(user_id as bigint) as playlist_id, cast(bandwidth as bigint) as bandwidth, 'http://a.example/v/' || event_id || '.m3u8' as url, cast(row_number() over (partition by user_id order by bandwidth, i) - 1 as integer) as rung from s""")
def m3u8_variants(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", F.row_number().over(_ordered("event_id")).alias("i"))
    line = F.concat(F.lit('#EXT-X-STREAM-INF:PROGRAM-ID=1,CODECS="a,b",BANDWIDTH='), (20000 + F.col("event_id") * 97 % 40000).cast("string"), F.lit("\n"), F.col("event_id").cast("string"), F.lit(".m3u8"))
    rows = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    text = rows.select("user_id", F.concat(F.lit("#EXTM3U\n"), "body").alias("text"))
    return playlist.variants(playlist.lines(text, "user_id", "text"), F.lit("http://a.example/v/master.m3u8"))


@query("select event_id, coalesce(nullif(lower(event_type), 'view'), 'seen') as a, event_type || '+' || user_id as b, cast(3 as integer) as n, 'x=' || user_id || '&y=' || event_type as shown from events")
def map_functions(spark, sf_dir):
    m = maps.fold_keys(F.create_map(F.lit("Kind"), F.col("event_type"), F.lit("USER"), F.col("user_id").cast("string")))
    appended = maps.put(m, "kind", F.concat(F.lit("+"), F.col("user_id").cast("string")), "append")
    kept = maps.put(appended, "user", F.lit("other"), "keep")
    third = maps.put(kept, "more", F.lit("1"))
    seen = F.when(maps.lookup(m, "KI", prefix=True) == "view", F.lit("seen")).otherwise(maps.lookup(m, "kind"))
    shown = maps.show(maps.rename_keys(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")), {"user": "x", "kind": "y"}))
    return events(spark, sf_dir).select("event_id", seen.alias("a"), maps.lookup(kept, "kind", match_case=True).alias("b"), maps.count(third).alias("n"), shown.alias("shown"))


@query(f"with {E_SQL}, t as (select *, us + cents * 1000 as fires from e) select user_id, event_id, row_number() over (partition by user_id order by fires, event_id) as place from t where fires <= 1705276800000000")
def due_timers(spark, sf_dir):
    t = events(spark, sf_dir).withColumn("at", F.col("us") + F.col("cents") * 1000)
    return queues.due(t, ["user_id"], "at", "event_id", 1705276800000000).select("user_id", "event_id", "place")


@query(f"with {E_SQL}, t as (select *, us + cents * 1000 as fires from e) select user_id, event_id, cast(fires - coalesce(lag(fires) over (partition by user_id order by fires, event_id), 0) as bigint) as delay from t")
def timer_delays(spark, sf_dir):
    t = events(spark, sf_dir).withColumn("at", F.col("us") + F.col("cents") * 1000)
    return queues.delays(t, ["user_id"], "at", "event_id").select("user_id", "event_id", "delay")


@query("select vec_id, array_to_string([cast(floor(x * 1000) as bigint) for x in list_sort(cast(embedding as double[]))], ',') as sorted from embeddings")
def sorted_arrays(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.array_sort(F.col("embedding").cast("array<double>")).alias("x"))
    return v.select("vec_id", F.array_join(F.transform("x", lambda x: F.floor(x * 1000).cast("string")), ",").alias("sorted"))


@query(f"with {E_SQL} select event_id, event_id & 3 = 3 as both, (us // 1000000 - 1704067200) % 2 = 0 as even, cast(list_position([abs(x - cents / 30000.0) for x in [0.5, 0.25, 1.0 / 3, 1.0]], list_min([abs(x - cents / 30000.0) for x in [0.5, 0.25, 1.0 / 3, 1.0]])) - 1 as integer) as nearest, us + 10800 as stable from e")
def flags_and_nearest(spark, sf_dir):
    n = F.col("event_id")
    value = F.col("cents") / F.lit(30000.0)
    return events(spark, sf_dir).select("event_id", hashes.all_flags(n, 3).alias("both"), (F.expr("us div 1000000 - 1704067200") % 2 == 0).alias("even"), timemath.nearest_rational(value, [(1, 2), (1, 4), (1, 3), (1, 1)]).alias("nearest"), timemath.add_stable(F.col("us"), 1, 90000, 1, 25, 3).alias("stable"))
