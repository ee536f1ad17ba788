"""Registered queries of bitstream filters and elementary-stream parsers over streams built from the events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.format_queries import _hex, _ordered, _section
from tidemark.functions import hashes
from tidemark.operators import queues
from tidemark.queries import E_SQL, events, query
from tidemark.sources import bitstreams, rtp, transport
from tidemark.sources.media_sinks import dealt
from tidemark.storage import materialize


def _golomb(value):
    """An unsigned Exp-Golomb code as text of bits."""
    code = F.bin(value + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(code) - 1), code)


def _bits(value, n):
    return F.lpad(F.bin(value), n, "0")


def _bytes_of_bits(bits):
    """Bits with a stop bit and zeros up to a whole byte."""
    padded = F.concat(bits, F.lit("1"))
    padded = F.rpad(padded, (F.ceil(F.length(padded) / 8) * 8).cast("int"), "0")
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(padded, F.lit("(.{8})"), F.lit(1)), lambda b: F.lpad(F.conv(b, 2, 16), 2, "0")), ""))


@query(f"""with {E_SQL}, s as (select event_id, user_id, row_number() over (partition by user_id order by us, event_id) as i, event_id % 4 = 0 as high, event_id % 3 = 0 as interlaced, cents % 200 as w, event_id % 150 as h, cents % 8 as crop from e)
select user_id, i - 1 as n, 0 as u, cast(case when high then 100 else 66 end as integer) as profile, cast(event_id % 256 as integer) as level, cast(event_id % 32 as integer) as set_id, cast(1 as integer) as chroma_format, cast(case when high then 10 else 8 end as integer) as luma_bits, cast(event_id % 16 as integer) as n_reference,
cast(16 * (w + 1) - 2 * crop as integer) as width, cast(16 * (h + 1) * case when interlaced then 2 else 1 end - case when interlaced then 4 else 2 end * crop as integer) as height, interlaced from s""")
def sequence_sets(spark, sf_dir):
    """A frame for each event, with a sequence set whose sizes and flags are the event's and a slice that holds start-code look-alikes."""
    n, cents = F.col("event_id"), F.col("cents")
    high, interlaced, crop = n % 4 == 0, n % 3 == 0, cents % 8
    g = lambda v: _golomb(v if not isinstance(v, int) else F.lit(v).cast("long"))
    colour = F.concat(g(1), g(2), g(0), F.lit("00"))  # one plane in two dimensions, 10 bits, no bypass, no scaling
    order = F.when(n % 2 == 0, F.concat(g(0), g(4))).otherwise(F.concat(g(1), F.lit("0"), g(3), g(6), g(2), g(1), g(2)))
    fields = [_bits(F.when(high, 100).otherwise(66).cast("long"), 8), F.lit("0" * 8), _bits(n % 256, 8), g(n % 32), F.when(high, colour).otherwise(""), g(0), order, g(n % 16), F.lit("0"), g(cents % 200), g(n % 150)]
    fields += [F.when(interlaced, F.lit("01")).otherwise(F.lit("1")), F.lit("1"), F.when(crop > 0, F.concat(F.lit("1"), g(0), g(crop), g(crop), g(0))).otherwise(F.lit("0")), F.lit("0")]
    sets = bitstreams.with_prevention(_bytes_of_bits(F.concat(*fields)))
    slice_ = bitstreams.with_prevention(F.unhex(F.concat(F.lit("65000001000000"), _hex(n, 8), F.lit("AA"))))
    frame = F.concat(F.unhex(F.lit("0000000167")), sets, F.unhex(F.lit("000001")), slice_)
    rows = events(spark, sf_dir).select("user_id", (F.row_number().over(_ordered()) - 1).cast("long").alias("n"), frame.alias("frame"))
    return bitstreams.sequence_sets(bitstreams.units(rows, ["user_id", "n"], "frame"), ["user_id", "n", "u"])


@query(f"""with {E_SQL}, p as (select *, '4001' || printf('%02X', user_id % 256) || '07' as vps, '4201' || printf('%04X', user_id % 65536) || '80' as sps, '4401' || printf('%02X', user_id % 251) || '80' as pps from e)
select event_id, '00000001' || '4601' || '50' || case when event_id % 5 = 0 then '00000001' || vps || '00000001' || sps || '00000001' || pps else '' end || '00000001' || case when event_id % 5 = 0 then '2601' else '0201' end || hex(encode(props)) as annexb, cast(4 + case when event_id % 5 = 0 then 6 else 0 end - 2 as bigint) as n_units_twice, true as same from p""")
def start_coded_packets(spark, sf_dir):
    """Length-prefixed packets with a decoder record for each user: to start codes, and back."""
    n, user = F.col("event_id"), F.col("user_id")
    vps, sps, pps = F.concat(F.lit("4001"), _hex(user % 256, 2), F.lit("07")), F.concat(F.lit("4201"), _hex(user % 65536, 4), F.lit("80")), F.concat(F.lit("4401"), _hex(user % 251, 2), F.lit("80"))
    one = lambda kind, unit: F.concat(F.lit(kind), F.lit("0001"), _hex(F.length(unit) / 2, 4), unit)
    record = F.unhex(F.concat(F.lit("01" + "00" * 20 + "01" + "03"), one("20", vps), one("21", sps), one("22", pps)))
    picture = F.concat(F.when(n % 5 == 0, F.lit("2601")).otherwise(F.lit("0201")), F.hex("props"))
    data = F.unhex(F.concat(F.lit("0003" + "460150"), _hex(F.length(picture) / 2, 4), picture))
    rows = events(spark, sf_dir).select("event_id", bitstreams.to_start_codes(data, record, True).alias("a"))
    counted = bitstreams.units(rows, ["event_id"], "a", True).groupBy("event_id").agg((2 * F.count("*") - 2).alias("n_units_twice"))
    back = bitstreams.to_lengths(rows, ["event_id"], "a")
    again = back.select("event_id", bitstreams.to_start_codes(F.col("data"), F.unhex(F.lit("01" + "00" * 20 + "0300")), True).alias("b"))
    return rows.join(counted, "event_id").join(again, "event_id").select("event_id", F.hex("a").alias("annexb"), "n_units_twice", (F.col("a") == F.col("b")).alias("same"))


@query(f"""with {E_SQL}, f as (select event_id, k, 1 + (event_id * (k + 1) + cents) % case when event_id % 97 = 0 then 70000 when event_id % 3 = 0 then 300 else 90 end as size, event_id % 8 + 1 as n from e, lateral (select unnest(range(event_id % 8 + 1)) as k))
select event_id, cast(k as integer) as k, cast(size as integer) as size, printf('%02X', (event_id + k) % 256) as first, printf('%02X', (event_id + k) % 256) as last from f""")
def superframe_parts(spark, sf_dir):
    """Superframes of one to eight frames whose sizes need one to three bytes, and single frames without an index."""
    n = F.col("event_id")
    most = F.when(n % 97 == 0, 70000).when(n % 3 == 0, 300).otherwise(90)
    sizes = F.transform(F.sequence(F.lit(0), (n % 8).cast("int")), lambda k: (1 + (n * (k + 1) + F.col("cents")) % most).cast("int"))
    rows = events(spark, sf_dir).withColumn("z", sizes)
    body = F.array_join(F.transform("z", lambda z, k: F.repeat(_hex((n + k) % 256, 2), z)), "")
    width = F.when(F.array_max("z") > 65535, 3).when(F.array_max("z") > 255, 2).otherwise(1)
    mark = _hex(0xC0 + (width - 1) * 8 + F.size("z") - 1, 2)
    little = F.array_join(F.transform("z", lambda z: F.substring(F.concat(_hex(z % 256, 2), _hex(F.floor(z / 256) % 256, 2), _hex(F.floor(z / 65536), 2)), F.lit(1), width * 2)), "")
    plain = (F.size("z") == 1) & ((n % 256).bitwiseAND(F.lit(0xE0)) != 0xC0)
    packet = F.unhex(F.concat(body, F.when(plain, F.lit("")).otherwise(F.concat(mark, little, mark))))
    parts = bitstreams.superframe_parts(rows.select("event_id", packet.alias("p")), ["event_id"], "p")
    return parts.select("event_id", "k", F.octet_length("part").alias("size"), F.hex(F.substring("part", 1, 1)).alias("first"), F.hex(F.expr("substring(part, octet_length(part), 1)")).alias("last"))


@query(f"""with {E_SQL}, p as (select user_id, row_number() over (partition by user_id order by us, event_id) as i, event_id, case when event_id % 3 = 0 then '86' else '84' end || repeat('11', cast(event_id % 400 as integer)) as h from e),
g as (select *, coalesce(sum(case when event_id % 3 = 0 then 1 else 0 end) over (partition by user_id order by i rows between unbounded preceding and 1 preceding), 0) as k from p),
m as (select user_id, k, max(i) as i, count(*) as frames, string_agg(h, '' order by i) as body, max(len(h) // 2) as most, array_agg(len(h) // 2 order by i) as z, bool_or(event_id % 3 = 0) as done from g group by user_id, k)
select user_id, row_number() over (partition by user_id order by k) - 1 as n, i, cast(frames as integer) as frames, case when frames = 1 then body when frames <= 8 then body || printf('%02X', cast(192 + case when most > 255 then 8 else 0 end + frames - 1 as integer)) || array_to_string([case when most > 255 then printf('%02X%02X', x % 256, x // 256) else printf('%02X', x) end for x in z], '') || printf('%02X', cast(192 + case when most > 255 then 8 else 0 end + frames - 1 as integer)) end as data from m where done""")
def superframes(spark, sf_dir):
    """Frames of which every third event's is seen."""
    n = F.col("event_id")
    body = F.concat(F.when(n % 3 == 0, F.lit("86")).otherwise(F.lit("84")), F.repeat(F.lit("11"), (n % 400).cast("int")))
    rows = events(spark, sf_dir).select("user_id", F.row_number().over(_ordered()).cast("long").alias("i"), F.unhex(body).alias("frame"))
    return bitstreams.superframes(rows, ["user_id"], "i", "frame").select("user_id", "n", "i", "frames", F.hex("data").alias("data"))


def _cut_anywhere(spark, sf_dir, frame, every):
    """Each user's frames, one for each event, as chunks of so many bytes, whose time is their number."""
    rows = events(spark, sf_dir).select("user_id", F.struct("us", "event_id").alias("o"), F.unhex(frame).alias("f"))
    return queues.reblock(rows, ["user_id"], "o", "f", every)


@query(f"""with {E_SQL}, p as (select user_id, row_number() over (partition by user_id order by us, event_id) - 1 as n, event_id, event_id % 3 as code, event_id % 12 as idx, event_id % 8 as mode, event_id % 2 as low from e),
s as (select *, [32, 40, 48, 56, 64, 80][idx // 2 + 1] as kbps, [48000, 44100, 32000][code + 1] as rate from p), z as (select *, 2 * (kbps * 96000 // rate + case when code = 1 then idx % 2 else 0 end) as size from s), a as (select *, sum(size) over (partition by user_id order by n) - size as place from z)
select user_id, n, cast(place // 333 as bigint) as ts, cast(size as integer) as size, cast(rate as integer) as rate, cast([2, 1, 2, 3, 3, 4, 4, 5][mode + 1] + low as integer) as channels, printf('%02X', event_id % 255) as tail from a""")
def ac3_frames(spark, sf_dir):
    """AC-3 frames of all rates and modes, cut into chunks of 333 bytes; their bodies hold no sync word."""
    n = F.col("event_id")
    code, index, mode = n % 3, n % 12, n % 8
    kbps = F.element_at(F.array(*[F.lit(x) for x in bitstreams.AC3_KBPS[:6]]), (F.floor(index / 2) + 1).cast("int"))
    rate = F.element_at(F.array(*[F.lit(x) for x in bitstreams.AC3_RATES]), (code + 1).cast("int"))
    size = 2 * (F.floor(kbps * 96000 / rate) + F.when(code == 1, index % 2).otherwise(0))
    skipped = F.when((mode % 2 == 1) & (mode != 1), 2).otherwise(0) + F.when(mode >= 4, 2).otherwise(0) + F.when(mode == 2, 2).otherwise(0)
    last = F.rpad(F.concat(_bits(mode, 3), F.repeat(F.lit("0"), skipped), _bits(n % 2, 1)), 16, "0")
    head = F.concat(F.lit("0B770000"), _hex(code * 64 + index, 2), F.lit("40"), F.lpad(F.conv(last, 2, 16), 4, "0"))
    frame = F.concat(head, F.repeat(_hex(n % 255, 2), (size - 8).cast("int")))
    got = bitstreams.audio_frames(_cut_anywhere(spark, sf_dir, frame, 333), ["user_id"], "block", "block", "data", "AC3")
    return got.filter("not last").select("user_id", "n", "ts", "size", "rate", "channels", F.hex(F.expr("substring(frame, size, 1)")).alias("tail"))


@query(f"""with {E_SQL}, p as (select user_id, row_number() over (partition by user_id order by us, event_id) - 1 as n, event_id, event_id % 3 as r, event_id % 14 + 1 as idx, event_id % 2 as pad from e),
s as (select *, [44100, 48000, 32000][r + 1] as rate, [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][idx] as kbps from p), z as (select *, 144 * kbps * 1000 // rate + pad as size from s), a as (select *, sum(size) over (partition by user_id order by n) - size as place from z)
select user_id, n, cast(place // 777 as bigint) as ts, cast(size as integer) as size, cast(rate as integer) as rate, cast(case when event_id % 5 = 0 then 1 else 2 end as integer) as channels from a""")
def mpeg_audio_frames(spark, sf_dir):
    """Layer-3 frames of all rates, cut into chunks of 777 bytes."""
    n = F.col("event_id")
    rate = F.element_at(F.array(*[F.lit(x) for x in bitstreams.MPEG_RATES]), (n % 3 + 1).cast("int"))
    kbps = F.element_at(F.array(*[F.lit(x) for x in bitstreams.MPEG_KBPS[1, 3]]), (n % 14 + 1).cast("int"))
    size = F.floor(144 * kbps * 1000 / rate) + n % 2
    head = F.concat(F.lit("FFFB"), _hex((n % 14 + 1) * 16 + (n % 3) * 4 + (n % 2) * 2, 2), F.when(n % 5 == 0, F.lit("C0")).otherwise(F.lit("00")))
    frame = F.concat(head, F.repeat(F.lit("5A"), (size - 4).cast("int")))
    got = bitstreams.audio_frames(_cut_anywhere(spark, sf_dir, frame, 777), ["user_id"], "block", "block", "data", "MP3")
    return got.filter("not last").select("user_id", "n", "ts", "size", "rate", "channels")


@query(f"""with {E_SQL} select event_id, printf('%04X', cast(2 * 2048 + event_id % 13 * 128 + event_id % 8 * 8 as integer)) as config, hex(encode(props)) as payload, upper(hex(encode(props))) as chomped, printf('%04X', len(props)) || hex(encode(props)) as sample, props as text, case when event_id % 3 = 0 then 'ABCD' else '' end || hex(encode(props)) as kept, cast(96 as integer) as core from e""")
def packet_filters(spark, sf_dir):
    n, props = F.col("event_id"), F.col("props").cast("binary")
    size = F.octet_length(props) + 7 + F.when(n % 4 == 0, 2).otherwise(0)
    second = F.lit(0x40) + (n % 13) * 4 + F.floor(n % 8 / 4)
    head = F.concat(F.when(n % 4 == 0, F.lit("FFF0")).otherwise(F.lit("FFF1")), _hex(second, 2), _hex((n % 4) * 64 + F.floor(size / 2048), 2), _hex(F.floor(size / 8) % 256, 2), _hex(size % 8 * 32 + 31, 2), F.lit("FC"), F.when(n % 4 == 0, F.lit("0000")).otherwise(F.lit("")))
    asc = bitstreams.adts_to_config(F.concat(F.unhex(head), props))
    sample = bitstreams.text_to_sample(F.col("props"))
    dts = F.concat(F.unhex(F.lit("7FFE8001FC0005F0")), F.unhex(F.repeat(F.lit("00"), (88 + n % 50).cast("int"))))
    return events(spark, sf_dir).select(
        "event_id", F.hex(asc["config"]).alias("config"), F.hex(asc["payload"]).alias("payload"), F.hex(bitstreams.chomp(F.concat(props, F.unhex(F.repeat(F.lit("00"), (n % 9).cast("int")))))).alias("chomped"),
        F.hex(sample).alias("sample"), bitstreams.sample_to_text(sample).alias("text"), F.hex(bitstreams.with_record(props, F.unhex(F.lit("ABCD")), n % 3 == 0)).alias("kept"), F.octet_length(bitstreams.core_only(dts)).alias("core"),
    )


@query("""with u as (select distinct user_id from events), v as (select user_id, 0 as version, null as since, 30 as until, 50 as n from u union all select user_id, 1, 30, 50, 36 + user_id % 40 from u union all select user_id, 2, 50, null, 1 from u)
select user_id, cast(7 as integer) as program, cast(256 + k as integer) as pid, cast(case when k % 2 = 0 then 27 else 15 end as integer) as stream_type, cast(version as integer) as version, cast(since as bigint) as since, cast(until as bigint) as until from v, lateral (select unnest(range(n)) as k)""")
def ts_versions(spark, sf_dir):
    """A program's map of up to 75 streams over two or three packets, in three versions: repeated with a packet twice, with a
    packet lost (one version in vain), with a bit wrong, announced ahead of time, and behind the end of another section."""
    entry = lambda k: F.concat(F.when(k % 2 == 0, F.lit("1B")).otherwise(F.lit("0F")), _hex(0xE100 + k, 4), F.lit("F000"))

    def table(version, n, current=1):
        body = F.concat(F.lit("02"), _hex(0xB000 + 13 + 5 * n, 4), F.lit("0007"), _hex(F.lit(0xC0 + 2 * version + current), 2), F.lit("0000E100F000"), F.array_join(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), entry), ""))
        return F.concat(body, _hex(hashes.crc32_mpeg(F.unhex(body)), 8))

    def carried(at, payload, lost=None, twice=None):
        """(n, counter, begins, body) of the packets of a payload that begins at n; the counter goes on at n."""
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length(payload) / 368).cast("int") - 1), lambda k: F.struct((at + 2 * k).cast("long").alias("n"), ((at / 2).cast("int") + k).alias("c"), (k == 0).alias("b"), F.rpad(F.substring(payload, k * 368 + 1, F.lit(368)), 368, "F").alias("h")))
        cut = cut if lost is None else F.filter(cut, lambda x: x["n"] != lost)
        return cut if twice is None else F.concat(cut, F.transform(F.filter(cut, lambda x: x["n"] == twice), lambda x: F.struct((x["n"] + 1).alias("n"), x["c"].alias("c"), x["b"].alias("b"), x["h"].alias("h"))))

    users = dealt(events(spark, sf_dir).select("user_id").distinct(), "user_id")  # few bytes, but of each user much is made
    # The tables are columns, made once for each user, and not for each packet that is cut from them.
    made = {"fifty": table(0, F.lit(50)), "ahead": table(3, F.lit(60), current=0), "many": table(1, 36 + F.col("user_id") % 40), "one": table(2, F.lit(1))}
    users = users.withColumns({k: F.concat(F.lit("00"), t) for k, t in made.items()})
    users = users.withColumn("wrong", F.concat(F.substring("many", 1, 32), F.lit("AA"), F.expr("substring(many, 35, length(many))")))
    runs = [carried(F.lit(2), F.col("fifty"), twice=4), carried(F.lit(6), F.col("ahead")), carried(F.lit(14), F.col("many"), lost=16), carried(F.lit(20), F.col("wrong")), carried(F.lit(30), F.col("many")), carried(F.lit(40), F.col("many"))]
    runs.append(F.array(F.struct(F.lit(50).cast("long").alias("n"), F.lit(25).alias("c"), F.lit(True).alias("b"), F.rpad(F.concat(F.lit("03ABCDEF"), F.expr("substring(one, 3, length(one))")), 368, "F").alias("h"))))
    maps = users.select("user_id", F.explode(F.concat(*runs)).alias("p")).select("user_id", "p.n", F.concat(F.lit("47"), F.when(F.col("p.b"), F.lit("4064")).otherwise(F.lit("0064")), _hex(16 + F.col("p.c") % 16, 2), "p.h").alias("h"))
    association = users.select("user_id", F.lit(0).cast("long").alias("n"), F.rpad(F.concat(F.lit("47400010"), _section("00B00D" + "0001C10000" + "0007E064")), 376, "F").alias("h"))
    packets = materialize(maps.unionByName(association).select("user_id", "n", F.unhex("h").alias("raw")), "packets")
    return transport.stream_table(packets, ["user_id"])


@query(f"""with {E_SQL}, p as (select user_id, event_id, row_number() over (partition by user_id order by us, event_id) as i from e), a as (select *, i * 10000 + case when i > 20 and i % 5 = 0 then 15000 else 0 end + case when event_id % 11 = 0 then 500000 else 0 end as arrival from p where event_id % 13 <> 0),
d as (select *, min(case when event_id % 11 <> 0 then arrival end) over (partition by user_id order by i rows between 1 following and unbounded following) as nxt from a), g as (select * from d where not (event_id % 11 = 0 and coalesce(nxt + 100000 <= arrival, false)))
select user_id, row_number() over (partition by user_id order by i) - 1 as n, i + 65500 as number, coalesce(lag(i) over (partition by user_id order by i) <> i - 1, false) as lost, event_id from g""")
def reordered_packets(spark, sf_dir):
    """Packets ten milliseconds apart, of which some are lost, some come behind their successor, and some half a second late."""
    i = F.row_number().over(_ordered()).cast("long")
    e = events(spark, sf_dir).select("user_id", "event_id", i.alias("i")).filter("event_id % 13 <> 0")
    arrival = F.col("i") * 10000 + F.when((F.col("i") > 20) & (F.col("i") % 5 == 0), 15000).otherwise(0) + F.when(F.col("event_id") % 11 == 0, 500000).otherwise(0)
    raw = F.unhex(F.concat(F.lit("8060"), _hex((F.col("i") + 65500) % 65536, 4), _hex(F.col("i"), 8), F.lit("00000007"), _hex(F.col("event_id"), 16)))
    got = rtp.reordered(e.select("user_id", arrival.alias("arrival"), "i", raw.alias("raw")), ["user_id"], "arrival", "i", "raw")
    got = got.filter("not late").withColumn("event_id", F.conv(F.hex("payload"), 16, 10).cast("long"))
    first = F.col("number") - F.col("ts") - 65500  # numbers count from the first packet's, which may be behind the wrap
    return got.select("user_id", "n", (F.col("number") - first).alias("number"), "lost", "event_id")
