"""Registered queries of scans by ranges, over the lines of orders as one long stream a return flag: three keys, one of which has
half of all rows. With their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import samples
from tidemark.operators import pictures, scans, sync
from tidemark.queries import E_SQL, events, query, table

L_SQL = "l as (select l_returnflag as flag, l_orderkey as o, l_linenumber as n, l_partkey as p, l_suppkey as s, cast(l_quantity as bigint) as x, cast(round(l_extendedprice * 100) as bigint) as cents from lineitem)"


def lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("x"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))


#: An order may have a line number twice, so its part and price tell its lines apart.
KEYS, ORDER = ["flag"], ["o", "n", "p", "s", "cents", "x"]


@query(f"with {L_SQL} select flag, o, n, row_number() over (partition by flag order by o, n, p, s, cents, x) as seq from l")
def numbered_lines(spark, sf_dir):
    return scans.numbered(lines(spark, sf_dir), KEYS, ORDER).select("flag", "o", "n", "seq")


@query(f"with {L_SQL} select flag, o, n, cast(round(1000000 * list_sum([v * power(0.5, len(w) - i) for v, i in w])) as bigint) as y from (select flag, o, n, list(x) over (partition by flag order by o, n, p, s, cents, x rows between 70 preceding and current row) as w from l)".replace("list_sum([v * power(0.5, len(w) - i) for v, i in w])", "list_sum(list_transform(w, lambda v, i: v * power(0.5, len(w) - i)))"))
def smoothed_lines(spark, sf_dir):
    """y = x + y before / 2: what lies 70 rows back adds less than a double holds."""
    got = scans.linear_filter(lines(spark, sf_dir), KEYS, ORDER, "x", [1.0], [-0.5])
    return got.select("flag", "o", "n", F.round(F.col("y") * 1000000).cast("long").alias("y"))


TAPS = [3, -1, 4, 1, -5, 9, 2, -6]


@query(f"with {L_SQL} select flag, o, n, cast({' + '.join(f'{t} * coalesce(lag(x, {k}) over (partition by flag order by o, n, p, s, cents, x), 0)' for k, t in enumerate(TAPS))} as bigint) as y from l")
def convolved_lines(spark, sf_dir):
    got = scans.convolve(lines(spark, sf_dir), KEYS, ORDER, "x", [float(t) for t in TAPS])
    return got.select("flag", "o", "n", F.round("y").cast("long").alias("y"))


@query(f"""with {L_SQL}, p as (select *, row_number() over (partition by flag order by o, n, p, s, cents, x) - 1 as i from l), d as (select *, 3 * (1 + sin(2 * pi() * (i % 12) / 12)) as delay, list(x) over (partition by flag order by o, n, p, s, cents, x rows between 7 preceding and current row) as w from p),
r as (select *, cast(floor(delay + 1e-9) as integer) as k, delay - floor(delay + 1e-9) as part from d) select flag, o, n, cast(round(1000 * ((1 - part) * coalesce(w[len(w) - k], 0) * cast(len(w) > k as integer) + part * coalesce(w[len(w) - k - 1], 0) * cast(len(w) > k + 1 as integer))) as bigint) as y from r""")
def swinging_lines(spark, sf_dir):
    """The quantities read up to six rows back, twelve rows a swing."""
    got = scans.vibrato(lines(spark, sf_dir), KEYS, ORDER, "x", 12, 3.0)
    return got.select("flag", "o", "n", F.round(F.col("y") * 1000).cast("long").alias("y"))


@query("""with l as (select l_returnflag as flag, l_shipdate as day, l_orderkey as o, l_linenumber as n, l_partkey as p, l_suppkey as s from lineitem), q as (select o_orderkey as id, o_orderdate as day, ['A', 'N', 'R'][o_orderkey % 3 + 1] as flag from orders),
s as (select flag, day, 1 as side, o, n, p, s, null as id from l union all select flag, day, 0, id, 0, 0, 0, id from q)
select flag, o, n, p, s, order_id from (select *, last_value(id ignore nulls) over (partition by flag order by day, side, o, n, p, s rows unbounded preceding) as order_id from s) where side = 1""")
def orders_before_lines(spark, sf_dir):
    """For each shipped line the last order of its stream at or before its day: as-of over keys that are a third of all rows each."""
    none = F.lit(0).cast("long")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("day"), F.lit(1).alias("side"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.lit(None).cast("long").alias("id"))
    key = F.element_at(F.array(*[F.lit(x) for x in "ANR"]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    order = table(spark, sf_dir, "orders").select(key.alias("flag"), F.col("o_orderdate").alias("day"), F.lit(0).alias("side"), F.col("o_orderkey").alias("o"), none.alias("n"), none.alias("p"), none.alias("s"), F.col("o_orderkey").alias("id"))
    got = scans.last_known(line.unionByName(order), KEYS, ["day", "side", "o", "n", "p", "s"], "id", "order_id")
    return got.filter("side = 1").select("flag", "o", F.col("n").cast("int").alias("n"), "p", "s", "order_id")


@query("""with p as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value from (select event_id, ts, user_id, cast(round(value * 100) as bigint) as value from events)), f as (select user_id, i // 64 as frame, i % 64 as k, value from p),
c as (select *, k + 0.0 as i from f) select user_id, frame, cast(sum(value * round(1000000 * (0.5 - 0.5 * cos(2 * pi() * k / 63)))) as bigint) as hann, cast(sum(value * round(1000000 * (0.54 - 0.46 * cos(2 * pi() * k / 63)))) as bigint) as hamming from c group by 1, 2""")
def windowed_frames(spark, sf_dir):
    """Each user's values in frames of 64 under two windows, whose coefficients are whole millionths here."""


    from tidemark.functions import windows

    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = e.select("user_id", F.floor(i / 64).alias("frame"), (i % 64).cast("long").alias("k"), "v")
    weighed = lambda name: F.sum(F.col("v") * F.round(windows.coefficient(name, F.col("k"), 64) * 1000000)).cast("long")
    return rows.groupBy("user_id", "frame").agg(weighed("hann").alias("hann"), weighed("hamming").alias("hamming"))


V_SQL = "v as (select vec_id, [cast(floor(least(greatest(cast(x as double) * 100 + 128, 0), 255)) as bigint) for x in embedding] as b from embeddings where len(embedding) = 64)"


def _grids(spark, sf_dir):
    """The vectors as pictures of 8 by 8 bytes."""
    level = lambda x: F.floor(F.least(F.greatest(x.cast("double") * 100 + 128, F.lit(0.0)), F.lit(255.0))).cast("long")
    b = F.transform("embedding", level)
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select("vec_id", b.alias("b"), F.unhex(F.array_join(F.transform(b, lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("y"))


@query(f"""with {V_SQL}, p as (select vec_id, r, c, b[r * 8 + c + 1] as y, b[r // 2 * 4 + c // 2 + 1] - 128 as u, b[16 + r // 2 * 4 + c // 2 + 1] - 128 as v from v, range(8) a(r), range(8) d(c)), k as (select *, (y - 16) * {pictures.LUMA} as l from p)
select vec_id, string_agg(printf('%02X%02X%02XFF', least(greatest((l + v * {pictures.RED_V}) >> 20, 0), 255), least(greatest((l - v * {pictures.GREEN_V} - u * {pictures.GREEN_U}) >> 20, 0), 255), least(greatest((l + u * {pictures.BLUE_U}) >> 20, 0), 255)), '' order by c, 7 - r) as turned from k group by 1""")
def turned_colours(spark, sf_dir):
    """The pictures, with colours from their own first bytes, as pixels and turned by 90 degrees."""
    g = _grids(spark, sf_dir).withColumn("p", F.concat("y", F.expr("substring(y, 1, 16)"), F.expr("substring(y, 17, 16)")))
    return g.select("vec_id", F.hex(pictures.turned(pictures.rgba_of(F.col("p"), F.lit(8), F.lit(8)), F.lit(8), F.lit(8), 90, 4)).alias("turned"))


@query(f"""with {V_SQL}, d as (select a.vec_id, r, c, sum(abs(a.b[(r + i) * 8 + c + j + 1] - s.b[i * 8 + j + 1])) as diff from v a join v s on s.vec_id = a.vec_id + 1, range(6) x(r), range(6) y(c), range(3) z(i), range(3) w(j) group by 1, 2, 3)
select vec_id, cast(r as integer) as row, cast(c as integer) as column, cast(diff as bigint) as difference from (select *, row_number() over (partition by vec_id order by diff, r, c) as k from d) where k = 1""")
def found_corners(spark, sf_dir):
    """Where the corner of 3 by 3 of the next picture fits best in each."""
    g = _grids(spark, sf_dir)
    corner = F.concat(*[F.expr(f"substring(y, {i * 8 + 1}, 3)") for i in range(3)])
    small = g.select((F.col("vec_id") - 1).alias("vec_id"), corner.alias("s"))
    place = pictures.found_in(F.col("y"), F.lit(8), F.lit(8), F.col("s"), F.lit(3), F.lit(3))
    return g.join(small, "vec_id").select("vec_id", place.alias("f")).select("vec_id", "f.*")


@query(f"""with {V_SQL}, s as (select vec_id, [x * 400 - 51200 for x in b] as w from v), m as (select vec_id, [least(greatest(w[2 * i + 1] + w[2 * i + 2], -32768), 32767) for i in range(32)] as m, [w[2 * i + 2] >> 8 for i in range(32)] as e from (select vec_id, [least(greatest(x, -32768), 32767) for x in w] as w from s))
select vec_id, array_to_string(m, ',') as mixed, array_to_string([x + 128 for x in e], ',') as bytes from m""")
def mixed_samples(spark, sf_dir):
    """The vectors as interleaved samples of two channels: both mixed into one, and the second in bytes."""
    wide = F.transform("b", lambda x: F.least(F.greatest(x * 400 - 51200, F.lit(-32768)), F.lit(32767)).cast("long"))
    g = _grids(spark, sf_dir).withColumn("planes", samples.planar(wide, 2))
    mono = F.get(samples.mixed(F.col("planes"), [[1.0, 1.0]], 16), F.lit(0))
    return g.select("vec_id", F.array_join(mono.cast("array<string>"), ",").alias("mixed"), F.array_join(samples.converted(F.get("planes", F.lit(1)), "s16", "u8").cast("array<string>"), ",").alias("bytes"))


@query(f"""with recursive {E_SQL}, p as (select user_id, event_id, row_number() over (partition by user_id order by us, event_id) as i, 1024 + cents % 7 as d, sum(case when event_id % 17 = 0 then 1 else 0 end) over (partition by user_id order by us, event_id) as jumps, sum(1024 + cents % 7) over (partition by user_id order by us, event_id) as till from e),
t as (select user_id, event_id, i, d, cast((till - d) * 25 // 44100 + 40 * jumps as bigint) as t from p),
r(user_id, i, event_id, t, own, due) as (select user_id, i, event_id, t, (t * 40)::bigint, (t * 1764 + d)::bigint from t where i = 1
  union all select t.user_id, t.i, t.event_id, t.t, case when near then (this * 2000 + 44100) // 88200 else t.t * 40 end, case when near then this + t.d else t.t * 1764 + t.d end
  from (select t.*, (2 * t.t - 1) * 882 * 2 - (2 * t.t + 1) * 882 <= r.due and r.due <= (2 * t.t + 1) * 882 * 2 - (2 * t.t - 1) * 882 as near, least(greatest(r.due, (2 * t.t - 1) * 882), (2 * t.t + 1) * 882) as this from r join t on t.user_id = r.user_id and t.i = r.i + 1) t)
select user_id, event_id, t, cast(own as bigint) as out_ts from r""")
def audio_times(spark, sf_dir):
    """Packets of some 1,024 samples, whose times in twenty-fifths of a second say little: by way of their lengths they become
    even milliseconds, but for jumps that no rounding explains."""
    from tidemark.functions import timemath

    e = events(spark, sf_dir)
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    d = F.lit(1024) + F.col("cents") % 7
    jumps = F.sum((F.col("event_id") % 17 == 0).cast("long")).over(order)
    rows = e.select("user_id", "us", "event_id", d.alias("d"), (F.sum(d).over(order) - d).alias("since"), jumps.alias("jumps"))
    rows = rows.withColumn("t", F.expr("since * 25 div 44100 + 40 * jumps"))
    return timemath.rescale_delta(rows, "t", "d", ["us", "event_id"], ["user_id"], (1, 25), (1, 44100), (1, 1000)).select("user_id", "event_id", "t", "out_ts")


@query(f"""with {E_SQL}, x as (select event_id, event_id * 37 % 250000 as f from e), s as (select *, f // 17982 as tens, f % 17982 as left_ from x), n as (select *, f + 18 * tens + case when left_ >= 2 then 2 * ((left_ - 2) // 1798) else 0 end as g from s)
select event_id, f as frame, printf('%02d:%02d:%02d;%02d', g // 108000 % 24, g // 1800 % 60, g // 30 % 60, g % 30) as code, f as back, cast(round(power(sin(event_id / 100.0), 2) * 1000 + case when f > 1000 then 7 else event_id % 5 end) as bigint) as value from n""")
def drop_frame_codes(spark, sf_dir):
    """Timecodes of thirty frames a second that leave numbers out, there and back; and an expression of two variables."""
    from tidemark.functions import timemath

    f = F.col("event_id") * 37 % 250000
    code = timemath.timecode(F.col("f"), 30, drop=True)
    value = timemath.expression("pow(sin(n / 100), 2) * 1000", {"n": "event_id"})
    more = F.when(F.col("f") > 1000, F.lit(7)).otherwise(F.col("event_id") % 5)
    return events(spark, sf_dir).withColumn("f", f).select("event_id", F.col("f").alias("frame"), code.alias("code"), timemath.parse_timecode(code, 30).alias("back"), F.round(value + more).cast("long").alias("value"))


@query(f"""with {E_SQL}, p as (select * from e where event_type = 'purchase'), v as (select * from e where event_type <> 'purchase'), s as (select us, 1 as side, event_id, null as other, null as other_us from p union all select us, 0, event_id, event_id, us from v)
select event_id, s_event_id, s_us from (select side, event_id, last_value(other ignore nulls) over w as s_event_id, last_value(other_us ignore nulls) over w as s_us from s window w as (order by us, side, event_id rows unbounded preceding)) where side = 1""")
def asof_one_stream(spark, sf_dir):
    """Each purchase with the last other event of anyone at or before it: one stream without keys."""
    e = events(spark, sf_dir).select("event_id", "us", "event_type")
    got = sync.asof_by_ranges(e.filter("event_type = 'purchase'"), e.filter("event_type != 'purchase'"), [], "us", "event_id", ["event_id"])
    return got.select("event_id", "s_event_id", "s_us")


@query(f"""with {E_SQL}, a as (select user_id, us, event_id from e where event_type = 'purchase'), b as (select user_id, us, event_id from e where event_type = 'view'), c as (select user_id, us, event_id from e where event_type = 'click'), t as (select user_id, us from a union select user_id, us from c),
ends as (select t.user_id, max(a.us) as a_end, max(c.us) as c_end from t left join a on a.user_id = t.user_id and a.us = t.us left join c on c.user_id = t.user_id and c.us = t.us group by 1), f as (select user_id, arg_min(event_id, us) as first_view from b group by 1)
select t.user_id, t.us, case when t.us <= a_end then a.event_id end as "0_event_id", coalesce(b.event_id, first_view) as "1_event_id", c.event_id as "2_event_id"
from t join ends using (user_id) asof left join a on t.user_id = a.user_id and t.us >= a.us asof left join b on t.user_id = b.user_id and t.us >= b.us asof left join c on t.user_id = c.user_id and t.us >= c.us left join f on f.user_id = t.user_id where coalesce(t.us <= c_end, true)""")
def aligned_levels(spark, sf_dir):
    """Two inputs of the highest level drive the output and end it each in its own way; the one between them is repeated at both ends."""
    e = events(spark, sf_dir).select("user_id", "us", "event_id", "event_type")
    parts = [e.filter(F.col("event_type") == t) for t in ("purchase", "view", "click")]
    got = sync.align(parts, ["user_id"], "us", "event_id", ["event_id"], levels=[2, 1, 2], before=["null", "infinity", "null"], after=["null", "infinity", "stop"])
    return got.select("user_id", "us", "0_event_id", "1_event_id", "2_event_id")
