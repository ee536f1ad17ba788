"""Rational time, wrap-around, timecodes and clocks as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRAP_33 = 1 << 33


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def rescale(a: Column, b: Column | int, c: Column | int, mode: str = "near") -> Column:
    """a * b / c as a whole number. mode: zero, inf (away from zero), down, up, near (halves away from zero). Null where
    the result leaves 64 bits or c is not positive."""
    b, c = (F.lit(x) if isinstance(x, int) else x for x in (b, c))
    product = _wide(a.cast("long")) * b.cast("decimal(18,0)")
    by = c.cast("decimal(18,0)")
    size = F.abs(product)
    whole = {
        "zero": lambda: F.sign(product).cast("int") * _div(size, by),
        "inf": lambda: F.sign(product).cast("int") * _div(size + by - 1, by),
        "near": lambda: F.sign(product).cast("int") * _div(size * 2 + by, by * 2),
        "down": lambda: F.when(product < 0, -_div(size + by - 1, by)).otherwise(_div(size, by)),
        "up": lambda: F.when(product < 0, -_div(size, by)).otherwise(_div(size + by - 1, by)),
    }[mode]()
    fits = F.abs(whole) <= F.lit((1 << 63) - 1).cast("decimal(20,0)")
    return F.when((c > 0) & fits, whole.cast("decimal(38,0)").cast("long"))


def _div(x: Column, y: Column) -> Column:
    """Whole quotient of numbers that are not negative."""
    x, y = x.cast("decimal(38,0)"), y.cast("decimal(38,0)")
    return ((x - x % y) / y).cast("decimal(38,0)")


def rescale_q(pts: Column, num: Column | int, den: Column | int, out_num: Column | int, out_den: Column | int) -> Column:
    """pts in units of num/den as units of out_num/out_den, halves away from zero."""
    n, d, m, e = (F.lit(x) if isinstance(x, int) else x for x in (num, den, out_num, out_den))
    return rescale(pts, (n.cast("long") * e.cast("long")), (d.cast("long") * m.cast("long")))


def compare_times(a: Column, a_num: int, a_den: int, b: Column, b_num: int, b_den: int) -> Column:
    """-1, 0 or 1 for times in different units."""
    left, right = _wide(a) * F.lit(a_num * b_den), _wide(b) * F.lit(b_num * a_den)
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def compare_wrapped(a: Column, b: Column, modulus: int = WRAP_33) -> Column:
    """The signed distance a - b of numbers that wrap at a power of two, from -modulus/2 on."""
    d = (a - b).bitwiseAND(F.lit(modulus - 1))
    return F.when(d >= modulus // 2, d - modulus).otherwise(d)


def unwrap(df, ts: str, order: list[str], keys: list[str], modulus: int = WRAP_33):
    """Adds unwrapped: the running sum of signed distances, from the first time on."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    d = F.coalesce(compare_wrapped(F.col(ts), F.lag(ts).over(w), modulus), F.col(ts))
    return df.withColumn("_d", d).withColumn("unwrapped", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def log2_floor(x: Column) -> Column:
    """The place of the highest bit; 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x)) - 1).otherwise(F.lit(0))


def gcd_of(a: Column, b: Column) -> Column:
    """The greatest common divisor of whole numbers, by at most 92 steps of Euclid's rule; that of 0 and 0 is 0."""
    step = lambda acc, _: F.when(acc["y"] == 0, acc).otherwise(F.struct(acc["y"].alias("x"), (acc["x"] % acc["y"]).alias("y")))
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda acc: acc["x"])


def _whole(x: Column, y: Column) -> Column:
    """x / y for whole numbers that divide."""
    return _div(F.abs(x), y).cast("long") * F.when(x < 0, -1).otherwise(1)


def reduce(num: Column, den: Column) -> Column:
    """struct<num, den> in lowest terms, the sign on top."""
    g = F.greatest(gcd_of(num, den), F.lit(1))
    sign = F.when(den < 0, -1).otherwise(1)
    return F.struct((sign * _whole(num.cast("long"), g)).alias("num"), F.abs(_whole(den.cast("long"), g)).alias("den"))


def add(a: Column, b: Column) -> Column:
    return reduce(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def subtract(a: Column, b: Column) -> Column:
    return reduce(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])


def multiply(a: Column, b: Column) -> Column:
    return reduce(a["num"] * b["num"], a["den"] * b["den"])


def divide(a: Column, b: Column) -> Column:
    return reduce(a["num"] * b["den"], a["den"] * b["num"])


def nearest_rational(value: Column | float, choices: list[tuple[int, int]]) -> Column:
    """The index of the nearest of a list of fractions, the first of equals."""
    value = F.lit(value) if isinstance(value, (int, float)) else value
    far = F.array(*[F.struct(F.abs(F.lit(n / d) - value).alias("far"), F.lit(i).alias("i")) for i, (n, d) in enumerate(choices)])
    return F.array_min(far)["i"]


def add_stable(ts: Column, ts_num: int, ts_den: int, inc_num: int, inc_den: int, n: int = 1) -> Column:
    """ts, in units of ts_num/ts_den, after n steps of inc_num/inc_den, so that many small steps do not drift."""
    inc_num = inc_num * n
    m, d = inc_num * ts_den, inc_den * ts_num
    if m % d == 0:
        return ts + m // d
    if m < d:
        return ts
    old = rescale_q(ts, ts_num, ts_den, inc_num, inc_den)
    back = rescale_q(old, inc_num, inc_den, ts_num, ts_den)
    return rescale_q(old + 1, inc_num, inc_den, ts_num, ts_den) + (ts - back)


def _near(a: int, b: int, c: int) -> int:
    sign = -1 if a < 0 else 1
    return sign * ((abs(a) * b * 2 + c) // (2 * c))


def rescale_delta(df: DataFrame, ts: str, duration: str, order: list[str], keys: list[str], in_tb: tuple[int, int], fs_tb: tuple[int, int], out_tb: tuple[int, int]) -> DataFrame:
    """keys, order, ts and out_ts: each time in units of in_tb as one of out_tb, by way of the finer fs_tb: a time that is as
    near as rounding allows to the end of the row before it counts as that end, so that rounding does not add up."""
    from tidemark.operators.folds import fold

    fine = in_tb[0] * out_tb[1] > out_tb[0] * in_tb[1]
    to_fs, to_out, fs_out = ((a[0] * b[1], a[1] * b[0]) for a, b in ((in_tb, fs_tb), (in_tb, out_tb), (fs_tb, out_tb)))

    def step(last: int | None, row: tuple) -> tuple[int | None, list[tuple]]:
        t, length, *rest = row
        if last is not None and length and fine:
            low, high = ((2 * t - 1) * to_fs[0] // to_fs[1]) >> 1, (-(-(2 * t + 1) * to_fs[0] // to_fs[1]) + 1) >> 1
            if 2 * low - high <= last <= 2 * high - low:
                this = min(max(last, low), high)
                return this + length, [(*rest, t, _near(this, *fs_out))]
        return _near(t, *to_fs) + length, [(*rest, t, _near(t, *to_out))]

    kinds = dict(df.dtypes)
    out = ", ".join(f"`{c}` {kinds[c]}" for c in order) + f", `{ts}` long, out_ts long"
    return fold(df.withColumn(ts, F.col(ts).cast("long")), keys, order, [ts, duration, *order], None, step, out)


def gmt_text(ts: Column) -> Column:
    """Fri, 31 Jan 2025 10:00:00 GMT, for a session in UTC."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def timecode(frame: Column, fps: int, drop: bool = False, day: bool = True) -> Column:
    """hh:mm:ss:ff of a frame number; with drop (fps 30 or 60) two numbers a minute are skipped but each tenth, and a
    semicolon stands before the frames. Hours begin again after 24 with day, and else go on, so that the number can be told
    from the text."""
    n = frame.cast("long")
    if drop:
        skip = fps // 30 * 2
        ten, minute = fps * 600 - skip * 9, fps * 60 - skip
        d, m = F.floor(n / ten), n % ten
        n = n + skip * 9 * d + F.when(m >= skip, F.lit(skip) * F.floor((m - skip) / minute)).otherwise(F.lit(0))
    part = lambda by, of: (F.floor(n / by) % of).cast("int") if of else F.floor(n / by).cast("int")
    return F.format_string("%02d:%02d:%02d" + (";" if drop else ":") + "%02d", part(fps * 3600, 24 if day else None), part(fps * 60, 60), part(fps, 60), (n % fps).cast("int"))


def parse_timecode(text: Column, fps: int) -> Column:
    """The frame number of hh:mm:ss:ff; any other sign than a colon before the frames means that numbers are dropped, two a
    minute but each tenth. Null if the text is no timecode."""
    at = r"^\s*(\d+):(\d+):(\d+)(\D)\s*(\d+)"
    part = lambda i: F.regexp_extract(text, at, i)
    hours, minutes, seconds, frames = (part(i).cast("long") for i in (1, 2, 3, 5))
    minutes_in_all = 60 * hours + minutes
    n = (hours * 3600 + minutes * 60 + seconds) * fps + frames
    return F.when(text.rlike(at), F.when(part(4) == ":", n).otherwise(n - 2 * (minutes_in_all - F.floor(minutes_in_all / 10))))


#: What expression() lets through besides numbers, columns and + - * / % ( ) ,
EXPRESSION_FUNCTIONS = {"abs", "ceil", "cos", "exp", "floor", "greatest", "least", "ln", "log2", "pow", "round", "sign", "sin", "sqrt", "tan", "trunc"}
EXPRESSION_CONSTANTS = {"PI": math.pi, "E": math.e, "PHI": (1 + math.sqrt(5)) / 2}


def expression(text: str, names: dict[str, str]) -> Column:
    """An arithmetic expression over named columns (names: name in the text -> column) and the usual constants and functions,
    as a column expression of doubles; anything else in it raises ValueError."""
    out = []
    for number, name, sign, other in re.findall(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|([-+*/%(),])|(\S))", text):
        if other or (name and name not in names and name not in EXPRESSION_CONSTANTS and name not in EXPRESSION_FUNCTIONS):
            raise ValueError(f"not in an expression: {other or name!r}")
        if number:
            out.append(f"{number}D")
        elif name:
            out.append(f"cast(`{names[name]}` as double)" if name in names else f"{EXPRESSION_CONSTANTS[name]!r}D" if name in EXPRESSION_CONSTANTS else name)
        else:
            out.append(sign)
    return F.expr(" ".join(out))


def lyric_time(text: Column) -> Column:
    """[mm:ss.cc] as milliseconds, with a sign before the minutes if any; null if it is none."""
    at = r"^\[(-?)(\d+):(\d{2})(?:[.:](\d{1,3}))?\]"
    part = lambda i: F.regexp_extract(text, at, i)
    fraction = F.when(part(4) == "", F.lit(0)).otherwise(F.rpad(part(4), 3, "0").cast("long"))
    ms = part(2).cast("long") * 60_000 + part(3).cast("long") * 1000 + fraction
    return F.when(text.rlike(at), F.when(part(1) == "-", -ms).otherwise(ms))


def media_clock(start: Column, now: Column, system: Column, speed: Column, offset: Column) -> Column:
    return (start + (now - system) * speed - offset).cast("long")


def clock_resets(set_to: Column, clock: Column, speed: Column) -> Column:
    """Whether setting the clock has an effect: the error is over 50 ms, or over 5 s at less than half speed."""
    return F.abs(set_to - clock) > F.when(speed < 0.5, 5000).otherwise(50)
