"""Ordered-stream operators. Every result has an explicit sequence column, and every order a unique last column.

With `keys` a stream is each key's rows, and all work is one exchange on the keys. Without keys the whole table is one
stream; its positions come from sorted ranges whose sizes are summed, so no task holds more than a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.folds import fold
from tidemark.storage import materialize

def positions(df: DataFrame, order: list[str], keys: list[str] | None = None, name: str = "seq", parts: int | None = None) -> DataFrame:
    """Adds each row's place, from 1, in its key's order, or in the order of the whole table.

    Without keys the rows are dealt by ranges of the whole order, so equal times are parted by what breaks the tie, and
    each range is sorted and numbered where it lies. The ranges are a written table: their sizes and their rows must come
    from the same cuts, and lost tasks must not deal them again. `parts` is how many there are, by default as many as the
    session's shuffles have. With keys a key is one task's work; scans.numbered() does the same by ranges.
    """
    if keys:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    part, nth, before = "_range_part", "_range_nth", "_range_before"
    if clash := {part, nth, before} & set(df.columns):
        raise ValueError(f"columns with names of this operator: {sorted(clash)}")
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition above 33 bits that count its rows in order
    dealt = materialize(dealt.withColumn(nth, at).select(*df.columns, F.shiftright(nth, 33).alias(part), (F.col(nth).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(nth)), "ranges")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select(part, F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias(before))
    return dealt.join(F.broadcast(offsets), part).select(*df.columns, (F.col(before) + F.col(nth)).cast("long").alias(name))


def merge_tagged(df: DataFrame, ts: str, input_idx: Column, tie: str, name: str = "seq") -> DataFrame:
    """interleave() for streams that lie in one table, read once: input_idx tells the input; rows where it is null are in none."""
    tagged = df.filter(F.col(ts).isNotNull()).withColumn("input_idx", input_idx).filter("input_idx is not null")
    return positions(tagged, [ts, "input_idx", tie], name=name)


def interleave(streams: list[DataFrame], ts: str, tie: str, name: str = "seq") -> DataFrame:
    """Ordered merge: the smallest time first, then the lowest input; rows without a time are dropped."""
    tagged = [s.filter(F.col(ts).isNotNull()).withColumn("input_idx", F.lit(i)) for i, s in enumerate(streams)]
    return positions(reduce(DataFrame.unionByName, tagged), [ts, "input_idx", tie], name=name)


def concatenate(items: list[DataFrame], ts: str, durations: list[int] | None = None) -> DataFrame:
    """Items one after another: adds item and, with durations, shifts times by what came before."""
    starts = [sum((durations or [0] * len(items))[:i]) for i in range(len(items))]
    moved = [d.withColumn("item", F.lit(i)).withColumn(ts, F.col(ts) + F.lit(s)) for i, (d, s) in enumerate(zip(items, starts, strict=True))]
    return reduce(DataFrame.unionByName, moved)


def fan_out(df: DataFrame, n: int) -> list[DataFrame]:
    """The stream, n times over; Spark reuses the exchange below."""
    return [df] * n


def explode_channels(df: DataFrame, channels: str) -> DataFrame:
    """One row for each channel of an array column: channel, sample."""
    return df.select(*[c for c in df.columns if c != channels], F.posexplode(channels).alias("channel", "sample"))


def step(df: DataFrame, order: list[str], n: int, keys: list[str] | None = None) -> DataFrame:
    """Rows 0, n, 2n, ... of each stream."""
    return positions(df, order, keys).filter((F.col("seq") - 1) % n == 0)


def seek(df: DataFrame, ts: str, at: int) -> DataFrame:
    return df.filter(F.col(ts) >= at)


def first_at_or_after(df: DataFrame, ts: str, at: int, tie: str, keys: list[str] | None = None) -> DataFrame:
    """The first row at or after a time, of each key or of all."""
    later = seek(df, ts, at)
    if not keys:
        return later.orderBy(ts, tie).limit(1)
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(ts, tie))
    return later.groupBy(*keys).agg(first.alias("r")).select("r.*")


def reverse(df: DataFrame, order: list[str], payload: list[str], keys: list[str], arrays: bool = False) -> DataFrame:
    """Payload in reverse, times as they are; with `arrays` each payload array is reversed inside too."""
    placed = positions(df, order, keys)
    n = F.count("*").over(Window.partitionBy(*keys))
    kept = placed.drop(*payload)
    inner = {c for c, kind in df.dtypes if arrays and kind.startswith("array")}
    turned = placed.withColumn("seq", (n - F.col("seq") + 1).cast("long")).select(*keys, "seq", *[(F.reverse(c) if c in inner else F.col(c)).alias(c) for c in payload])
    return kept.join(turned, [*keys, "seq"])


def permute(df: DataFrame, order: list[str], payload: list[str], mapping: str, keys: list[str]) -> DataFrame:
    """Within batches as long as the mapping ("0 2 1" or "0|2|1") place p gets the payload of place mapping[p]; times
    stay. A last, shorter batch keeps its order. A place of -1 drops the row."""
    to = [int(x) for x in mapping.replace("|", " ").split()]
    n = len(to)
    if not to or any(x >= n for x in to):
        raise ValueError(f"not a mapping: {mapping!r}")
    placed = positions(df, order, keys).withColumn("batch", F.expr(f"(seq - 1) div {n}")).withColumn("place", ((F.col("seq") - 1) % n).cast("int"))
    full = F.count("*").over(Window.partitionBy(*keys, "batch")) == n
    placed = placed.withColumn("source", F.when(full, F.element_at(F.array(*[F.lit(x) for x in to]), F.col("place") + 1)).otherwise(F.col("place"))).filter("source >= 0")
    source = positions(df, order, keys).select(*keys, F.expr(f"(seq - 1) div {n}").alias("batch"), ((F.col("seq") - 1) % n).cast("int").alias("source"), *payload)
    return placed.drop(*payload).join(source, [*keys, "batch", "source"]).drop("source")


def random_in_batches(df: DataFrame, order: list[str], payload: list[str], size: int, seed: int, keys: list[str]) -> DataFrame:
    """Payload in a random order, that of a digest of seed, keys and place, inside batches of `size`; times ascending."""
    placed = positions(df, order, keys).withColumn("batch", F.expr(f"(seq - 1) div {size}"))
    at = F.row_number().over(Window.partitionBy(*keys, "batch").orderBy("seq"))
    drawn = F.row_number().over(Window.partitionBy(*keys, "batch").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("seq").cast("string"))), "seq"))
    source = placed.select(*keys, "batch", drawn.alias("place"), *payload)
    return placed.drop(*payload).withColumn("place", at).join(source, [*keys, "batch", "place"]).drop("place")


def rebatch(df: DataFrame, order: list[str], value: str, n: int, keys: list[str], pad: object | None = 0) -> DataFrame:
    """Arrays of n values in order; the last is padded, or with pad None left short."""
    placed = positions(df, order, keys).withColumn("batch", F.expr(f"(seq - 1) div {n}"))
    got = placed.groupBy(*keys, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(value).alias("v")))), lambda x: x["v"]).alias("samples"), F.count("*").alias("n_real"))
    if pad is None:
        return got
    return got.withColumn("samples", F.concat("samples", F.array_repeat(F.lit(pad).cast(dict(df.dtypes)[value]), F.lit(n) - F.size("samples"))))


def tile(df: DataFrame, order: list[str], value: str, n: int, keys: list[str]) -> DataFrame:
    """n successive rows as one; a short last tile is kept."""
    return rebatch(df, order, value, n, keys, None)


def pad_tail(df: DataFrame, order: list[str], value: str, keys: list[str], pad: object = 0, pad_rows: int | None = None, whole_rows: int | None = None) -> DataFrame:
    """Rows of `pad` at each stream's end: pad_rows more, or up to whole_rows in all."""
    placed = positions(df, order, keys).select(*keys, "seq", value, F.lit(False).alias("padded"))
    n = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    to = F.col("n") + pad_rows if pad_rows is not None else F.greatest("n", F.lit(whole_rows))
    more = n.filter(to > F.col("n")).select(*keys, F.explode(F.sequence(F.col("n") + 1, to)).alias("seq"))
    return placed.unionByName(more.select(*keys, "seq", F.lit(pad).cast(dict(df.dtypes)[value]).alias(value), F.lit(True).alias("padded")))


def delay(df: DataFrame, order: list[str], value: str, k: int, keys: list[str], fill: object = 0) -> DataFrame:
    """The value k rows before."""
    placed = positions(df, order, keys)
    return placed.withColumn("delayed", F.lag(value, k, fill).over(Window.partitionBy(*keys).orderBy("seq")))


def zip_streams(left: DataFrame, right: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The i-th row with the i-th, until either ends; the right one's columns get the prefix r_."""
    a, b = positions(left, order, keys), positions(right, order, keys)
    on = [*(keys or []), "seq"]
    return a.join(b.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on]), on)


def pick_field(df: DataFrame, order: list[str], parity: int, keys: list[str]) -> DataFrame:
    """Every second row: the even ones for parity 0, the odd ones for 1."""
    return positions(df, order, keys).filter((F.col("seq") - 1) % 2 == parity)


def separate_fields(df: DataFrame, column: str) -> DataFrame:
    """A row for the even and a row for the odd elements of an array."""
    halves = F.array(*[F.filter(F.col(column), lambda x, i: i % 2 == p) for p in (0, 1)])
    return df.select(*[c for c in df.columns if c != column], F.posexplode(halves).alias("field", column))


def interpolate_times(df: DataFrame, order: list[str], ts: str, keys: list[str], limit: int | None = None) -> DataFrame:
    """Fills null times between two known ones in equal whole steps, up or down; step = |end - last| / (n + 1). Gaps at
    the ends, and with `limit` longer gaps, stay null; the original remembers 128 rows."""
    placed = positions(df, order, keys)
    back = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(ts).isNotNull(), F.struct(F.col("seq").alias("q"), F.col(ts).alias("t")))
    placed = placed.withColumn("_a", F.last(known, True).over(back)).withColumn("_b", F.first(known, True).over(ahead))
    gap = F.col("_b.q") - F.col("_a.q")
    by = F.expr("abs(_b.t - _a.t) div (_b.q - _a.q)")
    k = F.col("seq") - F.col("_a.q")
    filled = F.when(F.col("_b.t") > F.col("_a.t"), F.col("_a.t") + by * k).otherwise(F.col("_a.t") - by * k)
    inside = F.col("_a").isNotNull() & F.col("_b").isNotNull() & ((gap - 1 <= limit) if limit is not None else F.lit(True))
    return placed.withColumn("filled_ts", F.coalesce(F.col(ts), F.when(inside, filled))).drop("_a", "_b")


def smooth_jitter(df: DataFrame, order: list[str], ts: str, keys: list[str], cycle: int = 4) -> DataFrame:
    """Removes the judder of a repeating cadence: of each stream the times t become new times in units of 1/(2*cycle).

    The first cycle + 2 times only scale. A later one adds (cycle+1) times its distance from the time `cycle` rows before
    it, less (cycle-1) times the distance between the rows 1 and cycle + 1 before it: over a whole cadence this is steady.
    A time before all that is remembered shifts the memory. Each key's times are read one after another, and only the last
    cycle + 2 of them are held.
    """
    size = cycle + 2

    def step(state: tuple[tuple[int, ...], int, int], row: tuple) -> tuple[tuple, list[tuple]]:
        ring, n, new = state  # ring: the last `size` times, oldest first
        t = row[0]
        if n < size:
            new, ring = t * 2 * cycle, (*ring, t)
        else:
            if t < ring[0]:
                shift = t + ring[1] - ring[2] - ring[-1]
                ring = tuple(x + shift for x in ring)
            new += (ring[1] - ring[-1]) * (cycle - 1) + (t - ring[2]) * (cycle + 1)
            ring = (*ring[1:], t)
        return (ring, n + 1, new), [(n + 1, t, new)]

    times = df.filter(F.col(ts).isNotNull()).withColumn("_t", F.col(ts).cast("long"))
    return fold(times, keys, order, ["_t"], ((), 0, 0), step, "seq long, ts long, new_ts long")


def byte_slice(content: Column, start: int, end: int) -> Column:
    """Bytes [start, end) of a binary column."""
    if end <= start:
        raise ValueError("the end must come after the start")
    return F.substring(content, start + 1, end - start)
