"""Joins along time: as-of, nearest, tolerance, keyed lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(main: DataFrame, second: DataFrame, keys: list[str], ts: str, tie: str, columns: list[str], before: str = "null", after: str = "infinity", shortest: bool = False) -> DataFrame:
    """Each main row with the last row of the second stream at or before it (s_ columns); one exchange for both.

    before: what main rows get ahead of the second stream's first row: "null", "infinity" (that first row), or "stop"
    (they are dropped). after, past its last row: "infinity" repeats it, "null" gives nulls, "stop" ends the output.
    shortest is after="stop". Equal times match. The rule for equal times of the second stream is its later tie.
    """
    after = "stop" if shortest else after
    side = [F.col(k) for k in keys]
    row = lambda *c: F.struct(*[F.col(x) for x in c])
    a = main.select(*side, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), row(*main.columns).alias("_m"), F.lit(None).cast(second.select(row(ts, *columns).alias("x")).schema[0].dataType).alias("_s"))
    b = second.select(*side, F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(a.schema["_m"].dataType).alias("_m"), row(ts, *columns).alias("_s"))
    both = a.unionByName(b)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie")
    both = both.withColumn("_found", F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys)
    both = both.withColumn("_end", F.max(F.when(F.col("_side") == 0, F.col("_t"))).over(whole))
    if before == "infinity":
        both = both.withColumn("_first", F.first("_s", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        both = both.withColumn("_found", F.coalesce("_found", "_first"))
    out = both.filter("_side = 1")
    if before == "stop":
        out = out.filter(F.col("_found").isNotNull())
    past = F.col("_t") > F.col("_end")
    if after == "stop":
        out = out.filter(~past)
    elif after == "null":
        out = out.withColumn("_found", F.when(past, F.lit(None)).otherwise(F.col("_found")))
    return out.select("_m.*", F.col(f"_found.{ts}").alias(f"s_{ts}"), *[F.col(f"_found.{c}").alias(f"s_{c}") for c in columns])


def asof_by_ranges(main: DataFrame, second: DataFrame, keys: list[str], ts: str, tie: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """asof() with nulls ahead of the second stream's first row and its last one repeated, for keys of any size, or none: the
    rows of both are dealt by ranges of key and time, of which the last second row goes on to the next. (ts, tie) must be
    unique within a key and stream."""
    from tidemark.operators import scans

    row = lambda *c: F.struct(*[F.col(x) for x in c])
    a = main.select(*keys, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), row(*main.columns).alias("_m"), F.lit(None).cast(second.select(row(ts, *columns).alias("x")).schema[0].dataType).alias("_s"))
    b = second.select(*keys, F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(a.schema["_m"].dataType).alias("_m"), row(ts, *columns).alias("_s"))
    found = scans.last_known(a.unionByName(b), keys, ["_t", "_side", "_tie"], "_s", "_found", parts).filter("_side = 1")
    return found.select("_m.*", F.col(f"_found.{ts}").alias(f"s_{ts}"), *[F.col(f"_found.{c}").alias(f"s_{c}") for c in columns])


def within(main: DataFrame, second: DataFrame, keys: list[str], ts: str, tie: str, columns: list[str], tolerance: int) -> DataFrame:
    """As-of, but a match older than the tolerance counts for nothing."""
    found = asof(main, second, keys, ts, tie, columns)
    near = F.col(ts) - F.col(f"s_{ts}") <= tolerance
    return found.select(*main.columns, *[F.when(near, F.col(f"s_{c}")).alias(f"s_{c}") for c in (ts, *columns)])


def neighbours(queries: DataFrame, items: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """For each query the greatest item value not above it (below_at) and the least one not under it (above_at)."""
    q = queries.select(*keys, F.col(at).alias("_v"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"))
    i = items.select(*keys, F.col(at).alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast(q.schema["_tie"].dataType).alias("_tie"))
    both = q.unionByName(i)
    item = F.when(F.col("_side") == 0, F.col("_v"))
    w = Window.partitionBy(*keys).orderBy("_v")
    below = F.max(item).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.min(item).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return both.withColumn("below_at", below).withColumn("above_at", above).filter("_side = 1").select(*keys, F.col("_v").alias(at), F.col("_tie").alias(tie), "below_at", "above_at")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys; Spark broadcasts the table if its size allows."""
    return rows.join(table, keys, "left")


def align(inputs: list[DataFrame], keys: list[str], ts: str, tie: str, columns: list[str], levels: list[int] | None = None, before: list[str] | None = None, after: list[str] | None = None) -> DataFrame:
    """Frames of several inputs at the times of those with the highest sync level: keys, ts, and for input i the columns
    i_ts and i_... of its last row at or before that time; one exchange for all inputs.

    levels: by default the first input alone drives. before and after, for each input: "null" (nothing ahead of its first or
    past its last row), "infinity" (its first or last row instead), or "stop" (no output there); by default null and
    infinity. Several rows of one input at one time: the last by tie counts. One output for each time.
    """
    n = len(inputs)
    levels, before, after = levels or [1] + [0] * (n - 1), before or ["null"] * n, after or ["infinity"] * n
    rows = [d.select(*keys, F.col(ts).alias("_t"), F.lit(i).alias("_i"), F.struct(F.col(ts).alias("t"), F.col(tie).alias("tie"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]).alias("_r")) for i, d in enumerate(inputs)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    whole = Window.partitionBy(*keys)
    so_far = whole.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = lambda i: F.when(F.col("_i") == i, F.col("_r"))
    both = both.withColumns({f"_found{i}": F.max(own(i)).over(so_far) for i in range(n)} | {f"_first{i}": F.min(own(i)).over(whole) for i in range(n)} | {f"_end{i}": F.max(F.when(F.col("_i") == i, F.col("_t"))).over(whole) for i in range(n)})
    drivers = [i for i in range(n) if levels[i] == max(levels)]
    out = both.filter(F.col("_i").isin(drivers)).dropDuplicates([*keys, "_t"])
    made = []
    for i in range(n):
        found, past = F.col(f"_found{i}"), F.coalesce(F.col("_t") > F.col(f"_end{i}"), F.lit(False))
        if before[i] == "stop":
            out = out.filter(found.isNotNull())
        if after[i] == "stop":
            out = out.filter(~past)
        value = F.coalesce(found, F.col(f"_first{i}")) if before[i] == "infinity" else found
        value = F.when(~past, value) if after[i] == "null" else value
        made += [value["t"].alias(f"{i}_{ts}"), *[value[f"c{k}"].alias(f"{i}_{c}") for k, c in enumerate(columns)]]
    return out.select(*keys, F.col("_t").alias(ts), *made)
