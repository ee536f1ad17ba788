"""Fold-style statistics over streams and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timeline import positions

FULL_SCALE = 1 << 30
MOST_DB = 91


def decibels(power: Column) -> Column:
    """-10 log10(power / 2^30); 91 for no power."""
    return F.when(power == 0, F.lit(float(MOST_DB))).otherwise(-10 * F.log10(power.cast("double") / F.lit(float(FULL_SCALE))))


def value_histogram(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))


def volume(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Of each key the number of samples, their mean power (a rounded whole number) and the largest magnitude: folded
    from the histogram, so that an exchange carries a row for each distinct value."""
    counts = value_histogram(df, value, keys)
    square = (F.col("v").cast("long") * F.col("v").cast("long")).cast("decimal(38,0)")
    out = counts.groupBy(*keys).agg(F.sum("n").alias("n_samples"), F.sum(square * F.col("n")).cast("decimal(38,0)").alias("energy"), F.max(F.abs("v")).cast("long").alias("max_volume"))
    return out.select(*keys, "n_samples", F.expr("cast((energy + n_samples div 2) div n_samples as bigint)").alias("mean_power"), "max_volume")


def level_bins(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Samples for each whole decibel below full scale, from the loudest until a thousandth of all is counted."""
    counts = value_histogram(df, value, keys)
    bins = counts.groupBy(*keys, F.floor(decibels(F.col("v").cast("long") * F.col("v").cast("long"))).cast("int").alias("db")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(w.orderBy("db").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bins.withColumn("_b", before).withColumn("_t", F.sum("n").over(w)).filter(F.expr("_b = 0 or _b < _t div 1000")).drop("_b", "_t")


def annotate_share(df: DataFrame, keys: list[str], hit: Column, amount: int) -> DataFrame:
    """Of each group the whole percentage of rows that hit, and it again as a mark if it is `amount` or more; no group is dropped."""
    got = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("n_hit"))
    share = F.expr("n_hit * 100 div n")
    return got.select(*keys, "n", share.alias("percent"), F.when(share >= amount, share).alias("mark"))


def bounding_box(df: DataFrame, keys: list[str], x: str, y: str, hit: Column) -> DataFrame:
    """Least and greatest x and y of the rows that hit; nulls where none does."""
    low = lambda c: F.min(F.when(hit, F.col(c)))
    high = lambda c: F.max(F.when(hit, F.col(c)))
    return df.groupBy(*keys).agg(low(x).alias("x_min"), high(x).alias("x_max"), low(y).alias("y_min"), high(y).alias("y_max"))


def representative(df: DataFrame, order: list[str], vector: str, id_col: str, n: int, keys: list[str]) -> DataFrame:
    """Of every n rows in order the one nearest to their mean vector, the first of equals; the last batch may be short.

    A batch of at most n vectors of one length is one group; errors count as equal where they are to nine digits.
    """
    import numpy as np
    import pyarrow as pa

    placed = positions(df, order, keys or None).withColumn("batch", F.expr(f"(seq - 1) div {n}"))
    rows = placed.select(*keys, "batch", "seq", id_col, F.col(vector).cast("array<double>").alias("_v"))
    kinds = dict(rows.dtypes)
    width = len(keys)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq").combine_chunks()
        x = _matrix(group["_v"])
        away = x - x.mean(axis=0)
        best = int(np.argmin(np.round(np.einsum("ij,ij->i", away, away), 9)))
        row = group.slice(best, 1)
        return pa.table([*row.columns[: width + 1], row[id_col], pa.array([len(x)], pa.int64())], names=[*keys, "batch", id_col, "n_rows"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "batch", id_col]) + ", n_rows long"
    return rows.groupBy(*keys, "batch").applyInArrow(run, schema)


def running(df: DataFrame, order: list[str], value: str, keys: list[str]) -> DataFrame:
    """Least, greatest and mean so far."""
    placed = positions(df, order, keys)
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("run_min", F.min(value).over(w)).withColumn("run_max", F.max(value).over(w)).withColumn("run_sum", F.sum(value).over(w)).withColumn("run_n", F.count(value).over(w))


def slow_calls(df: DataFrame, elapsed_ms: str, limit: int = 100) -> DataFrame:
    return df.filter(F.col(elapsed_ms) > limit)


def autocorrelation(df: DataFrame, order: list[str], value: str, keys: list[str], lags: int) -> DataFrame:
    """For each lag 0..lags the sum of products of values that many rows apart."""
    placed = positions(df, order, keys)
    w = Window.partitionBy(*keys).orderBy("seq")
    sums = [F.sum(F.col(value) * F.col(f"_l{k}")).alias(f"lag_{k}") for k in range(lags + 1)]
    lagged = placed.select(*keys, "seq", value, *[F.lag(value, k).over(w).alias(f"_l{k}") for k in range(lags + 1)])
    got = lagged.groupBy(*keys).agg(*sums)
    return got.select(*keys, F.posexplode(F.array(*[f"lag_{k}" for k in range(lags + 1)])).alias("lag", "product"))


def linear_prediction(correlation: Column, order: int) -> Column:
    """Levinson's recursion on an array of autocorrelations: predictor coefficients of the given order; zeros without energy."""
    r = lambda i: F.element_at(correlation, i + 1)

    def grow(acc: Column, i: Column) -> Column:
        a, err = acc["a"], acc["err"]
        products = F.transform(a, lambda x, j: x * r(i - j - 1))
        reflect = F.when(err == 0, F.lit(0.0)).otherwise(-(r(i) * -1 + F.aggregate(products, F.lit(0.0), lambda s, x: s + x)) / err)
        mirrored = F.zip_with(a, F.reverse(a), lambda x, y: x - reflect * y)
        return F.struct(F.concat(mirrored, F.array(reflect)).alias("a"), (err * (1 - reflect * reflect)).alias("err"))

    zero = F.struct(F.array().cast("array<double>").alias("a"), r(F.lit(0)).cast("double").alias("err"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), zero, grow, lambda acc: acc["a"])


def squared_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def absolute_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def quantise(value: Column, boundaries: list[float]) -> Column:
    """The index of the first boundary that the value does not exceed, at most the last."""
    passed = F.filter(F.array(*[F.lit(float(b)) for b in boundaries]), lambda b: value > b)
    return F.least(F.lit(len(boundaries)), F.size(passed))


#: A codebook of up to so many entries is shipped with the query; a larger one, or a table, is dealt out in blocks.
MOST_ENTRIES = 65_536
#: The most rows of a block of queries or entries, and the least of a block of entries that is made for a task more.
BLOCK, SMALL_BLOCK = 32_768, 1024


def _matrix(vectors):
    """The rows of an Arrow list column, which all have one length."""
    import numpy as np
    import pyarrow.compute as pc

    if pc.count_distinct(pc.list_value_length(vectors), mode="all").as_py() != 1:
        raise ValueError("vectors are of one length and not null")
    return pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _best(x, ids, book, n: int, signed: bool):
    """Of each row of x the n best entries: the row, entry, distance and sign of each, best first.

    A matrix product leaves out what is worse than n others for any rounding; the rest is summed component by component,
    so that distances do not depend on how entries are dealt into blocks, and equal entries have equal distances.
    """
    import numpy as np

    def in_order(a, b):
        out = np.zeros(len(a))
        for k in range(a.shape[1]):
            out += a[:, k] * b[:, k]
        return out

    half = 0.5 * in_order(book, book)
    norms, rounding = np.sqrt(2 * half), (book.shape[1] + 4) * 2.0**-52
    found = []
    step = max(1, (1 << 20) // len(book))  # some 8 MB a matrix
    for a in range(0, len(x), step):
        part = x[a : a + step]
        product = part @ book.T
        near = half - (np.abs(product) if signed else product)
        if n >= len(book):
            rows, cols = np.divmod(np.arange(near.size), len(book))
        else:
            slack = rounding * (np.sqrt(in_order(part, part))[:, None] * norms + half)
            most = np.partition(near + slack, n - 1, axis=1)[:, n - 1 : n]
            rows, cols = np.nonzero((near - slack <= most) | ~np.isfinite(most))
        exact = np.zeros(len(rows))
        for k in range(book.shape[1]):  # a component at a time: where all entries tie, whole vectors of each pair would be 1 GB
            exact += part[rows, k] * book[cols, k]
        distance = half[cols] - (np.abs(exact) if signed else exact)
        order = np.lexsort((ids[cols], distance, rows))
        rows, cols = rows[order], cols[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < n
        sign = np.where(signed & (exact[order] <= 0), -1, 1)
        found.append((rows[kept] + a, ids[cols[kept]], distance[order][kept], sign[kept].astype(np.int32)))
    return [np.concatenate(c) for c in zip(*found)]


def nearest_entries(vectors: DataFrame, codebook: list[tuple[int, list[float]]], n: int, id_col: str, vector_col: str, signed: bool = False) -> DataFrame:
    """The n entries with the least |e|^2 / 2 - x.e for each vector, lower index first among equals: rank, entry, distance.

    signed: an entry may stand for its negative too; sign is -1 then. Up to MOST_ENTRIES the codebook is a block that
    every task has; more entries go the way of nearest_rows. Each vector gives n rows at most, never one for each entry.
    """
    if not codebook:
        raise ValueError("a codebook has an entry at least")
    if len(codebook) > MOST_ENTRIES:
        book = vectors.sparkSession.createDataFrame([(int(i), [float(c) for c in e]) for i, e in codebook], "e long, v array<double>")
        return nearest_rows(vectors, book.withColumnsRenamed({"e": id_col, "v": vector_col}), n, id_col, vector_col, signed)
    import numpy as np
    import pyarrow as pa

    ids = np.array([i for i, _ in codebook], np.int64)
    book = np.array([e for _, e in codebook], np.float64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, entry, distance, sign = _best(_matrix(batch.column(1)), ids, book, n, signed)
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(rank, pa.int32()), pa.array(entry), pa.array(distance), pa.array(sign)], names=["q", "rank", "entry", "distance", "sign"])

    out = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "q long, rank int, entry long, distance double, sign int")
    return out.withColumnRenamed("q", id_col)


def nearest_rows(vectors: DataFrame, entries: DataFrame, n: int, id_col: str, vector_col: str, signed: bool = False) -> DataFrame:
    """nearest_entries with a table of entries of any size, whose columns have the names of those of the vectors.

    Both tables are dealt into blocks of bounded size. Every block of vectors meets every block of entries, which gives
    the n best of the block for each vector, and the n best of those are the n best of all. Null vectors are left out.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    pick = lambda df: df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"))
    asked, held = pick(vectors), pick(entries)
    n_asked, n_held = asked.count(), held.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, -(-n_asked // BLOCK))
    down = max(1, -(-n_held // BLOCK), min(tasks, -(-n_held // SMALL_BLOCK)))
    block = lambda k: F.pmod(F.xxhash64("i", "v"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = asked.withColumn("row", F.monotonically_increasing_id()).withColumn("a", block(across)).withColumn("b", every(down))
    held = held.withColumn("b", block(down)).withColumn("a", every(across))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["row", "q", "entry", "distance", "sign"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())], names=names)
        left, right = left.combine_chunks(), right.combine_chunks()
        rows, *found = _best(_matrix(left["v"]), right["i"].to_numpy(), _matrix(right["v"]), n, signed)
        at = pa.array(rows)
        return pa.table([left["row"].take(at), left["i"].take(at), *[pa.array(c) for c in found]], names=names)

    best = asked.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInArrow(run, "row long, q long, entry long, distance double, sign int")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("distance", "entry"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= n).select(F.col("q").alias(id_col), "rank", "entry", "distance", "sign")


def least_squares(df: DataFrame, y: str, xs: list[str]) -> list[float]:
    """Coefficients without an intercept, from one aggregation of products; singular systems get the least solution."""
    import numpy as np

    names = [*xs, y]
    row = df.agg(*[F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    full = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
    return np.linalg.lstsq(full[:-1, :-1], full[:-1, -1], rcond=None)[0].tolist()


def principal_components(df: DataFrame, xs: list[str]) -> list[tuple[float, list[float]]]:
    """Variances and unit axes of the columns, largest first, from one aggregation; of an axis the largest part is positive.

    A task adds up its rows' second moments; what is put together is a row for each task and moment, and what reaches the
    driver a row for each moment. Rows with a null are left out.
    """
    import numpy as np
    import pyarrow as pa

    k = len(xs)

    def moments(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns)])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.reshape(-1))], names=["i", "v"])

    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(xs)]).dropna()
    found = rows.mapInArrow(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1) ** 2)
    for r in found:
        total[r["i"]] = r["v"]
    total = total.reshape(k + 1, k + 1) / max(total[0], 1.0)
    mean, second = total[0, 1:], total[1:, 1:]
    values, axes = np.linalg.eigh(second - np.outer(mean, mean))
    out = []
    for k in np.argsort(-values):
        axis = axes[:, k] * np.sign(axes[np.abs(axes[:, k]).argmax(), k])
        out.append((float(values[k]), axis.tolist()))
    return out


def code_lengths(counts: dict[object, int]) -> dict[object, int]:
    """Lengths of an optimal prefix code for a bounded alphabet's counts (from groupBy().count()); symbols never seen get none."""
    import heapq
    from itertools import count

    tie = count()
    heap = [(n, next(tie), (s,)) for s, n in sorted(counts.items(), key=lambda x: str(x[0])) if n > 0]
    if len(heap) == 1:
        return {heap[0][2][0]: 1}
    heapq.heapify(heap)
    length = dict.fromkeys((s for _, _, (s,) in heap), 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], next(tie), a[2] + b[2]))
    return length


def scale_volume(sample: Column, percent: int) -> Column:
    """sample * percent / 100, cut towards zero, within 16 bits."""
    scaled = F.expr("0") + (sample.cast("long") * percent / 100).cast("long")
    return F.least(F.lit(32767), F.greatest(F.lit(-32767), scaled)).cast("int")


def clip_shift(sample: Column, shift: float) -> Column:
    """A shifted sample, within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sample + shift))
