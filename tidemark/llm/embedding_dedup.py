"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors count as one. The others are normalised and turned to the axes of a principal component analysis of their
second moments, largest first; turning changes no cosine. Two unit vectors of cosine c are at most sqrt(2 - 2c) apart. The
leading axes are cut into cells, as many as the largest label has tiles; a vector lives in its cell and visits only the
later cells of its label that are not further away than that, over all cut axes together. A cell's vectors are dealt to
tiles of bounded size, and its visitors to blocks. Within a tile and a block the products of leading dimensions are summed
first; what the rest can add is bounded by the product of the suffix norms, and pairs that cannot reach the threshold any
more are dropped before the next dimensions. What is left is decided by the cosine of the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.near_dedup import SALTS
from tidemark.llm.shared import grouped, keyed, materialize, tidy

#: Vectors in a tile, visitors in a block, and dimensions that are added at once.
TILE, BLOCK, STEP = 1024, 8192, 8
#: At most so many leading axes are cut, into at most so many parts each.
CUT_AXES, CUT_PARTS = 24, 16
_SLACK = 1e-9


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Columns: axes by falling second moment."""
    return axes_of(vectors.T @ vectors)


def axes_of(moments: np.ndarray) -> np.ndarray:
    _, axes = np.linalg.eigh(moments)
    return np.ascontiguousarray(axes[:, ::-1])


def second_moments(vectors: DataFrame, n: int) -> np.ndarray:
    """The n x n second moments of all vectors (one column, of length n), as unit vectors: each task sums its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(0)))
                total += x.T @ x
        for i in range(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(total[i])], names=["i", "j", "p"])

    out = np.zeros((n, n))
    for i, j, p in vectors.mapInArrow(tidy(run), "i int, j int, p double").groupBy("i", "j").agg(F.sum("p")).collect():  # n * n rows
        out[i, j] = p
    return (out + out.T) / 2


def _matrix(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # times a power of two: squares neither overflow nor vanish


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def close_pairs(a: np.ndarray, b: np.ndarray, least: float, same: bool, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b whose product may be `least` or more; a is b, and i < j, if `same`.

    a and b are unit vectors on the principal axes. counts gets the number of pairs left after each step.
    """
    n = a.shape[1]
    tail_a, tail_b = (np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0)) for x in (a, b))
    head = min(STEP, n)
    part = a[:, :head] @ b[:, :head].T
    may = part + (np.outer(tail_a[:, head], tail_b[:, head]) if head < n else 0) >= least - _SLACK
    if same:
        may &= np.tri(len(a), len(b), 0, bool).T & ~np.eye(len(a), dtype=bool)
    i, j = np.nonzero(may)
    part = part[i, j]
    while head < n and len(i):
        if counts is not None:
            counts.append(len(i))
        end = min(head + STEP, n)
        part = part + np.einsum("ij,ij->i", a[i, head:end], b[j, head:end])
        stay = part + (tail_a[i, end] * tail_b[j, end] if end < n else 0) >= least - _SLACK
        i, j, part, head = i[stay], j[stay], part[stay], end
    return i, j


def _links(least: float, axes: np.ndarray):
    out = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("src", pa.int64()), ("dst", pa.int64())])

    def work(rows: pa.Table) -> pa.Table | None:
        """For each vector of a tile and a block of its visitors its number of links here, and a spanning forest of them."""
        at_home = rows.column("side").to_numpy() == 0
        ids, weight = rows.column("id").to_numpy(), rows.column("weight").to_numpy()
        x = _matrix(rows.column("vector"))
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        turned = (x / norm[:, None]) @ axes
        home, away = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        found = [(home, *close_pairs(turned[home], turned[home], least, True))] if rows.column("first_block")[0].as_py() else []
        for start in range(0, len(away), TILE):
            part = away[start : start + TILE]
            found.append((part, *close_pairs(turned[home], turned[part], least, False)))
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([home[i] for _, i, _ in found], [other[j] for other, _, j in found]))
        good = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= least
        i, j = i[good], j[good]
        if not len(i):
            return None
        n = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        some = np.flatnonzero(n)
        label, forest = np.arange(len(ids)), []
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            if label[p] != label[q]:
                forest.append((ids[p], ids[q]))
                label[label == label[q]] = label[p]
        nulls = [None] * len(forest)
        counted = [pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())]
        joined = [pa.array(nulls, pa.int64()), pa.array(nulls, pa.int64()), pa.array([p for p, _ in forest], pa.int64()), pa.array([q for _, q in forest], pa.int64())]
        return pa.table([pa.concat_arrays([a, b]) for a, b in zip(counted, joined, strict=True)], schema=out)

    return lambda batches: grouped(batches, ["label", "cell", "tile", "block"], work, out)


def choose_cuts(quantiles: list[list[float]], cells: float, reach: float) -> list[list[float]]:
    """Cuts of each leading axis, from its quantiles (CUT_PARTS - 1 of them), until there are `cells` cells: as many parts,
    a power of two, as leave half a reach between cuts, and two at least."""
    out: list[list[float]] = []
    left = math.log2(max(1.0, cells))
    for q in quantiles:
        if left <= 0:
            break
        parts = CUT_PARTS
        while parts > 2 and (math.log2(parts) > left + 1 or min(np.diff(q[CUT_PARTS // parts - 1 :: CUT_PARTS // parts])) < reach / 2):
            parts //= 2
        out.append(sorted(set(q[CUT_PARTS // parts - 1 :: CUT_PARTS // parts])))
        left -= math.log2(len(out[-1]) + 1)
    return out


def cells_of(lead: np.ndarray, cuts: list[list[float]], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each row of leading coordinates, and as (row, cell) the later cells that are at most `reach` away."""
    home = np.zeros(len(lead), np.int64)
    row, code, gone = np.arange(len(lead)), np.zeros(len(lead), np.int64), np.zeros(len(lead))
    for k, c in enumerate(cuts):
        edges = np.concatenate([[-np.inf], c, [np.inf]])
        x = lead[:, k]
        home = home * (len(c) + 1) + np.searchsorted(c, x, side="right")
        made = []
        for part in range(len(c) + 1):
            away = np.maximum(0.0, np.maximum(edges[part] - x, x - edges[part + 1]))[row]
            far = gone + away * away
            near = far <= reach * reach
            made.append((row[near], code[near] * (len(c) + 1) + part, far[near]))
        row, code, gone = (np.concatenate(x) for x in zip(*made, strict=True))
    later = code > home[row]
    return home, row[later], code[later]


def _leading(axes: np.ndarray):
    """The leading coordinates of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead = _unit(_matrix(batch.column(0))) @ axes[:, :CUT_AXES]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in lead.T], names=[f"t{k}" for k in range(lead.shape[1])])

    return run


def _place(axes: np.ndarray, cuts: list[list[float]], reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                home, row, visits = cells_of(_unit(_matrix(part.column(1))) @ axes[:, : len(cuts)], cuts, reach)
                order = np.argsort(row, kind="stable")
                offsets = pa.array(np.searchsorted(row[order], np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home), pa.ListArray.from_arrays(offsets, pa.array(visits[order]))], names=["id", "vector", "label", "weight", "cell", "visits"])

    return run


def embedding_near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors of its label with cosine >= least), component_id (the smallest vec_id that links
    reach) and kept (it is that one) of every row.

    Vectors that are null, zero, or hold a null or non-finite component, and those with a null label or vec_id, have no
    link. Vectors of different lengths are not compared. Every row is a vector of its own: rows that repeat a vec_id, or a
    whole row, count among each other's links. Other columns are dropped. No rows: no rows.
    """
    spark = vectors.sparkSession
    number = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    rows = keyed(vectors, {"vec_id": id_col, "vector": vector_col, "label": label_col}).select(F.col("vec_id").cast("long"), F.col("vector").cast(f"array<{number}>").alias("vector"), F.col("label").cast("string").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(number)))  # no negative zeros: equal vectors, equal hashes
    good = rows.filter(able)
    whole = good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    whole = materialize(whole.withColumn("id", F.monotonically_increasing_id()), "vectors")
    links = None
    for (n,) in whole.select(F.size("vector").alias("n")).distinct().orderBy("n").collect():  # lengths: one in any real table
        made = _compare(whole.filter(F.size("vector") == n), n, number, least)
        links = made if links is None else links.unionByName(made)
    if links is None:
        links = spark.createDataFrame([], "id long, n long, src long, dst long")
    links = materialize(links, "tile-links")
    counts = links.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    classes = connected_components(links.filter("src is not null").select("src", "dst"), "vector-classes")
    reps = whole.select("id", "rep")
    least_of = classes.join(reps, "id").groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(least_of, "component").select("id", "component_id")
    per = whole.select("id", "label", "vector", "rep", "weight").join(counts, "id", "left").join(classes, "id", "left").filter("weight > 1 or n is not null")
    per = per.select(F.xxhash64("label", "vector").alias("h"), F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of = rows.withColumn("g", F.when(able, F.xxhash64("label", "vector"))).withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    out = of.join(per, (F.col("g") == F.col("h")) & (F.col("s") == F.col("salt")) & (of["label"] == F.col("l")) & (of["vector"] == F.col("v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _compare(own: DataFrame, n: int, number: str, least: float) -> DataFrame:
    """id and n links, or src and dst, from every tile and each block of its visitors."""
    axes = axes_of(second_moments(own.select("vector"), n))
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    lead = min(n, CUT_AXES)
    most = own.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    cuts: list[list[float]] = []
    if most > TILE:
        marks = [i / CUT_PARTS for i in range(1, CUT_PARTS)]
        spread = own.select("vector").mapInArrow(tidy(_leading(axes)), ", ".join(f"t{k} double" for k in range(lead)))
        cuts = choose_cuts(list(spread.agg(*[F.percentile_approx(f"t{k}", marks, 1000) for k in range(lead)]).first()), most / TILE, reach)
    placed = own.select("id", "vector", "label", "weight").mapInArrow(tidy(_place(axes, cuts, reach)), f"id long, vector array<{number}>, label string, weight long, cell long, visits array<long>")
    placed = materialize(placed, "cells")
    homes = placed.groupBy("label", "cell").agg(F.count("*").alias("n_home"))
    visits = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("n_away"))
    tiles, blocks = F.ceil(F.col("n_home") / TILE).cast("int"), F.ceil((F.coalesce("n_away", F.lit(0)) + F.col("n_home")) / BLOCK).cast("int")
    sizes = materialize(homes.join(visits, ["label", "cell"], "left").select("label", "cell", tiles.alias("tiles"), blocks.alias("blocks")), "cell-sizes")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    tile, block = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"), F.pmod(F.xxhash64("id", "label"), F.col("blocks")).cast("int")
    home = placed.drop("visits").join(sizes, ["label", "cell"]).withColumn("tile", tile)
    columns = ["label", "cell", "tile", "block", "side", "first_block", "id", "weight", "vector"]
    at_home = home.withColumn("block", every(F.col("blocks"))).withColumn("side", F.lit(0)).withColumn("first_block", F.col("block") == 0)
    # Vectors of a tile visit the later tiles of their own cell, and all tiles of the later cells that they can reach.
    beside = home.filter(F.col("tile") + 1 < F.col("tiles")).withColumn("tile", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)))
    away = placed.drop("cell").withColumn("cell", F.explode("visits")).drop("visits").join(sizes, ["label", "cell"]).withColumn("tile", every(F.col("tiles")))
    guests = beside.unionByName(away).withColumn("block", block).withColumn("side", F.lit(1)).withColumn("first_block", F.col("block") == 0)
    pairs = at_home.select(*columns).unionByName(guests.select(*columns))
    group = ["label", "cell", "tile", "block"]
    return pairs.repartition(*group).sortWithinPartitions(*group, "side", "id").mapInArrow(tidy(_links(least, axes)), "id long, n long, src long, dst long")
