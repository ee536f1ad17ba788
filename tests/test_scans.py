"""Scans by ranges against plain loops, for any number of ranges and a key that has nearly all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import scans

KEYS = ["k"]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = []
    for i in range(2400):
        k = None if i % 97 == 0 else "hot" if rnd.random() < 0.9 else f"cold{rnd.randrange(40)}"
        out.append((k, i * 7 % 2399 if i else 2399, None if rnd.random() < 0.02 else float(rnd.randint(-50, 50)), None if rnd.random() < 0.4 else f"v{i}"))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, o long, x double, s string").repartition(5).cache()


def streams(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        found.setdefault(r[0], []).append(r)
    return found


def same(got, want, name):
    got = {(r["k"], r["o"]): r[name] for r in got.collect()}
    assert set(got) == set(want)
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)


PARTS = [1, 9, 60]


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("b, a", [([0.25], [-0.75]), ([0.2, 0.3, 0.1], [-0.4, 0.5]), ([1.0, -1.0, 0.5], []), ([0.1], [0.0, 0.0, -0.9]), ([2.0], [])])
def test_recursive_filters(df, rows, parts, b, a):
    want = {}
    for k, mine in streams(rows).items():
        x, y = [r[2] or 0.0 for r in mine], []
        for n in range(len(x)):
            y.append(sum(c * x[n - i] for i, c in enumerate(b) if n >= i) - sum(c * y[n - i] for i, c in enumerate(a, 1) if n >= i))
            want[k, mine[n][1]] = y[-1]
    same(scans.linear_filter(df, KEYS, ["o"], "x", b, a, "y", parts), want, "y")


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("n_taps", [1, 5, 63, 200])
def test_convolutions(df, rows, parts, n_taps):
    taps = np.random.default_rng(n_taps).integers(-9, 9, n_taps).astype(float).tolist()
    want = {}
    for k, mine in streams(rows).items():
        y = np.convolve([r[2] or 0.0 for r in mine], taps)[: len(mine)]
        want |= {(k, r[1]): v for r, v in zip(mine, y.tolist())}
    got = {(r["k"], r["o"]): r["y"] for r in scans.convolve(df, KEYS, ["o"], "x", taps, "y", parts).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in want)


@pytest.mark.parametrize("parts", PARTS)
def test_places_and_last_values(df, rows, parts):
    got = scans.last_known(scans.numbered(df, KEYS, ["o"], "n", parts), KEYS, ["o"], "s", "before", parts).collect()
    got = {(r["k"], r["o"]): (r["n"], r["before"]) for r in got}
    want = {}
    for k, mine in streams(rows).items():
        last = None
        for n, r in enumerate(mine, 1):
            last = r[3] or last
            want[k, r[1]] = (n, last)
    assert got == want


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("period, depth", [(50, 6.5), (7, 0.0), (300, 40.0)])
def test_swinging_delays_and_gains(df, rows, parts, period, depth):
    slow, loud = {}, {}
    for k, mine in streams(rows).items():
        x = [r[2] or 0.0 for r in mine]
        at = lambda i: x[i] if i >= 0 else 0.0  # noqa: E731, B023
        for n, r in enumerate(mine):
            delay = depth * (1 + math.sin(2 * math.pi * (n % period) / period))
            whole = math.floor(delay)
            slow[k, r[1]] = (1 - (delay - whole)) * at(n - whole) + (delay - whole) * at(n - whole - 1)
            loud[k, r[1]] = x[n] * (1 - 0.3 * (1 - math.cos(2 * math.pi * (n % period) / period)))
    same(scans.vibrato(df, KEYS, ["o"], "x", period, depth, "y", parts), slow, "y")
    same(scans.tremolo(df, KEYS, ["o"], "x", period, 0.6, "y", parts), loud, "y")


def test_crossfeed_keeps_what_both_channels_share(df):
    got = scans.crossfeed(df.withColumn("r", F.col("x")), KEYS, ["o"], "x", "r", 700, 44100, 0.6, 4).collect()
    assert all(math.isclose(r["out_left"], r["x"], abs_tol=1e-9) and math.isclose(r["out_right"], r["x"], abs_tol=1e-9) for r in got if r["x"] is not None)
    apart = scans.crossfeed(df.withColumn("r", F.lit(0.0)), KEYS, ["o"], "x", "r", 700, 44100, 1.0, 4).collect()
    assert all(math.isclose(r["out_left"] + r["out_right"], r["x"], abs_tol=1e-9) for r in apart if r["x"] is not None)


def test_no_rows_and_names(spark, df):
    assert scans.numbered(df.limit(0), KEYS, ["o"]).count() == 0
    assert scans.linear_filter(df, [], ["k", "o"], "x", [1.0], []).count() == 2400  # one stream
    with pytest.raises(ValueError):
        scans.numbered(df, KEYS, ["o"], "x")
    for bad in (lambda: scans.convolve(df, KEYS, ["o"], "x", []), lambda: scans.linear_filter(df, KEYS, ["o"], "x", [], []), lambda: scans.vibrato(df, KEYS, ["o"], "x", 0, 1.0)):
        with pytest.raises(ValueError):
            bad()


def test_a_hot_key_is_many_tasks_work(df):
    from tidemark.operators.scans import _PART, Scan

    class Count(Scan):
        columns, out, start = ["x"], {"part": "long"}, 0
        made = {"part": "long"}

        def local(self, rows, state):
            from pyspark import TaskContext

            return {"part": np.full(len(rows["x"]), TaskContext.get().partitionId())}, 0

        def combine(self, before, after):
            return 0

    assert _PART.startswith("_")
    sizes = [r["count"] for r in scans.scan(df, KEYS, ["o"], Count(), 8).groupBy("part").count().collect()]
    assert len(sizes) >= 7 and max(sizes) <= 2 * 2400 / 8


@pytest.mark.parametrize("parts", [1, 11])
def test_as_of_by_ranges_is_as_of(spark, df, parts):
    from tidemark.operators import sync

    rows = df.withColumn("t", F.floor(F.col("o") / 5)).filter("k is not null").select("k", "t", "o", "x", "s")
    main, second = rows.filter("o % 3 = 0"), rows.filter("o % 3 != 0")
    want = sync.asof(main, second, ["k"], "t", "o", ["o", "s"]).collect()
    got = sync.asof_by_ranges(main, second, ["k"], "t", "o", ["o", "s"], parts).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 700
