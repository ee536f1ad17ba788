import os
import random
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.operators import abr, intervals, stats, sync, telemetry, timeline
from tidemark.plans.pipeline import Graph, scans


def stream(spark, n=57, keys=3, seed=1):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.randint(0, 5)
        rows.append((i, i % keys, t, rnd.randint(-50, 50)))
    return spark.createDataFrame(rows, "id long, k int, t long, v long"), rows


def by_key(rows, key=1):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[key], []).append(r)
    return out


def test_global_positions_match_one_sort(spark):
    df, rows = stream(spark, 200)
    got = {r["id"]: r["seq"] for r in timeline.positions(df, ["t", "id"], parts=7).collect()}
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert got == want
    assert timeline.positions(df.limit(0), ["t", "id"]).count() == 0
    same = df.withColumn("t", F.lit(1).cast("long"))
    assert sorted(r["seq"] for r in timeline.positions(same, ["t", "id"]).collect()) == list(range(1, 201))


def test_positions_of_fewer_columns(spark):
    placed = timeline.positions(stream(spark, 200)[0], ["t", "id"], parts=5)
    assert placed.count() == 200 and placed.select("seq").distinct().count() == 200
    with pytest.raises(ValueError):
        timeline.positions(placed.withColumnRenamed("seq", "_range_nth"), ["t", "id"])


def test_one_time_for_all_rows_is_dealt_evenly(spark, tmp_path, monkeypatch):
    kept = {}
    monkeypatch.setattr(timeline, "materialize", lambda d, tag: kept.setdefault(tag, storage.materialize(d, tag)))
    same = spark.range(4000).select("id", F.lit(7).cast("long").alias("t"))
    assert [r["seq"] for r in timeline.positions(same, ["t", "id"], parts=8).orderBy("id").collect()] == list(range(1, 4001))
    sizes = [r["count"] for r in kept["ranges"].groupBy("_range_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


def test_the_shared_folder_is_the_sessions_own(spark, monkeypatch):
    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://a.example:7077"))
    with pytest.raises(RuntimeError):
        storage.shared_folder(cluster)


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_entry_counts_as_the_first_action(partitions):
    code = f"""from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "{partitions}").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
print("rows:", __spark_entry__.entry(spark).count(), __spark_entry__.entry(spark).agg({{"seq": "max"}}).first()[0])"""
    got = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=300)
    assert "rows: 1000 1000" in got.stdout


def test_interleave_ties_and_nulls(spark):
    a = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id long, t long")
    b = spark.createDataFrame([(10, 5), (11, 6)], "id long, t long")
    got = [(r["id"], r["input_idx"]) for r in timeline.interleave([a, b, a.limit(0)], "t", "id").orderBy("seq").collect()]
    assert got == [(1, 0), (10, 1), (11, 1), (3, 0)]


def test_split_then_interleave_is_identity(spark):
    df, rows = stream(spark)
    parts = [p.filter(F.col("k") == i) for i, p in enumerate(timeline.fan_out(df, 3))]
    assert [r["id"] for r in timeline.interleave(parts, "t", "k").orderBy("t", "id").collect()] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]


def test_reverse_twice_is_identity(spark):
    df, rows = stream(spark)
    df = df.withColumn("samples", F.array("v", "id"))
    once = timeline.reverse(df, ["t", "id"], ["v", "samples"], ["k"], arrays=True).drop("seq")
    twice = timeline.reverse(once, ["t", "id"], ["v", "samples"], ["k"], arrays=True)
    assert {(r["id"], r["v"], tuple(r["samples"])) for r in twice.collect()} == {(r[0], r[3], (r[3], r[0])) for r in rows}
    for k, own in by_key(rows).items():
        assert [r["v"] for r in once.filter(F.col("k") == k).orderBy("t", "id").collect()] == [r[3] for r in own][::-1]


def test_permute_batches(spark):
    df, rows = stream(spark)
    got = timeline.permute(df, ["t", "id"], ["v"], "2|0|1", ["k"])
    for k, own in by_key(rows).items():
        v = [r[3] for r in own]
        want = [x for a in range(0, len(v), 3) for x in ([v[a + 2], v[a], v[a + 1]] if a + 3 <= len(v) else v[a:])]
        assert [r["v"] for r in got.filter(F.col("k") == k).orderBy("t", "id").collect()] == want
    with pytest.raises(ValueError):
        timeline.permute(df, ["t"], ["v"], "0 5", ["k"])


def test_random_batches_keep_rows(spark):
    df, rows = stream(spark)
    a, b = (sorted((r["k"], r["seq"], r["v"]) for r in timeline.random_in_batches(df, ["t", "id"], ["v"], 8, 3, ["k"]).collect()) for _ in range(2))
    assert a == b and sorted(x[2] for x in a) == sorted(r[3] for r in rows)


def test_rebatch_and_tile(spark):
    df, rows = stream(spark)
    for pad, call in ((0, lambda: timeline.rebatch(df, ["t", "id"], "v", 8, ["k"])), (None, lambda: timeline.tile(df, ["t", "id"], "v", 8, ["k"]))):
        for r in call().collect():
            own = [x[3] for x in by_key(rows)[r["k"]]][8 * r["batch"] : 8 * r["batch"] + 8]
            assert list(r["samples"]) == own + ([0] * (8 - len(own)) if pad == 0 else []) and r["n_real"] == len(own)


def test_fields(spark):
    df = spark.createDataFrame([(1, [0, 1, 2, 3, 4])], "id long, x array<int>")
    assert [(r["field"], list(r["x"])) for r in timeline.separate_fields(df, "x").orderBy("field").collect()] == [(0, [0, 2, 4]), (1, [1, 3])]
    s, rows = stream(spark)
    even = timeline.pick_field(s, ["t", "id"], 0, ["k"]).count()
    assert even == sum((len(v) + 1) // 2 for v in by_key(rows).values())
    with pytest.raises(ValueError):
        timeline.byte_slice(F.lit(b"abc"), 3, 3)


def test_interpolation_runs_up_and_down(spark):
    rows = [(0, 0, None), (1, 0, 100), (2, 0, None), (3, 0, None), (4, 0, 131), (5, 0, None), (6, 0, 110), (7, 0, None)]
    got = timeline.interpolate_times(spark.createDataFrame(rows, "id long, k int, ts long"), ["id"], "ts", ["k"])
    assert [r["filled_ts"] for r in got.orderBy("id").collect()] == [None, 100, 110, 120, 131, 121, 110, None]


def test_interpolation_fills_gaps_of_any_length(spark):
    df = spark.createDataFrame([(i, 1, 10 * i if i in (0, 300) else None) for i in range(301)], "id long, k int, ts long")
    got = {r["id"]: r["filled_ts"] for r in timeline.interpolate_times(df, ["id"], "ts", ["k"]).collect()}
    assert got == {i: 10 * i for i in range(301)}
    strict = timeline.interpolate_times(df, ["id"], "ts", ["k"], limit=128)
    assert strict.filter("filled_ts is null").count() == 299


def test_steady_times_stay_steady(spark):
    rows = [(i, 0, 40 * i) for i in range(30)]
    got = timeline.smooth_jitter(spark.createDataFrame(rows, "id long, k int, t long"), ["t", "id"], "t", ["k"], 4).orderBy("seq").collect()
    assert [r["new_ts"] for r in got] == [40 * i * 8 for i in range(30)]
    judder = [(i, 0, 10 * (i + (i % 4 == 3))) for i in range(80)]
    out = [r["new_ts"] for r in timeline.smooth_jitter(spark.createDataFrame(judder, "id long, k int, t long"), ["t", "id"], "t", ["k"], 4).orderBy("seq").collect()]
    steps = np.diff(out[12:])
    assert steps.std() <= np.diff([r[2] * 8 for r in judder][12:]).std()


@pytest.mark.parametrize("before", ["null", "stop", "infinity"])
@pytest.mark.parametrize("after", ["null", "stop", "infinity"])
def test_asof_matches_brute_force(spark, before, after):
    df, rows = stream(spark, 120, keys=4)
    main, second = df.filter("id % 3 = 0"), df.filter("id % 3 != 0 and k != 2")
    got = {r["id"]: r["s_id"] for r in sync.asof(main, second, ["k"], "t", "id", ["id"], before, after).collect()}
    want = {}
    for r in rows:
        if r[0] % 3:
            continue
        other = sorted((x for x in rows if x[0] % 3 and x[1] != 2 and x[1] == r[1]), key=lambda x: (x[2], x[0]))
        found = [x for x in other if x[2] <= r[2]]
        m = found[-1][0] if found else (other[0][0] if other and before == "infinity" else None)
        if m is None and before == "stop":
            continue
        if after == "stop" and not other:
            continue
        if other and r[2] > other[-1][2] and after != "infinity":
            if after == "stop":
                continue
            m = None
        want[r[0]] = m
    assert got == want


def test_zip_stops_at_the_shorter(spark):
    df, _ = stream(spark)
    got = timeline.zip_streams(df.filter("k = 0"), df.filter("k = 1").limit(4), ["t", "id"])
    assert sorted(r["seq"] for r in got.collect()) == [1, 2, 3, 4]


def test_intervals_match_sets(spark):
    rnd = random.Random(3)
    rows = [(k, b, b + rnd.randint(-1, 9)) for k in range(3) for b in (rnd.randint(0, 80) for _ in range(12))]
    df = spark.createDataFrame(rows, "k int, beg long, end long")
    cover = {k: {x for q, b, e in rows if q == k for x in range(b, e)} for k in range(3)}
    assert {r["k"]: r["covered"] for r in intervals.coverage(df, ["k"]).collect()} == {k: len(v) for k, v in cover.items()}
    for r in intervals.gaps(df, ["k"]).collect():
        assert not cover[r["k"]] & set(range(r["beg"], r["end"])) and {r["beg"] - 1, r["end"]} <= cover[r["k"]]
    asked = spark.createDataFrame([(k, b, b + 3) for k in range(4) for b in range(0, 80, 3)], "k int, beg long, end long")
    for r in intervals.has(df, asked, ["k"]).collect():
        assert r["had"] == (set(range(r["beg"], r["end"])) <= cover.get(r["k"], set()))


def test_linear_prediction_of_a_known_process(spark):
    r = [1.0, 0.5, 0.25, 0.125]
    got = spark.range(1).select(stats.linear_prediction(F.array(*[F.lit(x) for x in r]), 3).alias("a")).first()["a"]
    assert np.allclose(got, [0.5, 0, 0])
    m = np.array([[r[abs(i - j)] for j in range(3)] for i in range(3)])
    r = [3.0, 1.2, -0.4, 0.9]
    m = np.array([[r[abs(i - j)] for j in range(3)] for i in range(3)])
    got = spark.range(1).select(stats.linear_prediction(F.array(*[F.lit(x) for x in r]), 3).alias("a")).first()["a"]
    assert np.allclose(got, np.linalg.solve(m, r[1:]))


def test_nearest_entries_signed_and_ties(spark):
    book = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-3.0, 0.1])]
    df = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.0, -2.0])], "id long, x array<double>")
    got = {(r["id"], r["rank"]): (r["entry"], r["sign"]) for r in stats.nearest_entries(df, book, 2, "id", "x").collect()}
    assert got == {(7, 1): (0, 1), (7, 2): (1, 1), (8, 1): (0, 1), (8, 2): (1, 1)}
    signed = {(r["id"], r["rank"]): (r["entry"], r["sign"]) for r in stats.nearest_entries(df, book, 1, "id", "x", signed=True).collect()}
    assert signed[(8, 1)] == (2, -1)


@pytest.mark.parametrize("signed", [False, True])
def test_nearest_rows_over_blocks_are_those_of_all(spark, monkeypatch, signed):
    monkeypatch.setattr(stats, "BLOCK", 16)
    monkeypatch.setattr(stats, "MOST_ENTRIES", 2)
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (90, 4)).astype(float)
    x[40:60] = x[3]  # more equal entries than are asked for
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    key = 0.5 * (x * x).sum(axis=1) - (np.abs(x @ x.T) if signed else x @ x.T)
    want = {(q, r + 1): int(e) for q in range(0, 90, 2) for r, e in enumerate(np.lexsort((np.arange(90), key[q]))[:3])}
    asked = df.filter("id % 2 = 0")
    for got in (stats.nearest_rows(asked, df, 3, "id", "x", signed), stats.nearest_entries(asked, list(enumerate(x.tolist())), 3, "id", "x", signed)):
        assert {(r["id"], r["rank"]): r["entry"] for r in got.collect()} == want


def test_fits_and_codes(spark):
    df = spark.createDataFrame([(float(a), float(b), 2.0 * a - 3.0 * b) for a in range(5) for b in range(4)], "a double, b double, y double")
    assert np.allclose(stats.least_squares(df, "y", ["a", "b"]), [2, -3])
    (v, axis), *_ = stats.principal_components(df, ["a", "y"])
    x = np.array([(r["a"], r["y"]) for r in df.collect()])
    assert np.isclose(v, np.linalg.eigvalsh(np.cov(x.T, bias=True))[-1]) and np.isclose(np.hypot(*axis), 1)
    lengths = stats.code_lengths({"a": 45, "b": 13, "c": 12, "d": 16, "e": 9, "f": 5, "none": 0})
    assert sum(n * {"a": 45, "b": 13, "c": 12, "d": 16, "e": 9, "f": 5}[s] for s, n in lengths.items()) == 224
    assert stats.code_lengths({"x": 3}) == {"x": 1}
    v = df.select(stats.scale_volume(F.lit(-301), 50).alias("x"), stats.scale_volume(F.lit(30000), 200).alias("y"), stats.clip_shift(F.lit(0.7), 0.5).alias("z")).first()
    assert tuple(v) == (-150, 32767, 1.0)


def replayed(log, rungs):
    at = changes = last = 0
    out = []
    for measured, transfer, start, buffer in log:
        if measured:
            limit = 3_000_000 if not changes and len(rungs) > 2 else 10_000_000
            fit = [i for i, b in enumerate(rungs) if b * 1.3 <= measured and b < limit]
            want = fit[-1] if fit else 0
            ok = want != at
            if rungs[want] > rungs[at]:
                ok = start >= last + 20_000 and int(transfer * (rungs[want] // rungs[at]) * 1.1) <= buffer
            elif rungs[want] < rungs[at]:
                ok = not (buffer > 18_000 and rungs[at] * 8000 < measured)
            if ok and want != at:
                at, changes, last = want, changes + 1, start
        out.append(at)
    return out


def test_bitrate_replay_matches_a_plain_loop(spark):
    rnd, rungs = random.Random(4), [400_000, 1_200_000, 2_500_000, 5_000_000]
    logs = {k: [(rnd.choice([0, 300_000, 700_000, 2_000_000, 4_000_000, 9_000_000, 20_000_000]), rnd.randint(0, 6000), 4000 * i, rnd.randint(0, 40_000)) for i in range(60)] for k in range(5)}
    df = spark.createDataFrame([(k, i, *r) for k, v in logs.items() for i, r in enumerate(v)], "k int, n long, measured long, transfer_ms long, start_ms long, buffer_ms long")
    got = {}
    for r in abr.replay(df, list(enumerate(rungs)), ["k"]).orderBy("k", "n").collect():
        got.setdefault(r["k"], []).append(r["stream_id"])
    assert got == {k: replayed(v, rungs) for k, v in logs.items()} and any(len(set(v)) > 2 for v in got.values())
    assert {r["stream_id"] for r in abr.replay(df, list(enumerate(rungs)), ["k"], forced_stream=2).collect()} == {2}
    ladder = spark.createDataFrame([(0, 5), (1, 3), (2, 5), (3, 1)], "stream_id int, bitrate long")
    assert abr.ladder(ladder) == [(3, 1), (1, 3), (2, 5), (0, 5)]


def test_telemetry_records(spark):
    df = spark.createDataFrame([(3, None, -1), (99, "x", 5)], "event_id int, note string, duration_ms long")
    got = df.select(telemetry.event_name(F.col("event_id")).alias("n"), telemetry.text_record(["event_id", "note"]).alias("r")).collect()
    assert [tuple(x) for x in got] == [("play", "event_id=3\tnote="), ("", "event_id=99\tnote=x")]
    assert [r["live"] for r in telemetry.clone_source(df).collect()] == [True, False]
    assert df.select(telemetry.parse_text_record(telemetry.text_record(["event_id"])).alias("m")).first()["m"] == {"event_id": "3"}


def test_graph_runs_its_stages(spark):
    df, _ = stream(spark)
    g = Graph().add("loud", lambda d: d.filter("v > 0"), "in").add("first", lambda d: timeline.step(d, ["t", "id"], 2, ["k"]), "loud").add("rest", lambda a, b: a.join(b, "id", "left_anti"), "loud", "first")
    out = g.build({"in": df})
    assert list(out) == ["rest"] and "loud, first -> rest" in g.dump()
    with pytest.raises(ValueError):
        Graph().add("a", lambda d: d, "b").add("b", lambda d: d, "a").build({}, ["a"])


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    df, _ = stream(spark)
    df.write.parquet(f"file://{tmp_path}/x")
    plan = " ".join(scans(timeline.seek(spark.read.parquet(f"file://{tmp_path}/x"), "t", 10).select("id")))
    assert "GreaterThanOrEqual(t,10)" in plan and "ReadSchema: struct<id:bigint,t:bigint>" in plan


def test_entries_that_tie_take_no_memory_of_whole_pairs():
    import tracemalloc

    import numpy as np

    from tidemark.operators import stats

    x, ids = np.full((1024, 64), 0.3), np.arange(1024)[::-1].copy()
    tracemalloc.start()
    rows, entries, distances, _ = stats._best(x, ids, x, 3, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6  # 1,048,576 pairs of vectors are 1,074 MB
    assert entries.tolist() == [0, 1, 2] * 1024 and rows.tolist() == np.repeat(np.arange(1024), 3).tolist() and len(set(distances.tolist())) == 1
