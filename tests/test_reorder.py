"""The reorder buffer and what it carries against plain loops."""

import random

from pyspark.sql import functions as F

from tidemark.sources import rtp
from tidemark.streaming import queries as streams
from tidemark.streaming import stateful


def packet(number, ts, payload, marker=False):
    return bytes([0x80, 96 | marker << 7]) + (number % 65536).to_bytes(2, "big") + (ts % 2**32).to_bytes(4, "big") + bytes(4) + payload


def given(arrivals, threshold):
    """(number, lost) in the order in which they are given: by a clock that ticks with each microsecond at which something may happen."""
    out, late, waiting, due = [], [], {}, None

    def release(now):
        nonlocal due
        while waiting:
            head = min(waiting)
            if head != due and waiting[head] + threshold > now:
                return
            out.append((head, head != due))
            due = head + 1
            del waiting[head]

    times = sorted({t for t, _ in arrivals} | {t + threshold for t, _ in arrivals})
    for now in times:
        release(now)
        for t, number in arrivals:
            if t == now:
                due = number if due is None else due
                if number < due or number in waiting:
                    late.append(number)
                else:
                    waiting[number] = t
                release(now)
    release(float("inf"))
    return out, late


def shuffled(seed):
    rnd = random.Random(seed)
    sent = [(i * 1000 + rnd.choice([0, 0, 0, 900, 2500, 9000, 60000]), i) for i in range(1, 200) if rnd.random() > 0.1]
    sent += [(t + rnd.randint(0, 5000), i) for t, i in sent if rnd.random() < 0.05]
    return sorted(sent)


def test_packets_are_given_in_order_within_the_threshold(spark):
    rows, want = [], {}
    for key in range(12):
        arrivals, threshold = shuffled(key), 5000
        rows += [(key, t, n, packet(65480 + i, i, bytes([i % 256]))) for n, (t, i) in enumerate(arrivals)]
        want[key] = given(arrivals, threshold)
    df = spark.createDataFrame(rows, "key int, t long, tie long, raw binary").repartition(3)
    got = rtp.reordered(df, ["key"], "t", "tie", "raw", 5000).collect()
    for key, (out, late) in want.items():
        mine = sorted((r for r in got if r["key"] == key and not r["late"]), key=lambda r: r["n"])
        assert [(r["ts"], r["lost"]) for r in mine] == out and [r["n"] for r in mine] == list(range(len(out)))
        assert sorted(r["ts"] for r in got if r["key"] == key and r["late"]) == sorted(late)
        assert all(r["n"] is None for r in got if r["late"])
    assert rtp.reordered(df.limit(0), ["key"], "t", "tie", "raw").count() == 0


def test_the_streaming_form_gives_the_same(spark, tmp_path):
    arrivals, work = shuffled(3), rtp.Reorder(5000)
    rows = [(1, t, n, i) for n, (t, i) in enumerate(arrivals)] + [(-1, 10**13, 0, 1)]
    spark.createDataFrame(rows, "key long, us long, tie long, number long").select("key", F.timestamp_micros("us").alias("at"), "us", "tie", "number").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = streams.read(spark, f"file://{tmp_path}/in", "key long, at timestamp, us long, tie long, number long")
    live = stateful.fold_in_order(stream, "key", "at", "tie", ["us", "number"], work.start, work.step, "n long, number long, lost boolean, late boolean, given_us long", "1 second")
    got = sorted((r["n"], r["number"], r["lost"]) for r in streams.run_to_end(live).filter("key = 1 and not late").collect())
    out, _ = given(arrivals, 5000)
    assert got == [(n, i, lost) for n, (i, lost) in enumerate(out)][: len(got)] and len(got) >= len(out) - 6  # what waits at the end has no end to wait for


def test_units_of_fragments_and_aggregates(spark):
    unit = lambda kind, n: bytes([0x60 | kind]) + bytes(n % 250 + i % 5 for i in range(n))
    a, b, c, d, e = unit(5, 300), unit(1, 20), unit(7, 9), unit(8, 4), unit(1, 40)
    pieces = lambda u, *cuts: [bytes([u[0] & 0xE0 | 28, (0x80 if x == 1 else 0) | (0x40 if y == len(u) else 0) | u[0] & 31]) + u[x:y] for x, y in zip((1, *cuts), (*cuts, len(u)))]
    together = bytes([0x78]) + b"".join(len(u).to_bytes(2, "big") + u for u in (c, d))
    p = [*pieces(a, 100, 200), b, together, *pieces(e, 10, 20, 30), b""]
    numbered = [(0, i, i * 1000, packet(i, 7, x)) for i, x in enumerate(p)]
    broken = [(1, i, i * 1000, packet(i, 7, x)) for i, x in enumerate(p) if i not in (1, 5)]
    mixed = [(2, i, i * 1000, packet(i, 7, x)) for i, x in enumerate([p[0], b, p[1], p[2]])]
    df = spark.createDataFrame(numbered + broken + mixed, "key int, tie long, t long, raw binary")
    got = rtp.video_units(rtp.reordered(df, ["key"], "t", "tie", "raw", 1), ["key"]).collect()
    units = lambda k: [(r["n"], r["k"], bytes(r["unit"]), r["whole"]) for r in sorted((r for r in got if r["key"] == k), key=lambda r: (r["n"], r["k"]))]
    assert units(0) == [(0, 0, a, True), (3, 0, b, True), (4, 0, c, True), (4, 1, d, True), (5, 0, e, True)]
    assert units(1) == [(0, 0, a[:100], False), (2, 0, b, True), (3, 0, c, True), (3, 1, d, True)]
    assert units(2) == [(0, 0, a[:100], False), (1, 0, b, True)]
