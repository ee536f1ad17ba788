"""Streaming forms give what the batch forms give once the input has ended."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timeline
from tidemark.streaming import queries as streams

SCHEMA = "id long, ts timestamp, user long, kind string, bytes long"


@pytest.fixture
def folder(spark, tmp_path):
    rnd, start, rows = random.Random(2), dt.datetime(2024, 1, 1), []
    for i in range(240):
        start += dt.timedelta(seconds=rnd.randint(1, 90))
        rows.append((i, start, i % 4, rnd.choice(["view", "click"]), rnd.randint(1, 99)))
    for k in range(4):  # files by time, as a live source would bring them
        spark.createDataFrame(rows[60 * k : 60 * k + 60], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return f"file://{tmp_path}/in"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_tumbling_windows(spark, folder):
    batch = spark.read.parquet(folder).groupBy(F.window("ts", "10 minutes"), "kind").agg(F.count("*").alias("n_events"), F.sum("bytes").alias("bytes")).select("kind", F.col("window.start").alias("start"), "n_events", "bytes")
    live = streams.sample_windows(streams.read(spark, folder, SCHEMA, 4), "ts", "10 minutes", ["kind"], "bytes")
    got, want = rows_of(streams.run_to_end(live, "append")), rows_of(batch)
    assert got and set(got) <= set(want)  # windows that the watermark has not passed yet stay open
    assert rows_of(streams.run_to_end(live, "complete")) == want


def test_sliding_and_session_windows(spark, folder):
    live = streams.sliding_speed(streams.read(spark, folder, SCHEMA), "ts", "10 minutes", "5 minutes", "bytes")
    batch = spark.read.parquet(folder).groupBy(F.window("ts", "10 minutes", "5 minutes")).agg(F.sum("bytes").alias("bytes")).select(F.col("window.start").alias("start"), "bytes")
    assert rows_of(streams.run_to_end(live, "complete")) == rows_of(batch)
    live = streams.sessions(streams.read(spark, folder, SCHEMA, 4), "ts", "3 minutes", ["user"])
    batch = spark.read.parquet(folder).groupBy(F.session_window("ts", "3 minutes"), "user").agg(F.count("*").alias("n_events")).select("user", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")
    got = rows_of(streams.run_to_end(live, "append"))
    assert got and set(got) <= set(rows_of(batch))


def test_every_nth_across_batches(spark, folder):
    live = streams.step(streams.read(spark, folder, SCHEMA).withColumn("us", F.unix_micros("ts")).drop("ts"), "user", "id", 5)
    batch = timeline.step(spark.read.parquet(folder), ["id"], 5, ["user"])
    assert sorted(r["id"] for r in streams.run_to_end(live).collect()) == sorted(r["id"] for r in batch.collect())


def test_last_value_across_batches(spark, folder):
    source = streams.read(spark, folder, SCHEMA).select("id", "user", F.col("bytes").cast("double").alias("value"), (F.col("kind") == "click").cast("int").alias("marker"))
    got = streams.run_to_end(streams.keep_last(source, "user", "id", "value", "marker")).collect()
    assert got and all(r["marker"] == 1 for r in got)
    assert {r["id"] for r in got} == {r["id"] for r in spark.read.parquet(folder).filter("kind = 'click'").collect()}


def test_segments_are_seen_once(spark, folder):
    live = streams.segments_once(streams.read(spark, folder, SCHEMA, 4), "ts", ["user"], "30 days")
    assert sorted(r["user"] for r in streams.run_to_end(live).collect()) == [0, 1, 2, 3]


def test_stream_pairs(spark, folder):
    e = streams.read(spark, folder, SCHEMA, 4)
    a, b = e.filter("kind = 'view'"), streams.read(spark, folder, SCHEMA, 4).filter("kind = 'click'")
    got = {(r["l_id"], r["r_id"]) for r in streams.run_to_end(streams.pair_within(a, b, "user", "ts", "5 minutes", "30 days")).collect()}
    rows = spark.read.parquet(folder).collect()
    want = {(x["id"], y["id"]) for x in rows for y in rows if x["kind"] == "view" and y["kind"] == "click" and x["user"] == y["user"] and abs((x["ts"] - y["ts"]).total_seconds()) <= 300}
    assert got == want


def test_each_batch_can_go_to_several_sinks(spark, folder, tmp_path):
    def each(df, i):
        df.write.mode("append").parquet(f"file://{tmp_path}/a")
        df.filter("kind = 'view'").write.mode("append").parquet(f"file://{tmp_path}/b")

    streams.run_to_end(streams.read(spark, folder, SCHEMA), each=each)
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == 240
    assert 0 < spark.read.parquet(f"file://{tmp_path}/b").count() < 240


def test_pushed_rows_and_first_known(spark, tmp_path):
    path = f"file://{tmp_path}/pushed"
    for k in range(3):
        streams.push(spark, path, spark.createDataFrame([(k, 1, "flv" if k else None)], "o long, k int, format string"))
    live = streams.run_to_end(streams.read(spark, path, "o long, k int, format string"))
    assert [r["first_format"] for r in streams.first_known(live, ["k"], "o", "format").orderBy("o").collect()] == [None, "flv", "flv"]


def test_spooled_records_are_sent_once(spark, tmp_path):
    path, sent = f"file://{tmp_path}/spool", []
    for name in ("b1", "b2"):
        streams.spool(spark.createDataFrame([(name,)], "r string"), path, name)

    def send(df):
        if len(sent) == 1 and df.first()["r"] == "b2" and "failed" not in sent:
            sent.append("failed")
            raise OSError("no line")
        sent.append(df.first()["r"])

    with pytest.raises(OSError):
        streams.resend(spark, path, send)
    assert streams.resend(spark, path, send) == ["b2"] and streams.resend(spark, path, send) == []
    assert sent == ["b1", "failed", "b2"]


def test_bitrate_rule_across_batches(spark, tmp_path):
    from tidemark.operators import abr

    rnd, rungs = random.Random(4), [(0, 400_000), (1, 1_200_000), (2, 2_500_000), (3, 5_000_000)]
    rows = [(k, i, rnd.choice([0, 300_000, 700_000, 4_000_000, 9_000_000]), rnd.randint(0, 6000), 4000 * i, rnd.randint(0, 40_000)) for i in range(40) for k in range(3)]
    schema = "k int, n long, measured long, transfer_ms long, start_ms long, buffer_ms long"
    for a in range(0, len(rows), 30):
        spark.createDataFrame(rows[a : a + 30], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    got = streams.run_to_end(streams.replay_rates(streams.read(spark, f"file://{tmp_path}/in", schema), rungs, "k"))
    assert rows_of(got) == rows_of(abr.replay(spark.createDataFrame(rows, schema), rungs, ["k"]))
