"""Written media files, listed and pushed sources, and state with timers."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import queues
from tidemark.sources import listed, media_sinks, readers
from tidemark.streaming import pushed, stateful
from tidemark.streaming import queries as streams


@pytest.fixture
def folder(spark, tmp_path):
    media_sinks.register(spark)
    pushed.register(spark)
    return f"file://{tmp_path}"


def files_in(folder):
    root = folder.removeprefix("file://")
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.startswith("."))


def raw(spark, rows):
    return spark.createDataFrame(rows, "file string, n int, data binary")


def test_a_task_that_is_tried_twice_leaves_one_file(spark, folder, monkeypatch):
    from pyspark.sql import SparkSession  # noqa: F401

    encoder = media_sinks.Raw

    def writer(path):
        return media_sinks._Writer(path, encoder, False)

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    import pyarrow as pa

    def batches(fail):
        yield pa.RecordBatch.from_pylist([{"file": "a/x.bin", "data": b"1"}, {"file": "a/x.bin", "data": b"2"}])
        if fail:
            raise RuntimeError("lost")
        yield pa.RecordBatch.from_pylist([{"file": "b.bin", "data": b"3"}])

    w, now = writer(f"{folder}/out"), Task(1)
    monkeypatch.setattr(media_sinks.TaskContext, "get", classmethod(lambda cls: now))
    with pytest.raises(RuntimeError):
        w.write(batches(True))
    now = Task(2)
    first = w.write(batches(False))
    now = Task(3)
    w.write(batches(False))  # a second one that ran at the same time; its message is not taken
    w.commit([first, None])
    assert files_in(f"{folder}/out") == ["_SUCCESS", "a/x.bin", "b.bin"]
    assert open(f"{folder}/out/a/x.bin".removeprefix("file://"), "rb").read() == b"12"
    again = writer(f"{folder}/out")
    now = Task(4)
    message = again.write(batches(False))
    with pytest.raises(ValueError, match="there already"):
        again.commit([message])
    other = writer(f"{folder}/out")
    other.write(batches(False))
    other.abort([])
    assert files_in(f"{folder}/out") == ["_SUCCESS", "a/x.bin", "b.bin"]


def test_modes_and_names(spark, folder):
    one = raw(spark, [("x.bin", 1, b"b"), ("x.bin", 0, b"a"), ("d/y.bin", 0, b"")])
    save = lambda df, mode="append": media_sinks.by_file(df, ["n"]).write.format("raw_files").mode(mode).save(f"{folder}/o")
    save(one)
    assert files_in(f"{folder}/o") == ["_SUCCESS", "d/y.bin", "x.bin"]
    save(raw(spark, [("z.bin", 0, b"z")]), "overwrite")
    assert files_in(f"{folder}/o") == ["_SUCCESS", "z.bin"]
    for bad in ("../up.bin", "/abs.bin", "_hidden", "", None):
        with pytest.raises(Exception, match="no name for a file"):
            save(raw(spark, [(bad, 0, b"")]))
    with pytest.raises(Exception, match="by_file|several partitions"):
        raw(spark, [("q", 0, b"1"), ("r", 0, b"2"), ("q", 1, b"3")]).coalesce(1).write.format("raw_files").mode("append").save(f"{folder}/o")
    with pytest.raises(Exception, match="needs columns"):
        one.write.format("flv").mode("append").save(f"{folder}/o")
    assert files_in(f"{folder}/o") == ["_SUCCESS", "z.bin"]


def test_many_files_are_given_their_names_by_tasks(spark, folder, monkeypatch):
    rows = raw(spark, [(f"{'ab'[i % 2]}/{i}.bin", j, b"%d" % j) for i in range(40) for j in range(3)])
    moved = []
    monkeypatch.setattr(media_sinks.Written, "__post_init__", lambda self: moved.extend(self.files), raising=False)
    media_sinks.save(rows, ["n"], "raw_files", f"{folder}/m")
    assert not moved  # no file's name came to the driver
    root = f"{folder}/m".removeprefix("file://")
    assert files_in(f"{folder}/m") == sorted(["_SUCCESS", *(f"{'ab'[i % 2]}/{i}.bin" for i in range(40))]) and not [d for d in os.listdir(root) if d.startswith("_attempts")]
    assert all(open(f"{root}/{'ab'[i % 2]}/{i}.bin", "rb").read() == b"012" for i in range(40))
    with pytest.raises(ValueError, match="there already: .*a/6.bin"):
        media_sinks.save(raw(spark, [("a/6.bin", 0, b"x"), ("new.bin", 0, b"y")]), ["n"], "raw_files", f"{folder}/m")
    assert len(files_in(f"{folder}/m")) == 41 and open(f"{root}/a/6.bin", "rb").read() == b"012"
    assert not [d for d in os.listdir(root) if d.startswith("_attempts")]


def test_names_that_cannot_be_given_are_all_taken_back(spark, folder, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "in").write_bytes(b"a file, not a folder")
    with pytest.raises(Exception):
        media_sinks.save(raw(spark, [*((f"{i}.bin", 0, b"x") for i in range(20)), ("in/y.bin", 0, b"y")]), ["n"], "raw_files", f"{folder}/t")
    assert files_in(f"{folder}/t") == ["in"]


def test_a_lists_files_are_read_by_tasks(spark, folder, tmp_path, monkeypatch):
    for i in range(50):
        (tmp_path / f"f%20 {i}.bin").write_bytes(b"%d" % i)
    (tmp_path / "list").write_text("".join(f"file 'f%20 {i}.bin'\n" for i in range(50)))
    named = []
    qualified = readers.qualified
    monkeypatch.setattr(readers, "qualified", lambda s, names: named.extend(names) or qualified(s, names))
    got = readers.open_source(spark, f"{folder}/list", "FFCAT").orderBy("item").collect()
    assert [bytes(r["content"]) for r in got] == [b"%d" % i for i in range(50)] and got[0]["file"] == f"file:{tmp_path}/f%20 0.bin"
    assert len(named) < 5


def test_masters_named_by_rows_are_those_of_a_pattern(spark, folder, tmp_path):
    from tidemark.sources import hls

    for i in range(12):
        (tmp_path / f"u{i}").mkdir()
        (tmp_path / f"u{i}" / "master.m3u8").write_text(f"#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH={400000 + i}\nlo.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=900000\nhi.m3u8\n")
    masters = spark.createDataFrame([(f"{folder}/u{i}/master.m3u8",) for i in range(12)], "m string")
    short = lambda df: sorted((r["master"].split("/")[-2], r["bandwidth"], r["url"].split("/")[-1], r["rung"]) for r in df.collect())
    got = short(hls.variants_of(masters, "m"))
    assert len(got) == 24 and got == short(hls.variants(spark, f"{folder}/*/master.m3u8"))
    many = spark.range(0, 300, 1, 1).select("id", F.lit(f"{folder}/u1/master.m3u8").alias("path"))
    seen = []
    kept = listed.pa.concat_batches
    listed.pa.concat_batches, made = (lambda parts: seen.append(len(parts)) or kept(parts)), None
    try:
        asked = listed.pa.RecordBatch.from_pydict({"id": list(range(300)), "path": [f"{folder}/u1/master.m3u8"] * 300, "a": [None] * 300, "b": [None] * 300})

        class Rows:  # the function that tasks run, here in this process
            schema = many.schema
            select = lambda self, *c: self
            mapInArrow = lambda self, f, kinds: list(f([asked]))

        Rows.schema = many.select("id", "path").schema
        made = listed.texts(Rows(), ["id"], "path")
    finally:
        listed.pa.concat_batches = kept
    assert seen == [300] and [b.num_rows for b in made] == [300] and made[0].column(0).to_pylist() == list(range(300))
    assert {r["n"] for r in listed.texts(many, ["id"], "path").groupBy("text").agg(F.count("*").alias("n")).collect()} == {300}


def test_ranges_of_many_chunks_are_found_by_bisection(monkeypatch):
    import time

    rnd = random.Random(2)
    found = sorted({(a, a + rnd.randint(1, 400), f"c{a}") for a in [0, *(rnd.randrange(2000) for _ in range(150))]})
    reader = pushed.PushedReader({"path": "x", "unit": "10", "unitsPerPartition": "3"})
    monkeypatch.setattr(pushed, "chunks", lambda path: found)
    end = pushed.reaches(found, 0) // 10 * 10
    parts = reader.partitions({"bytes": 0}, {"bytes": end})
    assert len(parts) > 50 and all(p.parts == [c for c in found if c[0] < p.end and c[1] > p.start] for p in parts)
    found = [(a, a + 1000, "") for a in range(0, 60_000_000, 1000)]
    reader = pushed.PushedReader({"path": "x", "unit": "10", "unitsPerPartition": "300"})
    began = time.process_time()
    assert len(reader.partitions({"bytes": 0}, {"bytes": 60_000_000})) == 20_000
    assert time.process_time() - began < 20  # 1,200 million comparisons take minutes


def test_subtitles_are_found_by_their_folder(spark, monkeypatch):
    from tidemark import queries

    opened, kept = [], readers.open_source
    monkeypatch.setattr(readers, "open_source", lambda s, path, *rest: opened.append(path) or kept(s, path, *rest))
    assert queries.QUERIES["subtitles_written"](spark, "/root/testdata/sf0.001").count() == 2000
    assert len(opened) == 2 and not any("*" in path for path in opened)


def test_encoders_refuse_what_has_no_form():
    with pytest.raises(ValueError, match="8191"):
        media_sinks.Adts().packet({"config": b"\x12\x10", "payload": bytes(8185)})
    with pytest.raises(ValueError, match="no such header"):
        media_sinks.Adts().packet({"config": b"\x2f\x80", "payload": b""})
    ivf = media_sinks.Ivf()
    head = ivf.head({"fourcc": "VP90", "width": 640, "height": 360, "rate": 30, "scale": 1, "frames": 7})
    assert len(head) == 32 and head[:4] == b"DKIF" and head[8:12] == b"VP90" and head[12:16] == b"\x80\x02\x68\x01" and head[24] == 7
    assert ivf.packet({"pts": -1, "data": b"ab"}) == b"\x02\0\0\0" + b"\xff" * 8 + b"ab"
    assert media_sinks.Pictures().packet({"data": b"xy"}).endswith(b"Content-length: 2\r\n\r\nxy\r\n")


def test_lists_match_files_by_their_whole_path(spark, folder, tmp_path):
    for d in ("a", "b", "we[ir]d*"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.bin").write_bytes(d.encode())
    (tmp_path / "list").write_text(f"ffconcat version 1.0\nfile a/x.bin\nfile 'b/x.bin'\nfile 'we[ir]d*/x.bin'\nfile {folder}/a/x.bin\nfile {tmp_path}/b/x.bin\n")
    got = readers.open_source(spark, f"{folder}/list", "FFCAT").orderBy("item").collect()
    assert [(r["item"], bytes(r["content"])) for r in got] == [(0, b"a"), (1, b"b"), (2, b"we[ir]d*"), (3, b"a"), (4, b"b")]
    (tmp_path / "gone").write_text("file a/none.bin\n")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.open_source(spark, f"{folder}/gone", "FFCAT").collect()
    (tmp_path / "empty").write_text("ffconcat version 1.0\n")
    assert readers.open_source(spark, f"{folder}/empty", "FFCAT").count() == 0
    assert readers.MOST_ITEMS > 100_001
    readers.MOST_ITEMS, most = 4, readers.MOST_ITEMS
    try:
        with pytest.raises(ValueError, match="more than 4"):
            readers.open_source(spark, f"{folder}/list", "FFCAT")
    finally:
        readers.MOST_ITEMS = most


def test_subtitle_formats_are_registered(spark, folder, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.500 align:start\nhi\nyou\n")
    (tmp_path / "a.ass").write_text("[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,Main,,0,0,0,,{\\i1}hi\\Nyou, too\n")
    for name, text in (("a.vtt", "hi\nyou"), ("a.ass", "hi\nyou, too")):
        assert [(r["start_ms"], r["end_ms"], r["text"]) for r in readers.open_source(spark, f"{folder}/{name}").collect()] == [(1000, 2500, text)]


def test_only_missing_bytes_are_read(spark, folder, tmp_path):
    data = bytes(range(256)) * 4
    (tmp_path / "f.bin").write_bytes(data)
    rnd = random.Random(3)
    asked = [(k, a, a + rnd.randint(0, 80)) for k in range(3) for a in [rnd.randrange(1100) for _ in range(12)]]
    had = [(k, a, a + rnd.randint(0, 60)) for k in range(2) for a in [rnd.randrange(1100) for _ in range(12)]]
    a = spark.createDataFrame([(*r, f"{folder}/f.bin") for r in asked], "k int, beg long, end long, path string")
    h = spark.createDataFrame(had, "k int, beg long, end long")
    want = {(k, i) for k, b, e in asked for i in range(b, min(e, len(data)))} - {(k, i) for k, b, e in had for i in range(b, e)}
    got = listed.fill(a, h, ["k"], "path", block=17).collect()
    read = [(r["k"], r["at"] + i) for r in got for i in range(len(r["data"]))]
    assert len(read) == len(set(read)) and set(read) == want  # each missing byte once, and no other
    assert all(bytes(r["data"]) == data[r["at"] : r["at"] + len(r["data"])] for r in got)


def push_file(folder, start, data):
    root = folder.removeprefix("file://")
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/{start:020d}-{len(data)}.chunk", "wb") as f:
        f.write(data)


def read_on(spark, folder, out, checkpoint, **options):
    stream = spark.readStream.format("pushed").options(unit=10, unitsPerPartition=3, unitsPerRead=2, **options).load(folder)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sorted((r["n"], bytes(r["raw"])) for r in spark.read.schema("n long, raw binary").parquet(out).collect())


def test_a_restarted_query_gives_each_packet_once(spark, folder):
    data = bytes(random.Random(1).randrange(256) for _ in range(205))
    units = [(i, data[10 * i : 10 * i + 10]) for i in range(20)]
    where, out, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint"
    push_file(where, 0, data[:33])
    assert read_on(spark, where, out, checkpoint) == units[:3]
    assert read_on(spark, where, out, checkpoint) == units[:3]  # nothing new
    push_file(where, 70, data[70:])
    assert read_on(spark, where, out, checkpoint) == units[:3]  # a hole
    push_file(where, 33, data[33:70])
    assert read_on(spark, where, out, checkpoint, discard="true") == units
    for name in os.listdir(f"{folder}/checkpoint/commits".removeprefix("file://")):
        if "2" in name:  # as if the driver was lost between writing the last batch and noting it as done
            os.remove(f"{folder}/checkpoint/commits/{name}".removeprefix("file://"))
    assert read_on(spark, where, out, checkpoint) == units


def test_pushed_offsets(spark, folder):
    where = f"{folder}/p"
    reader = pushed.PushedReader({"path": where, "unit": "10", "discard": "true", "unitsPerPartition": "2"})
    assert reader.initialOffset() == reader.latestOffset() == {"bytes": 0} and reader.partitions({"bytes": 0}, {"bytes": 0}) == []
    push_file(where, 25, b"x" * 5)
    assert reader.initialOffset() == {"bytes": 30} and reader.latestOffset() == {"bytes": 30}
    push_file(where, 30, b"y" * 50)
    parts = reader.partitions({"bytes": 30}, {"bytes": 80})
    assert [(p.start, p.end) for p in parts] == [(30, 50), (50, 70), (70, 80)]
    assert [b.num_rows for b in reader.read(parts[0])] == [2]
    reader.commit({"bytes": 40})
    assert len(pushed.chunks(where)) == 1
    reader.commit({"bytes": 80})
    with pytest.raises(ValueError, match="no longer there"):
        reader.partitions({"bytes": 30}, {"bytes": 80})


LIVE = "user long, at timestamp, n long, quality long, is_key boolean"


def live(spark, folder, rows, cuts, late_by):
    """The rows as files, in an order that is up to `late_by` rows from that of their times, behind them a far row."""
    rnd = random.Random(5)
    mixed = [r for _, r in sorted((i + rnd.random() * late_by, r) for i, r in enumerate(rows))]
    mixed.append((-1, dt.datetime(2100, 1, 1), 0, 0, False))
    edges = [0, *sorted(rnd.sample(range(1, len(mixed)), cuts - 1)), len(mixed)] if cuts > 1 else [0, len(mixed)]
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        spark.createDataFrame(mixed[a:b], LIVE).coalesce(1).write.parquet(f"{folder}/stage{k}")
        name = next(f for f in files_in(f"{folder}/stage{k}") if f.endswith(".parquet"))
        root = folder.removeprefix("file://")
        os.makedirs(f"{root}/live", exist_ok=True)
        os.rename(f"{root}/stage{k}/{name}", f"{root}/live/{k}.parquet")
        os.utime(f"{root}/live/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return streams.read(spark, f"{folder}/live", LIVE, 1)


@pytest.mark.parametrize("cuts, late_by", [(1, 0), (4, 0), (6, 12)])
def test_a_switch_is_that_of_the_batch_however_the_stream_is_cut(spark, folder, cuts, late_by):
    rnd, at, rows = random.Random(cuts), dt.datetime(2024, 1, 1), []
    for i in range(150):
        at += dt.timedelta(seconds=rnd.randint(0, 9))
        rows.append((i % 3, at, i, rnd.randrange(2), rnd.random() < 0.15))
    switch_at = int(rows[60][1].replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    batch = spark.createDataFrame(rows, LIVE).withColumn("us", F.unix_micros("at"))
    want = queues.splice(batch.filter("quality = 0").drop("quality"), batch.filter("quality = 1").drop("quality"), ["user"], "us", "is_key", switch_at)
    stream = stateful.switch(live(spark, folder, rows, cuts, late_by), "user", "at", "n", "quality", "is_key", switch_at, "10 minutes")
    got = streams.run_to_end(stream).filter("user >= 0")
    assert sorted((r["user"], r["n"], r["quality"]) for r in got.collect()) == sorted((r["user"], r["n"], r["quality"]) for r in want.collect())


@pytest.mark.parametrize("cuts", [1, 5])
def test_timers_fire_once_in_order_unless_taken_back(spark, folder, cuts):
    rnd, at, rows = random.Random(9), dt.datetime(2024, 1, 1), []
    for i in range(120):
        at += dt.timedelta(seconds=rnd.randint(1, 30))
        rows.append((i % 2, at, rnd.randrange(6), rnd.randint(0, 400), rnd.random() < 0.2))
    want = {}
    for user in (0, 1):
        mine = [r for r in rows if r[0] == user]
        fired = []
        for i, (_, t, n, wait, back) in enumerate(mine):
            later = next((s for _, s, m, _, _ in mine[i + 1 :] if m == n), None)
            fires = t + dt.timedelta(seconds=wait)
            if not back and (later is None or later > fires):
                fired.append((fires, n))
        want[user] = [n for _, n in sorted(fired)]
    stream = live(spark, folder, rows, cuts, 0)
    fires = F.when(~F.col("is_key"), F.timestamp_micros(F.unix_micros("at") + F.col("quality") * 1_000_000))
    got = streams.run_to_end(stateful.timers(stream.withColumn("fires", fires), "user", "at", "n", "fires", "1 minute")).filter("user >= 0").collect()
    for user in (0, 1):
        assert [r["n"] for r in sorted((r for r in got if r["user"] == user), key=lambda r: r["place"])] == want[user]
        assert sorted(r["place"] for r in got if r["user"] == user) == list(range(1, len(want[user]) + 1))


def test_an_attempts_files_lie_in_one_folder(spark, folder, monkeypatch):
    seen = []
    publish = media_sinks._each

    def each(session, path, folders, act):
        if act is media_sinks._publish:
            root = path.removeprefix("file://")
            seen.extend((f, d) for f in folders for _, d, _ in os.walk(f"{root}/{f}"))
        return publish(session, path, folders, act)

    monkeypatch.setattr(media_sinks, "_each", each)
    media_sinks.save(raw(spark, [(f"{i}/in/x.bin", j, b"%d" % (i + j)) for i in range(20) for j in range(2)]), ["n"], "raw_files", f"{folder}/s")
    assert seen and not [d for _, d in seen if d]  # a folder for each name would take a block of disk in each attempt
    root = f"{folder}/s".removeprefix("file://")
    assert all(open(f"{root}/{i}/in/x.bin", "rb").read() == b"%d%d" % (i, i + 1) for i in range(20))


RANGES = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:3\n#EXTINF:1,\n#EXT-X-BYTERANGE:20@10\na.ts\n#EXT-X-BYTERANGE: 30\n#EXTINF:1,\na.ts\n#EXTINF:1,\nb.ts\n#EXTINF:1,\n#EXT-X-BYTERANGE:5@0\na.ts\n#EXT-X-BYTERANGE:7\n#EXTINF:1,\na.ts\n"


def test_byte_ranges_of_a_playlist(spark):
    from tidemark.sources import playlist

    parse = lambda text: playlist.segments(playlist.lines(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text"), ranges=True).orderBy("seq")
    assert [(r["seq"], r["url"], r["beg"], r["end"]) for r in parse(RANGES).collect()] == [(3, "a.ts", 10, 30), (4, "a.ts", 30, 60), (5, "b.ts", None, None), (6, "a.ts", 0, 5), (7, "a.ts", 5, 12)]
    for before in ("", "#EXTINF:1,\na.ts\n", "#EXT-X-BYTERANGE:5@0\n#EXTINF:1,\nb.ts\n"):
        with pytest.raises(Exception, match="no offset for a byte range of a.ts"):
            parse(f"#EXTM3U\n{before}#EXT-X-BYTERANGE:5\n#EXTINF:1,\na.ts\n").collect()


def test_segments_that_are_ranges_or_whole_files(spark, folder, tmp_path, monkeypatch):
    from tidemark.sources import hls

    monkeypatch.setattr(listed, "READ_UNITS", 2)
    unit = lambda i: b"G%03d" % i + bytes(184)
    (tmp_path / "all.ts").write_bytes(b"".join(unit(i) for i in range(8)) + b"G")
    (tmp_path / "own.ts").write_bytes(unit(100) + unit(101))
    item = lambda n, at: f"#EXT-X-BYTERANGE:{n * 188}{at}\n#EXTINF:1,\nall.ts\n"
    (tmp_path / "list.m3u8").write_text(f"#EXTM3U\n{item(1, '@0')}{item(3, '')}#EXTINF:1,\nown.ts\n{item(2, '@752')}{item(2, '')}#EXTINF:1,\nall.ts\n")
    parts = hls.segments(hls.variants(spark, f"{folder}/list.m3u8"))
    numbers = lambda rows: [(r["seq"], r["n"] % (1 << 32), int(r["raw"][1:4])) for r in rows.orderBy("n").collect()]
    ranges = {0: [0], 1: [1, 2, 3], 2: [100, 101], 3: [4, 5], 4: [6, 7], 5: range(8)}
    assert numbers(hls.packets(parts)) == [(seq, n, i) for seq, found in ranges.items() for n, i in enumerate(found)]
    assert numbers(hls.packets(parts.drop("beg", "end").filter("seq = 2"))) == [(2, 0, 100), (2, 1, 101)]


def test_hls_files_are_as_many_as_users_not_days(spark):
    from tidemark.queries import QUERIES, events
    from tidemark.storage import file_names, shared_folder

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    where = f"{shared_folder(spark)}/tidemark"
    there = set(file_names(spark, where))
    QUERIES["hls_packets"](spark, sf)
    (made,) = [f for f in file_names(spark, where) if f.startswith("hls-") and f not in there]
    users, days = events(spark, sf).selectExpr("count(distinct user_id)", "count(distinct user_id, us div 86400000000)").first()
    found = files_in(f"{where}/{made}")
    own = [f for f in found if "-s" in f]
    assert days > 3 * users and 0 < len(own) <= 2 * (users // 10 + 1)
    assert len(found) == 5 * users + len(own) + 1  # a master, two lists and two qualities; _SUCCESS


def test_formats_are_found_from_other_threads_and_sessions(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    from tidemark.sources import transport

    def write(session, name):  # in a new thread no session is active
        rows = session.range(2).selectExpr("'x.ts' as file", "cast(id as int) as n", "cast(repeat('G', 188) as binary) as data")
        media_sinks.save(rows, ["n"], "raw_files", f"{folder}/{name}")
        return files_in(f"{folder}/{name}")

    def read(session):
        transport.register(session)
        return session.read.format("ts_packets").load(f"{folder}/one/x.ts").count()

    in_thread = lambda f, *args: ThreadPoolExecutor(1).submit(f, *args).result()
    other = spark.newSession()
    assert in_thread(write, other, "one") == in_thread(write, spark, "two") == ["_SUCCESS", "x.ts"]
    assert in_thread(read, other) == in_thread(read, spark) == 2


def test_rows_that_lie_by_files_are_not_dealt_again(spark, folder):
    lie = raw(spark, [(f"{i}.bin", j, b"%d" % j) for i in range(6) for j in range(3)]).repartition(3, "file").sortWithinPartitions("file", "n")
    media_sinks.save(lie, None, "raw_files", f"{folder}/p")
    root = f"{folder}/p".removeprefix("file://")
    assert all(open(f"{root}/{i}.bin", "rb").read() == b"012" for i in range(6))
    torn = raw(spark, [("a.bin", j, b"%d" % j) for j in range(40)]).repartition(2)
    with pytest.raises(Exception, match="several partitions: .*a.bin"):
        media_sinks.save(torn, None, "raw_files", f"{folder}/torn")
    assert files_in(f"{folder}/torn") == []
