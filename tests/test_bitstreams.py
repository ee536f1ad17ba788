"""Bitstream filters and parsers against plain loops: streams cut at any byte, broken headers, odd packets."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import bitstreams as bs


def test_prevention_is_put_in_and_taken_out(spark):
    rnd = random.Random(1)
    payloads = [bytes(rnd.choice([0, 0, 0, 1, 2, 3, 4, 255]) for _ in range(rnd.randint(0, 20))) for _ in range(300)] + [b"", b"\0\0", b"\0\0\0\0\0", b"\0\0\3\0\0\3", b"\n\0\0\n"]

    def guarded(data):
        out, zeros = bytearray(), 0
        for b in data:
            if zeros == 2 and b <= 3:
                out.append(3)
                zeros = 0
            out.append(b)
            zeros = zeros + 1 if b == 0 else 0
        return bytes(out + b"\3" if zeros == 2 else out)

    df = spark.createDataFrame([(p,) for p in payloads], "p binary").withColumn("g", bs.with_prevention(F.col("p")))
    for r in df.withColumn("b", bs.without_prevention(F.col("g"))).collect():
        assert bytes(r["g"]) == guarded(bytes(r["p"])) and bytes(r["b"]) == bytes(r["p"])
        assert not any(x in bytes(r["g"]) for x in (b"\0\0\0", b"\0\0\1", b"\0\0\2"))


def test_units_of_odd_frames(spark):
    frames = [None, b"", b"\0\0", b"no code", b"\0\0\1", b"\0\0\0\1\x65a\0\0\1\x41b\0\0\0\1\x09\n", b"x\0\0\1\x67\0\0\0"]
    got = bs.units(spark.createDataFrame(list(enumerate(frames)), "i int, f binary"), ["i"], "f").orderBy("i", "u").collect()
    assert [(r["i"], r["u"], r["type"], bytes(r["unit"])) for r in got] == [(5, 0, 5, b"\x65a"), (5, 1, 1, b"\x41b"), (5, 2, 9, b"\x09\n"), (6, 0, 7, b"\x67")]


def test_records_and_prefixes():
    avc = bytes([1, 66, 0, 30, 0xFF, 0xE2, 0, 2]) + b"\x67a" + b"\0\3\x67bc\1\0\1\x68"
    assert bs.read_record(avc, False) == (4, [b"\x67a", b"\x67bc", b"\x68"])
    for bad in (None, b"", b"\0\0\0\1", avc[:9], b"\0" + avc[1:]):
        assert bs.read_record(bad, False) is None and bs.start_coded(b"abc", bad, False) == b"abc"
    assert bs.read_record(bytes([1] + [0] * 20 + [0, 1, 50, 0, 0]), True) is None  # a type that no record holds
    packet = b"\0\0\0\2\x09x" + b"\0\0\0\2\x65y" + b"\0\0\0\1\x65" + b"\0\0\0\5\x41"
    assert bs.start_coded(packet, avc, False) == b"".join(bs.START_CODE + u for u in (b"\x09x", b"\x67a", b"\x67bc", b"\x68", b"\x65y", b"\x65", b"\x41"))
    assert list(bs.prefixed(b"\0\1", 4)) == []


def test_sequence_sets_with_scaling_and_cut_short(spark):
    bits = lambda *parts: "".join(parts)
    ue = lambda v: "0" * (len(bin(v + 1)) - 3) + bin(v + 1)[2:]
    scaling = "1" + ue(1) + ue(18) + "0" * 7  # the first list: a delta of 1, then -9: it ends; seven lists are not there
    text = bits(f"{100:08b}", "0" * 8, f"{40:08b}", ue(0), ue(1), ue(0), ue(0), "0", "1", scaling, ue(0), ue(2), ue(4), "0", ue(119), ue(67), "1", "1", "1", ue(0), ue(0), ue(0), ue(4), "01")
    whole = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    assert bs.sequence_set(whole) is not None and bs.sequence_set(whole[:5]) is None and bs.sequence_set(b"") is None
    rows = spark.createDataFrame([(0, 7, b"\x67" + whole), (1, 7, b"\x67"), (2, 8, b"\x68")], "i int, type int, unit binary")
    got = {r["i"]: r for r in bs.sequence_sets(rows, ["i"]).collect()}
    assert set(got) == {0, 1} and got[1]["width"] is None and (got[0]["profile"], got[0]["width"], got[0]["height"]) == (100, 1920, 1080)


def test_superframes_split_and_join(spark):
    shown, hidden = b"\x86", b"\x84"
    packets = [(1, hidden + b"a" * 300), (2, hidden + b"b"), (3, shown + b"c"), (4, shown), (5, hidden), *((6 + i, hidden) for i in range(8)), (14, shown), (15, hidden)]
    made = bs.superframes(spark.createDataFrame([("k", *p) for p in packets], "k string, i int, d binary"), ["k"], "i", "d").orderBy("n").collect()
    assert [(r["n"], r["i"], r["frames"]) for r in made] == [(0, 3, 3), (1, 4, 1), (2, 14, 10)] and made[2]["data"] is None
    first = bytes(made[0]["data"])
    assert first == packets[0][1] + packets[1][1] + packets[2][1] + bytes([0xCA, 45, 1, 2, 0, 2, 0, 0xCA])
    rows = [(0, first), (1, shown), (2, None), (3, b""), (4, b"\xc0"), (5, b"ab" + bytes([0xC1, 9, 9, 0xC1])), (6, b"ab" + bytes([0xC1, 0, 2, 0xC1]))]
    parts = bs.superframe_parts(spark.createDataFrame(rows, "i int, d binary"), ["i"], "d").orderBy("i", "k").collect()
    assert [(r["i"], r["k"], bytes(r["part"])) for r in parts] == [(0, 0, packets[0][1]), (0, 1, packets[1][1]), (0, 2, packets[2][1]), (1, 0, shown), (4, 0, b"\xc0"), (5, 0, b"ab"), (6, 1, b"ab")]


def _audio(kind, rnd):
    if kind == "AC3":
        code, index = rnd.randrange(3), rnd.randrange(6)
        head = bytes([0x0B, 0x77, 0, 0, code << 6 | index, 0x40, 0x40, 0])
        size = bs.ac3_header(head)[0]
    elif kind == "MP3":
        head = bytes([255, 0xFB, rnd.randint(1, 14) << 4 | rnd.randrange(3) << 2 | rnd.randrange(2) << 1, 0])
        size = bs.mpeg_header(head)[0]
    else:
        size = rnd.randint(7, 90)
        head = bytes([255, 0xF1, 0x50, 0x40 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 31, 0xFC])
    return head + bytes(rnd.randrange(1, 10) for _ in range(size - len(head)))


@pytest.mark.parametrize("kind", ["AC3", "MP3", "ADTS"])
def test_frames_do_not_depend_on_where_chunks_are_cut(spark, kind):
    rnd = random.Random(kind)
    rows, want = [], []
    for key in range(6):
        frames = [_audio(kind, rnd) for _ in range(8)]
        junk = b"\x0b\xff\x0b" if key % 2 else b""
        stream = junk + b"".join(frames) + frames[0][: rnd.randint(1, 6)]
        cuts = sorted(rnd.randrange(len(stream) + 1) for _ in range(key * 5)) if key < 5 else range(1, len(stream))
        edges = [0, *cuts, len(stream)]
        rows += [(key, t, 10 * t, stream[a:b]) for t, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
        at = len(junk)
        for n, f in enumerate([*frames, stream[len(junk) + sum(map(len, frames)) :]]):
            want.append((key, n, 10 * max(t for t, e in enumerate(edges[:-1]) if e <= at), f, n == 8))
            at += len(f)
    got = bs.audio_frames(spark.createDataFrame(rows, "key int, o int, t int, d binary").repartition(3), ["key"], "o", "t", "d", kind).collect()
    assert sorted((r["key"], r["n"], r["ts"], bytes(r["frame"]), r["last"]) for r in got) == sorted(want)


def test_headers_that_are_none():
    assert bs.ac3_header(b"\x0b\x77\0\0\xc0\x40\x40\0") is None and bs.ac3_header(b"\x0b\x77\0\0\x3f\x40\x40\0") is None and bs.ac3_header(b"12345678") is None
    assert bs.ac3_header(bytes([0x0B, 0x77, 0, 63, 0x0F, 0x80, 0, 0])) == (128, 48000, 6)  # the extended form
    assert [bs.mpeg_header(bytes(x)) for x in ([255, 0xEB, 0x90, 0], [255, 0xF9, 0x90, 0], [255, 0xFB, 0xF0, 0], [255, 0xFB, 0x9C, 0])] == [None] * 4
    assert bs.mpeg_header(bytes([255, 0xFF, 0x10, 0]))[0] == 12 * 32000 // 44100 * 4 and bs.mpeg_header(bytes([255, 0xF3, 0x10, 0xC0])) == (72 * 8000 // 22050, 22050, 1)
    assert bs.adts_header(b"\xff\xf1\0\0\0\0\0") is None


def test_small_filters_on_odd_packets(spark):
    rows = spark.createDataFrame([(0, None), (1, b""), (2, b"\0\0"), (3, b"\xff\xf1\x50\x80\x01\x3f\xfc"), (4, b"\0\3abcd"), (5, b"\0\3a")], "i int, d binary")
    d = F.col("d")
    got = rows.select("i", bs.chomp(d).alias("c"), bs.adts_to_config(d).alias("a"), bs.sample_to_text(d).alias("s"), bs.core_only(d).alias("o"), bs.with_record(d, F.lit(b"\0\3"), F.lit(True)).alias("r")).orderBy("i").collect()
    assert [r["c"] for r in got] == [None, b"", b"", rows.collect()[3]["d"], b"\0\3abcd", b"\0\3a"]
    assert [r["a"] for r in got] == [None] * 6 and [r["s"] for r in got] == [None, None, "", None, "abc", None]
    assert [r["r"] for r in got][4] == b"\0\3abcd" and got[2]["r"] == b"\0\3\0\0"
    assert [r["o"] for r in got] == [r["d"] for r in rows.collect()]
