import hashlib
import hmac
import random
import zlib
from math import gcd
from urllib.parse import quote, urljoin

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashes, maps, timemath, url, windows
from tidemark.schema import is_failure
from tidemark.sources import playlist, scripts, sniff, subtitles, transport


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "address, host, port, path, domain",
    [
        ("http://a.b/c/d.mp4?x=1", "a.b", 80, "c/d.mp4?x=1", ""),
        ("https://a.b:8443/c", "a.b", 8443, "c", ""),
        ("https://a.b", "a.b", 443, "", ""),
        ("rtmp://h:1935/app", "h", 1935, "app", ""),
        ("http://h:x/p", "h", 0, "p", ""),
        ("http://1.2.3.4/f.mp3?domain=q.r", "1.2.3.4", 80, "f.mp3", "q.r"),
        ("http://h/f.mp3?domain=q.r&k=2", "h", 80, "f.mp3?k=2", "q.r"),
        ("http://h/f.mp3?k=2&domain=q.r&z=3", "h", 80, "f.mp3?k=2&z=3", "q.r"),
    ],
)
def test_url_parts(spark, address, host, port, path, domain):
    u = F.col("u")
    got = spark.createDataFrame([(address,)], "u string").select(url.host(u), url.port(u), url.path(u), url.domain(u)).first()
    assert tuple(got) == (host, port, path, domain)


def test_names_and_extensions(spark):
    u = F.col("u")
    for address, ext, name in (("http://a/b.c/x.Mp3,1?q=.z", "MP3", "x"), ("noext", "", "noext"), ("a/b.m3u8", "M3U8", "b")):
        got = spark.createDataFrame([(address,)], "u string").select(url.extension(u), url.short_name(u)).first()
        assert tuple(got) == (ext, name)


def test_strict_split(spark):
    u = F.col("u")
    rows = ["http://h:80/p%20q?x=1#f", "http://[::1]:81", "http://h:/p", "http://h:9x/", "nothing", "http://[::1/p", "ftp://h?x"]
    got = [r["s"] for r in spark.createDataFrame([(r,) for r in rows], "u string").select(url.split_url(u).alias("s")).collect()]
    assert [None if g is None else (g["host"], g["ipv6"], g["port"], g["path"], g["query"]) for g in got] == [("h", False, 80, "/p%20q", "x=1"), ("::1", True, 81, "/", ""), None, None, None, None, ("h", False, None, "/", "x")]


def test_escapes():
    rnd = random.Random(1)
    for _ in range(200):
        s = "".join(rnd.choice("aZ09-_.~ /?&=+%é🙂\n") for _ in range(10))
        assert url.percent_encode(s) == quote(s, safe="-_.~") and url.percent_decode_strict(url.percent_encode(s)) == s
    assert url.percent_decode_strict("a%2Fb%zzc") == "a/b" and url.percent_decode_strict("a b") == "a" and url.percent_decode_strict("x%4") == "x"
    assert url.percent_decode_lenient("a+%zz%41%") == "a %zzA%"


def test_resolve_matches_the_library(spark):
    base = "http://h.example/a/b/c.m3u8?x=/y"
    links = ["seg.ts", "/root.ts", "http://o.example/z", "//p.example/q", "d/e.ts?k=1"]
    got = [r["x"] for r in spark.createDataFrame([(x,) for x in links], "l string").select(url.resolve(F.lit(base), F.col("l")).alias("x")).collect()]
    assert got == [urljoin(base, x) for x in links]


def test_addresses(spark):
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in ("1.2.3.4", "256.1.1.1", "1.2.3", "255.255.255.255")], "t string").select(url.ipv4_number(t).alias("n")).collect()
    assert [r["n"] for r in rows] == [16909060, None, None, 4294967295]


def test_hashes_match_the_standard_library(spark):
    data = [b"", b"a", b"hello world", bytes(range(256)) * 3]
    df = spark.createDataFrame([(x,) for x in data], "d binary")
    d = F.col("d")
    names = ["md5", "SHA1", "sha224", "sha256", "sha384", "sha512", "CRC32", "adler32"]
    for row, x in zip(df.select(*[hashes.hash_by_name(n, d).alias(n) for n in names], hashes.hmac_hex("sha256", b"k", d).alias("h"), hashes.djb2_hash(d).alias("djb2")).collect(), data, strict=True):
        for n in names[:6]:
            assert row[n] == hashlib.new(n.lower(), x).hexdigest()
        assert row["CRC32"] == f"{zlib.crc32(x):08x}" and row["adler32"] == f"{zlib.adler32(x):08x}"
        assert row["h"] == hmac.new(b"k", x, "sha256").hexdigest()
    with pytest.raises(ValueError):
        hashes.hash_by_name("none", d)
    assert hashes.djb2(b"ab") == (5381 * 33 + 97) * 33 + 98


def test_murmur_known_values():
    assert hashes.murmur3_128(b"").hex() == "0" * 32
    assert hashes.murmur3_128(b"hello").hex() == "029bbd41b3a7d8cb191dae486a901e5b"
    assert hashes.murmur3_128(b"The quick brown fox jumps over the lazy dog").hex() == "6c1b07bc7bbc4be347939ac4a93c437a"


def test_bits_and_bytes(spark):
    df = spark.createDataFrame([(bytes([0x12, 0x34, 0x56, 0x78, 0x9A]),)], "d binary")
    d = F.col("d")
    got = df.select(hashes.read_number(d, 1, 2), hashes.read_number(d, 1, 2, little=True), hashes.read_bits(d, 4, 12), hashes.read_bits(d, 7, 3)).first()
    assert tuple(got) == (0x3456, 0x5634, 0x234, 0)
    assert [hashes.exp_golomb(b)[0] for b in ("1", "010", "011", "00100", "00111")] == [0, 1, 2, 3, 6]
    assert [hashes.signed_golomb(b)[0] for b in ("1", "010", "011", "00100", "00101")] == [0, 1, -1, 2, -2]
    with pytest.raises(ValueError):
        hashes.exp_golomb("000")
    h = spark.createDataFrame([("0Aff",), ("abc",), ("zz",)], "h string").select(hashes.unhex_strict(F.col("h")).alias("x")).collect()
    assert [None if r["x"] is None else bytes(r["x"]) for r in h] == [b"\x0a\xff", None, None]
    iv = spark.range(1).select(hashes.sequence_iv(F.lit(258)).alias("x")).first()["x"]
    assert bytes(iv) == bytes(14) + b"\x01\x02"
    coded = spark.createDataFrame([(b"k" * 16, bytes(range(16)), b"some plain text")], "k binary, iv binary, p binary").withColumn("c", F.expr("aes_encrypt(p, k, 'CBC', 'PKCS', iv)"))
    assert bytes(coded.select(hashes.decrypt_cbc(F.expr("substring(c, 17)"), F.col("k"), F.col("iv")).alias("x")).first()["x"]) == b"some plain text"


def exact(a, b, c, mode):
    q, r = divmod(abs(a) * b, c)
    sign = -1 if a < 0 else 1
    return {"zero": sign * q, "inf": sign * (q + (r > 0)), "near": sign * ((2 * abs(a) * b + c) // (2 * c)), "down": a * b // c, "up": -(-a * b // c)}[mode]


@pytest.mark.parametrize("mode", ["zero", "inf", "near", "down", "up"])
def test_rescale_rounds_as_named(spark, mode):
    rnd = random.Random(5)
    rows = [(rnd.randint(-(10**15), 10**15), rnd.randint(1, 10**5), rnd.randint(1, 10**5)) for _ in range(60)] + [(x, 1, 2) for x in range(-5, 6)] + [(0, 3, 7)]
    got = spark.createDataFrame(rows, "a long, b long, c long").select("a", "b", "c", timemath.rescale(F.col("a"), F.col("b"), F.col("c"), mode).alias("x")).collect()
    assert [r["x"] for r in got] == [exact(r["a"], r["b"], r["c"], mode) for r in got]
    assert one(spark, timemath.rescale(F.col("a"), 10, 1), a=2**62) is None and one(spark, timemath.rescale(F.col("a"), 1, 0), a=1) is None


def test_time_comparisons(spark):
    assert one(spark, timemath.compare_times(F.col("a"), 1, 1000, F.col("b"), 1, 90000), a=1000, b=90000) == 0
    assert one(spark, timemath.compare_times(F.col("a"), 1, 1000, F.col("b"), 1, 90000), a=999, b=90000) == -1
    assert one(spark, timemath.compare_wrapped(F.col("a"), F.col("b")), a=5, b=2**33 - 5) == 10
    assert one(spark, timemath.compare_wrapped(F.col("a"), F.col("b")), a=2**33 - 5, b=5) == -10
    df = spark.createDataFrame([(i, 0, (2**33 - 200 + 90 * i) % 2**33) for i in range(6)], "i int, k int, p long")
    assert [r["unwrapped"] - (2**33 - 200) for r in timemath.unwrap(df, "p", ["i"], ["k"]).orderBy("i").collect()] == [90 * i for i in range(6)]


def test_rationals(spark):
    df = spark.createDataFrame([((1, 6), (-1, 4)), ((4, 8), (2, -6))], "a struct<num:long,den:long>, b struct<num:long,den:long>")
    a, b = F.col("a"), F.col("b")
    got = df.select(timemath.add(a, b), timemath.subtract(a, b), timemath.multiply(a, b), timemath.divide(a, b)).collect()
    assert [tuple(map(tuple, r)) for r in got] == [((-1, 12), (5, 12), (-1, 24), (-2, 3)), ((1, 6), (5, 6), (-1, 6), (-3, 2))]
    assert gcd(12, 18) == 6 and one(spark, timemath.nearest_rational(F.col("x"), [(1, 2), (1, 3), (2, 6)]), x=0.34) == 1
    assert [one(spark, timemath.log2_floor(F.col("x")), x=x) for x in (0, 1, 7, 8, 1 << 40)] == [0, 0, 2, 3, 40]


def test_clocks_and_codes(spark):
    assert [one(spark, timemath.timecode(F.col("n"), 30), n=n) for n in (0, 30 * 3661 + 5)] == ["00:00:00:00", "01:01:01:05"]
    assert [one(spark, timemath.timecode(F.col("n"), 30, drop=True), n=n) for n in (1799, 1800, 17982)] == ["00:00:59;29", "00:01:00;02", "00:10:00;00"]
    assert [one(spark, timemath.lyric_time(F.col("t")), t=t) for t in ("[01:02.50]x", "[-0:01.5]", "[ti:x]")] == [62500, -1500, None]
    assert one(spark, timemath.gmt_text(F.to_timestamp(F.col("t"))), t="2025-01-31 10:00:00") == "Fri, 31 Jan 2025 10:00:00 GMT"
    assert one(spark, timemath.media_clock(F.lit(100), F.lit(50), F.lit(30), F.lit(1.5), F.lit(5)), t=0) == 125
    assert [one(spark, timemath.clock_resets(F.lit(100), F.lit(c), F.lit(s)), t=0) for c, s in ((60, 1.0), (49, 1.0), (49, 0.4))] == [False, True, False]
    assert [one(spark, is_failure(F.lit(c)), t=0) for c in (1, 0, -5)] == [False, False, True]


def test_maps(spark):
    df = spark.createDataFrame([({"Title": "a", "artist": "b", "ar": "c"}, '[1,{"x":2}]')], "m map<string,string>, j string")
    m = F.col("m")
    got = df.select(maps.lookup(m, "TITLE"), maps.lookup(m, "TITLE", match_case=True), maps.lookup(m, "art", prefix=True), maps.count(maps.put(m, "ar", F.lit("z"))), F.element_at(maps.put(m, "ar", F.lit("z"), "keep"), "ar"), F.element_at(maps.put(m, "ar", F.lit("z"), "append"), "ar"), F.element_at(maps.rename_keys(m, {"artist": "performer"}), "performer"), F.element_at(maps.fold_keys(m), "title"), maps.show(maps.parse(F.lit("a=1&b=2"))), maps.json_get(F.col("j"), "$[1].x"), maps.json_size(F.col("j"))).first()
    assert tuple(got) == ("a", None, "b", 3, "c", "cz", "b", "a", "a=1&b=2", "2", 2)


def test_windows_are_even(spark):
    for name in [*windows.COSINES, "bartlett", "welch", "sine", "bhann", "lanczos", "gauss", "tukey"]:
        v = [r["x"] for r in spark.range(33).select("id", windows.coefficient(name, F.col("id"), 33).alias("x")).orderBy("id").collect()]
        assert all(abs(a - b) < 1e-9 for a, b in zip(v, v[::-1], strict=True)) and max(v) == v[16]
    with pytest.raises(ValueError):
        windows.coefficient("none", F.lit(0), 3)


def test_sniffing(spark):
    u = F.col("u")
    rows = {"http://a/x.MP4": "MP4", "http://a/x.MP4?k": "NONE", "http://a/x.mp4?k=.z": "MP4", "http://a/x.TS?domain=b.mp3": "TS", "a.ffconcat": "FFCAT", "a.FFCAT": "NONE", "none": "NONE", "x.m3u8": "M3U8"}
    got = spark.createDataFrame([(k,) for k in rows], "u string").select("u", sniff.format_by_address(u).alias("f")).collect()
    assert {r["u"]: r["f"] for r in got} == rows
    protocols = {"HTTPS://x": "HTTP", "http:x": "HTTP", "rtmp://x": "RTMP", "RTSP:x": "RTSP", "/a/b": "FILE"}
    got = spark.createDataFrame([(k,) for k in protocols], "u string").select("u", sniff.protocol(u).alias("f")).collect()
    assert {r["u"]: r["f"] for r in got} == protocols
    contents = [(b"#EXTM3U\n", None, "M3U8"), (b"FLV\x01", None, "FLV"), (b"\0\0\0 ftypisom", None, "MP4"), (b"x" * 2000 + b"moov", "audio/aac", "AAC"), (b"", None, "NONE")]
    got = spark.createDataFrame([c[:2] for c in contents], "c binary, t string").select(sniff.format_by_content(F.col("c"), F.col("t")).alias("f")).collect()
    assert [r["f"] for r in got] == [c[2] for c in contents]


MEDIA = "#EXTM3U\r\n#EXT-X-TARGETDURATION:10\r\n\r\n#EXT-X-MEDIA-SEQUENCE:5\n#EXTINF:9.5,\na.ts\n#EXT-X-DISCONTINUITY\n#EXTINF:3.0005,title\n/b.ts\n#EXTINF:1,\nhttp://o/c.ts\n"
MASTER = '#EXTM3U\n#EXT-X-STREAM-INF:PROGRAM-ID=1,BANDWIDTH=800,CODECS="a,b"\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=500000\nmid.m3u8\n#EXT-X-STREAM-INF:NAME=x\nsame.m3u8\n'


def test_playlists(spark):
    df = spark.createDataFrame([(1, MEDIA), (2, "#EXTINF:1,\nx.ts"), (3, MASTER), (4, MEDIA + "#EXT-X-ENDLIST")], "id int, text string")
    parsed = playlist.lines(df, "id", "text")
    got = [tuple(r) for r in playlist.segments(parsed, F.lit("http://h/l/p.m3u8")).filter("playlist_id = 1").orderBy("seq").collect()]
    assert got == [(1, 5, "http://h/l/a.ts", 9500, 0, False, False), (1, 6, "http://h/b.ts", 3000, 9500, True, False), (1, 7, "http://o/c.ts", 1000, 12500, False, False)]
    assert {r["playlist_id"]: r["ended"] for r in playlist.segments(parsed).collect()} == {1: False, 4: True}
    assert [tuple(r) for r in playlist.variants(parsed).orderBy("rung").collect()] == [(3, 500000, "mid.m3u8", 0), (3, 500000, "same.m3u8", 1), (3, 819200, "low.m3u8", 2)]
    again = playlist.segments(parsed).withColumn("read", F.lit(2)).unionByName(playlist.segments(parsed).withColumn("read", F.lit(1)))
    assert playlist.refresh(again, "read").filter("playlist_id = 1 and read = 1").count() == 3
    a = spark.range(1).select(playlist.attributes(F.lit('A=1,B="x,y",C=')).alias("m")).first()["m"]
    assert a == {"A": "1", "B": "x,y", "C": ""}


def pes(stream=0xE0, pts=None, dts=None, body=b"body"):
    def clock(mark, t):
        return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])

    head = (clock(3 if dts is not None else 2, pts) if pts is not None else b"") + (clock(1, dts) if dts is not None else b"")
    flags = (0x80 if pts is not None else 0) | (0x40 if dts is not None else 0)
    rest = bytes([0x80, flags, len(head)]) + head + body
    return b"\0\0\1" + bytes([stream]) + len(rest).to_bytes(2, "big") + rest


def test_elementary_packets(spark):
    rows = [pes(), pes(pts=0), pes(pts=2**33 - 1, dts=12345678901 % 2**33), b"\0\0\1\xbf\0\5hello", b"\0\0\1\xbe\0\5hello", b"", b"\0\0\2\xe0\0\0\0\0\0", b"\0\0\1\xe0\0\x00\x80\x80\xff", pes(pts=5)[:11], None]
    df = spark.createDataFrame(list(enumerate(rows)), "n int, raw binary")
    got = [(r["ok"], r["pts"], r["dts"], r["payload_size"]) for r in transport.pes_headers(df, "raw", ["n"]).orderBy("n").collect()]
    last = 2**33 - 1
    assert got == [(True, None, None, 4), (True, 0, None, 4), (True, last, 12345678901 % 2**33, 4), (True, last, last, 5), (True, None, None, 0)] + [(False, None, None, None)] * 5


def adts(n):
    size = 7 + n
    return bytes([0xFF, 0xF1, 0x50, 0x80 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 0x1F, 0xFC]) + bytes(n)


def test_frames_across_chunks(spark):
    data = b"junk" + b"".join(adts(n) for n in (10, 30, 5, 200))
    for cut in range(1, len(data), 7):
        frames, left = transport.adts_frames([(100, data[:cut]), (200, data[cut:])])
        assert [len(f) for _, f in frames] == [17, 37, 12, 207] and left in (b"", b"\0")
        assert all(t in (100, 200) for t, _ in frames)
    df = spark.createDataFrame([(1, 0, 100, data[:40]), (1, 1, 200, data[40:]), (2, 0, 5, b"\xff")], "k int, o int, ts long, d binary")
    got = transport.split_frames(df, ["k"], "o", "ts", "d").orderBy("k", "n").collect()
    assert [(r["k"], r["n"], r["ts"], len(r["frame"]), r["last"]) for r in got] == [(1, 0, 100, 17, False), (1, 1, 100, 37, False), (1, 2, 200, 12, False), (1, 3, 200, 207, False), (2, 0, 5, 1, True)]


def test_pictures_across_chunks(spark):
    chunks = [b"\0\0\0\1\x65aa", b"bb", b"cc\0\0\1\x41ddd", b"\0\0\1\x41e", b"xy\0\0\1"]
    df = spark.createDataFrame([(1, i, 10 * i, c) for i, c in enumerate(chunks)] + [(2, 0, 5, b"q")], "k int, o int, ts long, d binary")
    got = [(r["k"], r["n"], r["ts"], bytes(r["frame"]), r["is_key"], r["last"]) for r in transport.split_pictures(df, ["k"], "o", "ts", "d").orderBy("k", "n").collect()]
    assert got == [(1, 0, 0, b"\0\0\0\1\x65aabbcc", True, False), (1, 1, 20, b"\0\0\1\x41ddd", False, False), (1, 2, 30, b"\0\0\1\x41exy\0\0\1", False, True), (2, 0, 5, b"q", False, True)]


def test_units():
    data = b"x\0\0\1\x65abc\0\0\0\1\x41de\0\0\1"
    assert [data[a:b] for a, b in transport.nal_units(data)] == [b"\x65abc", b"\x41de", b""]
    assert transport.is_key_unit(b"\x65") and not transport.is_key_unit(b"\x41") and transport.is_key_unit(bytes([19 << 1]), hevc=True)


def test_packet_source(spark, tmp_path):
    raw = b"".join(bytes([0x47, 0x40 if n == 3 else 0, n, 0x30 if n == 4 else 0x10]) + (bytes([183]) if n == 4 else b"\0") + bytes(183) for n in range(10)) + b"tail"
    (tmp_path / "a.ts").write_bytes(raw)
    transport.register(spark)
    rows = spark.read.format("ts_packets").option("packetsPerPartition", 4).load(str(tmp_path / "a.ts"))
    got = rows.select("n", transport.packet_header(F.col("raw")).alias("h")).orderBy("n").collect()
    assert [(r["n"], r["h"]["pid"], r["h"]["unit_start"], r["h"]["ok"]) for r in got] == [(n, n, n == 3, n != 4) for n in range(10)]


def test_scripts_and_cues(spark):
    text = "[A]\nKEY=v=w\nACTION=seek:10:a:b\n;no\nACTION=pasue:5\nACTION=x"
    rows = scripts.parse(spark.createDataFrame([("f", i, t) for i, t in enumerate(text.split("\n"))], "file string, line_no int, text string")).orderBy("line_no").collect()
    assert [(r["section"], r["value"], r["cmd"], r["at_ms"], r["args"], r["known"]) for r in rows] == [("A", "v=w", None, None, None, None), ("A", "seek:10:a:b", "seek", 10, "a:b", True), ("A", "pasue:5", "pasue", 5, None, False), ("A", "x", "x", None, None, False)]
    srt = "1\r\n00:00:01,500 --> 00:00:03,000\r\nOne\r\n\r\n2\r\n01:00:00,000 --> 01:00:02,25\r\nTwo\r\nlines\r\n"
    vtt = "WEBVTT\n\nid\n00:01.000 --> 00:02.000 align:start\nHi"
    cues = subtitles.blocks(spark.createDataFrame([(1, srt), (2, vtt)], "id int, text string"), "id", "text")
    assert [tuple(r)[2:] for r in cues.orderBy("file_id", "n").collect()] == [(1500, 3000, "One"), (3600000, 3602250, "Two\nlines"), (1000, 2000, "Hi")]
    back = subtitles.blocks(subtitles.to_srt(cues).filter("file_id = 1"), "file_id", "srt")
    assert back.select("start_ms", "text").orderBy("n").collect() == cues.filter("file_id = 1").select("start_ms", "text").orderBy("n").collect()
    lrc = subtitles.lyrics(spark.createDataFrame([(1, "[ti:t]\n[00:01.00][00:03.00]la\n[00:02.00]lo")], "id int, text string"), "id", "text")
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in lrc.orderBy("start_ms").collect()] == [(1000, 2000, "la"), (2000, 3000, "lo"), (3000, None, "la")]
    sub = subtitles.framed(spark.createDataFrame([(1, "{25}{50}a|b\n[10][]c")], "id int, text string"), "id", "text")
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in sub.orderBy("line_no").collect()] == [(1000, 2000, "a\nb"), (1000, None, "c")]
    ass = subtitles.dialogue(spark.createDataFrame([(1, "Dialogue: 0,0:00:01.50,0:00:02.00,Top,,0,0,0,,{\\b1}Hi,\\Nyou")], "id int, text string"), "id", "text")
    assert [tuple(r)[2:] for r in ass.collect()] == [(1500, 2000, "Top", "Hi,\nyou")]


def test_drift_free_times_match_a_plain_loop(spark):
    """Frames of 1,024 samples at 44,100, stamped in milliseconds: the way back to samples is exact."""
    rows = [(0, i, round(i * 1024 * 1000 / 44100), 1024) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i long, t long, d long")
    got = timemath.rescale_delta(df, "t", "d", ["i"], ["k"], (1, 1000), (1, 44100), (1, 44100)).orderBy("i").collect()
    assert [r["out_ts"] for r in got] == [1024 * i for i in range(300)]
    plain = timemath.rescale_delta(df, "t", "d", ["i"], ["k"], (1, 1000), (1, 44100), (1, 100)).orderBy("i").collect()
    assert [r["out_ts"] for r in plain] == [(t * 100 * 2 + 1000) // 2000 for _, _, t, _ in rows]


def test_steps_and_codes(spark):
    x = F.col("x")
    assert [one(spark, timemath.add_stable(x, 1, 90000, 1, 25, 3), x=v) for v in (0, 7)] == [10800, 10807]
    ts = 0
    for _ in range(300):
        ts = one(spark, timemath.add_stable(x, 1, 1000, 1, 3), x=ts) if _ < 6 else ts
    assert ts == 2000
    for frame in (0, 1799, 1800, 17981, 17982, 107892):
        code = one(spark, timemath.timecode(x, 30, drop=True), x=frame)
        assert one(spark, timemath.parse_timecode(x, 30), x=code) == frame and ";" in code
    assert one(spark, timemath.parse_timecode(x, 25), x="no code") is None
    assert one(spark, timemath.gcd_of(x, F.lit(4660046610375530309)), x=2880067194370816120) == 1
    with pytest.raises(ValueError):
        timemath.expression("__import__(1)", {})
    assert one(spark, hashes.from_base64(x), x="no base64!") is None
    assert one(spark, hashes.exp_golomb_at(x), x="0001") is None


def test_sources_are_opened_by_their_format(spark, tmp_path):
    from tidemark.sources import readers

    (tmp_path / "a.m3u8").write_text("#EXTM3U\n#EXTINF:2.5,\nx.ts\n#EXT-X-ENDLIST\n")
    (tmp_path / "list").write_text("ffconcat version 1.0\nfile b.bin\nfile 'c.bin'\nfile b.bin\n")
    (tmp_path / "b.bin").write_bytes(b"B")
    (tmp_path / "c.bin").write_bytes(b"C")
    where = f"file://{tmp_path}"
    assert [(r["seq"], r["duration_ms"]) for r in readers.open_source(spark, f"{where}/a.m3u8").collect()] == [(0, 2500)]
    assert [bytes(r["content"]) for r in readers.open_source(spark, f"{where}/list").orderBy("item").collect()] == [b"B", b"C", b"B"]
    assert readers.format_of(spark, f"{where}/b.bin") == "BINARY"
    for bad, kind in (("http://h/x.ts", None), (f"{where}/b.bin", "OGG")):
        with pytest.raises(ValueError):
            readers.open_source(spark, bad, kind)
    readers.register("ogg", lambda s, p: s.range(3))
    assert readers.open_source(spark, "x", "OGG").count() == 3


def test_flash_files_that_are_cut_or_none(spark):
    from tidemark.sources import flv

    tag = bytes([18, 0, 0, 3, 0, 0, 1, 2, 0, 0, 0]) + b"abc" + bytes([0, 0, 0, 14])
    head = b"FLV\1\5\0\0\0\x09\0\0\0\0"
    df = spark.createDataFrame([(1, head + tag + tag[:13]), (2, b"no"), (3, None), (4, head)], "i int, c binary")
    got = [(r["i"], r["n"], r["type"], r["ts_ms"], bytes(r["data"]), r["whole"]) for r in flv.tags(df, "i", "c").orderBy("n").collect()]
    assert got == [(1, 0, 18, (2 << 24) + 1, b"abc", True), (1, 1, 18, (2 << 24) + 1, b"ab", False)]


def test_frame_numbers_beyond_a_day_come_back(spark, tmp_path):
    import duckdb

    from tidemark import queries

    n, frames = F.col("n"), [0, 2_159_999, 2_160_000, 2_160_007, 5_999_999, 300_000_000]
    rows = spark.createDataFrame([(x,) for x in frames], "n long")
    got = rows.select("n", timemath.timecode(n, 25).alias("a"), timemath.timecode(n, 25, day=False).alias("b"), timemath.parse_timecode(timemath.timecode(n, 25, day=False), 25).alias("c"), timemath.parse_timecode(timemath.timecode(n, 30, True, False), 30).alias("d")).orderBy("n").collect()
    assert [r["c"] for r in got] == [r["d"] for r in got] == frames
    assert (got[3]["a"], got[3]["b"], got[5]["b"]) == ("00:00:00:07", "24:00:00:07", "3333:20:00:00")
    duckdb.sql(f"copy (select n::bigint as event_id, timestamp '2024-01-03 04:05:06.789' as ts, 1::bigint as user_id, 'view' as event_type, 12.5::double as value, '' as props from (values {', '.join(f'({x})' for x in frames)}) t(n)) to '{tmp_path}/events.parquet'")
    made = queries.QUERIES["time_functions"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert sorted(tuple(r) for r in made.collect()) == sorted(con.execute(f"select {', '.join(made.columns)} from ({queries.SQL['time_functions']})").fetchall())
