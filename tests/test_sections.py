"""Table sections over many packets against a plain assembler."""

import random

from pyspark.sql import functions as F

from tidemark.functions import hashes
from tidemark.sources import transport


def crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
    return c


def section(table, name, version, body, current=1):
    head = bytes([table]) + (0xB000 | 9 + len(body)).to_bytes(2, "big") + name.to_bytes(2, "big") + bytes([0xC0 | version << 1 | current, 0, 0]) + body
    return head + crc(head).to_bytes(4, "big")


def packetize(sections, pid, rnd, first=0):
    """Packets of a pid in which the sections lie one after another; a section begins behind the end of the one before it,
    in the same packet, or in a packet of its own."""
    out, body, pointer = [], b"", None

    def flush():
        nonlocal body, pointer
        data = (bytes([pointer]) if pointer is not None else b"") + body
        flag = 0x40 if pointer is not None else 0
        out.append(bytes([0x47, flag | pid >> 8, pid & 255, 0x10 | (first + len(out)) % 16]) + data.ljust(184, b"\xff"))
        body, pointer = b"", None

    for s in sections:
        if body and (rnd.random() < 0.4 or len(body) == 183):
            flush()
        pointer = len(body) if pointer is None else pointer
        while s:
            room = 184 - len(body) - (pointer is not None)
            body, s = body + s[:room], s[room:]
            if s:
                flush()
    flush()
    return out


def assemble(packets):
    """Whole sections, in order, of packets (n, raw) of one pid."""
    out, held, last, open_ = [], b"", None, False
    for n, raw in packets:
        counter, body, starts = raw[3] & 15, raw[4:], raw[1] & 0x40
        if last is not None and last == (counter, body):
            continue
        if last is not None and counter != (last[0] + 1) % 16:
            held, open_ = b"", False
        last = (counter, body)
        pieces = [(body[1 : 1 + body[0]], False), (body[1 + body[0] :], True)] if starts else [(body, False)]
        for data, fresh in pieces:
            if fresh:
                held, open_ = data, True
            elif open_:
                held += data
            while open_ and len(held) >= 3 and held[0] != 0xFF:
                size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
                if len(held) < size:
                    break
                out.append(held[:size])
                held = held[size:]
            if open_ and held[:1] == b"\xff":
                open_ = False
    return out


def test_sections_are_those_of_a_plain_assembler(spark):
    rnd = random.Random(7)
    rows, want = [], []
    for key in range(40):
        pid = 100 + key
        made = [section(rnd.choice([0, 2, 70]), i, i % 32, bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 5, 150, 170, 175, 180, 190, 400, 1500, 4080])))) for i in range(12)]
        packets = packetize(made, pid, rnd)
        if key % 4 == 1:
            packets = [p for p in packets if rnd.random() > 0.1]
        if key % 4 == 2:
            packets = [p for p in packets for _ in range(1 + (rnd.random() < 0.2))]
        if key % 4 == 0:
            assert assemble(enumerate(packets)) == made
        rows += [(key, n, p) for n, p in enumerate(packets)]
        want += [(key, s) for s in assemble(enumerate(packets))]
    got = transport.sections(spark.createDataFrame(rows, "key int, n long, raw binary").repartition(3), ["key"]).collect()
    assert sorted((r["key"], bytes(r["section"])) for r in got if r["whole"]) == sorted(want)
    assert all(r["valid"] for r in got if r["whole"]) and any(not r["whole"] for r in got) and not any(r["valid"] for r in got if not r["whole"])
    assert all(r["pid"] == 100 + r["key"] for r in got)


def test_a_map_of_fifty_streams_lies_in_two_packets(spark):
    rnd = random.Random(1)
    body = b"\xe1\0\xf0\0" + b"".join(bytes([27, 0xE1, k, 0xF0, 0]) for k in range(50))
    pat, pmt = section(0, 1, 0, b"\0\1\xe0\x64"), section(2, 1, 0, body)
    packets = [*packetize([pat], 0, rnd), *packetize([pmt], 100, rnd)]
    assert len(packets) == 3
    df = lambda ps: spark.createDataFrame([(0, n, p) for n, p in enumerate(ps)], "key int, n long, raw binary")
    assert sorted(r["pid"] for r in transport.elementary_streams(df(packets), ["key"]).collect()) == [256 + k for k in range(50)]
    assert transport.elementary_streams(df(packets[:2]), ["key"]).count() == 0
    cut = transport.sections(df(packets[:2]), ["key"]).filter("table_id = 2").first()
    assert not cut["whole"] and len(cut["section"]) == 183
    damaged = packets[:2] + [packets[2][:30] + bytes([packets[2][30] ^ 1]) + packets[2][31:]]
    assert [r["valid"] for r in transport.sections(df(damaged), ["key"]).filter("table_id = 2").collect()] == [False]
    assert transport.elementary_streams(df(damaged), ["key"]).count() == 0
    assert transport.sections(df([]), ["key"]).count() == 0


def test_units_belong_to_the_map_in_force(spark):
    rnd = random.Random(1)
    pat = packetize([section(0, 1, 0, b"\0\1\xe0\x64")], 0, rnd)
    maps = [packetize([section(2, 1, v, b"\xe1\0\xf0\0" + bytes([kind, 0xE1, 0, 0xF0, 0]))], 100, rnd, first=v)[0] for v, kind in enumerate((27, 36))]
    unit = lambda i, c: bytes([0x47, 0x41, 0, 0x10 | c]) + (b"\0\0\1\xe0\0\0\x80\0\0" + bytes([i]) * 175)
    packets = [unit(1, 0), *pat, maps[0], unit(2, 1), maps[1], unit(3, 2)]
    df = spark.createDataFrame([(0, n, p) for n, p in enumerate(packets)], "key int, n long, raw binary")
    got = transport.demux(df, ["key"]).collect()
    assert sorted((r["stream_type"], r["payload"][0]) for r in got) == [(27, 1), (27, 2), (36, 3)]
    table = [(r["stream_type"], r["version"], r["since"], r["until"]) for r in transport.stream_table(df, ["key"]).orderBy("version").collect()]
    assert table == [(27, 0, None, 4), (36, 1, 4, None)]


def test_checksums_by_name(spark):
    rows = [(b"",), (b"123456789",), (bytes(range(256)),), (b"\0" * 40,)]
    df = spark.createDataFrame(rows, "d binary").select("d", hashes.hash_by_name("CRC32-MPEG2", F.col("d")).alias("c"), hashes.ends_in_crc32_mpeg(F.concat("d", F.unhex(hashes.hash_by_name("crc32mpeg2", F.col("d"))))).alias("ok"))
    for r in df.collect():
        assert r["c"] == f"{crc(bytes(r['d'])):08x}" and r["ok"]


def test_every_task_makes_packets_of_some_users(spark, monkeypatch):
    from tidemark import queries
    from tidemark.storage import materialize

    module = __import__("sys").modules[queries.QUERIES["ts_versions"].__module__]
    parts = []
    monkeypatch.setattr(module, "materialize", lambda df, tag: parts.append(df.rdd.getNumPartitions()) or materialize(df, tag), raising=False)
    assert queries.QUERIES["ts_versions"](spark, "/root/testdata/sf0.001").count() > 1000
    assert len(parts) == 1 and parts[0] >= int(spark.conf.get("spark.sql.shuffle.partitions"))
