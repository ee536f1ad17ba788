"""Transport-stream packets and elementary-stream frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.hashes import ends_in_crc32_mpeg, read_number
from tidemark.operators.folds import fold
from tidemark.schema import PES_HEADER
from tidemark.session import add_sources

PACKET_BYTES = 188
#: Packets that one read from a file takes.
READ_PACKETS = 10_000
SYNC = 0x47
#: Stream ids whose packets carry no optional header, and the one that is padding.
BARE_STREAMS = {0xBC, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}
PADDING_STREAM = 0xBE
MOST_PTS = (1 << 33) - 1


def packets(content: DataFrame, content_col: str, id_cols: list[str]) -> DataFrame:
    """A row for each whole packet of a binary column: id columns, n, raw."""
    n = F.expr(f"octet_length({content_col}) div {PACKET_BYTES}").cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = content.select(*id_cols, content_col, F.explode(at).alias("n"))
    return rows.select(*id_cols, F.col("n").cast("long").alias("n"), F.substring(content_col, F.col("n") * PACKET_BYTES + 1, F.lit(PACKET_BYTES)).alias("raw"))


def packet_header(raw: Column) -> Column:
    """The fields of one packet, in the JVM. ok is false where the header takes the whole packet or the sync byte is missing."""
    flags, control = read_number(raw, 1, 2), read_number(raw, 3, 1)
    bit = lambda v, i: F.shiftright(v, i).bitwiseAND(F.lit(1)) == 1
    adaptation = F.shiftright(control, 4).bitwiseAND(F.lit(3)).cast("int")
    offset = F.when(adaptation.bitwiseAND(F.lit(2)) != 0, 5 + read_number(raw, 4, 1)).otherwise(F.lit(4)).cast("int")
    size = F.octet_length(raw)
    ok = (read_number(raw, 0, 1) == SYNC) & (offset < size)
    return F.struct(bit(flags, 15).alias("error"), bit(flags, 14).alias("unit_start"), bit(flags, 13).alias("priority"), flags.bitwiseAND(F.lit(0x1FFF)).cast("int").alias("pid"), F.shiftright(control, 6).cast("int").alias("scrambling"), adaptation.alias("adaptation"), control.bitwiseAND(F.lit(15)).cast("int").alias("continuity"), offset.alias("data_offset"), F.greatest(F.lit(0), size - offset).alias("data_size"), ok.alias("ok"))


def _clock(data: Column, at: Column) -> Column:
    """A 33-bit clock in five bytes, with marker bits between its parts."""
    part = lambda i, size: read_number(data, at + i, size)
    high, middle, low = F.shiftright(part(0, 1), 1).bitwiseAND(F.lit(7)), F.shiftright(part(1, 2), 1), F.shiftright(part(3, 2), 1)
    return high * (1 << 30) + middle * (1 << 15) + low


def pes_header(data: Column) -> Column:
    """The header of an elementary-stream packet (the fields of PES_HEADER), in the JVM; ok is false for a wrong start code or
    a header that does not fit."""
    size = F.octet_length(data)
    stream, length, marks, header = read_number(data, 3, 1), read_number(data, 4, 2), read_number(data, 7, 1), read_number(data, 8, 1)
    bare, padding = stream.isin(list(BARE_STREAMS)), stream == PADDING_STREAM
    has_pts, has_dts = marks.bitwiseAND(F.lit(0x80)) != 0, marks.bitwiseAND(F.lit(0x40)) != 0
    need = F.when(has_pts, 5).otherwise(0) + F.when(has_dts, 5).otherwise(0)
    begins = (size >= 6) & (F.hex(F.substring(data, 1, 3)) == "000001")
    whole = begins & (bare | padding | ((size >= 9) & (header + 9 <= size) & (need <= header)))
    plain = whole & ~bare & ~padding
    payload = F.when(bare, length).when(padding, F.lit(0)).when(length > 0, F.greatest(F.lit(0), length - header - 3)).otherwise(F.lit(0))
    pts = F.when(whole & bare, F.lit(MOST_PTS)).when(plain & has_pts, _clock(data, F.lit(9)))
    dts = F.when(whole & bare, F.lit(MOST_PTS)).when(plain & has_dts, _clock(data, F.when(has_pts, F.lit(14)).otherwise(F.lit(9))))
    made = {"ok": F.coalesce(whole, F.lit(False)), "stream_id": F.when(whole, stream), "packet_length": F.when(whole, length), "pts": pts, "dts": dts, "header_length": F.when(plain, header), "data_offset": F.when(whole, F.when(plain, header + 9).otherwise(F.lit(6))), "payload_size": F.when(whole, payload)}
    kinds = dict(f.strip().split() for f in PES_HEADER.split(","))
    return F.struct(*[made[n].cast(kinds[n]).alias(n) for n in kinds])


def pes_headers(df: DataFrame, data_col: str, id_cols: list[str]) -> DataFrame:
    """id columns and the header's fields."""
    return df.select(*id_cols, pes_header(F.col(data_col)).alias("_h")).select(*id_cols, "_h.*")


def _entries(data: Column, first: Column, end: Column, size: int) -> Column:
    """Where the entries of a fixed size between two places begin."""
    return F.when(end - first >= size, F.sequence(first, end - size, F.lit(size))).otherwise(F.array().cast("array<int>"))


#: In one packet at most so many sections begin, as the shortest one has three bytes.
SECTIONS_A_PACKET = 61
STUFFING = 0xFF
_OWN = set("h n raw pid begins counter jump body before gap k p parts first data at s size whole section table_id extension version current number last_number valid since until program stream_type end".split())


def sections(packets_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pid, n, table_id, extension, version, current, number, last_number, section, whole, valid: the table sections
    that the packets of each pid carry, however many packets a section lies in; n is the packet in which it begins.

    packets_: keys, n (order), raw, of pids that carry sections. A packet repeated with its counter and content counts once.
    Where the counter tells of a lost packet (or one came damaged), or the stream ends, a section that is not complete by
    then comes out with whole false and the bytes there are. valid: its checksum is right (null for a section that has none).
    One exchange on keys and pid; what begins in a packet and goes on up to the next beginning is one group.
    """
    if clash := _OWN & set(keys):
        raise ValueError(f"keys with names of this operator: {sorted(clash)}")
    h = packet_header(F.col("raw"))
    rows = packets_.select(*keys, "n", "raw", h.alias("h")).filter("h.ok and not h.error and (h.adaptation & 1) = 1")
    jump = (F.col("h.adaptation") > 2) & (read_number(F.col("raw"), 4, 1) > 0) & (read_number(F.col("raw"), 5, 1) >= 128)
    rows = rows.select(*keys, "n", F.col("h.pid").alias("pid"), F.col("h.unit_start").alias("begins"), F.col("h.continuity").alias("counter"), jump.alias("jump"), F.substring("raw", F.col("h.data_offset") + 1, F.col("h.data_size")).alias("body"))
    w = Window.partitionBy(*keys, "pid").orderBy("n")
    rows = rows.withColumn("before", F.lag(F.struct("counter", "body")).over(w))
    again = F.coalesce((F.col("before.counter") == F.col("counter")) & (F.col("before.body") == F.col("body")), F.lit(False))
    gap = F.col("before").isNotNull() & ~F.col("jump") & (F.col("counter") != (F.col("before.counter") + 1) % 16)
    rows = rows.withColumn("gap", gap).filter(~again).withColumn("k", F.sum(F.col("begins").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = lambda k, side, data, lost: F.struct(k.alias("k"), F.lit(side).alias("side"), F.hex(data).alias("b"), lost.alias("lost"))
    rest = F.expr("octet_length(body) - 1")
    pointer = F.least(read_number(F.col("body"), 0, 1).cast("int"), rest)  # what comes before it ends the section that is open
    of_begin = F.array(part(F.col("k") - 1, 0, F.substring("body", F.lit(2), pointer), F.col("gap")), part(F.col("k"), 1, F.substring("body", pointer + 2, rest - pointer), F.lit(False)))
    parts = rows.select(*keys, "pid", "n", F.explode(F.when(F.col("begins"), of_begin).otherwise(F.array(part(F.col("k"), 0, F.col("body"), F.col("gap"))))).alias("p")).filter("p.k > 0")
    each = F.array_sort(F.collect_list(F.struct("n", "p.side", "p.b", "p.lost")))
    units = parts.groupBy(*keys, "pid", "p.k").agg(each.alias("parts"))
    lost = F.array_position(F.transform("parts", lambda x: x["lost"]), True)
    sure = F.when(lost > 0, F.slice("parts", F.lit(1), (lost - 1).cast("int"))).otherwise(F.col("parts"))
    units = units.select(*keys, "pid", F.col("parts")[0]["n"].alias("n"), F.octet_length(F.unhex(F.col("parts")[0]["b"])).alias("first"), F.unhex(F.array_join(F.transform(sure, lambda x: x["b"]), "")).alias("data"))
    data, size = F.col("data"), F.octet_length("data")
    length = lambda at: F.when(at + 3 <= size, read_number(data, at + 1, 2).bitwiseAND(F.lit(0xFFF)).cast("int") + 3)
    there = lambda at: (at < F.col("first")) & (read_number(data, at, 1) != STUFFING)
    step = lambda acc, _: F.when(there(F.element_at(acc, -1)) & length(F.element_at(acc, -1)).isNotNull(), F.concat(acc, F.array(F.element_at(acc, -1) + length(F.element_at(acc, -1))))).otherwise(acc)
    places = F.aggregate(F.sequence(F.lit(1), F.lit(SECTIONS_A_PACKET)), F.array(F.lit(0)), step)
    found = units.withColumn("at", F.explode(F.filter(F.array_distinct(places), there)))
    whole = F.coalesce(F.col("at") + length(F.col("at")) <= size, F.lit(False))
    found = found.select(*keys, "pid", "n", "at", F.expr("substring(data, at + 1, octet_length(data))").alias("s"), length(F.col("at")).alias("size"), whole.alias("whole"))
    section = F.when(F.col("whole"), F.substring("s", F.lit(1), F.col("size"))).otherwise(F.col("s"))
    found = found.select(*keys, "pid", "n", "at", "whole", section.alias("section"))
    s = F.col("section")
    long_form = F.coalesce(read_number(s, 1, 1) >= 128, F.lit(False)) & (F.octet_length(s) >= 8)
    field = lambda value: F.when(long_form, value.cast("int"))
    return found.select(
        *keys, "pid", "n", read_number(s, 0, 1).cast("int").alias("table_id"), field(read_number(s, 3, 2)).alias("extension"), field(F.shiftright(read_number(s, 5, 1), 1).bitwiseAND(F.lit(31))).alias("version"),
        F.when(long_form, read_number(s, 5, 1) % 2 == 1).alias("current"), field(read_number(s, 6, 1)).alias("number"), field(read_number(s, 7, 1)).alias("last_number"), "section", "whole",
        F.when(long_form, F.col("whole") & ends_in_crc32_mpeg(s)).alias("valid"),
    )


def _tables(found: DataFrame, keys: list[str], table_id: int) -> DataFrame:
    """The whole, right sections of a table that are in force: those of sections(), with `since` and `until`, the packets from
    and before which their version holds. The first version holds for what came before it too, and the last one on and on;
    that of a program's map ends when another version comes, not when it is no longer repeated."""
    rows = found.filter((F.col("table_id") == table_id) & F.col("whole") & F.col("valid") & F.col("current"))
    name = [*keys, "pid", "extension"]
    w = Window.partitionBy(*name).orderBy("n", "number")
    rows = rows.withColumn("_run", F.sum((~F.lag("version").over(w).eqNullSafe(F.col("version"))).cast("int")).over(w))
    runs = rows.groupBy(*name, "_run", "version", "section").agg(F.min("n").alias("_n"))
    began = F.min("_n").over(Window.partitionBy(*name, "_run"))
    runs = runs.withColumn("_began", began)
    after = Window.partitionBy(*name).orderBy("_run").rangeBetween(1, 1)
    return runs.select(*name, "version", "section", F.when(F.col("_run") > 1, F.col("_began")).alias("since"), F.min("_began").over(after).alias("until"))


def _of_pid(packets_: DataFrame, pid: int) -> DataFrame:
    return packets_.filter(read_number(F.col("raw"), 1, 2).bitwiseAND(F.lit(0x1FFF)) == pid)


def program_table(packets_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, program, pid, since, until: the program maps that each version of the association table (pid 0) names; network
    entries are left out."""
    tables = _tables(sections(_of_pid(packets_, 0), keys), keys, 0)
    end = F.octet_length("section") - 4  # a checksum ends it
    rows = tables.select(*keys, "section", "since", "until", F.explode(_entries(F.col("section"), F.lit(8), end, 4)).alias("at"))
    program, pid = read_number(F.col("section"), F.col("at"), 2), read_number(F.col("section"), F.col("at") + 2, 2).bitwiseAND(F.lit(0x1FFF))
    return rows.select(*keys, program.cast("int").alias("program"), pid.cast("int").alias("pid"), "since", "until").filter("program != 0")


def programs(packets_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, program, pid of all program maps that were ever named."""
    return program_table(packets_, keys).select(*keys, "program", "pid").distinct()


def stream_table(packets_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, program, pid, stream_type, version, since, until: the streams that each version of the program maps lists, without
    their descriptors, and the packets from and before which it holds (null: no such end)."""
    maps = programs(packets_, keys).select(*keys, F.col("program").alias("extension"), F.col("pid"))
    carried = packets_.withColumn("pid", read_number(F.col("raw"), 1, 2).bitwiseAND(F.lit(0x1FFF)).cast("int"))
    carried = carried.join(maps.select(*keys, "pid").distinct(), [*keys, "pid"], "left_semi").select(*keys, "n", "raw")
    tables = _tables(sections(carried, keys), keys, 2).join(maps, [*keys, "pid", "extension"], "left_semi").withColumnRenamed("extension", "program")
    s, end = F.col("section"), F.octet_length("section") - 4
    first = read_number(s, 10, 2).bitwiseAND(F.lit(0xFFF)).cast("int") + 12
    tables = tables.select(*keys, "program", "version", "since", "until", "section", end.alias("end"), first.alias("first"))
    # Entries are of varying length: each is 5 bytes and its descriptors, so the places follow one from another.
    size = lambda at: 5 + read_number(s, at + 3, 2).bitwiseAND(F.lit(0xFFF)).cast("int")
    step = lambda acc, _: F.when(F.element_at(acc, -1) + 5 <= F.col("end"), F.concat(acc, F.array(F.element_at(acc, -1) + size(F.element_at(acc, -1))))).otherwise(acc)
    places = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.expr("octet_length(section) div 5"))), F.array("first"), step)
    rows = tables.withColumn("at", F.explode(F.filter(places, lambda x: x + 5 <= F.col("end"))))
    kind, pid = read_number(F.col("section"), F.col("at"), 1), read_number(F.col("section"), F.col("at") + 1, 2).bitwiseAND(F.lit(0x1FFF))
    return rows.select(*keys, "program", pid.cast("int").alias("pid"), kind.cast("int").alias("stream_type"), "version", "since", "until")


def elementary_streams(packets_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, program, pid, stream_type of all streams that were ever listed."""
    return stream_table(packets_, keys).select(*keys, "program", "pid", "stream_type").distinct()


def demux(packets_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, program, pid, stream_type, k, pts, dts, payload: the elementary-stream packets of every listed stream, in order.

    packets_: keys, n (order), raw. A packet with its unit start begins the next one; what comes before a stream's first
    start is left out. A packet belongs to the streams that the map in force at its place lists; a unit goes on as long as
    they do. One exchange on keys and pid brings a stream's packets together, and each unit is one group.
    """
    h = packet_header(F.col("raw"))
    streams = stream_table(packets_, keys).groupBy(*keys, "pid", "program", "stream_type", "since").agg(F.max("until").alias("until"))
    rows = packets_.select(*keys, "n", "raw", h.alias("h")).filter("h.ok and not h.error")
    rows = rows.select(*keys, "n", F.col("h.pid").alias("pid"), F.col("h.unit_start").alias("begins"), F.substring("raw", F.col("h.data_offset") + 1, F.col("h.data_size")).alias("part")).join(streams, [*keys, "pid"])
    rows = rows.filter("(since is null or n >= since) and (until is null or n < until)").drop("since", "until")
    w = Window.partitionBy(*keys, "pid", "program", "stream_type").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    units = rows.withColumn("k", F.sum(F.col("begins").cast("long")).over(w)).filter("k > 0")
    units = units.groupBy(*keys, "program", "pid", "stream_type", "k").agg(joined_bytes("n", "part").alias("data"))
    units = units.withColumn("p", pes_header(F.col("data"))).filter("p.ok")
    return units.select(*keys, "program", "pid", "stream_type", (F.col("k") - 1).alias("k"), F.col("p.pts").alias("pts"), F.col("p.dts").alias("dts"), F.expr("substring(data, p.data_offset + 1, octet_length(data))").alias("payload"))


def joined_bytes(order: str, data: str) -> Column:
    """The bytes of a group's rows, one after another."""
    return F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.hex(data).alias("b")))), lambda x: x["b"]), ""))


def adts_frames(chunks: list[tuple[int, bytes]]) -> tuple[list[tuple[int, bytes]], bytes]:
    """(time, frame) of each whole frame in a row of timed chunks, and what is left. A frame that began in an earlier
    chunk has that chunk's time."""
    out, held, held_ts = [], b"", None
    for ts, data in chunks:
        carried, buffer, at = len(held), held + data, 0
        held = b""
        while at < len(buffer):
            at = _sync(buffer, at)
            if at < 0:
                held = buffer[-1:]
                break
            size = ((buffer[at + 3] & 3) << 11 | buffer[at + 4] << 3 | buffer[at + 5] >> 5) if len(buffer) - at > 7 else -1
            if size < 0 or at + size > len(buffer):
                held = buffer[at:]
                break
            if size < 7:
                at += 1
                continue
            out.append((held_ts if at < carried and held_ts is not None else ts, buffer[at : at + size]))
            at += size
        held_ts = ts
    return out, held


def _sync(data: bytes, at: int) -> int:
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if data[at + 1] & 0xF0 == 0xF0:
            return at
        at += 1
    return -1


def nal_units(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each unit between start codes of 3 or 4 bytes; a zero before a code belongs to the code."""
    codes, at = [], 0
    while (at := data.find(b"\0\0\1", at)) >= 0:
        codes.append(at)
        at += 3
    out = []
    for i, c in enumerate(codes):
        end = codes[i + 1] if i + 1 < len(codes) else len(data)
        if i + 1 < len(codes) and end > c + 3 and data[end - 1] == 0:
            end -= 1
        out.append((c + 3, end))
    return out


def is_key_unit(unit: bytes, hevc: bool = False) -> bool:
    """Instantaneous refresh pictures: type 5, or for HEVC types 16 to 21."""
    return bool(unit) and (16 <= (unit[0] >> 1 & 63) <= 21 if hevc else unit[0] & 31 == 5)


def _as_characters(data: Column) -> Column:
    """A character for each byte, so that text functions find bytes."""
    return F.decode(data, "ISO-8859-1")


def is_key_frame(frame: Column, hevc: bool = False) -> Column:
    """Whether a frame holds a refresh picture: a start code, and after it a unit of type 5, or for HEVC of 16 to 21."""
    kinds = r"[\x20-\x2b\xa0-\xab]" if hevc else r"[\x05\x25\x45\x65\x85\xa5\xc5\xe5]"
    return _as_characters(frame).rlike(r"\x00\x00\x01" + kinds)


def split_pictures(df: DataFrame, keys: list[str], order: str, ts: str, data: str, hevc: bool = False) -> DataFrame:
    """H.264 or H.265 frames of each key's chunks in order: keys, n, ts, frame, is_key, last.

    The first start code of a chunk, with a zero before it, ends the frame that is open; a chunk without one goes on with
    it. A code in a chunk's last four bytes does not count. A frame has the time of the chunk in which it began. What is
    open at the end comes out too, as `last`. One exchange on the keys; a frame is one group.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, F.col(order).alias("_o"), F.col(ts).cast("long").alias("_t"), F.col(data).alias("_d"), F.row_number().over(w).alias("_i"))
    at = F.instr(_as_characters(F.col("_d")), "\0\0\1") - 1
    good = (F.col("_i") > 1) & (at >= 0) & (at < F.octet_length("_d") - 4)
    rows = rows.withColumn("_at", F.when(good, at)).withColumn("_at", F.when(F.hex(F.expr("substring(_d, _at, 1)")).eqNullSafe("00") & (F.col("_at") > 0), F.col("_at") - 1).otherwise(F.col("_at")))
    rows = rows.withColumn("_k", F.count("_at").over(Window.partitionBy(*keys).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)))
    head = F.struct((F.col("_k") - F.col("_at").isNotNull().cast("int")).alias("n"), F.lit(0).alias("side"), F.when(F.col("_at").isNull(), F.col("_d")).otherwise(F.expr("substring(_d, 1, _at)")).alias("part"))
    tail = F.struct(F.col("_k").alias("n"), F.lit(1).alias("side"), F.expr("substring(_d, _at + 1, octet_length(_d))").alias("part"))
    parts = rows.select(*keys, "_o", "_t", F.explode(F.filter(F.array(head, tail), lambda x: x["part"].isNotNull())).alias("p")).select(*keys, "_o", "_t", "p.*")
    parts = parts.withColumn("_place", F.struct("_o", "side"))
    # A frame begins in the chunk whose code begins it, so that chunk's part is the first of it that is a tail.
    begun = F.min_by("_t", F.when((F.col("side") == 1) | (F.col("n") == 0), F.col("_place")))
    frames = parts.groupBy(*keys, "n").agg(begun.alias("ts"), joined_bytes("_place", "part").alias("frame"))
    last = F.col("n") == F.max("n").over(Window.partitionBy(*keys))
    return frames.select(*keys, F.col("n").cast("long").alias("n"), "ts", "frame", is_key_frame(F.col("frame"), hevc).alias("is_key"), last.alias("last")).filter(F.octet_length("frame") > 0)


def split_frames(df: DataFrame, keys: list[str], order: str, ts: str, data: str) -> DataFrame:
    """ADTS frames of each key's chunks in order: keys, n, ts, frame, last. A partial frame goes over to the next chunk, and
    what is left at the end comes out as it is, with `last`. A key's chunks are read one after another, and of them only
    what no frame has used up is held."""

    def step(state: tuple[bytes, int | None, int], row: tuple) -> tuple[tuple, list[tuple]]:
        held, held_ts, n = state
        made, left = adts_frames([(held_ts or 0, held), (row[0], bytes(row[1] or b""))])
        return (left, row[0], n + len(made)), [(n + i, t, f, False) for i, (t, f) in enumerate(made)]

    def end(state: tuple[bytes, int | None, int]) -> list[tuple]:
        held, held_ts, n = state
        return [(n, held_ts, held, True)] if held else []

    return fold(df.select(*keys, order, F.col(ts).cast("long").alias("_t"), F.col(data).alias("_d")), keys, [order], ["_t", "_d"], (b"", None, 0), step, "n long, ts long, frame binary, last boolean", end)


class _FilePart(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class PacketSource(DataSource):
    """spark.read.format("ts_packets").load(path): n, raw of each packet of a file that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "ts_packets"

    def schema(self) -> str:
        return "n long, raw binary"

    def reader(self, schema) -> DataSourceReader:
        return _PacketReader(self.options)


class _PacketReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per = options["path"], int(options.get("packetsPerPartition", 100_000))

    def _open(self, mode="size"):
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return files.get_file_info(at).size if mode == "size" else files.open_input_file(at)

    def partitions(self):
        n = self._open() // PACKET_BYTES
        return [_FilePart(self.path, a, min(n, a + self.per)) for a in range(0, n, self.per)] or [_FilePart(self.path, 0, 0)]

    def read(self, part: _FilePart):
        from tidemark.streaming.pushed import cut_units

        with self._open("file") as f:
            f.seek(part.start * PACKET_BYTES)
            for n in range(part.start, part.end, READ_PACKETS):
                yield cut_units(f.read((min(n + READ_PACKETS, part.end) - n) * PACKET_BYTES), n, PACKET_BYTES)


def register(spark) -> None:
    add_sources(spark, PacketSource)
