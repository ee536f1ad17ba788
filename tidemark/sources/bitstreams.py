"""Bitstream filters and elementary-stream parsers: what is done to packets of coded data without decoding them.

What has a fixed shape is a column expression; walks whose next place depends on what was read (length-prefixed units,
parameter sets) are Arrow-batched helpers on one packet; frames that run over chunk borders are a fold along each key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashes import read_bits, read_number
from tidemark.operators.folds import fold
from tidemark.sources.transport import joined_bytes

START_CODE = b"\0\0\0\1"
#: Unit types that a parameter record may hold (HEVC), and H.264 profiles whose sets have colour fields.
SET_TYPES = {32, 33, 34, 39, 40}
HIGH_PROFILES = {44, 83, 86, 100, 110, 118, 122, 128, 134, 135, 138, 139, 244}
#: Kilobits a second by index, sampling rates by code, channels by coding mode (AC-3), MPEG audio's by version and layer.
AC3_KBPS = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]
AC3_RATES, AC3_CHANNELS = [48000, 44100, 32000], [2, 1, 2, 3, 3, 4, 4, 5]
MPEG_RATES = [44100, 48000, 32000]
MPEG_KBPS = {
    (1, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448], (1, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384], (1, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256], (2, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160], (2, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}


def _characters(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def _bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def without_prevention(unit: Column) -> Column:
    """A unit's bytes without the 3 that keeps two zeros from looking like a start code."""
    return _bytes(F.regexp_replace(_characters(unit), r"\x00\x00\x03", "\0\0"))


def with_prevention(payload: Column) -> Column:
    """The bytes with a 3 after every two zeros that a byte up to 3, or the end, follows."""
    return _bytes(F.regexp_replace(_characters(payload), r"\x00\x00(?=[\x00-\x03]|\z)", "\0\0\x03"))


def unit_type(unit: Column, hevc: bool = False) -> Column:
    first = read_number(unit, 0, 1)
    return (F.shiftright(first, 1).bitwiseAND(F.lit(63)) if hevc else first.bitwiseAND(F.lit(31))).cast("int")


def units(frames: DataFrame, id_cols: list[str], data: str, hevc: bool = False) -> DataFrame:
    """id columns, u (from 0), type and unit of each unit between start codes; zeros before a code belong to the code, what
    lies before the first one to nothing. Null and empty frames have none."""
    parts = F.split(_characters(F.col(data)), r"\x00\x00+\x01", -1)
    rows = frames.select(*id_cols, F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("u", "c"))
    rows = rows.select(*id_cols, "u", _bytes(F.regexp_replace("c", r"\x00+\z", "")).alias("unit")).filter(F.octet_length("unit") > 0)
    return rows.select(*id_cols, "u", unit_type(F.col("unit"), hevc).alias("type"), "unit")


class Bits:
    """Reads a unit's payload bit by bit; past the end EOFError."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def u(self, n: int) -> int:
        if n > self.left:
            raise EOFError
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        n = self.ue()
        return (n + 1) // 2 if n % 2 else -(n // 2)


def _skip_scaling(bits: Bits, got: dict) -> None:
    for i in range(8 if got["chroma_format"] != 3 else 12):
        if bits.u(1):
            last = following = 8
            for _ in range(16 if i < 6 else 64):
                following = (last + bits.se()) % 256 if following else 0
                last = following or last


def _skip_cycle(bits: Bits, got: dict) -> None:
    bits.u(1), bits.se(), bits.se()
    for _ in range(bits.ue()):
        bits.se()


#: The sequence set of H.264, field after field: name, how it is read ("u8", "ue", or a function), and when it is there.
_HIGH = lambda g: g["profile"] in HIGH_PROFILES
SEQUENCE_SET: list[tuple[str, str | Callable, Callable[[dict], bool] | None]] = [
    ("profile", "u8", None), ("constraints", "u8", None), ("level", "u8", None), ("set_id", "ue", None), ("chroma_format", "ue", _HIGH), ("separate_planes", "u1", lambda g: g["chroma_format"] == 3),
    ("luma_bits", "ue", _HIGH), ("chroma_bits", "ue", _HIGH), ("bypass", "u1", _HIGH), ("has_scaling", "u1", _HIGH), ("scaling", _skip_scaling, lambda g: g["has_scaling"]), ("frame_num_bits", "ue", None),
    ("order_type", "ue", None), ("order_bits", "ue", lambda g: g["order_type"] == 0), ("cycle", _skip_cycle, lambda g: g["order_type"] == 1), ("n_reference", "ue", None), ("gaps", "u1", None), ("width_blocks", "ue", None),
    ("height_units", "ue", None), ("frames_only", "u1", None), ("adaptive", "u1", lambda g: not g["frames_only"]), ("direct", "u1", None), ("cropped", "u1", None),
    *((f"crop_{side}", "ue", lambda g: g["cropped"]) for side in ("left", "right", "top", "bottom")),
]
SEQUENCE_FIELDS = "profile int, level int, set_id int, chroma_format int, luma_bits int, n_reference int, width int, height int, interlaced boolean"


def read_fields(bits: Bits, grammar: list, defaults: dict) -> dict:
    got = dict(defaults)
    for name, kind, there in grammar:
        if there is None or there(got):
            got[name] = kind(bits, got) if callable(kind) else bits.ue() if kind == "ue" else bits.se() if kind == "se" else bits.u(int(kind[1:]))
    return got


def sequence_set(payload: bytes) -> tuple | None:
    """The fields of SEQUENCE_FIELDS of a set without its unit byte and prevention; null where it is cut short."""
    zero = {name: 0 for name, *_ in SEQUENCE_SET} | {"chroma_format": 1}
    try:
        g = read_fields(Bits(payload), SEQUENCE_SET, zero)
    except EOFError:
        return None
    planes = 0 if g["separate_planes"] else g["chroma_format"]
    across, down = (2 if planes in (1, 2) else 1), (2 if planes == 1 else 1) * (2 - g["frames_only"])
    width = 16 * (g["width_blocks"] + 1) - across * (g["crop_left"] + g["crop_right"])
    height = 16 * (g["height_units"] + 1) * (2 - g["frames_only"]) - down * (g["crop_top"] + g["crop_bottom"])
    return g["profile"], g["level"], g["set_id"], g["chroma_format"], 8 + g["luma_bits"], g["n_reference"], width, height, not g["frames_only"]


def _sequence_sets(payload: pd.Series) -> pd.DataFrame:
    rows = [x is not None and sequence_set(bytes(x)) or (None,) * 9 for x in payload]
    made = pd.DataFrame(rows, columns=[f.split()[0] for f in SEQUENCE_FIELDS.split(", ")])
    return made.astype({c: "boolean" if c == "interlaced" else "Int32" for c in made.columns})


def sequence_sets(found: DataFrame, id_cols: list[str]) -> DataFrame:
    """id columns and the fields of each H.264 sequence set among units() rows; fields of a set that is cut short are null."""
    rows = found.filter("type = 7").withColumn("_p", without_prevention(F.expr("substring(unit, 2, octet_length(unit))")))
    return rows.select(*id_cols, F.pandas_udf(_sequence_sets, SEQUENCE_FIELDS)("_p").alias("_s")).select(*id_cols, "_s.*")


def read_record(record: bytes | None, hevc: bool) -> tuple[int, list[bytes]] | None:
    """The size of length prefixes and the parameter sets that a decoder record holds; null if it is none."""
    try:
        if not record or record[0] != 1:
            return None
        at, sets = (22 if hevc else 5), []
        size = (record[21] if hevc else record[4]) % 4 + 1
        groups = range(record[at]) if hevc else range(2)
        at += hevc
        for k in groups:
            if hevc:
                if record[at] & 63 not in SET_TYPES:
                    return None
                n, at = int.from_bytes(record[at + 1 : at + 3], "big"), at + 3
            else:
                n, at = record[at] & (255 if k else 31), at + 1
            for _ in range(n):
                length = int.from_bytes(record[at : at + 2], "big")
                sets.append(record[at + 2 : at + 2 + length])
                at += 2 + length
        return (size, sets) if at <= len(record) else None
    except IndexError:
        return None


def prefixed(data: bytes, size: int) -> Iterator[bytes]:
    """The units of a packet in which each has its length before it; a length beyond the packet ends it there."""
    at = 0
    while at + size <= len(data):
        length = int.from_bytes(data[at : at + size], "big")
        yield data[at + size : at + size + length]
        at += size + length


def start_coded(data: bytes, record: bytes | None, hevc: bool) -> bytes:
    known = read_record(record, hevc)
    if known is None:
        return data
    out, met = [], False
    for unit in prefixed(data, known[0]):
        kind = (unit[0] >> 1 & 63 if hevc else unit[0] & 31) if unit else -1
        if not met and (16 <= kind <= 23 if hevc else kind == 5):
            met = True
            out += known[1]
        out.append(unit)
    return b"".join(START_CODE + u for u in out)


def to_start_codes(data: Column, record: Column, hevc: bool = False) -> Column:
    """A packet of length-prefixed units as units behind start codes of four bytes; before the first refresh unit of a packet
    go the parameter sets of its decoder record. A packet without such a record (it has start codes already) stays."""

    @F.pandas_udf("binary")
    def run(packets: pd.Series, records: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else start_coded(bytes(d), None if r is None else bytes(r), hevc) for d, r in zip(packets, records)], dtype=object)

    return run(data, record)


def to_lengths(frames: DataFrame, id_cols: list[str], data: str) -> DataFrame:
    """id columns and `data`: each frame's units, four bytes of length before each; the way back from to_start_codes()."""
    each = units(frames, id_cols, data).withColumn("b", F.concat(F.unhex(F.lpad(F.hex(F.octet_length("unit").cast("long")), 8, "0")), "unit"))
    return each.groupBy(*id_cols).agg(joined_bytes("u", "b").alias("data"))


def _little(data: Column, at: Column, size: Column) -> Column:
    pairs = F.regexp_extract_all(F.hex(F.substring(data, at + 1, size)), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("long")


def superframe_parts(packets: DataFrame, id_cols: list[str], data: str) -> DataFrame:
    """id columns, k, part: the frames that a VP9 superframe's index, at its tail, tells; a packet without an index is one
    frame, k 0. Frames that the index makes longer than the packet are cut at the index; empty ones are left out."""
    d, n = F.col("_d"), F.octet_length("_d")
    mark = read_number(d, n - 1, 1)
    rows = packets.select(*id_cols, F.explode(F.array(data)).alias("_d"))  # so that data that an expression makes is made once
    rows = rows.select(*id_cols, "_d", n.alias("_n"), _tail_index(d).cast("int").alias("_c"), (F.shiftright(mark, 3).bitwiseAND(F.lit(3)) + 1).cast("int").alias("_w"))
    rows = rows.withColumn("_end", F.when(F.col("_c") > 0, F.col("_n") - 2 - F.col("_c") * F.col("_w")).otherwise(F.col("_n")))
    told = F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda k: _little(F.col("_d"), F.col("_end") + 1 + k * F.col("_w"), F.col("_w")))
    rows = rows.withColumn("_s", F.when(F.col("_c") > 0, told).otherwise(F.array(F.col("_n").cast("long"))))
    rows = rows.select(*id_cols, "_d", "_s", "_end", F.posexplode("_s").alias("k", "_size"))
    rows = rows.withColumn("_from", F.aggregate(F.slice("_s", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x))
    rows = rows.withColumn("_take", F.least("_size", F.col("_end") - F.col("_from")).cast("int")).filter("_take > 0")
    return rows.select(*id_cols, "k", F.substring("_d", (F.col("_from") + 1).cast("int"), F.col("_take")).alias("part"))


def shows_frame(data: Column) -> Column:
    """Whether a VP9 frame is seen: it shows an earlier one, or its own flag says so."""
    at = F.when(read_bits(data, 2, 2) == 3, 1).otherwise(0)  # the highest profile has a bit more before the flags
    flag = lambda i: F.when(at == 1, read_bits(data, i + 1, 1)).otherwise(read_bits(data, i, 1))
    return (flag(4) == 1) | (flag(6) == 1)


def superframes(packets: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """keys, n, order (that of the last frame), frames, data: unseen VP9 frames joined to the next one that is seen, with
    an index behind them. A seen frame alone, and a packet that has an index already, stay as they are; unseen frames
    after the last seen one are left out; more than eight frames to one index give null data, as no index can tell them."""
    d = F.col(data)
    rows = packets.withColumn("_end", (shows_frame(d) | (_tail_index(d) > 0)).cast("long"))
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("_k", F.coalesce(F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    made = rows.groupBy(*keys, "_k").agg(joined_bytes(order, data).alias("_d"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.octet_length(d).alias("n")))).alias("_f"), F.max("_end").alias("_e"))
    made = made.filter("_e = 1").withColumn("_z", F.transform("_f", lambda x: x["n"]))
    width = F.greatest(F.lit(1), F.ceil(F.length(F.hex(F.array_max("_z").cast("long"))) / 2)).cast("int")
    mark = F.lpad(F.hex((0xC0 + (width - 1) * 8 + F.size("_z") - 1).cast("long")), 2, "0")
    little = lambda n: F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n.cast("long")), width * 2, "0"), F.lit("(..)"), F.lit(1))), "")
    index = F.unhex(F.concat(mark, F.array_join(F.transform("_z", little), ""), mark))
    whole = F.when(F.size("_z") == 1, F.col("_d")).when(F.size("_z") <= 8, F.concat("_d", index))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_k")) - 1
    return made.select(*keys, number.cast("long").alias("n"), F.element_at("_f", -1)["o"].alias(order), F.size("_z").alias("frames"), whole.alias("data"))


def _tail_index(data: Column) -> Column:
    """The number of frames that an index at the tail tells; 0 without one."""
    n = F.octet_length(data)
    mark = read_number(data, n - 1, 1)
    begin = n - 2 - (mark.bitwiseAND(F.lit(7)) + 1).cast("int") * (F.shiftright(mark, 3).bitwiseAND(F.lit(3)) + 1).cast("int")
    return F.when((n > 0) & (mark.bitwiseAND(F.lit(0xE0)) == 0xC0) & (begin >= 0) & (read_number(data, begin, 1) == mark), mark.bitwiseAND(F.lit(7)) + 1).otherwise(F.lit(0))


def ac3_header(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """Bytes, sampling rate and channels of the AC-3 or E-AC-3 frame that begins there; null if none does. Needs 8 bytes."""
    if data[at : at + 2] != b"\x0b\x77":
        return None
    extended = data[at + 5] >> 3 > 10
    code, mode = data[at + 4] >> 6, (data[at + 4] >> 1 & 7 if extended else data[at + 6] >> 5)
    if extended:
        rate = AC3_RATES[code] if code < 3 else AC3_RATES[data[at + 4] >> 4 & 3] // 2 if (data[at + 4] >> 4 & 3) < 3 else 0
        size, low = ((data[at + 2] & 7) << 8 | data[at + 3]) * 2 + 2, data[at + 4] & 1
    else:
        index = data[at + 4] & 63
        if code == 3 or index >= 2 * len(AC3_KBPS):
            return None
        rate, kbps = AC3_RATES[code], AC3_KBPS[index // 2]
        size = 2 * (kbps * 96_000 // rate + (index % 2 if code == 1 else 0))
        skipped = 2 * bool(mode & 1 and mode != 1) + 2 * bool(mode & 4) + 2 * (mode == 2)
        low = int.from_bytes(data[at + 6 : at + 8], "big") >> 12 - skipped & 1
    return (size, rate, AC3_CHANNELS[mode] + low) if rate else None


def mpeg_header(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """Bytes, sampling rate and channels of the MPEG audio frame that begins there; null if none does. Needs 4 bytes."""
    if data[at] != 255 or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, index = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3), data[at + 2] >> 2 & 3, data[at + 2] >> 4
    if version == 1 or layer == 4 or rate == 3 or index in (0, 15):
        return None
    hertz = MPEG_RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    bits = MPEG_KBPS[1 if version == 3 else 2, layer][index - 1] * 1000
    pad, samples = data[at + 2] >> 1 & 1, 72 if layer == 3 and version != 3 else 144
    return ((12 * bits // hertz + pad) * 4 if layer == 1 else samples * bits // hertz + pad), hertz, 1 if data[at + 3] >> 6 == 3 else 2


def adts_header(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """Bytes, sampling-rate index and channel configuration of the ADTS frame that begins there. Needs 7 bytes."""
    if data[at] != 255 or data[at + 1] & 0xF6 != 0xF0:
        return None
    size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
    return (size, data[at + 2] >> 2 & 15, (data[at + 2] & 1) << 2 | data[at + 3] >> 6) if size >= 7 else None


#: Formats whose frames begin with a header that tells their size: the reader, the bytes it needs, and the first byte.
HEADERS = {"AC3": (ac3_header, 8, b"\x0b"), "MP3": (mpeg_header, 4, b"\xff"), "ADTS": (adts_header, 7, b"\xff")}


def cut_frames(held: bytes, chunk: bytes, kind: str) -> tuple[list[tuple[int, tuple, bytes]], bytes]:
    """(place in held + chunk, header, frame) of each whole frame, and what is left for the next chunk. What is no frame is
    passed over byte by byte."""
    read, need, first = HEADERS[kind]
    data, out, at = held + chunk, [], 0
    while (at := data.find(first, at)) >= 0:
        if len(data) - at < need:
            return out, data[at:]
        found = read(data, at)
        if found is None:
            at += 1
        elif at + found[0] > len(data):
            return out, data[at:]
        else:
            out.append((at, found, data[at : at + found[0]]))
            at += found[0]
    return out, b""


def audio_frames(df: DataFrame, keys: list[str], order: str, ts: str, data: str, kind: str) -> DataFrame:
    """keys, n, ts, size, rate, channels, frame, last: the frames of each key's chunks in order, wherever the chunks are cut.

    A frame has the time of the chunk in which it begins. What is left at a key's end comes out as it is, with `last` and no
    header. One exchange on the keys; a task holds a batch and what no frame has used up.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        held, times, n = state  # times: from which place of what is held on a chunk's time holds
        chunk = bytes(row[1] or b"")
        times = [*times, (len(held), row[0])]
        time_at = lambda place: times[bisect_right(times, place, key=lambda t: t[0]) - 1][1]
        made, left = cut_frames(held, chunk, kind)
        rows = [(n + i, time_at(at), *header, frame, False) for i, (at, header, frame) in enumerate(made)]
        begin = len(held) + len(chunk) - len(left)
        rest = [(0, time_at(begin)), *((at - begin, t) for at, t in times if begin < at < begin + len(left))] if left else []
        return (left, rest, n + len(made)), rows

    def end(state: tuple) -> list[tuple]:
        held, times, n = state
        return [(n, times[0][1], len(held), None, None, held, True)] if held else []

    rows = df.select(*keys, order, F.col(ts).cast("long").alias("_t"), F.col(data).alias("_d"))
    return fold(rows, keys, [order], ["_t", "_d"], (b"", [], 0), step, "n long, ts long, size int, rate int, channels int, frame binary, last boolean", end)


def adts_to_config(frame: Column) -> Column:
    """struct<config, payload>: the two bytes of configuration that an ADTS header stands for, and the frame without its
    header (and checksum); null for a frame that has no such header or nothing behind it."""
    ok = (read_number(frame, 0, 2).bitwiseAND(F.lit(0xFFF6)) == 0xFFF0) & (F.octet_length(frame) > F.lit(9) - 2 * read_bits(frame, 15, 1))
    kind, rate, channels = read_bits(frame, 16, 2) + 1, read_bits(frame, 18, 4), read_bits(frame, 23, 3)
    config = F.unhex(F.lpad(F.hex(kind * 2048 + rate * 128 + channels * 8), 4, "0"))
    skip = F.lit(8) + 2 * (1 - read_bits(frame, 15, 1)).cast("int")
    return F.when(ok, F.struct(config.alias("config"), F.substring(frame, skip, F.octet_length(frame)).alias("payload")))


def chomp(data: Column) -> Column:
    """The bytes without zeros at their end."""
    return _bytes(F.regexp_replace(_characters(data), r"\x00+\z", ""))


def with_record(data: Column, record: Column, is_key: Column, every: bool = False) -> Column:
    """The packet with its stream's record before it: key packets only, or every one. A packet that has it stays as it is."""
    has = F.substring(data, F.lit(1), F.octet_length(record)) == record
    return F.when((F.lit(every) | is_key) & record.isNotNull() & ~has, F.concat(record, data)).otherwise(data)


def text_to_sample(text: Column) -> Column:
    """A subtitle's bytes behind two bytes of their length; null beyond 65,535."""
    data = text.cast("binary")
    return F.when(F.octet_length(data) < 65536, F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 4, "0")), data))


def sample_to_text(data: Column) -> Column:
    """The text that a length of two bytes leads; null where there is less than that."""
    n = read_number(data, 0, 2).cast("int")
    return F.when(F.octet_length(data) >= n + 2, F.decode(F.substring(data, F.lit(3), n), "UTF-8"))


def core_only(data: Column) -> Column:
    """A DTS packet's core, without the extension behind it; another packet as it is."""
    size = (read_bits(data, 46, 14) + 1).cast("int")
    return F.when((F.octet_length(data) >= 8) & (read_number(data, 0, 4) == 0x7FFE8001) & (size <= F.octet_length(data)), F.substring(data, F.lit(1), size)).otherwise(data)
