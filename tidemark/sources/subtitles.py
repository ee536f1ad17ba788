"""Text subtitles: cues with a start and an end in milliseconds, from regular expressions over whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timemath import lyric_time

_CLOCK = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"


def _clock_ms(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, _CLOCK, i)
    hours = F.when(part(1) == "", F.lit(0)).otherwise(part(1).cast("long"))
    return hours * 3_600_000 + part(2).cast("long") * 60_000 + part(3).cast("long") * 1000 + F.rpad(part(4), 3, "0").cast("long")


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("file_id"), F.posexplode(F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n", -1)).alias("line_no", "text"))


def blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """SRT and WebVTT: blocks between blank lines that hold an arrow. file_id, n, start_ms, end_ms, text."""
    split = F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n\\s*\n+", -1)
    rows = df.select(F.col(id_col).alias("file_id"), F.posexplode(F.filter(split, lambda b: b.rlike(_CLOCK + r"\s*-->\s*" + _CLOCK))).alias("n", "block"))
    line = F.regexp_extract("block", rf"(?m)^(\s*{_CLOCK}\s*-->\s*{_CLOCK}.*)$", 1)
    body = F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1)
    return rows.select("file_id", "n", _clock_ms(F.split(line, "-->")[0]).alias("start_ms"), _clock_ms(F.split(line, "-->")[1]).alias("end_ms"), F.btrim(body, F.lit(" \t\n")).alias("text"))


def lyrics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """LRC: a row for each time tag of a line; its end is the next time of the file."""
    from pyspark.sql import Window

    tags = F.regexp_extract_all("text", F.lit(r"(\[-?\d+:\d{2}(?:[.:]\d{1,3})?\])"), F.lit(1))
    rows = _lines(df, id_col, text_col).withColumn("body", F.trim(F.regexp_replace("text", r"^(\[[^\]]*\])+", ""))).select("file_id", "line_no", "body", F.explode(tags).alias("tag"))
    rows = rows.withColumn("start_ms", lyric_time(F.col("tag")))
    end = F.lead("start_ms").over(Window.partitionBy("file_id").orderBy("start_ms", "line_no"))
    return rows.select("file_id", "line_no", "start_ms", end.alias("end_ms"), F.col("body").alias("text"))


def framed(df: DataFrame, id_col: str, text_col: str, fps: float = 25.0) -> DataFrame:
    """MicroDVD {start}{end}text by frame numbers, and MPL2 [start][end]text by tenths of a second; | is a line break."""
    at = r"^([\[{])(-?\d+)[\]}][\[{](-?\d*)[\]}](.*)$"
    rows = _lines(df, id_col, text_col).filter(F.col("text").rlike(at))
    part = lambda i: F.regexp_extract("text", at, i)
    unit = F.when(part(1) == "{", F.lit(1000 / fps)).otherwise(F.lit(100.0))
    ms = lambda i: F.when(part(i) != "", F.floor(part(i).cast("double") * unit).cast("long"))
    return rows.select("file_id", "line_no", ms(2).alias("start_ms"), ms(3).alias("end_ms"), F.regexp_replace(part(4), r"\|", "\n").alias("text"))


def dialogue(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ASS/SSA dialogue lines: the style's name, times and text without override blocks; \\N is a line break."""
    at = r"^Dialogue:\s*[^,]*,([^,]*),([^,]*),([^,]*),(?:[^,]*,){5}(.*)$"
    rows = _lines(df, id_col, text_col).filter(F.col("text").rlike(at))
    part = lambda i: F.regexp_extract("text", at, i)
    return rows.select("file_id", "line_no", _clock_ms(part(1)).alias("start_ms"), _clock_ms(part(2)).alias("end_ms"), part(3).alias("style"), F.regexp_replace(F.regexp_replace(part(4), r"\{[^}]*\}", ""), r"\\[Nn]", "\n").alias("text"))


def to_srt(cues: DataFrame) -> DataFrame:
    """The text of an SRT file for each file_id, cues by their start."""
    clock = lambda c: F.format_string("%02d:%02d:%02d,%03d", F.floor(c / 3_600_000).cast("int"), (F.floor(c / 60_000) % 60).cast("int"), (F.floor(c / 1000) % 60).cast("int"), (c % 1000).cast("int"))
    made = cues.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text"))).alias("cues"))
    one = lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), clock(c["start_ms"]), F.lit(" --> "), clock(c["end_ms"]), F.lit("\n"), c["text"], F.lit("\n"))
    return made.select("file_id", F.array_join(F.transform("cues", one), "\n").alias("srt"))
