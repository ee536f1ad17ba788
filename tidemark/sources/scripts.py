"""Timed test scripts: [section], KEY=value, ACTION=command:ms[:arguments], ; comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The commands that a script may hold; any other is kept with known = false.
COMMANDS = ["exit", "play", "pause", "seek", "setview", "stop", "open", "disvideo", "playstream", "zoom", "downpause", "muxstart", "muxstop"]


def parse(lines: DataFrame, file_col: str = "file", line_col: str = "line_no", text_col: str = "text") -> DataFrame:
    """file, line_no, section, key, value, and of actions cmd, at_ms, args, known."""
    text = F.trim(text_col)
    rows = lines.select(F.col(file_col).alias("file"), F.col(line_col).alias("line_no"), text.alias("text")).filter("text != '' and not startswith(text, ';')")
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.regexp_extract("text", r"^\[([^\]]*)\]", 1)
    rows = rows.withColumn("section", F.last(F.when(F.col("text").startswith("["), name), True).over(w)).filter("not startswith(text, '[')")
    key, value = F.trim(F.substring_index("text", "=", 1)), F.trim(F.regexp_replace("text", "^[^=]*=?", ""))
    rows = rows.select("file", "line_no", "section", key.alias("key"), value.alias("value"))
    action = F.upper("key") == "ACTION"
    parts = F.split("value", ":", 3)
    cmd = F.when(action, F.lower(F.trim(F.get(parts, F.lit(0)))))
    return rows.select("*", cmd.alias("cmd"), F.when(action, F.get(parts, F.lit(1)).try_cast("long")).alias("at_ms"), F.when(action, F.get(parts, F.lit(2))).alias("args"), F.when(action, cmd.isin(COMMANDS)).alias("known"))
