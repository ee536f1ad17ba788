"""One way to open a source: its protocol and format choose the reader, as Spark's own formats choose theirs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import flv, listed, playlist, sniff, subtitles, transport
from tidemark.sources.media_sinks import dealt
from tidemark.storage import materialize

Reader = Callable[[SparkSession, str], DataFrame]
READERS: dict[str, Reader] = {}


def register(name: str, reader: Reader) -> None:
    """Adds a format, or puts another reader in a format's place."""
    READERS[name.upper()] = reader


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file and content. Of many files rather the folder than a pattern: Spark lists a folder at once, but what a pattern
    finds it looks up again one by one (some 4 ms each)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).select("file", F.decode("content", "UTF-8").alias("text"))


def _packets(spark: SparkSession, path: str) -> DataFrame:
    return transport.packets(_files(spark, path), "content", ["file"])


#: A list of more items than this is an error: they are numbered by an int.
MOST_ITEMS = (1 << 31) - 1
_GLOB = str.maketrans({c: f"\\{c}" for c in "{}[]*?\\"})
#: What pyarrow's file systems open as Spark's do.
ARROW_SCHEMES = {"file", "hdfs"}
_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"


def concatenated(spark: SparkSession, path: str) -> DataFrame:
    """item, file, content of the files that a concatenation list (lines "file name") names, in its order.

    Names without a scheme or a leading slash lie beside the list. A file named twice comes twice; one that is not there is an
    error, as is a list of more than MOST_ITEMS names. Files are matched by their whole path; each must fit a row. The names
    are rows, each read by the task that has it; only of lists that name files in stores that pyarrow does not open do they
    go through the driver to Spark's reader.
    """
    names = _texts(spark, path).select(F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*file\s+'?([^'\r\n]+?)'?\s*$"), F.lit(1))).alias("item", "name"))
    folder = path.rsplit("/", 1)[0]
    root = qualified(spark, ["/"])[0]
    named = F.col("name").rlike(f"^{_SCHEME}")
    full = F.when(named, F.col("name")).when(F.col("name").startswith("/"), F.concat(F.lit(root.rstrip("/")), F.col("name"))).otherwise(F.concat(F.lit(f"{qualified(spark, [folder])[0].rstrip('/')}/"), F.col("name")))
    scheme = F.lower(F.regexp_extract(full, f"^({_SCHEME})", 1))
    tidy = F.regexp_replace(F.regexp_replace(full, "(?<![:/])/{2,}", "/"), "^file:/+", "file:/")  # as Spark's readers tell a file's name
    wanted = materialize(dealt(names.select("item", tidy.alias("file"), scheme.alias("_scheme"))), "items")
    size = wanted.agg(F.count("*").alias("n"), F.max(~F.col("_scheme").isin([f"{x}:" for x in ARROW_SCHEMES])).alias("other")).first()
    if size["n"] > MOST_ITEMS:
        raise ValueError(f"{path}: more than {MOST_ITEMS} names")
    if size["n"] == 0:
        return spark.createDataFrame([], "item int, file string, content binary")
    wanted = wanted.select("item", "file")
    if not size["other"]:
        return listed.contents(wanted, ["item", "file"], "file")
    files = qualified(spark, [r["file"] for r in wanted.select("file").distinct().collect()])
    held = spark.read.format("binaryFile").load([f.translate(_GLOB) for f in files]).select("path", "content")
    return wanted.join(held, F.col("file") == F.col("path")).select("item", "file", "content")


def qualified(spark: SparkSession, names: list[str]) -> list[str]:
    """The names as Spark's own readers tell them, with scheme and authority."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(name)
        out.append(path.getFileSystem(conf).makeQualified(path).toString())
    return out


register("M3U8", lambda spark, path: playlist.segments(playlist.lines(_texts(spark, path), "file", "text")))
register("TS", _packets)
register("FLV", lambda spark, path: flv.tags(_files(spark, path), "file", "content"))
register("SRT", lambda spark, path: subtitles.blocks(_texts(spark, path), "file", "text"))
register("VTT", lambda spark, path: subtitles.blocks(_texts(spark, path), "file", "text"))
register("WEBVTT", READERS["VTT"])
register("ASS", lambda spark, path: subtitles.dialogue(_texts(spark, path), "file", "text"))
register("SSA", READERS["ASS"])
register("LRC", lambda spark, path: subtitles.lyrics(_texts(spark, path), "file", "text"))
register("FFCAT", concatenated)
register("BINARY", _files)


def format_of(spark: SparkSession, path: str) -> str:
    """The format that the address names, else the one that the first file's first bytes show, else BINARY."""
    ending = path.rsplit(".", 1)[-1].upper()
    if ending in READERS:
        return ending
    named, shown = (spark.read.format("binaryFile").load(path).limit(1).select(sniff.format_by_address(F.lit(path)), sniff.format_by_content(F.col("content"))).first() or ("NONE", "NONE"))
    return next((f for f in (named, shown) if f in READERS), "BINARY")


def open_source(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """The rows of a source. Only addresses that Spark's own file systems can read are opened here; others raise ValueError,
    as does a format that has no reader."""
    if path.lower().startswith(("http:", "https:", "rtmp:", "rtsp:")):
        raise ValueError(f"no network sources here: {path}")
    name = (format or format_of(spark, path)).upper()
    if name not in READERS:
        raise ValueError(f"no reader for {name}; there are {', '.join(sorted(READERS))}")
    return READERS[name](spark, path)
