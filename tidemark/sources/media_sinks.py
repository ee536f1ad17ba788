"""Writers of media files: data sources with a two-phase commit, one file for each value of the column `file`.

    media_sinks.register(spark)
    media_sinks.by_file(rows, ["n"]).write.format("flv").mode("append").save(folder)
    media_sinks.save(rows, ["n"], "flv", folder)  # the same for any number of files

A task writes its files under numbers in one folder of its own attempt, as a folder for each of theirs would take a block of
disk in each attempt. Only when all tasks are done, those of the attempts that counted
get their names, then _SUCCESS is written; whatever attempts leave behind is deleted. So a task that is tried twice leaves
one file, and a job that fails none. A file is the work of one task, which streams its rows. With a writer's own save() the
driver gives the names, one after another; with the save() of this module each attempt's are in a list beside its files, and
tasks give them, so that the driver handles a name for each attempt, not for each file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidemark.session import add_sources


def by_file(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows of each file in one partition, in order, as the writers ask for them. There are as many partitions as the
    session's shuffles have, however few bytes the rows are: what takes time is the number of files."""
    return dealt(rows, "file").sortWithinPartitions("file", *order)


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows over as many partitions as the session's shuffles have, those of equal columns in one. They are dealt by a hash of
    the columns: dealt by the columns, they might share a distinct()'s exchange, whose partitions Spark puts together by bytes."""
    by = [F.xxhash64(*columns)] if columns else []
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def file_system(path: str):
    """A file system and the path there; a path without a scheme is a local one. Of a local path each sign is itself."""
    from pyarrow import fs

    if "://" not in path or path.startswith("file:///"):
        return fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)
    return fs.FileSystem.from_uri(path)


class Raw:
    """The bytes of the rows, one after another."""

    columns = {"data": pa.binary()}

    def head(self, row: dict) -> bytes:
        return b""

    def packet(self, row: dict) -> bytes:
        return row["data"] or b""

    def tail(self) -> bytes:
        return b""


class Adts(Raw):
    """Audio packets, each behind a header made from its two bytes of configuration."""

    columns = {"config": pa.binary(), "payload": pa.binary()}

    def packet(self, row: dict) -> bytes:
        config, size = int.from_bytes(row["config"][:2], "big"), len(row["payload"]) + 7
        kind, rate, channels = config >> 11, config >> 7 & 15, config >> 3 & 15
        if not 1 <= kind <= 4 or rate == 15 or channels > 7:
            raise ValueError(f"no such header for configuration {config:04x}")
        if size >= 1 << 13:
            raise ValueError(f"a frame of {size} bytes, of 8191 at most")
        bits = 0xFFF1 << 40 | (kind - 1) << 38 | rate << 34 | channels << 30 | size << 13 | 0x7FF << 2
        return bits.to_bytes(7, "big") + row["payload"]


class Flv(Raw):
    """Tags of a flash file: type, ts_ms, data."""

    columns = {"type": pa.int32(), "ts_ms": pa.int64(), "data": pa.binary()}

    def head(self, row: dict) -> bytes:
        return b"FLV\x01\x05\0\0\0\x09\0\0\0\0"

    def packet(self, row: dict) -> bytes:
        data, ts = row["data"], row["ts_ms"] % (1 << 32)
        if len(data) >= 1 << 24:
            raise ValueError(f"a tag of {len(data)} bytes, of 16777215 at most")
        head = bytes([row["type"]]) + len(data).to_bytes(3, "big") + (ts & 0xFFFFFF).to_bytes(3, "big") + bytes([ts >> 24]) + b"\0\0\0"
        return head + data + (len(data) + 11).to_bytes(4, "big")


class Ivf(Raw):
    """Frames behind their size and time; fourcc, width, height, rate, scale and frames (their number) as the first row has them."""

    columns = {"fourcc": pa.string(), "width": pa.int32(), "height": pa.int32(), "rate": pa.int32(), "scale": pa.int32(), "frames": pa.int64(), "pts": pa.int64(), "data": pa.binary()}

    def head(self, row: dict) -> bytes:
        little = lambda name, n: row[name].to_bytes(n, "little")
        return b"DKIF\0\0\x20\0" + row["fourcc"].encode().ljust(4)[:4] + little("width", 2) + little("height", 2) + little("rate", 4) + little("scale", 4) + little("frames", 4) + bytes(4)

    def packet(self, row: dict) -> bytes:
        return len(row["data"]).to_bytes(4, "little") + (row["pts"] % (1 << 64)).to_bytes(8, "little") + row["data"]


def _clock(ms: int, mark: str) -> str:
    return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}{mark}{ms % 1000:03d}"


class Srt(Raw):
    """Numbered cues: start_ms, end_ms, text."""

    columns = {"start_ms": pa.int64(), "end_ms": pa.int64(), "text": pa.string()}
    mark = ","

    def __init__(self):
        self.n = 0

    def packet(self, row: dict) -> bytes:
        self.n += 1
        return f"{self.n}\n{self.cue(row)}".encode()

    def cue(self, row: dict) -> str:
        return f"{_clock(row['start_ms'], self.mark)} --> {_clock(row['end_ms'], self.mark)}\n{row['text']}\n\n"


class WebVtt(Srt):
    """Cues without numbers behind the format's own line."""

    mark = "."

    def head(self, row: dict) -> bytes:
        return b"WEBVTT\n\n"

    def packet(self, row: dict) -> bytes:
        return self.cue(row).encode()


class Pictures(Raw):
    """Pictures as parts of a mime stream."""

    def packet(self, row: dict) -> bytes:
        return b"--frame\r\nContent-type: image/jpeg\r\nContent-length: %d\r\n\r\n" % len(row["data"]) + row["data"] + b"\r\n"


FORMATS: dict[str, type[Raw]] = {"raw_files": Raw, "adts": Adts, "flv": Flv, "ivf": Ivf, "srt": Srt, "webvtt": WebVtt, "mpjpeg": Pictures}


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: for each file the place where its attempt put it, and the name it is to have."""

    folder: str = ""
    files: list[tuple[str, str]] = field(default_factory=list)


#: The list of an attempt's files (a file's place there is its number), and that of the attempts that counted. No file has
#: such a name, as it begins with _.
LIST, COUNTED = "_files.parquet", "_counted"
NAMES = pa.schema([("name", pa.string())])
#: Names that are read at once.
LIST_ROWS = 10_000


class _Writer(DataSourceArrowWriter):
    """job: the name of a job whose files save() publishes; then the driver only notes which attempts counted."""

    def __init__(self, path: str, encoder: type[Raw], overwrite: bool, job: str | None = None):
        self.path, self.encoder, self.overwrite, self.job, self.staged = path.rstrip("/"), encoder, overwrite, job or uuid.uuid4().hex, job is not None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        task = TaskContext.get()
        folder = f"{root}/_attempts-{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        done, out, made, last = Written(folder), None, None, b""  # no file has this name
        names: dict[str, int] = {}
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["file"] != last:
                        if out:
                            out.write(made.tail())
                            out.close()
                        last = row["file"]
                        if not last or last.startswith(("/", "_", ".")) or ".." in last.split("/"):
                            raise ValueError(f"no name for a file: {last!r}")
                        if last in names:
                            raise ValueError(f"the rows of {last} do not lie together: use by_file()")
                        if not names:
                            system.create_dir(folder, recursive=True)
                        names[last] = len(names)
                        made, out = self.encoder(), system.open_output_stream(f"{folder}/{names[last]}")
                        out.write(made.head(row))
                    out.write(made.packet(row))
            if out:
                out.write(made.tail())
        finally:
            if out:
                out.close()
        if not self.staged:
            done.files = [(f"{folder}/{n}", name) for name, n in names.items()]
        elif names:
            with system.open_output_stream(f"{folder}/{LIST}") as f:
                pq.write_table(pa.table([pa.array(list(names), pa.string())], schema=NAMES), f, row_group_size=LIST_ROWS)
        return done if names else Written()

    def _clear(self, system, root: str) -> None:
        _delete(system, f"{root}/_attempts-{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        if self.staged:
            system.create_dir(f"{root}/_attempts-{self.job}", recursive=True)
            with system.open_output_stream(f"{root}/_attempts-{self.job}/{COUNTED}") as f:
                f.write("\n".join(m.folder.rsplit("/", 1)[1] for m in messages if m and m.folder).encode())
            return
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self._clear(system, root)
            raise ValueError("rows of one file lie in several partitions: use by_file()")
        system.create_dir(root, recursive=True)
        there = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not f.path[len(root) :].startswith("/_attempts-")]
        if self.overwrite:
            for f in there:
                system.delete_file(f.path)
        elif taken := {f.path[len(root) + 1 :] for f in there} & set(names):
            self._clear(system, root)
            raise ValueError(f"there already: {sorted(taken)[:3]}")
        made_in = set()
        for place, name in files:
            if (parent := f"{root}/{name}".rsplit("/", 1)[0]) not in made_in:
                system.create_dir(parent, recursive=True)
                made_in.add(parent)
            system.move(place, f"{root}/{name}")
        self._clear(system, root)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))


def _delete(system, folder: str) -> None:
    from pyarrow import fs

    if system.get_file_info(folder).type != fs.FileType.NotFound:
        system.delete_dir(folder)


def _there(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type == fs.FileType.File


def _listed(system, folder: str) -> Iterator[str]:
    """The names in an attempt's list, a part at a time."""
    with system.open_input_file(f"{folder}/{LIST}") as f:
        for batch in pq.ParquetFile(f).iter_batches(LIST_ROWS):
            yield from batch.column(0).to_pylist()


def _taken(system, root: str, folder: str) -> list[str]:
    """The first names of an attempt that files have already."""
    return list(islice((name for name in _listed(system, folder) if _there(system, f"{root}/{name}")), 3))


def _publish(system, root: str, folder: str) -> list[str]:
    """Gives an attempt's files their names. A task that is tried again goes on where the first one ended."""
    made_in = set()
    for n, name in enumerate(_listed(system, folder)):
        if (parent := f"{root}/{name}".rsplit("/", 1)[0]) not in made_in:
            system.create_dir(parent, recursive=True)
            made_in.add(parent)
        try:
            system.move(f"{folder}/{n}", f"{root}/{name}")
        except OSError:
            if not _there(system, f"{root}/{name}"):
                raise
    return []


def _withdraw(system, root: str, folder: str) -> list[str]:
    """Deletes those of an attempt's files that have got their names."""
    for n, name in enumerate(_listed(system, folder)):
        if not _there(system, f"{folder}/{n}") and _there(system, f"{root}/{name}"):
            system.delete_file(f"{root}/{name}")
    return []


def _remove(system, root: str, folder: str) -> list[str]:
    _delete(system, folder)
    return []


def _named(system, root: str, folder: str) -> list[str]:
    return list(_listed(system, folder))


def _each(spark: SparkSession, path: str, folders: list[str], act) -> DataFrame:
    """What act(file system, root, folder) tells of each attempt's folder, in as many tasks as the session's shuffles have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(act(system, root, f"{root}/{folder}"), pa.string())], names=["told"])

    tasks = spark.sparkContext.parallelize([(f,) for f in folders], min(len(folders), int(spark.conf.get("spark.sql.shuffle.partitions")))).toDF("folder string")
    return tasks.mapInArrow(run, "told string")


def save(rows: DataFrame, order: list[str] | None, format_name: str, path: str) -> None:
    """Adds the rows to a folder as files of a format, like a writer with mode append, whatever their number: tasks write the
    files, look whether there are files of their names (an error, and none is added), and give them their names. If that
    fails, those that have got their names are deleted again; only a job that is lost with its driver leaves some, without
    _SUCCESS. Each file is one partition's, as by_file() deals them; with order None the rows lie so already, and in order."""
    spark, path, job = rows.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    register(spark)
    (rows if order is None else by_file(rows, order)).write.format(format_name).mode("append").option("job", job).save(path)
    system, root = file_system(path)
    attempts = f"_attempts-{job}"
    with system.open_input_file(f"{root}/{attempts}/{COUNTED}") as f:
        folders = [f"{attempts}/{name}" for name in f.read().decode().split("\n") if name]
    told = lambda act: [r["told"] for r in _each(spark, path, folders, act).collect()]
    try:
        if folders:
            if order is None and (torn := _each(spark, path, folders, _named).groupBy("told").count().filter("count > 1").take(3)):
                raise ValueError(f"rows of one file lie in several partitions: use by_file(): {sorted(r['told'] for r in torn)}")
            if taken := told(_taken):
                raise ValueError(f"there already: {sorted(taken)[:3]}")
            try:
                told(_publish)
            except Exception:
                told(_withdraw)
                raise
            told(_remove)
    finally:
        _delete(system, f"{root}/{attempts}")
    with system.open_output_stream(f"{root}/_SUCCESS"):
        pass


def _source(format_name: str, encoder: type[Raw]) -> type[DataSource]:
    class MediaFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self):
            raise ValueError(f"{format_name} files are read by tidemark.sources.readers")

        def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
            if missing := {"file", *encoder.columns} - set(schema.names):
                raise ValueError(f"{format_name} needs columns {sorted(missing)}")
            return _Writer(self.options["path"], encoder, overwrite, self.options.get("job"))

    return MediaFiles


def register(spark) -> None:
    """Makes every name in FORMATS a format of spark's writers. The column `file` is a name under the folder written to; two
    rows of one file in two partitions, a file that is there already (with mode append), and a null or outward name are errors."""
    add_sources(spark, *(_source(name, encoder) for name, encoder in FORMATS.items()))
