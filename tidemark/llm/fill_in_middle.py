"""Fill-in-the-middle transformation by secondary sort.

Each text is cut into pieces, chunks of whole lines of its prefix, middle or suffix, keyed by the document and the piece's
place in the output. One exchange on the document with a sort on (document, place) within partitions (what an RDD calls
repartitionAndSortWithinPartitions) puts the output in order, to be read as a stream. Restoration reads that stream alone:
it finds the marks, gives each piece its place in the text, and sorts again where the pieces lie, without an exchange. No
task holds more of a document than a batch of pieces, but for the one that cuts it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import keyed, text_bytes, tidy

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MARK = re.compile(b"<[PSM]>")
#: In a piece at most so many bytes; a longer line is cut. Pieces that a task hands on in one batch.
CHUNK_BYTES, BATCH_BYTES = 1 << 14, 4 << 20
#: A document: its id and 128 bits of its text's SHA-256, so that rows that repeat an id keep apart.
KEY = ["doc_id", "text_key"]
_KEY = [("doc_id", pa.int64()), ("text_key", pa.binary())]
#: How a document was cut, on its first piece; null on the others.
_FACTS = [("copies", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
PIECES = pa.schema([*_KEY, ("place", pa.int64()), ("chunk", pa.binary()), *_FACTS])
RESTORED = pa.schema([*_KEY, ("part", pa.int32()), ("place", pa.int64()), ("chunk", pa.binary()), *_FACTS, ("output_sha256", pa.string())])
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def chunks(text: bytes, start: int, end: int) -> Iterator[bytes]:
    """text[start:end] in parts that end after a line where one ends within CHUNK_BYTES."""
    while start < end:
        stop = end if end - start <= CHUNK_BYTES else text.rfind(b"\n", start, start + CHUNK_BYTES) + 1 or start + CHUNK_BYTES
        yield text[start:stop]
        start = stop


def plan_cut(doc_id: int | None, text: bytes, seed: int, percent: int, spm_percent: int) -> tuple[int, str, int, int]:
    """Number of lines, form, and the bytes after which prefix and middle end."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))
    n = text.count(b"\n") + (not text.endswith(b"\n") and text != b"")
    if not text or _MARK.search(text) or h3 % 100 >= percent:
        return n, "plain", 0, 0
    ends = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1, [len(text)]])
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < spm_percent else "psm", int(ends[a]), int(ends[b])


def _cut(seed: int, percent: int, spm_percent: int):
    def rows_of(doc_id: int | None, text: bytes, key: bytes, copies: int) -> Iterator[tuple]:
        n, form, a, b = plan_cut(doc_id, text, seed, percent, spm_percent)
        facts = (copies, n, form, None, None)
        order = [(b"", 0, len(text))]
        if form != "plain":
            facts = (copies, n, form, len(text[:a].decode()), len(text[a:b].decode()))
            order = [(PREFIX, 0, a), (SUFFIX, b, len(text))]
            order = (order if form == "psm" else order[::-1]) + [(MIDDLE, a, b)]
        place = 0
        for mark, start, end in order:
            for chunk in chunks(text, start, end) if end > start else [b""]:
                yield (doc_id, key, place, mark + chunk, *(facts if not place else (None,) * 5))
                mark, place = b"", place + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            texts = text_bytes(batch.column(1))
            met: dict[tuple, list[int]] = {}  # equal rows of a batch go on as one
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                met.setdefault((doc_id, hashlib.sha256(texts[i]).digest()[:16]), []).append(i)
            for (doc_id, key), at in met.items():
                for row in rows_of(doc_id, texts[at[0]], key, len(at)):
                    held.append(row)
                    size += len(row[3]) + 100
                    if size > BATCH_BYTES:
                        yield _batch(held, PIECES)
                        held, size = [], 0
        if held:
            yield _batch(held, PIECES)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The transformed texts as pieces in order: doc_id, text_key, place (from 0), chunk (bytes), and on the first piece of
    a document copies, n (its lines), form (psm, spm or plain), prefix_chars and middle_chars (null where plain).

    A document's chunks by place are its output. A partition holds its documents whole, sorted by key and place. `percent`
    of texts are cut, and `spm_percent` of these have the suffix first. Null and empty texts, and texts that hold a mark,
    are plain. Rows equal in id and text are one document with so many `copies`, counted for each batch of rows before the
    exchange: the same piece then comes once for each batch, its places beside each other. Rows with one id and several
    texts, a null id too, are documents of their own; a null id hashes as no digits. A text of any length is cut whole. No rows:
    no rows. Other columns are dropped, whatever their names.
    """
    rows = keyed(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tidy(_cut(seed, percent, spm_percent)), _ddl(PIECES)).repartition(*KEY).sortWithinPartitions(*KEY, "place")


class Splitter:
    """Reads an output chunk by chunk and gives (part, bytes): 0 prefix, 1 middle, 2 suffix. Holds two bytes at most."""

    PARTS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

    def __init__(self, form: str):
        self.part, self.marked, self.rest = 0, form != "plain", b""

    def feed(self, chunk: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        if not self.marked:
            yield 0, chunk
            return
        data = self.rest + chunk
        at = 0
        for m in _MARK.finditer(data):
            yield self.part, data[at : m.start()]
            self.part, at = self.PARTS[m[0]], m.end()
        keep = len(data) if last else max(at, len(data) - 2)  # a mark may go on in the next chunk
        yield self.part, data[at:keep]
        self.rest = data[keep:]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(starts a document, row) for each row of a partition that is sorted by document."""
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["doc_id"], row["text_key"])
            yield key != last, row
            last = key


def _flow(rows: Iterator[tuple], schema: pa.Schema, width) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += width(row)
        if size > BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams outputs: digests each, and gives every piece of it its part and place in the text it was made from."""

    def rows() -> Iterator[tuple]:
        first, copies, place, at, digest, split = None, 0, -1, 0, None, None

        def head() -> Iterator[tuple]:
            if first is not None:
                key = (first["doc_id"], first["text_key"])
                for part, chunk in split.feed(b"", last=True):
                    if chunk:
                        yield (*key, part, at, chunk, *(None,) * 6)
                yield (*key, -1, 0, None, copies, *(first[f] for f, _ in _FACTS[1:]), digest.hexdigest())

        for new, row in _documents(batches):
            if new:
                yield from head()
                first, copies, place, at, digest, split = row, 0, -1, 0, hashlib.sha256(), Splitter(row["form"])
            copies += row["copies"] or 0
            if row["place"] == place:  # the same piece, from another batch of equal rows
                continue
            place = row["place"]
            digest.update(row["chunk"])
            for part, chunk in split.feed(row["chunk"]):
                if chunk:
                    yield (row["doc_id"], row["text_key"], part, at, chunk, *(None,) * 6)
                    at += 1
        yield from head()

    yield from _flow(rows(), RESTORED, lambda r: len(r[4] or b"") + 100)


def restored(pieces: DataFrame) -> DataFrame:
    """What fill_in_middle() gave, taken back: the chunks of each text in its own order, by part (0 prefix, 1 middle, 2 suffix)
    and place, after a row of part -1 with the document's facts, its copies summed up, and output_sha256.

    Only outputs and their forms are read for it. The pieces must lie and be sorted as fill_in_middle() leaves them.
    """
    return pieces.mapInArrow(tidy(_read_back), _ddl(RESTORED)).sortWithinPartitions(*KEY, "part", "place")


DIGESTS = pa.schema([("doc_id", pa.int64()), *_FACTS[1:], ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        first, digest = None, None

        def done() -> Iterator[tuple]:
            if first is not None:
                row = (first["doc_id"], *(first[f] for f, _ in _FACTS[1:]), first["output_sha256"], digest.hexdigest())
                for _ in range(first["copies"]):
                    yield row

        for new, row in _documents(batches):
            if new:
                yield from done()
                first, digest = row, hashlib.sha256()
            else:
                digest.update(row["chunk"])
        yield from done()

    yield from _flow(rows(), DIGESTS, lambda r: 300)


def piece_digests(back: DataFrame) -> DataFrame:
    """For each row that fill_in_middle() was given: doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the
    output and of the text that restored() got back from it."""
    return back.mapInArrow(tidy(_digests), _ddl(DIGESTS))


def texts(pieces: DataFrame) -> DataFrame:
    """doc_id, form and output (a string) of each document, for outputs that fit a row; one row for equal rows."""
    each = pieces.select(*KEY, "form", F.struct("place", "chunk").alias("p"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_set("p")), lambda p: F.hex(p["chunk"])), "")
    return each.groupBy(*KEY).agg(F.max("form").alias("form"), F.unhex(whole).cast("string").alias("output")).drop("text_key")
