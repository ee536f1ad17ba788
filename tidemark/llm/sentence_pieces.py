"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the model's own compiled character map: at each place the longest prefix that the map holds is
replaced, else one character is copied, and every byte that comes out records the source byte it came from. The normalised
text is cut before each run of spaces, where no piece of the vocabulary crosses; runs not met before are encoded by the
library, whose own normalisation is switched off, and remembered with their pieces' places. These places, added up along
the text and looked up in the record, give every piece's span of bytes in the source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import keyed, tidy
from tidemark.llm.token_counts import byte_balanced

#: The character that stands for a space in pieces; kinds of pieces; the kind of model; field numbers of a model file.
SPACE_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
#: Characters of text that are encoded in one go, and what a worker remembers at most: runs and their pieces.
SLICE_CHARS, MEMO_RUNS, MEMO_PIECES = 4 << 20, 500_000, 4_000_000
_RUNS = re.compile(f"[ {SPACE_MARK}]*[^ {SPACE_MARK}]+|[ {SPACE_MARK}]+")


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: number, and an integer or bytes."""
    at = 0
    while at < len(message):
        tag, at = _number(message, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(message, at)
        else:
            size, at = _number(message, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


def _field(number: int, value: bytes) -> bytes:
    out, size = bytearray([number << 3 | 2]), len(value)
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes(out) + bytes([size]) + value


class CharacterMap:
    """A compiled character map: a double-array trie over source bytes, whose values are places of zero-ended replacements."""

    def __init__(self, compiled: bytes = b""):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.targets = compiled[4 + size :]
        #: Bytes that a source string of the map may start with; whatever else is copied in one go.
        self.starts = bytes(b for b in range(256) if self.units and self._step(self._base(0, self.units[0]), b))
        self.copied = re.compile(b"[^" + re.escape(self.starts) + b"]+") if self.starts else None

    @staticmethod
    def _base(at: int, unit: int) -> int:
        return at ^ (unit >> 10 << ((unit & 512) >> 6))

    def _step(self, at: int, byte: int) -> int | None:
        at ^= byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest source string that stands at text[at:], and that string's length."""
        best, node = None, self._base(0, self.units[0])
        for i in range(at, len(text)):
            here = self._step(node, text[i])
            if here is None:
                break
            unit = self.units[here]
            node = self._base(here, unit)
            if unit & 256:
                best = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if best is None:
            return None
        start = best[0]
        return self.targets[start : self.targets.index(0, start)], best[1]

    def unit(self, text: bytes, at: int) -> tuple[bytes, int]:
        """What becomes of what stands at text[at:], the longest string of the map or one character, and where that ends."""
        found = self.longest(text, at) if text[at] in self.starts else None
        if found:
            return found[0], at + found[1]
        end = at + 1
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        return text[at:end], end

    def apply(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The text with its strings replaced, and the source byte of each byte of it, that of the end last. All bytes of a
        copied character come from its first one, all bytes of a replacement from the first byte that it replaces."""
        heads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        starts = np.maximum.accumulate(np.where(heads, np.arange(len(text)), 0)) if text else np.zeros(0, np.int64)
        if not self.starts:
            return text, np.append(starts, len(text))
        parts, origins, at = [], [np.zeros(0, np.int64)], 0
        while at < len(text):
            bulk = self.copied.match(text, at)
            if bulk:
                parts.append(bulk[0])
                origins.append(starts[at : bulk.end()])
                at = bulk.end()
                continue
            made, end = self.unit(text, at)
            parts.append(made)
            origins.append(np.full(len(made), at))
            at = end
        return b"".join(parts), np.concatenate([*origins, [len(text)]])


class Normaliser:
    """The model's rules of normalisation: the character map, what becomes of spaces, and the space before the text."""

    def __init__(self, spec: bytes):
        found = dict(fields(spec))
        self.map = CharacterMap(found.get(2, b""))
        self.prefix, self.squeeze = bool(found.get(3, 1)), bool(found.get(4, 1))
        if not found.get(5, 1):
            raise ValueError("models that leave spaces as they are have no runs to cut at")

    def apply(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, its spaces still spaces, and the source byte of each of its bytes and of its end."""
        made, origin = self.map.apply(text)
        first = 0  # where the text begins behind the spaces before it
        while self.squeeze and first < len(text) and (unit := self.map.unit(text, first))[0] == b" ":
            first = unit[1]
        if self.squeeze and first == len(text):
            return b"", np.zeros(1, np.int64)
        if self.squeeze:  # a space stays where the byte before it is none
            space = np.frombuffer(made, np.uint8) == 32
            stay = ~space | ~np.concatenate([[True], space[:-1]])[: len(space)]
            made, origin = np.frombuffer(made, np.uint8)[stay].tobytes(), np.append(origin[:-1][stay], len(text))
        if self.prefix and first < len(text):
            made, origin = b" " + made, np.concatenate([[first], origin])
        if self.squeeze:
            made = made.rstrip(b" ")
            origin = origin[: len(made) + 1]
        return made, origin


class OffsetEncoder:
    """Encodes texts with a SentencePiece BPE model, and knows where each piece comes from."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        spec, rest, pieces, kinds = b"", [], [], []
        trainer: dict = {}
        for number, value in fields(model):
            if number == NORMALIZER:
                spec = value
                continue
            rest.append(_field(number, value))
            if number == PIECES:
                one = dict(fields(value))
                pieces.append(one[1].decode())
                kinds.append(one.get(3, NORMAL))
            elif number == TRAINER:
                trainer = dict(fields(value))
        inner = [p for p, k in zip(pieces, kinds) if k != CONTROL and SPACE_MARK in p.lstrip(SPACE_MARK)]
        if trainer.get(3) != BPE_MODEL or trainer.get(24) or USER_DEFINED in kinds or inner:
            raise ValueError(f"{path}: not a BPE model whose pieces all end before a space; runs cannot be encoded one by one")
        self.normaliser = Normaliser(spec)
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x01"  # no map, no space before the text, spaces kept and written as marks
        self.core = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + _field(NORMALIZER, plain))
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.exact = np.array([k in (NORMAL, UNUSED, BYTE) for k in kinds])
        self.width = np.array([1 if k == BYTE else len(p.replace(SPACE_MARK, " ").encode()) for p, k in zip(pieces, kinds)])
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.bounds, self.sizes = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.found: list[np.ndarray] = []  # id, begin and end within the run, of all pieces of the remembered runs

    def learn(self, runs: list[str]) -> None:
        """Remembers what each run becomes. Of a character's byte pieces the last one has its bytes."""
        made = self.core.encode(runs, num_threads=1)
        self.memo.update(zip(runs, range(len(self.memo), len(self.memo) + len(runs))))
        data = [r.encode() for r in runs]
        size, n = np.array([len(d) for d in data]), np.array([len(x) for x in made])
        ids = np.fromiter(chain.from_iterable(made), np.int64, n.sum())
        run = np.repeat(np.arange(len(runs)), n)
        width = self.width[ids]
        as_long = np.bincount(run, width, len(runs)) == size
        odd = np.flatnonzero(~as_long | (np.bincount(run, ~self.exact[ids], len(runs)) > 0))  # some piece is not as long as what it stands for
        first = np.repeat(np.cumsum(size) - size, n)  # of the run among all bytes
        ends = np.cumsum(width) - np.repeat(np.cumsum(np.bincount(run, width, len(runs))) - np.bincount(run, width, len(runs)), n).astype(np.int64)
        begins = ends - width
        in_bytes = self.is_byte[ids] & ~np.isin(run, odd)
        if in_bytes.any():
            heads = np.append((np.frombuffer(b"".join(data), np.uint8) & 0xC0) != 0x80, True)
            of = np.maximum.accumulate(np.where(heads, np.arange(len(heads)), 0))
            at = first[in_bytes]
            begins[in_bytes] = of[begins[in_bytes] + at] - at
            ends[in_bytes] = np.where(heads[ends[in_bytes] + at], ends[in_bytes], begins[in_bytes])
        for i in odd:
            told = self.core.encode(runs[i], return_type="proto").pieces
            begins[run == i], ends[run == i] = [p.begin for p in told], [p.end for p in told]
        self.found.append(np.array([ids, begins, ends], np.int32))
        self.sizes = np.concatenate([self.sizes, size])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(n)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many pieces each text has, and of all pieces, text by text: id, begin and end in the text's bytes."""
        if len(self.memo) > MEMO_RUNS or self.bounds[-1] > MEMO_PIECES:
            self.forget()
        normal = [self.normaliser.apply(t.encode()) for t in texts]
        cut = [_RUNS.findall(n.decode()) for n, _ in normal]
        flat = list(chain.from_iterable(cut))
        new = set(flat).difference(self.memo)
        if new:
            self.learn(list(new))
        runs = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        n_runs = np.array([len(c) for c in cut], np.int64)
        n_of_run = np.diff(self.bounds)[runs]
        first = np.cumsum(n_of_run) - n_of_run  # of each run's pieces among all
        take = np.repeat(self.bounds[:-1][runs] - first, n_of_run) + np.arange(n_of_run.sum())
        # the normalised texts, one after another, each with a place more for its end
        text_of_run = np.repeat(np.arange(len(texts)), n_runs)
        at = np.repeat(np.cumsum(self.sizes[runs]) - self.sizes[runs] + text_of_run, n_of_run)
        origin = np.concatenate([o for _, o in normal]) if normal else np.zeros(0, np.int64)
        self.found = [np.concatenate([np.zeros((3, 0), np.int32), *self.found], axis=1)]
        ids, begins, ends = self.found[0][:, take]
        n_of_text = np.bincount(text_of_run, n_of_run, len(texts)).astype(np.int64)
        return n_of_text, ids, origin[begins + at].astype(np.int32), origin[ends + at].astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)


_encoders: dict[str, OffsetEncoder] = {}


def encoder(path: str) -> OffsetEncoder:
    """One for each worker process and model."""
    if path not in _encoders:
        _encoders[path] = OffsetEncoder(path)
    return _encoders[path]


def sentence_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, begins and ends (each piece's bytes in the source text, end exclusive) and decoded of every row.

    Ids are those of the library without begin and end ids; decoded is what they decode to. A character in byte pieces has
    its bytes with the last of them, as the library tells it; the piece of the space put before a text takes no bytes for
    it. Null and empty texts have no ids and decode to an empty text. A text of any length is encoded whole. Repeated rows
    have one result each, a null id stays null, no rows give no rows, other columns are dropped whatever their names. Models
    other than BPE, with user-defined pieces, or with pieces across a space, are refused.
    """
    names = ["doc_id", "ids", "begins", "ends", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in byte_balanced(texts, SLICE_CHARS):
                counts, *columns = engine.encode(texts[part])
                bounds = np.concatenate([[0], np.cumsum(counts)])
                decoded = [engine.decode(columns[0][a:b].tolist()) if b > a else "" for a, b in zip(bounds[:-1], bounds[1:])]
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(c, pa.int32())) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(counts)), *lists, pa.array(decoded, pa.string())], names=names)

    rows = keyed(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def decoded_pieces(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column `decoded`: the text of each list of ids. A null list gives null, an empty one an empty text;
    ids that the model has not raise an error."""
    if "decoded" in rows.columns:
        raise ValueError("there is a column `decoded` already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(model_path).decode
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            made = pa.array([None if x is None else decode(x) if x else "" for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(tidy(run), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, decoded string")
