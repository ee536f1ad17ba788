"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of a word. Merges of a trained vocabulary run in the order of their ranks, and a
row of tokens is the exact result if and only if every token is what its own string merges to and every two neighbours
stay apart when merged together. So vectorised checks test each adjacent pair of the proposals, once for each distinct
pair: the pieces that stand at the border while both sides are being built are the right edge of the left token's merge
tree and the left edge of the right one's, and the pair fails when some piece of the one merges with some piece of the
other before either is taken up by its own side. Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_encoder import _bytes_of_characters
from tidemark.llm.shared import keyed, tidy
from tidemark.llm.token_counts import balanced, check_cuts_at_spaces

#: Words, pieces and distinct pairs that a worker remembers, in two generations of this size; longer words are not kept.
MEMO_WORDS, MEMO_PIECES, MEMO_WORD_BYTES, MEMO_PAIRS = 300_000, 300_000, 64, 3_000_000
#: Words of more symbols are merged with a heap.
LONG_WORD = 48
NEVER = np.int64(1) << 40
#: The pieces that the vocabulary's own splitter makes, here for ASCII text in lower case.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+")


class Memo(dict):
    """A dictionary with an older generation: what is asked for stays, the rest goes when the young one is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def missing(self, keys: set) -> list:
        """The keys in neither generation; those in the old one become young."""
        new = []
        for k in keys.difference(self):
            if k in self.old:
                self[k] = self.old[k]
            else:
                new.append(k)
        return new


class SpeculativeBPE:
    """Encodes words of a vocabulary whose pieces end at white space (`</w>` style) as the tokenizers library does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        check_cuts_at_spaces(path, spec)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile(b"(" + b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self.byte_char = str.maketrans({chr(b): c for c, b in _bytes_of_characters().items() if b < 128})
        self.odd_ascii = re.compile("[\x00-\x20\x7f]")

        size = max(self.vocab.values()) + 1
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.formed = np.full(size, -1, np.int64)  # the rank of the merge that makes a token; -1: a symbol
        ordered = True
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[x * size + y] = rank
            self.made.append(made)
            ordered &= self.left[made] < 0 and self.formed[x] < rank and self.formed[y] < rank
            self.left[made], self.right[made], self.formed[made] = x, y, rank
        self.size = size
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]
        made = np.flatnonzero(self.left >= 0)
        usable = np.ones(size, bool)
        # A token is proposed only if its parts are usable and first meet at the border by the very merge that makes it.
        first = self.first_meeting(self.left[made], self.right[made])
        for t, met in sorted(zip(made.tolist(), first.tolist(), strict=True), key=lambda x: self.formed[x[0]]):
            usable[t] = ordered and met == self.formed[t] and usable[self.left[t]] and usable[self.right[t]]
        end = len(self.suffix)
        self.last = {t[: len(t) - end]: i for t, i in self.vocab.items() if usable[i] and t.endswith(self.suffix)}
        self.inner = {t: i for t, i in self.vocab.items() if usable[i] and not (end and t.endswith(self.suffix))}
        self.reach: dict[str, int] = {}  # the length of the longest inner token by its first two characters
        for t in self.inner:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.known, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
        self.memo, self.piece_memo = Memo(MEMO_WORDS), Memo(MEMO_PIECES)
        self.n_words = self.n_failed = 0

    def rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def first_meeting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which a piece of a's right edge first merges with one of b's left edge, NEVER if none does."""
        first = np.full(len(a), NEVER)
        active, x, x_until = np.arange(len(a)), a.copy(), np.full(len(a), NEVER)
        while len(active):
            rows, y, y_until = np.arange(len(active)), b[active], np.full(len(active), NEVER)
            while len(rows):
                rank = self.rank_of(x[rows], y)
                # Equal ranks merge from left to right: x's own side comes first, y's own side after the border.
                met = (rank < x_until[rows]) & (rank <= y_until) & (rank < NEVER)
                np.minimum.at(first, active[rows[met]], rank[met])
                y_until, y = self.formed[y], self.left[y]
                more = y >= 0
                rows, y, y_until = rows[more], y[more], y_until[more]
            x_until, x = self.formed[x], self.right[x]
            more = x >= 0
            active, x, x_until = active[more], x[more], x_until[more]
        return first

    def stay_apart(self, pairs: np.ndarray) -> np.ndarray:
        """For each left * size + right: whether the two tokens stay as they are side by side."""
        distinct, back = np.unique(pairs, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = distinct[self.known[at] != distinct] if len(self.known) else distinct
        if len(new):
            verdict = self.first_meeting(new // self.size, new % self.size) == NEVER
            if len(self.known) > MEMO_PAIRS:
                old, was = distinct[self.known[at] == distinct], self.apart[at][self.known[at] == distinct]
            else:
                old, was = self.known, self.apart
            both = np.concatenate([old, new])
            order = np.argsort(both, kind="stable")
            self.known, self.apart = both[order], np.concatenate([was, verdict])[order]
        return self.apart[np.searchsorted(self.known, distinct)][back]

    def propose(self, piece: str) -> list[int]:
        """Greedy longest match; the last token carries the end of the word."""
        inner, last, reach, n, at, out = self.inner, self.last, self.reach, len(piece), 0, []
        while True:
            rest = piece[at:]
            t = last.get(rest)
            if t is not None:
                out.append(t)
                return out
            for stop in range(min(n - at - 1, reach.get(rest[:2], 1)), 0, -1):
                t = inner.get(rest[:stop])
                if t is not None:
                    out.append(t)
                    at += stop
                    break
            else:
                raise KeyError(f"no symbol for {rest[:1]!r}")

    def merge_exactly(self, piece: str) -> list[int]:
        """Repeatedly the merge of least rank, from left to right."""
        get, size, made = self.rank.get, self.size, self.made
        row = [self.vocab[c] for c in piece[:-1]] + [self.vocab[piece[-1] + self.suffix]]
        if len(row) > LONG_WORD:
            return self.merge_long(row)
        never = len(made)
        ranks = [get(x * size + y, never) for x, y in zip(row, row[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            row[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(row[i - 1] * size + row[i], never)
            if i < len(ranks):
                ranks[i] = get(row[i] * size + row[i + 1], never)
        return row

    def merge_long(self, row: list[int]) -> list[int]:
        """The same with a heap."""
        get, size, n = self.rank.get, self.size, len(row)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, row[i], row[i + 1]) for i in range(n - 1) if (r := get(row[i] * size + row[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i]
            if row[i] != x or j >= n or row[j] != y:
                continue
            row[i], row[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := get(row[k] * size + row[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, row[k], row[after[k]]))
        return [t for t in row if t >= 0]

    def pieces(self, word: bytes) -> list[str | int]:
        """The word's pieces in the byte alphabet, special tokens as their ids."""
        if word.isalpha():  # ASCII letters only
            return [word.decode().lower()]
        parts = self.special_at.split(word) if self.special_at else [word]
        out: list[str | int] = []
        for part in parts:
            if not part:
                continue
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                text = part.decode().lower()
                found = _ASCII_PIECES.findall(text)
                out += [p.translate(self.byte_char) for p in found] if self.odd_ascii.search(text) else found
            else:
                out += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part.decode()))]
        return out

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        proposed = [self.propose(p) for p in pieces]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for row in proposed for t in row), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(proposed)), sizes)
        inner = np.flatnonzero(of[1:] == of[:-1])
        if len(inner):
            good = self.stay_apart(flat[inner] * self.size + flat[inner + 1])
            failed = np.unique(of[inner[~good]]).tolist()
            self.n_failed += len(failed)
            for i in failed:
                proposed[i] = self.merge_exactly(pieces[i])
        self.n_words += len(pieces)
        return proposed

    def encode_words(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each word its decimal ids and its tokens, both joined by spaces."""
        parts = [self.pieces(w) for w in words]
        known = self.piece_memo
        known.turn()
        new = known.missing({p for row in parts for p in row if isinstance(p, str)})
        long = {}
        token = self.token
        for piece, ids in zip(new, self.encode_pieces(new), strict=True):
            (known if len(piece) <= MEMO_WORD_BYTES else long)[piece] = (" ".join(map(str, ids)).encode(), " ".join([token[i] for i in ids]).encode())
        out = []
        for row in parts:
            if len(row) == 1 and (x := known.get(row[0])):
                out.append(x)
                continue
            made = [(known[p] if p in known else long[p]) if isinstance(p, str) else (str(p).encode(), token[p].encode()) for p in row]
            out.append((b" ".join([x[0] for x in made]), b" ".join([x[1] for x in made])))
        return out

    def write(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """For each text its decimal ids and its decoded text, both joined by spaces, as binary arrays."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat = split.flatten().cast(pa.large_binary()).dictionary_encode()
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        words = flat.dictionary.to_pylist()
        memo = self.memo
        memo.turn()
        new = memo.missing(set(words))
        long = {}
        for word, made in zip(new, self.encode_words(new), strict=True):
            (memo if len(word) <= MEMO_WORD_BYTES else long)[word] = made
        made = [memo[w] if w in memo else long[w] for w in words]
        sizes = np.diff(split.offsets.to_numpy())
        index = flat.indices
        empty = np.array([not x[0] for x in made], bool)
        if empty.any():  # such words leave no trace, not even a space
            stay = ~empty[index.to_numpy(zero_copy_only=False)]
            of = np.repeat(np.arange(len(sizes)), sizes)[stay]
            sizes, index = np.bincount(of, minlength=len(sizes)), index.filter(pa.array(stay))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return tuple(pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([x[k] for x in made], pa.binary()).take(index)), b" ") for k in (0, 1))

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False) where the file names no decoder; unknown ids are left out."""
        return " ".join([self.token[i] for i in ids if i in self.token])


_encoders: dict[str, SpeculativeBPE] = {}


def bpe(path: str) -> SpeculativeBPE:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = SpeculativeBPE(path)
    return _encoders[path]


def bpe_encode(docs: DataFrame, tokenizer_path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded (the text that the ids decode to) of every row; with `digests` their SHA-256 instead.

    Null and empty texts: no ids, an empty decoded text. Texts of any length are encoded whole. Repeated rows: one result each;
    a null id stays null. No rows: no rows. Other columns are dropped, whatever their names. Digests are of
    the decimal ids joined by one space, and of the decoded text in UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = bpe(tokenizer_path)
        kind = pa.string() if digests else pa.list_(pa.int32())
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for part in balanced(lengths, 8 << 20):
                n = part.stop - part.start
                ids, decoded = (x.to_pylist() for x in engine.write(batch.column(1).slice(part.start, n)))
                counts = pa.array([i.count(b" ") + 1 if i else 0 for i in ids], pa.int64())
                if digests:
                    columns = [pa.array([hashlib.sha256(x).hexdigest() for x in c], kind) for c in (ids, decoded)]
                else:
                    columns = [pa.array([np.array(i.split(), np.int32) for i in ids], kind), pa.array([d.decode() for d in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), counts, *columns], names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    rows = keyed(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return rows.mapInArrow(tidy(run), schema)


def bpe_decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column `decoded`: the text of each list of ids. A null list gives null, an empty one an empty text."""
    fields = rows.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = bpe(tokenizer_path).decode
        for batch in batches:
            made = [None if x is None else decode(x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*fields, "decoded"])

    if "decoded" in fields:
        raise ValueError("there is a column `decoded` already")
    return rows.mapInArrow(tidy(run), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, decoded string")
