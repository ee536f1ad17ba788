"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at ASCII white space, where the tokenizer cuts too (a safe boundary: no piece, special string or
normalisation crosses it), so a text's count is the sum of its words' counts. Only words not met before are encoded, in
batches balanced by bytes, and their counts kept in a memo of bounded size. Long texts are the same: they are read in
slices that end at such a boundary.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import keyed, text_bytes, tidy

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
#: Encoded in one call: about so many bytes of words.
BATCH_BYTES = 1 << 16
#: Words of which a worker keeps the count, and the longest word kept.
MEMO_WORDS, MEMO_WORD_BYTES = 400_000, 64
#: A long text is read in slices of about so many bytes.
SLICE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def slices(text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """Parts of about `most` bytes that end before white space, or whole words where a word is longer."""
    at = 0
    while len(text) - at > most:
        found = _SPACE.search(text, at + most)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    if at < len(text) or not text:
        yield text[at:]


#: How a vocabulary's own splitter makes pieces, none of which holds white space.
SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def check_cuts_at_spaces(path: str, spec: dict) -> None:
    """Raises ValueError for a vocabulary whose pieces may hold white space: its texts cannot be encoded word by word."""
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if not steps or steps[0].get("pattern", {}).get("Regex") != SPLITTER or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or spec["model"].get("continuing_subword_prefix"):
        raise ValueError(f"{path}: its pieces do not end at white space; words cannot be encoded one by one")


class WordCounter:
    """Counts tokens of words with a tokenizer of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            check_cuts_at_spaces(path, json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, int] = {}

    def learn(self, words: list[bytes]) -> dict[bytes, int]:
        """Counts of new words: each encoded alone, many in one call."""
        found: dict[bytes, int] = {}
        groups: list[list[bytes]] = [[]]
        size = 0
        for w in words:
            if size > BATCH_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(w)
            size += len(w)
        for group in groups:
            if group:
                made = self.tokenizer.encode([w.decode() for w in group], is_pretokenized=True, add_special_tokens=False)
                of = np.fromiter((-1 if k is None else k for k in made.word_ids), np.int64, len(made))
                counts = np.bincount(of, minlength=len(group)) if len(of) else np.zeros(len(group), np.int64)
                found.update(zip(group, counts.tolist(), strict=True))
        return found

    def count(self, texts: list[bytes]) -> list[int]:
        parts = [(i, part.split()) for i, text in enumerate(texts) for part in slices(text)]
        out = [0] * len(texts)
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        new = set().union(*(words for _, words in parts)).difference(self.memo) if parts else set()
        found = self.learn(list(new)) if new else {}
        self.memo.update((w, n) for w, n in found.items() if len(w) <= MEMO_WORD_BYTES)
        memo = self.memo
        for i, words in parts:
            try:
                out[i] += sum(map(memo.__getitem__, words))
            except KeyError:
                out[i] += sum(memo[w] if w in memo else found[w] for w in words)
        return out


_counters: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    """One for each worker process and vocabulary."""
    if path not in _counters:
        _counters[path] = WordCounter(path)
    return _counters[path]


def balanced(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of the batch with about `most` bytes each, or one text."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def byte_balanced(texts: list[bytes] | list[str], most: int) -> Iterator[slice]:
    return balanced(list(map(len, texts)), most)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    Null and empty texts: 0 bytes, 0 tokens. Texts of any length are counted whole, in slices. Repeated rows: one result each.
    A null id stays null. No rows: no rows. Other columns are dropped, whatever their names. Special strings inside texts count as the library's default has it, as one token. Only vocabularies that cut at white
    space are counted word by word; any other is refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for batch in batches:
            texts = text_bytes(batch.column(1))
            tokens = [n for part in byte_balanced(texts, 8 << 20) for n in count(texts[part])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(tokens, pa.int64())], schema=OUT)

    rows = keyed(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
