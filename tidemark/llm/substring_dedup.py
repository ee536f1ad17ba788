"""Substring dedup by recompression.

Rounds name runs and pairs of symbols, words at first. A name is a hash of what it stands for, so equal runs and pairs have
equal names in every document and task. A round with limit k makes one symbol of each run of equal symbols, and one of each
two neighbours whose names fall left and right by a bit of their hash, of symbols of at most k words. What becomes of a
symbol depends on its neighbours alone, so of equal passages at most edge_of(rounds) words at either end are parsed
differently, and inside all symbols are the same: between its edge and its middle a window has symbols that all its copies
have. A symbol's name there stands for it and the words after it that make up half a window. Each window puts forward the
least of these names, the same in all copies, and what some window puts forward is exchanged; of a run also the name of what
it repeats, as a window may hold only a part of it. Names that two rows share show where repeats can be; only there windows
are built, and their words, as digests of 128 bits, decide over the whole corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.near_dedup import SALTS, mix, wide_word_hashes
from tidemark.llm.shared import keyed, materialize, tidy
from tidemark.llm.token_counts import balanced

_ODD = np.uint64(0x9E3779B97F4A7C15)
_RUN, _PART_OF_RUN, _PAIR, _PHRASE = np.uint64(3), np.uint64(5), np.uint64(7), np.uint64(11)
#: A run of so many equal symbols is exchanged under the name of one, too.
LONG_RUN = 3
#: Of one row in SAMPLE the keys are counted; of those that occur LEAST_HOT times the MOST_HOT most frequent are dealt on their own.
SAMPLE, MOST_HOT, LEAST_HOT = 64, 4000, 16


def rounds_for(window: int) -> list[tuple[int, bool]]:
    """(limit, whether runs are named) of each round, as many as leave half a window, up to the last phrase in it, places for
    more than the longest symbol they make."""
    out: list[tuple[int, bool]] = []
    for step in [(1, True), (1, False), (2, True), (2, False)]:
        if edge_of([*out, step]) + 2 * step[0] >= window // 2:
            break
        out.append(step)
    return out


def edge_of(rounds: list[tuple[int, bool]]) -> int:
    """Words at either end of a passage whose symbols its surroundings can change: a symbol for each round, two where
    runs are named."""
    return sum(limit * (2 if runs else 1) for limit, runs in rounds)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words, mixed from hashes of 1, 2, 4, ... words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block, have, at, out = mix(words + np.uint64(size)), 1, 0, None
    while have <= size:
        if size & have:
            part = block[at : at + n]
            out = part if out is None else mix(out * _ODD + part)
            at += have
        if have * 2 <= size:
            block = mix(block[:-have] * _ODD + block[have:])
        have *= 2
    return out


class Symbols:
    """The symbols of documents laid end to end: name, first word, number of words and document of each."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.name, self.start, self.length, self.of = mix(words + np.uint64(1)), np.arange(len(words)), np.ones(len(words), np.int64), doc
        self.runs: list[tuple[np.ndarray, ...]] = []  # of long ones: name of what is repeated, first word, words of one, repetitions

    def _keep(self, stay: np.ndarray) -> None:
        self.name, self.start, self.length, self.of = self.name[stay], self.start[stay], self.length[stay], self.of[stay]

    def round(self, limit: int, runs: bool, salt: int) -> None:
        """Names runs, then pairs, of symbols of at most `limit` words; a run's symbol is in no pair of the same round."""
        if len(self.name) < 2:
            return
        free = self.length <= limit
        if runs:
            same = np.zeros(len(self.name) + 1, bool)  # same[i]: symbol i is like the one before it
            same[1:-1] = (self.name[1:] == self.name[:-1]) & (self.of[1:] == self.of[:-1]) & free[1:]
            first = np.flatnonzero(same[1:] & ~same[:-1])
            if len(first):
                times = np.flatnonzero(same[:-1] & ~same[1:]) - first + 1
                long = times >= LONG_RUN
                self.runs.append((self.name[first[long]], self.start[first[long]], self.length[first[long]], times[long]))
                self.name[first] = mix(self.name[first] * _ODD + mix(times.astype(np.uint64) + (_RUN << np.uint64(32))))
                self.length[first] *= times
                free[first] = False
                stay = ~same[:-1]
                free = free[stay]
                self._keep(stay)
        side = mix(self.name + np.uint64(salt << 8)) >> np.uint64(63)
        pair = (side[:-1] == 0) & (side[1:] == 1) & free[:-1] & free[1:] & (self.of[:-1] == self.of[1:])
        first = np.flatnonzero(pair)
        self.name[first] = mix(self.name[first] * _ODD + mix(self.name[first + 1] + _PAIR))
        self.length[first] += self.length[first + 1]
        stay = np.ones(len(self.name), bool)
        stay[first + 1] = False
        self._keep(stay)


def recompress(words: np.ndarray, doc: np.ndarray, rounds: list[tuple[int, bool]]) -> Symbols:
    out = Symbols(words, doc)
    for i, (limit, runs) in enumerate(rounds):
        out.round(limit, runs, i + 1)
    return out


def names_to_exchange(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, name, and the first and last start of the windows that hold it, of each symbol that is exchanged.

    Of equal windows of two documents at least one has a name that the other has, with both windows between first and last.
    """
    doc, half = np.repeat(np.arange(len(counts)), counts), window // 2
    rounds = rounds_for(window)
    made = recompress(words, doc, rounds)
    ends = np.cumsum(counts)
    begin, end = ends - counts, ends
    inside = made.start + half <= end[made.of]
    at, of = made.start[inside], made.of[inside]
    name = mix(made.name[inside] * _ODD + window_hashes(words, half)[at] + _PHRASE)
    stay = least_of_windows(name, at, begin, end, window, edge_of(rounds))
    at, of, name = at[stay], of[stay], name[stay]
    parts = [(of, name, at + half - window, at)]
    for base, start, size, times in made.runs:
        of = doc[start]
        parts.append((of, mix(base * _ODD + _PART_OF_RUN), start + LONG_RUN * size - window, start + (times - LONG_RUN) * size))
    of, name, first, last = (np.concatenate(c) for c in zip(*parts, strict=True))
    first, last = np.maximum(first, begin[of]), np.minimum(last, end[of] - window)
    able = first <= last
    order = np.argsort(of[able], kind="stable")
    of, name, first, last = (c[able][order] for c in (of, name, first, last))
    return of, name, first - begin[of], last - begin[of]


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick() of each `size` values in a row."""
    have = 1
    while have * 2 <= size:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[: len(values) - (size - have)], values[size - have :]) if size > have else values


def least_of_windows(name: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int, edge: int) -> np.ndarray:
    """Which of the names, at places `at`, are the least of those that some window has between its edge and its half, where
    all copies of the window have the same."""
    size, half = int(end[-1]) if len(end) else 0, window // 2
    span = half - edge + 1
    if size < window:
        return np.zeros(len(name), bool)
    value = np.full(size, np.iinfo(np.uint64).max)
    value[at] = np.minimum(name, np.iinfo(np.uint64).max - np.uint64(1)) + np.uint64(1)
    least = _sliding(value, span, np.minimum)
    longs = np.flatnonzero(end - begin >= window)
    mark = np.zeros(size + 1, np.int64)
    np.add.at(mark, begin[longs] + edge, 1)
    np.add.at(mark, end[longs] - window + edge + 1, -1)
    there = np.cumsum(mark)[: len(least)] > 0  # where the span of a window of one document begins
    around = np.concatenate([np.zeros(span - 1, np.uint64), np.where(there, least, np.uint64(0)), np.zeros(span - 1, np.uint64)])
    return _sliding(around, span, np.maximum)[at] == value[at]


def _words(texts: pa.Array) -> list[list[bytes]]:
    return [(x or b"").split() for x in texts.cast(pa.binary()).to_pylist()]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[slice, pa.Array]]:
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for part in balanced(lengths, 4 << 20):
        yield part, batch.column(column).slice(part.start, part.stop - part.start)


def _lists(of: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.ListArray]:
    """One list for each of n documents; `of` is sorted."""
    offsets = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, 1):
                n = len(texts)
                (hashes, _), counts = wide_word_hashes(texts)
                of, name, first, last = names_to_exchange(hashes, counts, window)
                lists = _lists(of, n, name.view(np.int64), first.astype(np.int32), last.astype(np.int32))
                columns = [batch.column(k).slice(part.start, n) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array([_sha(w) for w in _words(texts)]), *lists], names=["doc_id", "digest", "n_words", "sha", "names", "firsts", "lasts"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name those whose name two different rows have; holds a batch, and of a name only what one row has."""
    held, known = None, None

    def table(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "first", "last"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(4)]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
        name, row = columns[0], columns[1]
        begins = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        shared = np.minimum.reduceat(row, begins) != np.maximum.reduceat(row, begins)
        shared[0] |= known is not None and name[0] == known
        known = name[-1] if shared[-1] else None
        held = None if shared[-1] else [c[begins[-1] :].copy() for c in columns]
        kept = np.repeat(shared, np.diff(np.append(begins, len(name))))
        if kept.any():
            yield table([c[kept] for c in columns[1:]])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by digest, salt and doc_id those whose doc_id is not the first of theirs; holds a batch."""
    known: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        low, high, doc, row, start, salt = (batch.column(k).to_numpy() for k in range(6))
        begins = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (salt[1:] != salt[:-1])]))
        first = doc[begins].copy()
        if known is not None and (low[0], high[0], salt[0]) == known[:3]:
            first[0] = known[3]
        known = low[-1], high[-1], salt[-1], first[-1]
        later = doc > np.repeat(first, np.diff(np.append(begins, len(low))))
        if later.any():
            yield pa.RecordBatch.from_arrays([pa.array(row[later]), pa.array(start[later])], names=["row", "start"])


def _windows(window: int):
    """Starts and digests of the windows between any first and last of the row's shared names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, 1):
                n = len(texts)
                lanes, counts = wide_word_hashes(texts)
                ends = np.cumsum(counts)
                begin, most = ends - counts, int(ends[-1])
                spans = batch.column(2).slice(part.start, n)
                flat, sizes = spans.flatten(), np.diff(spans.offsets.to_numpy())
                base = np.repeat(begin, sizes)
                mark = np.zeros(most + 2, np.int64)
                np.add.at(mark, base + flat.field("first").to_numpy(), 1)
                np.add.at(mark, base + flat.field("last").to_numpy() + 1, -1)
                at = np.flatnonzero(np.cumsum(mark)[:most] > 0)
                of = np.repeat(np.arange(n), counts)[at]
                keys = [window_hashes(x, window)[at].view(np.int64) for x in lanes]
                lists = _lists(of, n, (at - begin[of]).astype(np.int32), *keys)
                columns = [batch.column(k).slice(part.start, n) for k in (3, 0, 4)]
                yield pa.RecordBatch.from_arrays([*columns, texts, *lists], names=["row", "doc_id", "digest", "text", "starts", "low", "high"])

    return run


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, kept = [], [], []
            for words, starts in zip(_words(batch.column(2)), batch.column(3), strict=True):
                at = starts.values.to_numpy()
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
                left = [words[i] for i in np.flatnonzero(np.cumsum(mark)[:-1] == 0).tolist()]
                removed.append(len(words) - len(left))
                shas.append(_sha(left))
                kept.append(b" ".join(left).decode())
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())] if with_text else columns, names=["doc_id", "digest", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    return run


def _is_hot(rows: DataFrame, key: str) -> Column:
    """Whether the key is one of the at most MOST_HOT ones that are seen in two rows and LEAST_HOT times among one row in SAMPLE."""
    seen = rows.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).groupBy(key).agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b"))
    hot = seen.filter((F.col("n") >= LEAST_HOT) & (F.col("a") != F.col("b"))).orderBy(F.desc("n"), key).select(key).limit(MOST_HOT).collect()
    return F.expr(f"{key} in ({', '.join(f'{r[0]}L' for r in hot)})") if hot else F.lit(False)


def repeated_passages(docs: DataFrame, window: int = 50, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the text), n_words, n_removed, kept_sha256 and, with_text, kept_text of every row.

    A word is removed when a window of `window` words that covers it also starts in a row with a smaller doc_id. Rows with
    equal doc_id are judged each by its own text, and remove nothing from each other. kept_text is the kept words joined by
    spaces where words were removed, else null: the text stays as it is. Null and empty texts have no words, and a text
    shorter than a window keeps all. A row with a null doc_id keeps all its words and removes none from others. Texts of any
    length are read whole. Other columns are dropped. Windows are compared by 128-bit digests of their words, whole texts
    by SHA-256. No rows: no rows.
    """
    if len(rounds_for(window)) < 2:
        raise ValueError(f"windows of {window} words are too short for two rounds")
    rows = keyed(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    kind = "doc_id long, digest string, n_words long, sha string, names array<long>, firsts array<int>, lasts array<int>"
    parsed = materialize(rows.mapInArrow(tidy(_parse(window)), kind).withColumn("row", F.monotonically_increasing_id()), "symbols")

    able = parsed.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    first = able.groupBy("n_words", "sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("other")).filter("first != other").drop("other")
    salted = materialize(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "repeated-texts")
    copies = able.select("row", "doc_id", "n_words", "sha", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["n_words", "sha", "salt"]).filter("doc_id != first").select("row")
    copies = materialize(copies, "whole-copies")

    named = able.join(copies, "row", "left_anti").select("row", F.explode(F.arrays_zip("names", "firsts", "lasts")).alias("p")).select(F.col("p.names").alias("name"), "row", F.col("p.firsts").alias("first"), F.col("p.lasts").alias("last"))
    hot = _is_hot(named, "name")  # shared for certain, and need not meet
    met = named.filter(~hot).repartition("name").sortWithinPartitions("name").mapInArrow(tidy(_met), "row long, first int, last int")
    spans = met.unionByName(named.filter(hot).drop("name")).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = spans.join(able.select("row", "doc_id", "digest"), "row").dropDuplicates(["doc_id", "digest"])
    texts = rows.join(spans, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("doc_id", "text", "spans", "row", "digest")
    built = materialize(texts.mapInArrow(tidy(_windows(window)), "row long, doc_id long, digest string, text string, starts array<int>, low array<long>, high array<long>"), "windows")

    each = built.select(F.explode(F.arrays_zip("starts", "low", "high")).alias("w"), "row", "doc_id").select(F.col("w.low").alias("low"), F.col("w.high").alias("high"), "doc_id", "row", F.col("w.starts").alias("start"))
    hot = _is_hot(each, "low")  # dealt by salt, each with its first document, which partial sums find
    cold = each.filter(~hot).withColumn("salt", F.lit(0))
    warm = each.filter(hot)
    seeds = warm.groupBy("low", "high").agg(F.min("doc_id").alias("doc_id")).select("low", "high", "doc_id", F.lit(-1).cast("long").alias("row"), F.lit(-1).alias("start"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    warm = warm.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    met = cold.unionByName(warm).unionByName(seeds).repartition("low", "high", "salt").sortWithinPartitions("low", "high", "salt", "doc_id")
    gone = met.mapInArrow(tidy(_later), "row long, start int").groupBy("row").agg(F.collect_list("start").alias("starts"))
    kind = "doc_id long, digest string, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    cut = built.select("row", "doc_id", "digest", "text").join(gone, "row").select("doc_id", "digest", "text", "starts").mapInArrow(tidy(_cut(window, with_text)), kind)

    whole = copies.select("row", F.lit(True).alias("copy"))
    out = parsed.select("row", "doc_id", "digest", "n_words", "sha").join(whole, "row", "left").join(cut, ["doc_id", "digest"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    sha = F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha256", "sha"))
    text = [F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []
    return out.select("doc_id", "digest", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"), *text)
