"""Resampling towards a target distribution, by importance weights of hashed word runs.

A text's bytes are lower-cased and every run of separators becomes one space. One overlapped scan for each length, with
boundary checks on both sides, then gives the span of every run of so many words, and a span's CRC-32 its bucket. Texts are
scanned once: what is kept of each is its bucket counts, from which the corpus is counted, weighed and ranked.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import keyed, materialize, text_bytes, tidy
from tidemark.llm.token_counts import byte_balanced
from tidemark.operators.timeline import positions

_LETTERS = bytes(range(97, 123))
#: Each byte in lower case; all that is not a digit, a letter or part of a character beyond ASCII is a space.
_FOLD = bytes(b if b > 127 or b in _LETTERS or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes of text that are counted in one go, and ranked rows a range holds.
SLICE_BYTES, RANGE_ROWS = 8 << 20, 1_000_000
FEATURES = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"
_FEATURES = ["doc_id", "n_words", "n_features", "buckets", "counts"]


def run_patterns(most: int) -> list[regex.Pattern]:
    """For each length a pattern of so many words with single spaces between them, that start and end where words do."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(1, most + 1)]


def spaced(text: bytes) -> bytes:
    """The text's words in lower case, with one space between them."""
    return b" ".join(text.translate(_FOLD).split())


def run_hashes(text: bytes, patterns: list[regex.Pattern]) -> list[np.ndarray]:
    """The CRC-32 of every run of words, for each length in the order of the text."""
    words = spaced(text)
    crc = zlib.crc32
    return [np.fromiter((crc(m[0]) for m in p.finditer(words, overlapped=True)), np.uint32) for p in patterns]


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, and the buckets of each row's features in ascending order with their counts.

    Features are all runs of 1 to `longest` words, repeats counted. Null, empty and wordless texts have none. Texts of any
    length are scanned whole; their spans are hashed as they come, and at most `buckets` counts are left. Repeated rows have
    one result each, a null id stays null, no rows give no rows, and other columns are dropped whatever their names.
    """
    if longest < 1 or not 1 <= buckets <= 1 << 31:
        raise ValueError("runs have a word at least, and buckets are numbered by 32-bit integers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = run_patterns(longest)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for part in byte_balanced(texts, SLICE_BYTES):
                found = [run_hashes(t, patterns) for t in texts[part]]
                sizes = np.array([sum(map(len, f)) for f in found], np.int64)
                hashes = np.concatenate([h for f in found for h in f]).astype(np.int64)
                keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * buckets + hashes % buckets, return_counts=True)
                ends = pa.array(np.searchsorted(keys, np.arange(len(sizes) + 1) * buckets), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (keys % buckets, counts)]
                words = pa.array([len(f[0]) for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(sizes)), words, pa.array(sizes), *lists], names=_FEATURES)

    rows = keyed(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tidy(run), FEATURES)


def totals(features: DataFrame) -> DataFrame:
    """bucket, n: how many features of all rows lie in each bucket that has any."""
    each = features.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain, 1000 times the log of the ratio of its smoothed shares in the target and in the corpus, rounded
    down. Only the totals, a row for each of `buckets` buckets, reach the driver."""
    counts = np.zeros((2, buckets), np.int64)
    for side, rows in enumerate((corpus, target)):
        for r in rows.collect():
            counts[side, r["bucket"]] = r["n"]
    of_corpus, of_target = (float(n + buckets) for n in counts.sum(axis=1))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * of_corpus / ((float(s) + 1) * of_target))) for s, t in counts.T.tolist()], np.int64)


def draw_noise(doc_id: int | None, seed: int) -> int:
    """1000 times a Gumbel deviate, rounded down, that depends on the seed and the id alone."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(features: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of its features' gains) and score (weight and noise) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            first, last = int(ends[0]), int(ends[-1])
            of = lists.values.slice(first, last - first).to_numpy()
            n = batch.column(4).values.slice(batch.column(4).offsets[0].as_py(), last - first).to_numpy()
            so_far = np.concatenate([[0], np.cumsum(gain[of] * n)])
            weight = so_far[ends[1:] - first] - so_far[ends[:-1] - first]
            noise = np.array([draw_noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight), pa.array(weight + noise)], names=[*_FEATURES[:3], "weight", "score"])

    return features.mapInArrow(tidy(run), "doc_id long, n_words long, n_features long, weight long, score long")


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs.

    Of the N rows of at least `least_words` words those with the highest scores are drawn, floor(percent * N / 100) of them;
    rank counts them from 1 and is null for all others. Ties go to the smaller doc_id, and a null one goes before all;
    repeated rows are ranked one after another. Null and wordless texts have weight 0 and are never drawn where a word is
    asked for. Texts are read whole, whatever their length. No rows of docs give no rows; no rows of target (whose ids
    do not matter) weigh towards an even spread. Other columns are dropped, whatever their names.
    """
    spark = docs.sparkSession
    features = materialize(bucket_counts(docs, longest, buckets, id_col, text_col), "bucket-counts")
    wanted = bucket_counts(target.select(F.lit(0).alias("id"), F.col(f"`{text_col}`").alias("text")), longest, buckets, "id", "text")
    gain = gains(totals(features), totals(wanted), buckets)
    scored = materialize(weighed(features, gain, seed), "scores")
    n = scored.filter(F.col("n_words") >= least_words).count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n // RANGE_ROWS)
    lined_up = scored.withColumns({"late": F.col("n_words") < least_words, "down": -F.col("score")})
    placed = positions(lined_up, ["late", "down", "doc_id", "n_features"], name="place", parts=parts)
    drawn = percent * n // 100
    return placed.select(*scored.columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
