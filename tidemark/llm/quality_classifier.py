"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words that together are its whole text, however long it is. Every passage is
encoded by what it is made of (kinds of characters, lengths, repeated words and phrases), by its words and pairs of words in
hashed buckets, and a learned layer; a gated attention weighs the passages, and the label of a document is all that the
weights are learned from. The score is that of the weighted passage representation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.near_dedup import mix, word_hashes
from tidemark.llm.shared import keyed, one_text, tidy
from tidemark.llm.substring_dedup import window_hashes
from tidemark.llm.token_counts import balanced

PASSAGE = 64
#: At most so many labelled documents are learned from, and of them as many, in order, as have so many passages together.
SAMPLE_ROWS, SAMPLE_PASSAGES = 4000, 64_000
HIDDEN, GATE, EPOCHS, RATE = 24, 12, 160, 0.02
#: Buckets of words, and as many again of pairs of words.
BUCKETS = 256
#: Kinds of bytes that are counted; every other byte is of the last kind.
KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b"#", b"*", b"$%", b"&", b"|", b"<>", b"\"'`", b"()[]{}", b"=:;", b"/\\_-+@~^", bytes(range(128, 256)))
FEATURES = len(KINDS) + 1 + 6


def _kind_table() -> np.ndarray:
    table = np.full(256, len(KINDS), np.uint8)
    for k, chars in enumerate(KINDS):
        table[np.frombuffer(chars, np.uint8)] = k
    return table


_KIND = _kind_table()


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each passage is made of (rows of FEATURES), how often it has a word and a pair of words of each bucket, and the
    number of passages of each text, one at least."""
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    lengths = np.array([len(x) for x in raw], np.int64)
    n_docs = len(raw)
    data = np.frombuffer(b"".join(raw), np.uint8)
    kind = _KIND[data]
    hashes, counts = word_hashes(texts, lower=False)
    n_passages = np.maximum(1, -(-counts // PASSAGE))
    first_passage = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())

    doc_of_word = np.repeat(np.arange(n_docs), counts)
    nth = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    passage_of_word = first_passage[doc_of_word] + nth // PASSAGE
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    doc_start = np.cumsum(lengths) - lengths
    some = doc_start[lengths > 0]
    begins[some] = ~space[some]
    word_start = np.flatnonzero(begins)
    step = np.zeros(len(data) + 1, np.int64)
    opening = np.ones(len(hashes), bool)
    opening[1:] = passage_of_word[1:] != passage_of_word[:-1]
    opening &= nth > 0  # the first passage of a text begins with the text
    step[word_start[opening]] = 1
    base = np.repeat(first_passage, lengths)
    inner = np.cumsum(step[:-1])
    before = np.concatenate([[0], inner])[doc_start] if len(data) else np.zeros(n_docs, np.int64)
    passage_of_byte = base + inner - np.repeat(before, lengths)
    width = len(KINDS) + 1
    made = np.bincount(passage_of_byte * width + kind, minlength=total * width).reshape(total, width).astype(np.float64)
    size_bytes = np.maximum(made.sum(axis=1), 1)

    words = np.bincount(passage_of_word, minlength=total).astype(np.float64)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])
    distinct = _distinct(passage_of_word, hashes, total)
    phrase = window_hashes(hashes, 5)
    of = doc_of_word[: len(phrase)]
    inside = of == doc_of_word[4:] if len(phrase) else np.zeros(0, bool)
    repeated = np.zeros(len(hashes))
    if inside.any():
        at = np.flatnonzero(inside)
        key = phrase[at] ^ (of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        repeated[at] = times[back] > 1
    per_word = np.maximum(words, 1)
    more = [np.log1p(words) / 5, np.log1p(size_bytes) / 8, (size_bytes / per_word) / 10, np.bincount(passage_of_word, again, total) / per_word, distinct / per_word, np.bincount(passage_of_word, repeated, total) / per_word]
    return np.column_stack([np.sqrt(made / size_bytes[:, None]), *more]), _buckets(hashes, passage_of_word, total), n_passages


def _buckets(hashes: np.ndarray, passage_of_word: np.ndarray, total: int) -> np.ndarray:
    """Bytes: no passage has more than PASSAGE words."""
    word = passage_of_word * (2 * BUCKETS) + (hashes % np.uint64(BUCKETS)).astype(np.int64)
    inside = passage_of_word[1:] == passage_of_word[:-1]
    both = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) % np.uint64(BUCKETS)
    pair = passage_of_word[:-1] * (2 * BUCKETS) + BUCKETS + both.astype(np.int64)
    return np.bincount(np.concatenate([word, pair[inside]]), minlength=total * 2 * BUCKETS).astype(np.uint8).reshape(total, -1)


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    if not len(value):
        return np.zeros(n)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=n).astype(np.float64)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


@dataclass
class Model:
    """Centre and scale of the features, and the learned arrays by name."""

    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, words: np.ndarray, sizes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The score of each bag of `sizes` passages."""
        w = self.weights
        x = np.clip((x - self.centre) / self.scale, -8, 8)
        b = words * np.float32(1 / math.sqrt(PASSAGE))
        h = np.tanh(x @ w["encode"] + b @ w["words"].astype(np.float32) + w["encode_0"])
        t, g = np.tanh(h @ w["look"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * g) @ w["attend"]
        starts = np.cumsum(sizes) - sizes
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(_sums(e, starts), sizes)
        z = _sums(a[:, None] * h, starts)
        score = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score_0"], -30, 30)))
        if keep is not None:
            keep |= {"x": x, "b": b, "h": h, "t": t, "g": g, "a": a, "z": z, "starts": starts}
        return score

    def gradients(self, x: np.ndarray, words: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        k: dict = {}
        p = self.forward(x, words, sizes, k)
        w, n = self.weights, len(y)
        d = (p - y) / n
        dz = np.repeat(np.outer(d, w["score"]), sizes, axis=0)
        da = np.einsum("ij,ij->i", dz, k["h"])
        de = k["a"] * (da - np.repeat(_sums(k["a"] * da, k["starts"]), sizes))
        dt, dg = np.outer(de, w["attend"]) * k["g"] * (1 - k["t"] ** 2), np.outer(de, w["attend"]) * k["t"] * k["g"] * (1 - k["g"])
        dh = (k["a"][:, None] * dz + dt @ w["look"].T + dg @ w["gate"].T) * (1 - k["h"] ** 2)
        loss = -np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))
        return loss, {"score": k["z"].T @ d, "score_0": d.sum(), "attend": (k["t"] * k["g"]).T @ de, "look": k["h"].T @ dt, "gate": k["h"].T @ dg, "encode": k["x"].T @ dh, "words": (k["b"].T @ dh.astype(np.float32)).astype(np.float64), "encode_0": dh.sum(axis=0)}


def _shapes(features: int, buckets: int) -> dict[str, tuple[int, ...]]:
    return {"encode": (features, HIDDEN), "words": (buckets, HIDDEN), "encode_0": (HIDDEN,), "look": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "attend": (GATE,), "score": (HIDDEN,), "score_0": ()}


def train(x: np.ndarray, words: np.ndarray, sizes: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Adam on the whole sample, with a little weight decay. One class only: a constant score."""
    rng = np.random.default_rng(seed)
    shape = _shapes(x.shape[1], words.shape[1])
    spread = {"words": 0.05} | {k: 0.3 for k, s in shape.items() if s and not k.endswith("_0") and k != "words"}
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, {k: rng.normal(0, spread.get(k, 0), s) for k, s in shape.items()})
    m, v = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    for i in range(1, epochs + 1):
        _, g = model.gradients(x, words, sizes, y)
        for k, w in model.weights.items():
            grad = g[k] + 1e-4 * w * (not k.endswith("_0"))
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            model.weights[k] = w - RATE * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    return model


def untrained() -> Model:
    """What is used where there are no labels: every score is one half."""
    return Model(np.zeros(FEATURES), np.ones(FEATURES), {k: np.zeros(s) for k, s in _shapes(FEATURES, 2 * BUCKETS).items()})


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_passages: int = SAMPLE_PASSAGES) -> Model:
    """Trains on labelled documents in the order of a hash of their id, never on those whose crc32(id as text) mod 5 is 0:
    on at most sample_rows, and of them on as many as have sample_passages passages together (one that alone has over a
    tenth of these teaches nothing). Labels that are null are left out; of repeated labels the least counts, of rows that
    repeat a doc_id the text with the least hash."""
    marked = keyed(labels, {"doc_id": "doc_id", "quality": "quality"}).filter("quality is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 != 0")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = keyed(docs, {"doc_id": id_col, "text": text_col}).join(F.broadcast(marked), "doc_id")
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = one_text(rows).withColumn("n", F.greatest(F.lit(1), F.ceil(n_words / PASSAGE))).filter(F.col("n") <= sample_passages // 10)
    so_far = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id"))  # over sample_rows rows
    rows = rows.withColumn("so_far", so_far).filter(F.col("so_far") <= sample_passages).select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, words, sizes = passages(batch.column(1))
                at = np.cumsum(sizes)[:-1]
                columns = [pa.array([a.tobytes() for a in np.split(c, at)], pa.binary()) for c in (x, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "quality", "made", "words"])

    found = sorted(rows.mapInArrow(tidy(run), "doc_id long, quality int, made binary, words binary").collect(), key=lambda r: r["doc_id"])
    if not found:
        return untrained()
    bags = [np.frombuffer(r["made"]).reshape(-1, FEATURES) for r in found]
    words = np.concatenate([np.frombuffer(r["words"], np.uint8).reshape(-1, 2 * BUCKETS) for r in found])
    return train(np.concatenate(bags), words, np.array([len(b) for b in bags]), np.array([float(r["quality"] >= 1) for r in found]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (crc32(id as text) mod 5 is 0), score, predicted (1 if score >= threshold) of every row.

    Only the text counts for a score, and all of it. Null and empty texts are one empty passage. Repeated rows: one result
    each. A null id has a null held_out. Other columns are dropped. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for part in balanced(lengths, 2 << 20):
                n = part.stop - part.start
                scores = model.forward(*passages(batch.column(1).slice(part.start, n)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = keyed(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long"), "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return rows.mapInArrow(tidy(run), "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
