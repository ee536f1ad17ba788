import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import ODD_TEXTS, docs, prose
from tidemark.llm import bpe, packing, queries
from tidemark.llm.byte_encoder import ByteEncoder
from tidemark.llm.queries import vocabulary
from tidemark.llm.token_counts import WordCounter, slices, token_counts

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
PARTS = ["a", "B", "é", "É", "́", " ", " ", "\x1c", "\x85", "\x00", "<|endoftext|>", "<|startoftext|>", "1", "²", "Ⅷ", "'s", "'S", "Σ", "İ", "中", "🙂", "‍", "\t", "\n", "ſ", "!", "_", "ﬁ", "가", "\xa0", "th", "the", "ing", "aa", "!!!"]


def samples(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12))) for _ in range(n)] + [t or "" for t in ODD_TEXTS] + [prose(3, 400)]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def test_byte_ids_are_the_librarys():
    fast = ByteEncoder(BYTE)
    assert fast.fast is not None
    for text in samples(1500):
        assert fast.encode(text).tolist() == fast.slow(text).tolist()


def test_word_counts_are_the_librarys():
    t, counter, texts = library(WORD), WordCounter(WORD), samples(1500)
    assert counter.count([x.encode() for x in texts]) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_vocabularies_that_cut_elsewhere_are_not_counted_by_words():
    with pytest.raises(ValueError, match="white space"):
        WordCounter(BYTE)


def test_slices_end_at_white_space():
    text = b"ab cd\tefg " * 50
    assert b"".join(slices(text, 7)) == text
    assert [w for s in slices(text, 7) for w in s.split()] == text.split()
    assert list(slices(b"x" * 100, 7)) == [b"x" * 100]


def test_speculated_tokens_are_the_librarys():
    t, engine, texts = library(WORD), bpe.SpeculativeBPE(WORD), samples(1500)
    ids, decoded = (x.to_pylist() for x in engine.write(pa.array(texts)))
    assert 0 < engine.n_failed < engine.n_words
    for text, i, d in zip(texts, ids, decoded, strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert i.decode() == " ".join(map(str, want))
        assert d.decode() == t.decode(want, skip_special_tokens=False)


def test_pair_check_agrees_with_exact_merging():
    engine = bpe.SpeculativeBPE(WORD)
    inner = [(s, i) for s, i in engine.inner.items()][::97]
    last = [(s, i) for s, i in engine.last.items() if s][::89]
    rnd = random.Random(5)
    pairs = [(rnd.choice(inner), rnd.choice(last)) for _ in range(3000)]
    apart = engine.stay_apart(np.array([a[1] * engine.size + b[1] for a, b in pairs]))
    for (a, b), ok in zip(pairs, apart.tolist(), strict=True):
        assert (engine.merge_exactly(a[0] + b[0]) == [a[1], b[1]]) == ok


def test_long_words_merge_as_short_ones():
    engine = bpe.SpeculativeBPE(WORD)
    for piece in ("ab" * 60, "a" * 100, prose(9, 30).replace(" ", "")):
        row = [engine.vocab[c] for c in piece[:-1]] + [engine.vocab[piece[-1] + engine.suffix]]
        want = library(WORD).encode(piece, add_special_tokens=False).ids
        assert engine.merge_long(row) == want == engine.merge_exactly(piece)


def test_counts_of_odd_rows(spark):
    d = docs(spark, ODD_TEXTS).withColumn("n_tokens", F.lit(-1)).withColumn("n_bytes", F.lit("x"))
    got = {r["doc_id"]: r for r in token_counts(d, WORD, limit=100).collect()}
    t = library(WORD)
    for i, text in enumerate(ODD_TEXTS):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 100)
    assert token_counts(d.limit(0), WORD).count() == 0
    assert token_counts(d.union(d), WORD).count() == 2 * len(ODD_TEXTS)


def test_encode_and_decode_of_odd_rows(spark):
    d = docs(spark, ODD_TEXTS).withColumn("ids", F.lit("clash"))
    t = library(WORD)
    for r in bpe.bpe_encode(d, WORD).collect():
        want = t.encode(ODD_TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want and r["n_tokens"] == len(want) and r["decoded"] == t.decode(want, skip_special_tokens=False)
    for r in bpe.bpe_encode(d, WORD, digests=True).collect():
        want = t.encode(ODD_TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    back = bpe.bpe_decode(bpe.bpe_encode(d, WORD).select("doc_id", "ids").withColumn("ids", F.when(F.col("doc_id") > 0, F.col("ids"))), WORD)
    assert back.filter("doc_id = 0").first()["decoded"] is None
    assert bpe.bpe_encode(d.limit(0), WORD).count() == 0
    with pytest.raises(ValueError, match="white space"):
        bpe.SpeculativeBPE(BYTE)


def test_rows_that_come_twice_are_encoded_twice(spark):
    once = docs(spark, ODD_TEXTS).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    rows = [(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe.bpe_encode(once.union(once), WORD).collect()]
    assert len(rows) == 2 * len(ODD_TEXTS) and all(rows.count(r) >= 2 for r in rows)


def test_best_fill_is_the_best():
    rnd = random.Random(2)
    for _ in range(60):
        counts = {rnd.randint(1, 40): rnd.randint(1, 3) for _ in range(5)}
        capacity = rnd.randint(5, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= capacity}
        uses = packing.best_fill(counts, capacity)
        assert sum(k * v for k, v in uses.items()) == max(sums) and all(v <= counts[k] for k, v in uses.items())


def test_layout_uses_every_rest_once():
    counts = {k: (k * 7919) % 13 for k in range(1, 64)}
    rows, n = packing.layout(counts, 64)
    seen, filled = defaultdict(set), defaultdict(set)
    for length, first, ranks, uses, sequence, offset in rows:
        for k in range(ranks):
            assert first + k not in seen[length]
            seen[length].add(first + k)
            s, at = sequence + k // uses, offset + k % uses * length
            assert not filled[s] & set(range(at, at + length))
            filled[s] |= set(range(at, at + length))
    assert all(len(seen[k]) == v for k, v in counts.items())
    assert set(filled) == set(range(n)) and all(v == set(range(len(v))) and len(v) <= 64 for v in filled.values())


@pytest.mark.parametrize(("with_ids", "capacity"), [(True, 128), (False, 128), (True, 1024)])
def test_pack_holds_every_id_once(spark, with_ids, capacity):
    texts = ODD_TEXTS + [prose(i, 40 * i) for i in range(12)]
    d = docs(spark, texts).withColumn("length", F.lit("clash")).withColumn("row", F.lit(1))
    t, by, sequences = library(BYTE), defaultdict(list), defaultdict(list)
    for r in packing.pack(d.repartition(5), BYTE, capacity=capacity, with_ids=with_ids).collect():
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            piece = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert list(r["ids"]) == piece if with_ids else r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))


def test_op1_takes_its_digests_from_returned_ids(spark, monkeypatch, tmp_path):
    texts = ["one two three", None, "x " * 5000, *ODD_TEXTS]
    docs(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    made = []

    def pack(*args, **options):
        made.append(packing.pack(*args, **options))
        return made[-1]

    monkeypatch.setattr(queries, "pack", pack)
    got = queries.op1_packing(spark, f"file://{tmp_path}").collect()
    assert "ids" in made[0].columns
    want = Counter((r["doc_id"], r["start"], r["length"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in packing.pack(docs(spark, texts), BYTE).collect())
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    plain = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(docs(spark, texts), BYTE, with_ids=False).collect())
    assert plain == want


def test_pack_of_repeated_rows_and_none(spark):
    d = docs(spark, ["same words", "same words"]).withColumn("doc_id", F.lit(1).cast("long"))
    got = packing.pack(d, BYTE, capacity=16).collect()
    assert len(got) == 2 and len({(r["sequence_id"], r["offset"]) for r in got}) == 2
    assert packing.pack(d.limit(0), BYTE).count() == 0
