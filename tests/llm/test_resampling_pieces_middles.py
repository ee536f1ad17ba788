"""Importance resampling, SentencePiece offsets and fill-in-the-middle against brute force and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.helpers import ODD_TEXTS, docs, prose
from tidemark.llm import fill_in_middle as fim
from tidemark.llm import importance
from tidemark.llm.queries import vocabulary
from tidemark.llm.sentence_pieces import Normaliser, OffsetEncoder, decoded_pieces, sentence_pieces

ODD_COLUMNS = ["ids", "place", "rank", "score", "chunk", "part", "begins", "decoded", "copies", "n", "bucket"]
TEXTS = [*ODD_TEXTS, "a▁ b", "▁▁ x", "  lead", "trail  ", " ", "▁", "\x00z\x00", "a  b   c", "<s> </s> <0x0A>\n\n", "one\ntwo\n\nthree", "\n", "has <P> in it\nand more", prose(5, 3000).replace(" ", "\n", 900)]


def clashing(spark, texts):
    return docs(spark, texts).drop("lang", "source", "n_chars").withColumns({c: F.lit("x") for c in ODD_COLUMNS})


def fold(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute_resample(texts, target, longest, buckets, percent, least, seed=2024):
    runs = lambda t: [" ".join(w[i : i + k]) for w in [fold(t)] for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    place = lambda r: zlib.crc32(r.encode()) % buckets
    s, t = Counter(place(r) for x in texts for r in runs(x)), Counter(place(r) for x in target for r in runs(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, x in enumerate(texts):
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(r)) for r in runs(x))
        rows.append([i, len(fold(x)), len(runs(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("longest, buckets, percent, least", [(1, 10_000, 10, 20), (2, 97, 50, 2), (3, 1, 100, 0)])
def test_resampling_is_what_brute_force_draws(spark, longest, buckets, percent, least):
    texts = [*ODD_TEXTS, *(prose(i, 15 + i) for i in range(60))]
    target = [prose(i, 40) for i in range(0, 60, 7)] + [None, ""]
    got = importance.importance_resample(clashing(spark, texts).repartition(7), docs(spark, target), percent, least, longest, buckets)
    assert sorted(map(tuple, got.collect())) == brute_resample(texts, target, longest, buckets, percent, least)


def test_resampling_of_nothing_and_of_repeated_rows(spark):
    some, none = docs(spark, [prose(1, 30)]), docs(spark, [])
    assert importance.importance_resample(none, some).collect() == []
    assert [r["rank"] for r in importance.importance_resample(some, none, percent=100).collect()] == [1]
    same = some.union(some).union(some.withColumn("doc_id", F.lit(None).cast("long")))
    got = importance.importance_resample(same, some, percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3] and len({r["weight"] for r in got}) == 1


def test_spans_of_runs_stand_at_word_borders():
    patterns = importance.run_patterns(3)
    for text in (b"", b"a", b"A b", b"a bb a-c d  aa", "é ü ü-x9 \x00z 中文 é".encode()):
        words = fold(text.decode())
        want = [[zlib.crc32(" ".join(words[i : i + k]).encode()) for i in range(len(words) - k + 1)] for k in (1, 2, 3)]
        assert [h.tolist() for h in importance.run_hashes(text, patterns)] == want


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def test_pieces_are_the_librarys_and_know_their_bytes(spark, library):
    rows = sentence_pieces(clashing(spark, TEXTS).repartition(3), vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in rows.collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        text = text or ""
        want = library.encode(text, return_type="proto").pieces if text else []
        assert got[i]["ids"] == [p.id for p in want]
        assert (got[i]["begins"], got[i]["ends"]) == ([p.begin for p in want], [p.end for p in want])
        assert got[i]["decoded"] == (library.decode(got[i]["ids"]) if text else "")
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(got[i]["begins"], got[i]["ends"])) == data


def test_pieces_of_nothing_and_of_repeated_rows(spark, library):
    path = vocabulary("piece_bpe_32k.model")
    assert sentence_pieces(docs(spark, []), path).collect() == []
    one = docs(spark, ["ab cd"])
    rows = sentence_pieces(one.union(one).withColumn("doc_id", F.lit(None).cast("long")), path).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["doc_id"] is None
    lists = spark.createDataFrame([(library.encode("Zwölf  Boxkämpfer 🙂"), "x"), ([], "y"), (None, "z")], "ids array<int>, other string")
    assert [r["decoded"] for r in decoded_pieces(lists, path).orderBy("other").collect()] == ["Zwölf  Boxkämpfer 🙂", "", None]
    with pytest.raises(ValueError):
        decoded_pieces(lists.withColumn("decoded", F.lit(1)), path)


def test_what_is_remembered_may_be_forgotten(monkeypatch, library):
    from tidemark.llm import sentence_pieces as module

    monkeypatch.setattr(module, "MEMO_RUNS", 10)
    engine = OffsetEncoder(vocabulary("piece_bpe_32k.model"))
    for seed in range(6):
        text = prose(seed, 50)
        assert engine.encode([text, text])[1].tolist() == library.encode(text) * 2


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_maps_are_applied_as_the_library_does(rule, prefix, squeeze):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    ours = Normaliser(theirs.serialized_normalizer_spec())
    rnd = random.Random(f"{rule}{prefix}{squeeze}")
    parts = ["a", "B", "é", "é", " ", "  ", "　", "\xa0", "Ａ", "㌀", "ﬁ", "​", "½", "中", "\t", "\n", "¨", "ß", "İ", "🙂", "각", "가", "\x08", "ﷺ"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        want, offsets = theirs.normalize(text, with_offsets=True)
        made, origin = ours.apply(text.encode())
        assert made.decode().replace(" ", "▁") == want
        bytes_at = lambda t: np.cumsum([0, *(len(c.encode()) for c in t)]).tolist()
        at = bytes_at(text)
        assert [at.index(origin[i]) for i in bytes_at(made.decode())] == list(offsets)


def brute_middle(doc_id, text, seed=7, percent=100, spm_percent=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, len(units))))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm_percent:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 3, 50, 1 << 14])
@pytest.mark.parametrize("percent", [100, 60])
def test_middles_are_those_of_brute_force(spark, monkeypatch, chunk, percent):
    sizes = [TEXTS, [t for t in TEXTS if len(t or "") < 500]][chunk < 50]
    texts = [*sizes, "<", "a<\nP>\n<\nS", ">\n<M\n>", "P>\n<", "é\n🙂\nß"]
    module = fim._cut.__globals__
    monkeypatch.setitem(module, "CHUNK_BYTES", chunk)  # workers get it with the functions
    made = list(fim._cut(7, percent, 50)(iter([_batch(texts)])))
    made = [r for b in made for r in b.to_pylist()]
    outputs: dict[int, bytes] = {}
    for r in sorted(made, key=lambda r: (r["doc_id"], r["place"])):
        outputs[r["doc_id"]] = outputs.get(r["doc_id"], b"") + r["chunk"]
        assert len(r["chunk"]) <= chunk + 3
    want = {i: brute_middle(i, t, percent=percent) for i, t in enumerate(texts)}
    assert {i: o.decode() for i, o in outputs.items()} == {i: w[4] for i, w in want.items()}
    back = [r for b in fim._read_back(iter([_rows(sorted(made, key=lambda r: (r["doc_id"], r["place"])), fim.PIECES)])) for r in b.to_pylist()]
    digests = [r for b in fim._digests(iter([_rows(sorted(back, key=lambda r: (r["doc_id"], r["part"], r["place"])), fim.RESTORED)])) for r in b.to_pylist()]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) for r in digests} == {i: (*w[:4], sha(w[4]), sha(texts[i])) for i, w in want.items()}


def _batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _rows(rows, schema):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist(rows, schema=schema)


def test_middles_on_spark_with_repeats_nulls_and_clashing_columns(spark):
    base = clashing(spark, TEXTS)
    hot = clashing(spark, ["same\nrow\nagain\n"]).withColumn("doc_id", F.lit(500).cast("long")).crossJoin(spark.range(300).drop("id").selectExpr("1 as one")).drop("one")
    no_id = clashing(spark, ["no\nid\n", "no\nid\n", "other\n"]).withColumn("doc_id", F.lit(None).cast("long"))
    rows = base.union(hot).union(no_id).union(base).repartition(5)
    pieces = fim.fill_in_middle(rows)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter()
    for i, t, n in [*((i, t, 2) for i, t in enumerate(TEXTS)), (500, "same\nrow\nagain\n", 300), (None, "no\nid\n", 2), (None, "other\n", 1)]:
        made = brute_middle("" if i is None else i, t)
        want[(i, *made[:4], sha(made[4]), sha(t))] += n
    assert Counter(map(tuple, fim.piece_digests(fim.restored(pieces)).collect())) == want
    outputs = {(r["doc_id"], r["output"]) for r in fim.texts(pieces).collect()}
    assert outputs == {(i, brute_middle("" if i is None else i, t)[4]) for i, t in [*enumerate(TEXTS), (500, "same\nrow\nagain\n"), (None, "no\nid\n"), (None, "other\n")]}
    assert fim.piece_digests(fim.restored(fim.fill_in_middle(docs(spark, [])))).collect() == []
