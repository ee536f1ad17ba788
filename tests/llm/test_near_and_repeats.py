import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD_TEXTS, classes, docs, prose, words
from tidemark.llm import components, near_dedup, substring_dedup
from tidemark.llm.components import connected_components
from tidemark.llm.embedding_dedup import close_pairs, embedding_near_duplicates, principal_axes, second_moments
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.substring_dedup import _later, _met, edge_of, names_to_exchange, recompress, repeated_passages, rounds_for, window_hashes


def near_copies(base, n, changes, seed=1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(changes):
            w[rnd.randrange(len(w))] = prose(rnd.random(), 1)
        out.append(" ".join(w))
    return out


def shingles(text, k):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(texts, k):
    sets = [shingles(t, k) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, classes(range(len(sets)), links)


def check_near(spark, texts, k):
    sets, want = brute(texts, k)
    d = docs(spark, texts).withColumn("id", F.lit("clash")).withColumn("family", F.lit(3)).withColumn("n_shingles", F.lit(-1))
    got = {r["doc_id"]: r for r in near_duplicates(d, k).collect()}
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_second_moments_are_those_of_all_vectors(spark):
    x = np.random.default_rng(2).normal(size=(21_000, 4))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = second_moments(spark.createDataFrame([(v,) for v in x.tolist()], "vector array<double>").repartition(5), 4)
    assert np.allclose(got, unit.T @ unit) and abs(np.trace(got) - 21_000) < 1e-6


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "FAMILY_BLOCK", 20)
    base = prose(1, 150)
    texts = near_copies(base, 60, 3) + near_copies(base, 60, 10, 2) + near_copies(prose(2, 40), 8, 1) + [base] * 30 + [prose(i, 60) for i in range(10, 30)] + [base.upper(), base.replace(" ", "\n\t")]
    random.Random(3).shuffle(texts)
    check_near(spark, texts, 2)


def test_outsiders_of_a_large_family_meet_all_of_it(spark, monkeypatch):
    """A chain: each text is like the next one only, and blocks are small."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(near_dedup, "FAMILY_BLOCK", 4)
    w = prose(1, 400).split()
    chain = [" ".join(w[6 * i : 6 * i + 100]) for i in range(40)]
    texts = chain + [" ".join(w[200:300])] * 2 + [prose(i, 60) for i in range(10, 20)]
    random.Random(3).shuffle(texts)
    check_near(spark, texts, 2)
    with pytest.raises(ValueError):
        near_duplicates(docs(spark, ["a"]), share=(70, 100))


def test_near_duplicates_of_odd_rows(spark):
    check_near(spark, ODD_TEXTS + ["one", "ONE", "two words", "two words"], 5)
    none = docs(spark, ["a b"]).limit(0)
    assert near_duplicates(none).count() == 0
    lost = docs(spark, ["a b c", "a b c"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r["component_id"], r["kept"]) for r in near_duplicates(lost).collect()] == [(None, True)] * 2
    twice = docs(spark, ["a b c d e f", "a b c d e f", "q r s"]).withColumn("doc_id", F.lit(7).cast("long"))
    assert {r["component_id"] for r in near_duplicates(twice).collect()} == {7}
    a, b, c = (prose(i, 60) for i in (1, 2, 3))
    several = spark.createDataFrame([(1, a), (5, a), (5, b), (4, b), (9, b + " x"), (8, c), (6, c), (6, "q r s t u"), (3, "q r s t u")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicates(several).collect()} == {(1, 1), (5, 1), (4, 1), (9, 1), (8, 3), (6, 3), (3, 3)}


def test_sets_of_a_slice_are_those_of_its_texts():
    texts = pa.array([prose(i, 30).title() + (" é" if i % 3 else "") for i in range(40)] + [None, ""])
    for start, n in ((0, 42), (1, 9), (20, 22)):
        got = list(near_dedup.shingle_sets(texts.slice(start, n), 2))
        for a, t in zip(got, texts.slice(start, n).to_pylist(), strict=True):
            assert len(a) == len(shingles(t, 2)) and a.tolist() == next(near_dedup.shingle_sets(pa.array([t], pa.string()), 2)).tolist()


def test_odd_sketches_tell_high_similarity():
    rnd = np.random.default_rng(1)
    for j in (0.8, 0.9):
        far = []
        for _ in range(60):
            both, n = rnd.integers(0, 1 << 63, int(600 * j), dtype=np.uint64), int(600 * (1 - j) / 2)
            a, b = (np.concatenate([both, rnd.integers(0, 1 << 63, n, dtype=np.uint64)]) for _ in range(2))
            s = near_dedup.odd_sketches(np.array([near_dedup.samples_of(near_dedup.mix(x)) for x in (a, b)]))
            far.append(int(np.bitwise_count(s[0] ^ s[1]).sum()))
        assert max(far) <= near_dedup.most_differing(near_dedup.LEAST_ESTIMATE)
        assert abs(np.mean(far) - near_dedup.most_differing(j)) < 8


@pytest.mark.parametrize("large", [250_000, 10])
def test_components_of_chains_and_stars(spark, monkeypatch, large):
    monkeypatch.setattr(components, "LARGE", large)
    monkeypatch.setattr(components, "MOST_HUBS", 25)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (300, 200), (200, 300)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    ids = {x for p in links for x in p}
    assert got == {k: v for k, v in classes(ids, links).items() if k in got} and set(got) == ids
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_vectors(rows, least):
    ok = [(i, v, lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(ok)):
        for b in range(a):
            if ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]):
                x, y = np.array(ok[a][1], float), np.array(ok[b][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links.append((ok[a][0], ok[b][0]))
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, classes([i for i, _, _ in rows], links)


def test_embedding_links_match_brute_force(spark, monkeypatch):
    from tidemark.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(6, 16))
    rows = []
    for i in range(300):
        v = centres[i % 6] + rnd.normal(size=16) * rnd.choice([0.02, 0.12, 0.2, 1.0])
        rows.append([i, [float(np.float32(x)) for x in v], i % 2])
    for i in range(0, 60, 3):
        rows[i][1] = rows[0][1]
        rows[i][2] = 0
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [], [-0.0, 1.0], [0.0, 2.0], [1.0, 0.0]]
    rows += [[1000 + i, v, 0] for i, v in enumerate(odd)] + [[2000, rows[1][1], None]]
    n, want = brute_vectors([tuple(r) for r in rows], 0.98)
    d = spark.createDataFrame([tuple(r) for r in rows], "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash")).withColumn("cell", F.lit(1))
    got = {r["vec_id"]: r for r in embedding_near_duplicates(d).collect()}
    assert len(got) == len(rows) and sum(n.values()) > 300
    for i in n:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], want[i], want[i] == i)
    assert embedding_near_duplicates(d.limit(0)).count() == 0


def test_embedding_rows_with_equal_ids_and_huge_components(spark):
    rows = [(7, [1.0, 0.0], 0), (7, [1.0, 0.0], 0), (7, [1.0, 0.1], 0), (8, [1e200, 0.0], 0), (9, [1e-200, 1e-203], 0), (3, [0.0, 1.0], 0), (3, [0.0, 1.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_near_duplicates(d).collect())
    assert got == sorted([(7, 4, 7, True)] * 3 + [(8, 4, 7, False), (9, 4, 7, False)] + [(3, 0, 3, True)] * 2)


def test_cells_lose_no_close_vector():
    from tidemark.llm.embedding_dedup import cells_of, choose_cuts

    x = np.random.default_rng(3).normal(size=(400, 5)) * [0.6, 0.5, 0.3, 0.2, 0.1]
    quantiles = [np.quantile(x[:, k], [i / 16 for i in range(1, 16)]).tolist() for k in range(5)]
    cuts = choose_cuts(quantiles, 60, 0.2)
    assert 60 <= np.prod([len(c) + 1 for c in cuts]) <= 240 and len(cuts[0]) > 2
    home, row, visits = cells_of(x, cuts, 0.2)
    met = set(zip(row.tolist(), visits.tolist(), strict=True))
    near = [(i, j) for i in range(400) for j in range(400) if home[i] < home[j] and np.linalg.norm(x[i] - x[j]) <= 0.2]
    assert near and all((i, home[j]) in met for i, j in near) and len(met) < 0.3 * 400 * len(set(home.tolist()))


def test_leading_dimensions_drop_pairs_early():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(200, 64)) * np.linspace(3, 0.1, 64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    turned, counts = x @ principal_axes(x), []
    i, j = close_pairs(turned, turned, 0.98, True, counts)
    whole = x @ x.T
    assert {(a, b) for a, b in zip(*np.nonzero(np.triu(whole >= 0.98, 1)), strict=True)} <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert sum(counts) < 0.2 * 200 * 199 / 2


def brute_repeats(texts, size=50, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows, first = [words(t) for t in texts], {}
    for i, w in zip(ids, rows, strict=True):
        for a in range(len(w) - size + 1):
            k = tuple(w[a : a + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in zip(ids, rows, strict=True):
        gone = {a + k for a in range(len(w) - size + 1) if first[tuple(w[a : a + size])] < i for k in range(size)}
        out.append([x for k, x in enumerate(w) if k not in gone])
    return rows, out


def check_repeats(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows, kept = brute_repeats(texts, ids=ids)
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("n_words", F.lit(-1)).withColumn("row", F.lit("clash")).withColumn("digest", F.lit(0))
    got = sorted((r["doc_id"], r["digest"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"] or "") for r in repeated_passages(d).collect())
    want = []
    for i, t, w, k in zip(ids, texts, rows, kept, strict=True):
        left = " ".join(k)
        want.append((i, hashlib.sha256((t or "").encode()).hexdigest(), len(w), len(w) - len(k), hashlib.sha256(left.encode()).hexdigest(), left if len(k) < len(w) else ""))
    assert got == sorted(want)
    return sum(r[3] for r in got)


def test_repeats_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SAMPLE", 2)
    monkeypatch.setattr(substring_dedup, "LEAST_HOT", 6)
    rnd, shared = random.Random(7), [prose(100 + i, n) for i, n in enumerate((49, 50, 51, 57, 80, 200))]
    texts = []
    for i in range(60):
        parts = [prose(1000 + 10 * i + k, rnd.randint(0, 80)) for k in range(3)]
        texts.append(" ".join([parts[0], rnd.choice(shared), parts[1], rnd.choice(shared), parts[2]]))
    texts += ["z " * 49, "z " * 60, "z " * 500, "q " + "z " * 70, "ab " * 200, "a b " * 60, "b a " * 61, "a b c " * 40] + [texts[3]] * 3 + near_copies(prose(8, 300), 10, 2) + ODD_TEXTS
    assert check_repeats(spark, texts) > 1000


def test_swapped_words_of_a_balanced_sequence_are_no_copy(spark):
    """Sums of powers cannot tell these two sequences apart."""
    turns, head = [bin(i).count("1") % 2 for i in range(1024)], prose(5, 20)
    one, two = (head + " " + " ".join("xy"[b ^ t] for b in turns) for t in (0, 1))
    assert check_repeats(spark, [one, two]) == 1024


def test_repeats_of_rows_with_equal_ids(spark):
    a, b, c = (prose(i, 70) for i in (1, 2, 3))
    assert check_repeats(spark, [a + " " + b, c, a + " " + c, c + " " + b, a + " " + b, b, b], [5, 5, 9, 9, 9, 9, 9]) == 8 * 70
    assert check_repeats(spark, [a, a, b + " q " + a], [4, 4, 4]) == 0


def test_a_very_long_text_is_read_whole(spark):
    long = prose(11, 120_000)
    tail = " ".join(long.split()[-60:])
    assert check_repeats(spark, [long, "new " + tail, "x" * 300_000 + " " + tail]) == 120


def test_repeats_of_no_and_null_rows(spark):
    assert repeated_passages(docs(spark, ["a"]).limit(0)).count() == 0
    lost = docs(spark, [prose(1, 60)] * 2).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["n_removed"] for r in repeated_passages(lost).collect()] == [0, 0]


def test_equal_windows_have_a_name_in_common():
    rnd = np.random.default_rng(6)
    assert edge_of(rounds_for(50)) == 9  # a window puts forward one of the names at places 9 to 25
    for trial in range(900):
        kinds = [2, 3, 50, 10_000][trial % 4]
        passage = rnd.integers(1, kinds, 50).astype(np.uint64)
        if trial % 3 == 0:  # runs at either end and inside
            passage = np.repeat(passage, rnd.integers(1, 12, 50))[:50]
        if trial % 7 == 0:
            passage = np.tile(passage[: rnd.integers(1, 9)], 50)[:50]
        found = []
        for _ in range(2):
            a, b = (rnd.integers(1, kinds, rnd.integers(0, 40)).astype(np.uint64) for _ in range(2))
            if trial % 2:
                a, b = np.repeat(passage[:1], len(a)), np.repeat(passage[-1:], len(b))
            w = np.concatenate([a, passage, b])
            _, name, first, last = names_to_exchange(w, np.array([len(w)]), 50)
            found.append({int(n) for n, x, y in zip(name, first, last, strict=True) if x <= len(a) <= y})
        assert found[0] & found[1]


def test_symbols_cover_the_words_once():
    w = np.concatenate([np.random.default_rng(8).integers(0, 5, 500), np.full(90, 7)]).astype(np.uint64)
    made = recompress(w, np.zeros(590, np.int64), rounds_for(50))
    assert (np.cumsum(made.length) - made.length == made.start).all() and made.length.sum() == 590 and made.length.max() >= 90 and len(made.start) < 250
    assert len(window_hashes(w, 50)) == 541 and len(window_hashes(w[:10], 50)) == 0
    same = window_hashes(np.tile(w[:70], 2), 50)
    assert (same[:21] == same[70:]).all() and len(np.unique(same[:70])) == 70


def test_names_of_two_rows_meet_across_batches():
    rnd = random.Random(4)
    rows = sorted((rnd.choice([1, 2, 3, 5, 8, rnd.randint(10, 400)]), rnd.randint(0, 3), i, i) for i in range(300))
    for size in (1, 2, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + size]], pa.int64()) for k in range(4)], names=["name", "row", "first", "last"]) for a in range(0, 300, size)]
        got = sorted(x for b in _met(iter(batches)) for x in b.column(1).to_pylist())
        both = {r[0] for r in rows if len({q[1] for q in rows if q[0] == r[0]}) > 1}
        assert got == sorted(r[2] for r in rows if r[0] in both)


def test_windows_after_the_first_document_across_batches():
    rnd = random.Random(4)
    rows = sorted((rnd.choice([1, 2, rnd.randint(3, 90)]), rnd.randint(0, 1), rnd.randint(0, 1), rnd.randint(0, 5), i, i) for i in range(300))
    first = {}
    for r in rows:
        first.setdefault(r[:3], r[3])
    for size in (1, 2, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + size]], pa.int64()) for k in (0, 1, 3, 4, 5, 2)], names=["low", "high", "doc_id", "row", "start", "salt"]) for a in range(0, 300, size)]
        assert sorted(x for b in _later(iter(batches)) for x in b.column(0).to_pylist()) == sorted(r[4] for r in rows if r[3] > first[r[:3]])
