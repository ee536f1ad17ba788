import hashlib
import io
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD_TEXTS, docs, held_out, prose, words
from tidemark.llm import quality_classifier, quality_rules, queries, secret_scan, warc
from tidemark.llm.secret_scan import BASE_RULES, RULES, Rule, redact, scan_secrets, span_text, update_ledger


def stats(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, seen = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            seen |= set(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(seen) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(seen), failed


def test_statistics_match_brute_force(spark):
    texts = ODD_TEXTS + ["a b c d e " * 9, prose(1, 30) + "\n" + prose(1, 30), "x\n\n x\nx\n y", "#$ <|> " + prose(2, 50), "a b c d e f a b c d e", "one two three four five six seven eight nine ten"]
    d = docs(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(0))
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(d, [], columns=["lang"]).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == stats(t)
        assert r["kept"] == (not r["base_failed"]) and r["lang"] == "en"
    assert quality_rules.quality_rules(d.limit(0), []).count() == 0


def labelled(spark, n=300):
    good = [prose(i, 60) for i in range(n)]
    bad = [" ".join(w + "###" for w in prose(i, 60).split()) for i in range(n, n + n // 4)]
    d = docs(spark, good + bad)
    return d, spark.createDataFrame([(i, int(i < n), 0) for i in range(n + n // 4)], "doc_id long, quality int, toxic int"), n


def test_learned_list_rejects_what_labels_show(spark):
    d, labels, n = labelled(spark)
    rules = quality_rules.learn(d, labels)
    assert rules and all(op in (">=", "<=") for rule in rules for _, op, _ in rule)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(d, rules).collect() if held_out(r["doc_id"])}
    assert np.mean([k == (i < n) for i, k in got.items()]) > 0.97
    assert quality_rules.learn(d, labels.limit(0)) == []
    assert quality_rules.learn(d, labels.withColumn("quality", F.lit(None).cast("int"))) == []


def test_rules_are_native(spark):
    d, _, _ = labelled(spark, 20)
    plan = quality_rules.quality_rules(d, [[("symbol_share", ">=", 5)]])._jdf.queryExecution().toString()
    plan += scan_secrets(d)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_scored_passages_have_one_length_at_every_size(spark):
    import pyarrow as pa

    texts = [prose(3, n) for n in (6_400, 64)]
    x, b, sizes = quality_classifier.passages(pa.array(texts))
    assert sizes.tolist() == [100, 1] and (b.sum(axis=1) == 127).all()
    slices = [" ".join(words(texts[0])[a : a + 64]) for a in range(0, 6_400, 64)]
    parts, again, _ = quality_classifier.passages(pa.array(slices))
    assert np.allclose(x[:100, -2], parts[:, -2]) and (b[:100] == again).all()  # the share of distinct words, and the words
    # A model whose score is the share of distinct words of a passage: 64 different words in each, whatever the length.
    model = quality_classifier.untrained()
    model.weights["encode"][-2, 0] = model.weights["score"][0] = 1.0
    long, short = " ".join(f"w{i % 64}" for i in range(12_800)), " ".join(f"w{i}" for i in range(64))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs(spark, [long, short]), model).collect()}
    assert abs(got[0] - got[1]) < 1e-9


def test_scores_are_those_of_a_plain_forward_pass(spark):
    """The counts of each passage from its own text, and the network in loops over Python numbers."""
    import math

    import xxhash

    rnd = random.Random(5)
    texts = [None, "", "one", prose(1, 30) + "\n\t#!", " ".join(rnd.choice(["a b", "The", "##", "x.", "é"]) for _ in range(150)), prose(2, 64), prose(3, 65)]
    model = quality_classifier.untrained()
    gen = np.random.default_rng(1)
    model.centre, model.scale = gen.normal(size=len(model.centre)) * 0.1, np.ones(len(model.centre)) * 0.7
    model.weights = {k: gen.normal(0, 0.4, w.shape) for k, w in model.weights.items()}
    w, most = {k: v.tolist() for k, v in model.weights.items()}, quality_classifier.BUCKETS

    def plain(text):
        raw = (text or "").encode()
        ws = words(text)
        spots = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        cuts = [0, *[spots[i] for i in range(64, len(ws), 64)], len(raw)]
        five = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        hidden = []
        for k in range(max(1, -(-len(ws) // 64))):
            part, own = raw[cuts[k] : cuts[k + 1]], ws[64 * k : 64 * k + 64]
            size, n = max(len(part), 1), max(len(own), 1)
            kinds = [sum(b in kind for b in part) for kind in quality_classifier.KINDS]
            made = [math.sqrt(c / size) for c in [*kinds, len(part) - sum(kinds)]]
            again = sum(64 * k + i > 0 and ws[64 * k + i - 1] == x for i, x in enumerate(own))
            repeated = sum(five.get(tuple(ws[i : i + 5]), 0) > 1 for i in range(64 * k, 64 * k + len(own)))
            made += [math.log1p(len(own)) / 5, math.log1p(size) / 8, size / n / 10, again / n, len(set(own)) / n, repeated / n]
            h = [xxhash.xxh3_64_intdigest(x.encode()) for x in own]
            bag = Counter(x % most for x in h)
            bag.update(most + int(quality_classifier.mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) % most for a, b in zip(h, h[1:]))
            x = [min(8, max(-8, (v - c) / s)) for v, c, s in zip(made, model.centre.tolist(), model.scale.tolist(), strict=True)]
            hidden.append([math.tanh(w["encode_0"][j] + sum(v * w["encode"][i][j] for i, v in enumerate(x)) + sum(c / 8 * w["words"][i][j] for i, c in bag.items())) for j in range(quality_classifier.HIDDEN)])
        looks = []
        for h in hidden:
            t = [math.tanh(sum(v * w["look"][i][j] for i, v in enumerate(h))) for j in range(quality_classifier.GATE)]
            g = [1 / (1 + math.exp(-sum(v * w["gate"][i][j] for i, v in enumerate(h)))) for j in range(quality_classifier.GATE)]
            looks.append(math.exp(sum(a * b * c for a, b, c in zip(t, g, w["attend"], strict=True))))
        z = [sum(a * h[j] for a, h in zip(looks, hidden, strict=True)) / sum(looks) for j in range(quality_classifier.HIDDEN)]
        return 1 / (1 + math.exp(-(w["score_0"] + sum(a * b for a, b in zip(z, w["score"], strict=True)))))

    for r in quality_classifier.score(docs(spark, texts), model).collect():
        assert abs(r["score"] - plain(texts[r["doc_id"]])) < 1e-5, r["doc_id"]


def test_the_sample_has_a_bound_of_passages(spark, monkeypatch):
    d, labels, n = labelled(spark, 60)
    taught = []
    monkeypatch.setattr(quality_classifier, "train", lambda x, b, sizes, y: taught.append(sizes))
    long = docs(spark, [prose(1, 64 * 30)], 10_002)
    assert not held_out(10_002)
    quality_classifier.learn(d.union(long), labels.union(spark.createDataFrame([(10_002, 1, 0)], labels.schema)), sample_passages=20)
    assert sum(taught[0]) == 20 and max(taught[0]) == 1


def test_a_repeated_labelled_id_teaches_once(spark, monkeypatch):
    rows = [(1, prose(i, 60)) for i in range(30)] + [(i, prose(100 + i, 60)) for i in (2, 3, 4)]
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)], "doc_id long, quality int")
    assert not any(map(held_out, (1, 2, 3, 4)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    taught = {}
    monkeypatch.setattr(quality_classifier, "train", lambda x, b, sizes, y: taught.setdefault("classifier", []).append((x.tolist(), y.tolist())))
    monkeypatch.setattr(quality_rules, "learn_list", lambda sample, features: taught.setdefault("rules", []).append(sample))
    for order in (d.repartition(3), d.orderBy(F.desc("text"))):
        quality_classifier.learn(order, labels, sample_rows=4)
        quality_rules.learn(order, labels, sample_rows=4)
    for first, second in taught.values():
        assert first == second
    assert len(taught["classifier"][0][1]) == len(taught["rules"][0]) == 4


def test_passages_are_the_whole_text():
    import pyarrow as pa

    texts = ODD_TEXTS + [prose(1, 1000)]
    x, _, sizes = quality_classifier.passages(pa.array(texts))
    assert x.shape == (sizes.sum(), quality_classifier.FEATURES) and np.isfinite(x).all() and sizes.min() == 1 and sizes.max() == 313
    at = np.cumsum(sizes) - sizes
    size_bytes = np.expm1(x[:, -5] * 8)
    for i, t in enumerate(texts):
        total = size_bytes[at[i] : at[i] + sizes[i]].sum()
        assert round(total) == max(len((t or "").encode()), 1)
    one, _, n = quality_classifier.passages(pa.array([texts[-1]]))
    assert np.allclose(one, x[at[-1] :])


def test_gradients_match_differences():
    rnd = np.random.default_rng(3)
    sizes, y = np.array([1, 4, 2, 3]), np.array([0.0, 1.0, 1.0, 0.0])
    x, b = rnd.normal(size=(10, 6)), rnd.integers(0, 9, (10, 5)).astype(np.uint8)
    model = quality_classifier.train(x, b, sizes, y, epochs=3)
    _, g = model.gradients(x, b, sizes, y)
    for name, w in model.weights.items():
        spot = (0,) * np.ndim(w)
        moved = {}
        for sign in (1, -1):
            kept = np.array(w, float)
            kept[spot] += sign * 1e-3
            moved[sign] = quality_classifier.Model(model.centre, model.scale, model.weights | {name: kept}).gradients(x, b, sizes, y)[0]
        assert np.isclose((moved[1] - moved[-1]) / 2e-3, np.array(g[name])[spot], atol=1e-4)


def test_classifier_tells_held_out_rows(spark):
    d, labels, n = labelled(spark)
    model = quality_classifier.learn(d, labels)
    rows = quality_classifier.score(d.withColumn("score", F.lit("clash")), model).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == int(r["doc_id"] < n) for r in rows if r["held_out"]]) > 0.97
    odd = quality_classifier.score(docs(spark, ODD_TEXTS), model).collect()
    assert len(odd) == len(ODD_TEXTS) and odd[0]["score"] == odd[1]["score"]
    once = docs(spark, ODD_TEXTS)
    twice = [tuple(r) for r in quality_classifier.score(once.union(once).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id"))), model).collect()]
    assert len(twice) == 2 * len(ODD_TEXTS) and all(twice.count(r) >= 2 for r in twice)  # rows that come twice, and null ids
    assert quality_classifier.score(d.limit(0), model).count() == 0
    assert {r["score"] for r in quality_classifier.score(d, quality_classifier.learn(d, labels.limit(0))).take(3)} == {0.5}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


SECRETS = ["🙂 token=abcdefgh1", "PassWord : 'x" + "y" * 9 + "' and AKIA" + "Z" * 12, "token=secret:abcdefgh12", "api_key==abcdefgh api-key=abcdefgh", "a" * 31 + " " + "0f" * 16 + "g" + "ab" * 40, "AKIA AKIAAKIA" + "B" * 11, "token=" + "a1" * 20 + " x " + "token = " + "b2" * 20, "secret" + " " * 3000 + "=abcdefghij", "key=" + "f" * 64, "token=abcdefgh1 " * 300]


def test_spans_match_brute_force(spark):
    texts = ODD_TEXTS + SECRETS + SECRETS[:2]
    d = docs(spark, texts).withColumn("blob", F.lit("clash")).withColumn("spans", F.lit(1))
    for r in scan_secrets(d).collect():
        assert [(s["start"], s["order"], s["end"]) for s in r["spans"] if s["order"] < len(BASE_RULES)] == spans(texts[r["doc_id"]])
    named = {r["doc_id"]: r["t"] for r in scan_secrets(d).select("doc_id", span_text(F.col("spans")).alias("t")).collect()}
    assert named[len(ODD_TEXTS)] == "assign:2:17"
    assert scan_secrets(d.limit(0)).count() == 0


def test_ledger_scans_only_what_it_lacks(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    d = docs(spark, SECRETS)
    update_ledger(d, ledger, BASE_RULES)
    n = len(set(SECRETS))
    assert spark.read.parquet(ledger).count() == n
    update_ledger(d.union(docs(spark, ["new text"], 100)), ledger, BASE_RULES)
    assert spark.read.parquet(ledger).count() == n + 1
    changed = (*BASE_RULES[:2], Rule("hex", "[0-9a-f]{40,}", 0, 40))
    found = scan_secrets(d, ledger, changed)
    again = spark.read.parquet(ledger).filter(F.size("rules") == 1)
    assert again.count() == n and again.select(F.explode("rules")).distinct().count() == 1
    long = {r["doc_id"]: [s["end"] - s["start"] for s in r["spans"] if s["order"] == 2] for r in found.collect()}
    assert all(x >= 40 for v in long.values() for x in v) and long[4] == [80]
    before = {r["doc_id"]: r["spans"] for r in scan_secrets(d, ledger, BASE_RULES).collect()}
    assert [(s["start"], s["end"]) for s in before[4]] == [(32, 64), (65, 145)]


def test_the_query_reads_nothing_twice_with_a_kept_ledger(spark, tmp_path, monkeypatch):
    docs(spark, SECRETS).write.parquet(f"file://{tmp_path}/1/documents.parquet")
    docs(spark, [*SECRETS, "token=abcdefghij"]).write.parquet(f"file://{tmp_path}/2/documents.parquet")
    read, scan = [], secret_scan._scan
    monkeypatch.setattr(secret_scan, "_scan", lambda blobs, rules: read.append(blobs.count()) or scan(blobs, rules))
    spark.conf.set(queries.LEDGER, f"file://{tmp_path}/ledger")
    try:
        rows = [sorted(map(tuple, queries.op6_secret_scan(spark, f"file://{tmp_path}/{k}").collect())) for k in (1, 1, 2)]
    finally:
        spark.conf.unset(queries.LEDGER)
    assert read == [len(set(SECRETS)), 0, 1] and rows[0] == rows[1]
    assert rows[2] == sorted(map(tuple, queries.op6_secret_scan(spark, f"file://{tmp_path}/2").collect()))


def test_the_query_keeps_a_ledger_for_each_folder(spark, tmp_path, monkeypatch):
    read, scan = [], secret_scan._scan
    monkeypatch.setattr(secret_scan, "_scan", lambda blobs, rules: read.append(blobs.count()) or scan(blobs, rules))
    where, other = (f"file://{tmp_path}/{k}" for k in ("a", "b"))
    docs(spark, [*SECRETS, *SECRETS]).write.parquet(f"{where}/documents.parquet")
    docs(spark, SECRETS[:3]).write.parquet(f"{other}/documents.parquet")
    rows = [sorted(map(tuple, queries.op6_secret_scan(spark, f).collect())) for f in (where, where + "/", other, where)]
    assert read == [len(set(SECRETS)), 0, len(set(SECRETS[:3])), 0] and rows[0] == rows[1] == rows[3]
    docs(spark, [*SECRETS[2:], "token=abcdefghij", None]).write.mode("overwrite").parquet(f"{where}/documents.parquet")  # some go, one comes
    after = {r["doc_id"]: r for r in queries.op6_secret_scan(spark, where).collect()}
    assert read[-1] == 2 - (None in SECRETS or "" in SECRETS) and len(after) == len(SECRETS)
    for i, t in enumerate([*SECRETS[2:], "token=abcdefghij", None]):
        assert after[i]["n_assign"] == sum(k == 0 for _, k, _ in spans(t)) and after[i]["n_hex"] == sum(k == 2 for _, k, _ in spans(t))


def test_redaction_leaves_no_secret(spark):
    d = docs(spark, SECRETS + ["clean text stays"])
    out = {r["doc_id"]: r["t"] for r in scan_secrets(d, columns=["text"]).select("doc_id", redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out[len(SECRETS)] == "clean text stays" and all(not spans(t) for t in out.values())
    assert out[0] == "🙂 [secret]"
    assert len(RULES) > len(BASE_RULES)


PAGES = "page_id long, url string, html string"
BODIES = [None, "", "short", "short", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "y" * 100, "é" * 50, "é" * 50, "<html>" + "z" * 300_000, "<html>" + "z" * 300_000, "WARC/1.1\r\n\r\n" * 20]


def test_archives_read_back(spark, tmp_path):
    rows = [(50 - i, f"http://a.example/ü {i}", b) for i, b in enumerate(BODIES)]
    folder = f"file://{tmp_path}/warc"
    d = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit("clash")).withColumn("payload_digest", F.lit(1))
    got = {r["page_id"]: r for r in warc.round_trip(d, folder).collect()}
    first = {}
    for i, _, b in sorted(rows, key=lambda r: r[0]):
        first.setdefault(b or "", i)
    assert len(got) == len(rows)
    for i, _, b in rows:
        data = (b or "").encode()
        to = first[b or ""] if len(data) >= 100 and first[b or ""] != i else None
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to)
        assert (bytes(r["payload"]) if r["payload"] is not None else None) == (data if to is None else None)
    assert warc.round_trip(d.limit(0)).count() == 0


def test_repeated_and_null_page_ids(spark):
    d = spark.createDataFrame([(1, "u", "a" * 200), (1, "u", "a" * 200), (2, None, "a" * 200), (None, "v", "a" * 200), (None, None, None)], PAGES)
    got = sorted(json.dumps([r["page_id"], r["record_type"], r["refers_to"]]) for r in warc.round_trip(d).collect())
    assert got == sorted(json.dumps(x) for x in [[1, "response", None], [1, "response", None], [2, "revisit", 1], [None, "response", None], [None, "response", None]])


def test_damaged_archives_are_refused():
    digest = hashlib.sha256(b"body").hexdigest()
    good = warc.gzip_member(warc.record_bytes(1, "u", b"body", digest, None))
    two = good + warc.gzip_member(warc.record_bytes(2, "u", b"body", digest, 1))
    assert [x[0] for x in warc.read_archive(io.BytesIO(two))] == [1, 2]
    large = warc.record_bytes(3, "u", b"body" * 99_999, hashlib.sha256(b"body" * 99_999).hexdigest(), None)
    for step in (1, 7, 1 << 16):
        assert [len(b) for _, b in warc.read_records(io.BytesIO(two + warc.gzip_member(large)), step)] == [4, 0, 4 * 99_999]
    wrong = warc.record_bytes(1, "u", b"body", digest, None)
    for bad in (good[:-3], b"no gzip at all", warc.gzip_member(wrong.replace(b"body", b"bodx")), warc.gzip_member(wrong.replace(b"Content-Length: 4", b"Content-Length: 5")), warc.gzip_member(wrong.replace(b"Content-Length: 4", b"Content-Length: 3")), warc.gzip_member(wrong + b"x" * 90_000), warc.gzip_member(b"nothing")):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(bad)))
    assert zlib.decompress(good, 31).startswith(b"WARC/1.1\r\n")


def test_a_batch_of_nothing_but_empty_texts():
    import pyarrow as pa

    x, _, sizes = quality_classifier.passages(pa.array([None, "", ""], pa.string()))
    assert x.shape == (3, quality_classifier.FEATURES) and sizes.tolist() == [1, 1, 1] and np.isfinite(x).all()


def test_redaction_of_many_overlapping_spans(spark):
    def brute(text, found):
        out, at = "", 0
        for a, _, b in found:
            if a < at:
                at = max(at, b)
            else:
                out, at = out + text[at:a] + "[secret]", b
        return out + text[at:]

    rnd, rows = random.Random(1), []
    for i in range(200):
        t = "".join(rnd.choice("aé🙂中\n\x00b") for _ in range(rnd.randint(1, 700)))
        made = [(a, k, min(len(t), a + rnd.choice([1, 3, 20, 200]))) for k in range(rnd.choice([0, 1, 5, 130, 400])) for a in [rnd.randrange(len(t))]]
        rows.append((i, t, sorted(made)))
    long = "x" * 18 + " " + "password=abcdefghijkl1234567890abcdef  " * 60_000  # 2.3 million characters, a span in each 39
    rows.append((200, long, [(19 + 39 * k, 0, 19 + 39 * k + 37) for k in range(60_000)]))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<start:int,order:int,end:int>>")
    for r in df.select("i", redact(F.col("t"), F.col("s")).alias("o")).collect():
        assert r["o"] == brute(*rows[r["i"]][1:])
