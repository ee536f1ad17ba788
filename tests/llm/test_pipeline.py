import zlib

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import prose, words
from tests.llm.test_near_and_repeats import brute, brute_repeats, near_copies
from tests.llm.test_quality_and_secrets import spans, stats
from tidemark.llm.queries import queries, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, folder):
    good = [prose(i, 120) for i in range(60)]
    bad = [" ".join(w + "###" for w in prose(i, 80).split()) for i in range(60, 90)]
    shared = prose(500, 60)
    texts = good + bad + near_copies(good[0], 5, 1) + [f"{prose(600 + i, 90)} {shared} {prose(700 + i, 90)}" for i in range(4)] + [f"{prose(800, 50)} token=abcdefgh12 {prose(801, 50)}", "short", None, ""]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_match_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = f"file://{tmp_path}/{k}"
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
            after = {r["doc_id"]: r for r in docs.collect()}
            assert len(after) == docs.count() and all(r["n_chars"] == len(r["text"] or "") for r in after.values())
        ids = sorted(before)
        texts = [before[i]["text"] for i in ids]
        if name == "quality rules":
            good = {i for i in ids if not stats(before[i]["text"])[5]}
            assert set(after) <= good and {i for i in good if i < 60 or i >= 90} <= set(after)
            assert not [i for i in after if 60 <= i < 90]
        elif name == "MinHash near-dedup":
            _, classes = brute(texts, 5)
            assert set(after) == {ids[i] for i in classes if classes[i] == i} and len(after) < len(before)
        elif name == "substring dedup":
            rows, kept = brute_repeats(texts)
            assert {i: words(after[i]["text"]) for i in after} == {i: k for i, k in zip(ids, kept, strict=True) if k}
            assert all(after[i]["text"] == before[i]["text"] for i, r, k in zip(ids, rows, kept, strict=True) if r == k)
        elif name == "secret scans":
            assert set(after) == set(before) and not any(spans(r["text"]) for r in after.values())
            assert all(after[i]["text"] == before[i]["text"] for i in ids if not spans(before[i]["text"]))
        else:
            t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
            got = {}
            for r in docs.orderBy("doc_id", "start").collect():
                got.setdefault(r["doc_id"], []).extend(r["ids"])
            assert got == {i: t.encode(before[i]["text"] or "", add_special_tokens=False).ids + [0] for i in ids}


def test_run_is_all_stages(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    corpus(spark, folder)
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    filled = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in filled) <= 1024 and len({r["doc_id"] for r in got.collect()}) > 55


def test_every_operator_has_one_query():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert zlib.crc32(b"1") % 5 == 3


CLASHES = ["kept", "n_words", "base_failed", "symbol_share", "spans", "_left", "digest", "component_id", "row", "id", "blob", "kept_text", "_held_0", "payload", "length", "quality"]


def test_stages_take_odd_rows_and_columns_of_any_name(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    corpus(spark, folder)
    shared, long = prose(500, 60), prose(900, 30_000)
    texts = [(1, prose(1, 90)), (1, prose(1, 90)), (1, prose(2, 90)), (7, f"{prose(3, 60)} {shared}"), (8, f"{prose(4, 60)} {shared}"), (8, f"{prose(4, 60)} {shared}"), (None, prose(5, 80)), (9, None), (10, ""), (11, long), (12, f"{prose(6, 60)} token=abcdefgh12 {prose(8, 60)}"), (12, f"secret: abcdefgh99 {prose(7, 60)}")]
    d = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate(CLASHES):
        d = d.withColumn(c, F.lit(f"x{i}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, folder)
        assert out.columns == d.columns, name
        rows = out.collect()
        assert all(r[c] == f"x{i}" for r in rows for i, c in enumerate(CLASHES)) and all(r["n_chars"] == len(r["text"] or "") for r in rows), name
        got = sorted((r["doc_id"] or -1, r["text"] or "") for r in rows)
        want = [(i or -1, t or "") for i, t in texts]
        if name == "quality rules":
            want = [(i, t) for i, t in want if not stats(t)[5]]
        elif name == "substring dedup":
            want = [(i, t.removesuffix(f" {shared}") if i == 8 else t) for i, t in want]
        elif name == "secret scans":
            want = [(i, t.replace("token=abcdefgh12", "[secret]").replace("secret: abcdefgh99", "[secret]")) for i, t in want]
        assert got == sorted(want), name
        assert stage(spark, d.limit(0), folder).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, d, folder)
    assert packed.groupBy("doc_id").agg(F.sum(F.when(F.col("start") == 0, 1)).alias("n")).agg(F.sum("n")).first()[0] == len(texts)
    assert corpus_pipeline.STAGES[-1][1](spark, d.limit(0), folder).count() == 0
