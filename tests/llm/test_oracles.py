"""The registered queries against DuckDB, the tokenizers library and plain Python, on the smallest tables."""

import hashlib
import os
from collections import Counter

import duckdb
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.helpers import held_out
from tests.llm.test_quality_and_secrets import spans, stats
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_oracles_rows(spark, con, name, tmp_path):
    df = queries.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    df.write.parquet(f"file://{tmp_path}/out")
    got = con.execute(f"select {columns} from '{tmp_path}/out/*.parquet'")
    got, kinds = got.fetchall(), [d[1] for d in got.description]
    want = con.execute(f"select {columns} from ({queries.oracle_sql()[name]})")
    assert kinds == [d[1] for d in want.description]
    assert got and Counter(got) == Counter(want.fetchall())


def test_other_queries_give_what_their_contracts_say(spark, con):
    texts = dict(con.execute("select doc_id, text from documents").fetchall())
    word = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    ids = {i: word.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    pieces = SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    run = {n: {r["doc_id"]: r for r in f(spark, SF).collect()} for n, f in queries.queries().items() if n.startswith(("op2", "op5", "op6", "op7", "op8", "op12"))}
    assert all(set(rows) == set(texts) for rows in run.values())
    for i, t in texts.items():
        r = run["op5_token_counts"][i]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), len(ids[i]), len(ids[i]) > 2048)
        r = run["op8_bpe"][i]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids[i]), hashlib.sha256(" ".join(map(str, ids[i])).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(word.decode(ids[i], skip_special_tokens=False).encode()).hexdigest()
        r, cut = run["op12_sentencepiece"][i], pieces.encode(t or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(cut), hashlib.sha256(",".join(map(str, cut)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(pieces.decode(cut).encode()).hexdigest()
        r, found = run["op6_secret_scan"][i], spans(t)
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == q for _, k, _ in found) for q in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) - {""} <= set(r["spans"].split(","))
        r = run["op7_quality_rules"][i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == stats(t)
        assert not (r["kept"] and r["base_failed"])
        r = run["op2_quality_classifier"][i]
        assert r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
