"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import bpe_encode
from tidemark.llm.embedding_dedup import embedding_near_duplicates
from tidemark.llm.fill_in_middle import fill_in_middle, piece_digests, restored
from tidemark.llm.importance import importance_resample
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import ids_digests, pack
from tidemark.llm.quality_classifier import learn as learn_classifier
from tidemark.llm.quality_classifier import score
from tidemark.llm.quality_rules import learn, quality_rules
from tidemark.llm.secret_scan import BASE_RULES, scan_secrets, span_text
from tidemark.llm.sentence_pieces import sentence_pieces
from tidemark.llm.shared import shared_folder, table, tidy
from tidemark.llm.substring_dedup import repeated_passages
from tidemark.llm.token_counts import token_counts
from tidemark.llm.warc import round_trip


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.mapInArrow(tidy(ids_digests), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn_classifier(docs, table(spark, sf_dir, "labels")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as x from embeddings),
     ok as (select vec_id, label, x, sqrt(list_dot_product(x, x)) as n from v where label is not null and x is not null and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0),
     l as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) and a.n > 0 and b.n > 0 where list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
     r(id, reached) as (select vec_id, vec_id from v union select r.id, l.b from r join l on r.reached = l.a),
     c as (select id, min(reached) as component_id from r group by id),
     k as (select a, count(*) as n_links from l group by a)
select v.vec_id, coalesce(k.n_links, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.id = v.vec_id left join k on k.a = v.vec_id
"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


OP4_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
     s as (select doc_id, unnest(case when len(ws) = 0 then cast([] as varchar[]) when len(ws) = 1 then [ws[1]] else list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) end) as sh from w),
     n as (select w.doc_id, count(s.sh) as n from w left join s on s.doc_id = w.doc_id group by w.doc_id),
     p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
     l as (select p.a, p.b from p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * p.i >= 80 * (na.n + nb.n - p.i)),
     e as (select a, b from l union all select b, a from l),
     r(id, reached) as (select doc_id, doc_id from w union select r.id, e.b from r join e on r.reached = e.a),
     c as (select id, min(reached) as component_id from r group by id)
select n.doc_id, n.n as n_shingles, c.component_id, n.doc_id = c.component_id as kept from n join c on c.id = n.doc_id
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


#: The setting that names the ledger to keep; without it there is one for each folder of tables.
LEDGER = "tidemark.secretLedger"


def kept_ledger(spark: SparkSession, sf_dir: str) -> str:
    """Where the ledger of a folder of tables lies: beside what clean_up() deletes, so that the next scan reads only new texts."""
    return spark.conf.get(LEDGER, None) or f"{shared_folder(spark)}/tidemark-ledgers/{hashlib.sha256(sf_dir.rstrip('/').encode()).hexdigest()[:32]}"


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), kept_ledger(spark, sf_dir))
    base = F.filter("spans", lambda s: s["order"] < len(BASE_RULES))
    of_rule = lambda i: F.size(F.filter("spans", lambda s: s["order"] == i)).cast("long")
    counts = [of_rule(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, learn(docs, table(spark, sf_dir, "labels")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digests=True)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), with_text=False).drop("digest")


OP9_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
     s as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50),
     h as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as k from s),
     m as (select k, min(doc_id) as first_id from h group by k),
     r as (select h.doc_id, h.i from h join m on h.k = m.k where m.first_id < h.doc_id),
     c as (select distinct doc_id, j from (select doc_id, unnest(range(i, i + 50)) as j from r)),
     e as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as j from w),
     k as (select e.doc_id, string_agg(e.x, ' ' order by e.j) as kept, count(*) as n from e left join c on e.doc_id = c.doc_id and e.j = c.j where c.j is null group by e.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k on w.doc_id = k.doc_id
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = round_trip(table(spark, sf_dir, "pages"), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
     d as (select page_id, octet_length(encode(body)) as payload_bytes, sha256(body) as payload_digest from p),
     f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest, payload_bytes >= 100) else page_id end as first_id from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from f
"""


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its shift register, eight steps a byte, of each distinct word once; floats are doubles throughout.
OP11_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
     b as (select list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark),
     dw as (select doc_id, unnest(ws) as w from d),
     bw as (select unnest(ws) as w from b),
     words as (select distinct w from (select w from dw union all select w from bw)),
     octets as (select w, list_transform(range(0, octet_length(encode(w))), lambda i: cast('0x' || substr(hex(encode(w)), 2 * i + 1, 2) as bigint)) as xs from words),
     steps as (select w, list_prepend(4294967295, list_concat([], flatten(list_transform(xs, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1])))) as xs from octets),
     crc as (select w, xor(list_reduce(xs, lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295) % 10000 as bucket from steps),
     s as (select bucket, count(*) as n from dw join crc using (w) group by bucket),
     t as (select bucket, count(*) as n from bw join crc using (w) group by bucket),
     g as (select s.bucket, cast(floor(1000 * ln(((coalesce(t.n, 0) + 1)::double * ((select count(*) from dw) + 10000)::double) / ((s.n + 1)::double * ((select count(*) from bw) + 10000)::double))) as bigint) as gain from s left join t using (bucket)),
     f as (select doc_id, sum(gain) as weight from dw join crc using (w) join g using (bucket) group by doc_id),
     h as (select d.doc_id, cast(len(ws) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight, cast('0x' || substr(sha256('2024:' || coalesce(cast(d.doc_id as varchar), '')), 1, 8) as bigint) as h from d left join f on d.doc_id = f.doc_id),
     c as (select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from h),
     r as (select *, row_number() over (order by n_features < 20, score desc, doc_id) as place, (10 * count(*) filter (n_features >= 20) over ()) // 100 as drawn from c)
select doc_id, n_features, weight, score, case when place <= drawn then place end as rank from r
"""


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentence_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return pieces.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(restored(fill_in_middle(table(spark, sf_dir, "documents"))))


OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
     k as (select *, len(u) as n, cast('0x' || substr(h, 1, 8) as bigint) % (len(u) + 1) as c1, cast('0x' || substr(h, 9, 8) as bigint) % (len(u) + 1) as c2, cast('0x' || substr(h, 25, 8) as bigint) % 100 as c4 from d),
     f as (select *, case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') then 'plain' when c4 < 50 then 'spm' else 'psm' end as form,
                  array_to_string(u[1:least(c1, c2)], '') as p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') as m, array_to_string(u[greatest(c1, c2) + 1:], '') as s from k)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
       sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(case form when 'plain' then x else p || m || s end) as restored_sha256
from f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_quality_classifier, op3_embedding_dedup, op4_near_dedup, op5_token_counts, op6_secret_scan, op7_quality_rules, op8_bpe, op9_substring_dedup, op10_warc, op11_importance, op12_sentencepiece, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": OP3_SQL, "op4_near_dedup": OP4_SQL, "op9_substring_dedup": OP9_SQL, "op10_warc": OP10_SQL, "op11_importance": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
