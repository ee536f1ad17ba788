"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
documents, whatever they are: doc_id and text, and any others under any names. Learned quality rules are learned from the
documents that come in and the labels beside them. No documents: every stage returns none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import learn, quality_rules
from tidemark.llm.queries import vocabulary
from tidemark.llm.secret_scan import redact, scan_secrets
from tidemark.llm.shared import held, materialize, table
from tidemark.llm.substring_dedup import repeated_passages


def _with_text(docs: DataFrame, rows: DataFrame, names: dict[str, str], text: Column) -> DataFrame:
    """rows, whose columns of docs are named as in `names`, with a new text and n_chars counted again, in the columns of docs."""
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.coalesce(F.char_length(text).cast(docs.schema["n_chars"].dataType), F.col(names["n_chars"]))
    return rows.select(*[made.get(c, F.col(names[c])).alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go.

    Null and empty texts have no words, so they go; texts of any length are read whole. Repeated rows, and rows that repeat
    a doc_id, are judged each by its text; rows with a null doc_id like any other. Of documents that tie nothing depends on
    their order. Without labels only the base rule rejects.
    """
    names = held(docs)
    rules = learn(docs, table(spark, sf_dir, "labels"))
    rows = quality_rules(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), rules, names["doc_id"], names["text"], list(names.values()))
    return rows.filter("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays.

    Rows that repeat a doc_id are one document with several texts, and all stay or all go. Null and empty texts, and rows
    with a null doc_id, are like nothing and stay. Texts of any length are compared whole.
    """
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller doc_id holds go; a document of which nothing is left goes too.

    Rows that repeat a doc_id, or a whole row, are cut each by its own text and cut nothing from each other. Rows with a
    null doc_id, and null, empty and short texts, stay as they are. Texts of any length are compared whole.
    """
    names = held(docs)
    found = repeated_passages(docs).filter("n_removed > 0").select("doc_id", "digest", "kept_text").dropDuplicates(["doc_id", "digest"])
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    digest = F.sha2(F.coalesce(F.col(names["text"]), F.lit("")), 256)
    rows = rows.join(found, (F.col(names["doc_id"]) == F.col("doc_id")) & (digest == F.col("digest")), "left").filter("kept_text is null or kept_text != ''")
    return _with_text(docs, rows, names, F.coalesce("kept_text", names["text"]))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark.

    Null and empty texts have none; texts of any length are read whole. Spans that overlap become one mark. Every row stays,
    repeated ones and those with a null doc_id too; a text without secrets stays as it is.
    """
    names = held(docs)
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rows = scan_secrets(rows, id_col=names["doc_id"], text_col=names["text"], columns=list(names.values()))
    text = F.col(names["text"])
    return _with_text(docs, rows, names, F.when(F.size("spans") > 0, redact(text, F.col("spans"))).otherwise(text))


def fill_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 ids, and where each piece of a document lies in them.

    A null text is an empty one and gives the closing id alone; very long texts are cut into as many pieces as they need.
    Repeated rows, and rows that repeat a doc_id or have none, are documents of their own; of rests of one length the order
    of rows decides. Other columns are dropped.
    """
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", keep_good), ("MinHash near-dedup", keep_one_of_each), ("substring dedup", cut_repeats), ("secret scans", hide_secrets), ("packing", fill_windows)]
#: Near-duplicate classes, learned rules and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage keeps is written and read again, so that each is worked out once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
