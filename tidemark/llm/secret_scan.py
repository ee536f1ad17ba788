"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every text is addressed by the SHA-256 of its content. The ledger holds, for each blob, the rules (with
their versions) that have read it and the spans they found; a scan reads only the pairs of blob and rule version that the
ledger lacks, adds them, and joins the findings back to all paths that hold the blob. Matches get their places from the
lengths of what lies between them, summed along the blob.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.quality_rules import let
from tidemark.llm.shared import fresh_path, keyed, materialize

#: Rows that share a blob are dealt to so many parts where they meet its findings.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a Java pattern; one whose `group` has fewer than `least` characters is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(f'{self.pattern}|{self.group}|{self.least}'.encode()).hexdigest()[:12]}"


#: A run that is too short for `access` or `hex` holds no longer one, so their least length stands in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES
_SPANS = "array<struct<start:int,order:int,end:int>>"


def _hits(text: Column, rule: Rule, order: int) -> Column:
    """An element for each match: the characters before it since the last match, its own, and whether it is long enough."""
    pattern = F.lit(rule.pattern)

    def made(m: Column) -> Column:
        group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else m
        one = lambda gaps, g: F.transform(m, lambda x, i: F.struct(F.lit(order).alias("order"), i.alias("k"), F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(x).alias("size"), (F.char_length(F.get(g, i)) >= rule.least).alias("good")))
        return let(F.split(text, rule.pattern, -1), lambda gaps: let(group, lambda g: one(gaps, g)))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), made)


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, todo (rule versions) and text -> blob, rules, spans."""
    none = F.array().cast("array<struct<order:int,k:int,gap:int,size:int,good:boolean>>")
    found = [F.when(F.array_contains("todo", r.version) & F.col("text").rlike(r.pattern), _hits(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    read = materialize(blobs.select("blob", "todo", F.concat(*found).alias("hits")), "secret-hits")
    each = read.filter(F.size("hits") > 0).select("blob", F.explode("hits").alias("h")).select("blob", "h.*")
    so_far = Window.partitionBy("blob", "order").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")).filter("good")
    spans = each.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("size")).cast("int").alias("start"), "order", "end"))).alias("spans"))
    return read.select("blob", F.col("todo").alias("rules")).join(spans, "blob", "left").select("blob", "rules", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def _named(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Spans as the ledger keeps them: under the version of their rule, not its place in a list."""
    version = F.array(*[F.lit(r.version) for r in rules])
    return df.withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.get(version, s["order"]).alias("rule"), s["end"].alias("end"))))


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scans what the ledger lacks of the versions' texts and adds it; returns the ledger: blob, rules, spans.

    A blob has a row for each scan that read it. An interrupted update adds nothing. Null texts count as empty.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    wanted = F.array(*[F.lit(r.version) for r in rules])
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    if _exists(spark, ledger):
        seen = _of(read_ledger(spark, ledger), blobs).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0).drop("seen")
    else:
        blobs = blobs.withColumn("todo", wanted)
    _named(_scan(blobs, rules), rules).write.mode("append").option("compression", "zstd").parquet(ledger)
    return read_ledger(spark, ledger)


def read_ledger(spark, ledger: str) -> DataFrame:
    return spark.read.schema("blob string, rules array<string>, spans array<struct<start:int,rule:string,end:int>>").parquet(ledger)


def _of(known: DataFrame, blobs: DataFrame) -> DataFrame:
    """The rows of a ledger that are about blobs at hand: a kept ledger may hold many more."""
    return known.join(blobs.select("blob").distinct(), "blob", "left_semi")


def _exists(spark, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def scan_secrets(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """id, `columns` of the input and spans (start, order of the rule in `rules`, end; code points) of every row.

    With a kept ledger only texts and rules that it lacks are read; without one all are. Rows with equal texts share one scan.
    Null and empty texts: no spans. Texts of any length are read whole. Repeated rows: one result each. No rows: no rows.
    Other columns, whatever their names, are dropped unless named. Spans come by start, then in the order of the rules; those of different rules may overlap.
    """
    kept = ledger is not None
    ledger = ledger or fresh_path(versions.sparkSession, "secret-ledger")
    known = update_ledger(versions, ledger, rules, text_col)
    if kept:
        known = _of(known, versions.select(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("blob")))
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.version), F.lit(i))])
    found = known.select("blob", F.explode("spans").alias("s")).select("blob", F.col("s.start").alias("start"), F.element_at(order, F.col("s.rule")).alias("order"), F.col("s.end").alias("end")).filter("`order` is not null")
    found = found.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", "order", "end"))).alias("spans"))
    found = found.select("blob", "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    more = {f"_kept_{i}": c for i, c in enumerate(columns or [])}
    paths = keyed(versions, {"doc_id": id_col, "_text": text_col} | more)
    paths = paths.select("doc_id", *[k for k in more], F.sha2(F.coalesce("_text", F.lit("")), 256).alias("blob")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = paths.join(found, ["blob", "salt"], "left")
    return out.select("doc_id", *[F.col(k).alias(c) for k, c in more.items()], F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Spans whose greatest end is found in one go.
BLOCK = 128


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each maximal stretch of overlapping spans replaced by the mark; spans come by start.

    Work grows with the text and its spans: what lies between stretches is cut from the text in four bytes a character,
    where a character's place is known, and how far the spans before one reach is found by blocks.
    """

    def before(ends: Column) -> Column:
        """How far the spans before each block reach."""
        tops = F.transform(F.sequence(F.lit(0), F.floor((F.size(ends) - 1) / BLOCK).cast("int")), lambda b: F.array_max(F.slice(ends, b * BLOCK + 1, F.lit(BLOCK))))
        return F.aggregate(tops, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x))))

    def reached(ends: Column, tops: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return F.greatest(F.get(tops, block), F.coalesce(F.array_max(F.slice(ends, block * BLOCK + 1, i % BLOCK)), F.lit(0)))

    def cut(ends: Column, tops: Column, wide: Column) -> Column:
        part = lambda a, b: F.decode(F.substring(wide, 4 * a + 1, 4 * (b - a)), "UTF-32")
        gaps = F.filter(F.transform(spans, lambda s, i: F.struct(reached(ends, tops, i).alias("a"), s["start"].alias("b"))), lambda g: g["b"] >= g["a"])
        tail = part(F.element_at(tops, -1), F.floor(F.octet_length(wide) / 4).cast("int"))
        return F.array_join(F.concat(F.transform(gaps, lambda g: part(g["a"], g["b"])), F.array(tail)), mark)

    done = let(F.transform(spans, lambda s: s["end"]), lambda ends: let(before(ends), lambda tops: let(F.encode(text, "UTF-32"), lambda wide: cut(ends, tops, wide))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


__all__ = ["BASE_RULES", "MORE_RULES", "RULES", "Rule", "read_ledger", "redact", "scan_secrets", "span_text", "update_ledger"]
