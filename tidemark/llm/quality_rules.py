"""Quality rules: statistics as Spark expressions, and decision lists learned from labelled statistics.

Everything that touches the rows is a DataFrame expression. The learner sees only the statistics of a bounded sample of
labelled rows, on the driver: sequential covering grows a conjunction of thresholds by information gain on two thirds of
the rows, prunes it on the other third, removes what it covers and goes on while rules stay precise. The list becomes one
ordered conditional expression.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD_SEPARATORS, keyed, one_text

SYMBOLS = "[#*$%&|<>]"
SPACES = " \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the learner may use, in thousandths of what they are a share of.
SHARES = ["symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "word_length"]
#: At most so many labelled rows are learned from.
SAMPLE_ROWS = 4000
Rule = list[tuple[str, str, int]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(hashes: Column, size: int = 5) -> Column:
    """Words that lie in a window of `size` words which the text holds twice or more; words come as 64-bit hashes."""

    def covered(windows: Column) -> Column:
        def places(ordered: Column) -> Column:
            same = lambda s, k: (F.get(ordered, k - 1)["h"] == s["h"]) | (F.get(ordered, k + 1)["h"] == s["h"])
            at = F.array_sort(F.transform(F.filter(ordered, lambda s, k: F.coalesce(same(s, k), F.get(ordered, k - 1)["h"] == s["h"], F.get(ordered, k + 1)["h"] == s["h"], F.lit(False))), lambda s: s["i"]))
            step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(size), p - acc["last"])).alias("n"), p.alias("last"))
            return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")), step, lambda acc: acc["n"])

        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, places))

    starts = F.sequence(F.lit(0), F.size(hashes) - size)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(F.size(hashes) < size, F.lit(0)).otherwise(let(windows, covered))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with BASE statistics, base_failed and the learner's SHARES; a null text has no words."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.filter(F.split(text, WORD_SEPARATORS, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")

    def by_words(w: Column) -> Column:
        chars = F.char_length(F.array_join(w, "")).cast("long").alias("word_chars")
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), chars, _repeat_words(h).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(h)).cast("long").alias("n_distinct")))

    def by_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    found = docs.withColumn("_w", let(words, by_words)).withColumn("_l", let(lines, by_lines))
    found = found.withColumn("_c", F.struct(*[F.regexp_count(text, F.lit(x)).cast("long").alias(n) for n, x in (("n_symbols", SYMBOLS), ("n_upper", "[A-Z]"), ("n_digits", "[0-9]"), ("n_marks", "[!?]"))]))
    w, x, c = F.col("_w"), F.col("_l"), F.col("_c")
    base = {"n_words": w["n_words"], "word_chars": w["word_chars"], "n_symbols": c["n_symbols"], "n_dup_lines": x["n_dup_lines"], "n_repeat_words": w["n_repeat_words"]}
    share = lambda a, b: F.when(b > 0, F.floor(a * 1000 / b)).otherwise(F.lit(0)).cast("long")
    shares = [share(c["n_symbols"], w["word_chars"]), share(x["n_dup_lines"], x["n_lines"]), share(w["n_repeat_words"], w["n_words"]), share(w["n_distinct"], w["n_words"]),
              share(c["n_upper"], w["word_chars"]), share(c["n_digits"], w["word_chars"]), share(c["n_marks"], w["word_chars"]), share(w["word_chars"], w["n_words"])]
    failed = (w["n_words"] < 10) | (100 * w["n_repeat_words"] > 20 * w["n_words"])
    return found.withColumns(base | dict(zip(SHARES, shares, strict=True)) | {"base_failed": failed}).drop("_w", "_l", "_c")


def _holds(rule: Rule, row: dict[str, int]) -> bool:
    return all(row[f] >= t if op == ">=" else row[f] <= t for f, op, t in rule)


def _grow(rows: list[tuple[dict[str, int], int]], features: list[str], longest: int = 3) -> Rule:
    """Adds the threshold of the highest gain until no bad row is missed or none helps; y = 1 is what rules look for."""
    rule: Rule = []
    while len(rule) < longest:
        p0, n0 = sum(y for _, y in rows), sum(1 - y for _, y in rows)
        if not p0 or not n0:
            break
        before, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for f in features:
            ordered = sorted((x[f], y) for x, y in rows)
            for op in (">=", "<="):
                run = reversed(ordered) if op == ">=" else ordered
                p = n = 0
                last = None
                for v, y in run:
                    if v != last and last is not None and p:
                        best = max(best, (p * (math.log2(p / (p + n)) - before), (f, op, last)), key=lambda b: b[0])
                    p, n, last = p + y, n + 1 - y, v
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if _holds([best[1]], r[0])]
    return rule


def _prune(rule: Rule, rows: list[tuple[dict[str, int], int]]) -> tuple[Rule, float, int]:
    """The shortest beginning of the rule that is worth most on rows that did not grow it; its precision and cover there."""

    def worth(r: Rule) -> tuple[float, float, int]:
        hit = [y for x, y in rows if _holds(r, x)]
        return (2 * sum(hit) - len(hit)) / (len(hit) + 2), (sum(hit) + 0.5) / (len(hit) + 1), len(hit)

    tried = [(worth(rule[:k]), -k) for k in range(1, len(rule) + 1)]
    (_, precision, cover), k = max(tried, key=lambda t: (t[0][0], t[1]))
    return rule[:-k], precision, cover


def learn_list(rows: list[tuple[dict[str, int], int]], features: list[str], precision: float = 0.8, most: int = 12) -> list[Rule]:
    """Rules in order; a row that one of them holds for is rejected. rows: statistics, and 1 for quality."""
    bad = [(x, 1 - q) for x, q in rows]
    rules: list[Rule] = []
    while len(rules) < most and sum(y for _, y in bad) > 5:
        grow, prune = [r for i, r in enumerate(bad) if i % 3], bad[::3]
        rule = _grow(grow, features)
        if not rule:
            break
        rule, sure, cover = _prune(rule, prune)
        if sure < precision or cover < 3:
            break
        rules.append(rule)
        bad = [r for r in bad if not _holds(rule, r[0])]
    return rules


def as_condition(rules: list[Rule]) -> Column:
    """True where no rule rejects: when(rule 1, false).when(rule 2, false)...otherwise(true)."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for f, op, t in rule:
            holds = holds & (F.col(f) >= t if op == ">=" else F.col(f) <= t)
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns from at most sample_rows labelled documents, taken in the order of a hash of their id; rows whose
    crc32(id as text) mod 5 is 0 are left out, to measure on. Null labels and ids, and texts the base rule fails, teach
    nothing; of rows that repeat a doc_id the text with the least hash counts. Without labels there are no rules. A list has
    at most 12 rules of 3 conditions each (learn_list(most=12), _grow(longest=3)), so that it stays to be read."""
    marked = keyed(labels, {"doc_id": "doc_id", "quality": "quality"}).filter("quality is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 != 0")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = keyed(docs, {"doc_id": id_col, "text": text_col}).join(F.broadcast(marked), "doc_id")
    rows = one_text(rows)
    # base_failed is not filtered here: Spark would push that below the join, and so work out the statistics of every text.
    found = [r for r in statistics(rows).select("doc_id", "quality", "n_words", "base_failed", *SHARES).collect() if not r["base_failed"]]
    found.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    features = ["n_words", *SHARES]
    return learn_list([({f: r[f] for f in features}, int(r["quality"] >= 1)) for r in found], features)


def quality_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """id, `columns` of the input, BASE statistics, base_failed and kept (not base_failed, and no rule rejects) of every row.

    Null and empty texts have no words: base_failed. Texts of any length are read whole. Repeated rows: one result each. No
    rows: no rows. Other columns are dropped, so their names cannot clash with the statistics.
    """
    rows = keyed(docs, {"doc_id": id_col, "_text": text_col} | {f"_kept_{i}": c for i, c in enumerate(columns or [])})
    found = statistics(rows, "_text").withColumn("kept", ~F.col("base_failed") & as_condition(rules))
    return found.select("doc_id", *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(columns or [])], *BASE, "base_failed", "kept")
