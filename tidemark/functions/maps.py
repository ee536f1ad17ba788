"""Dictionaries and JSON: map functions with the usual folding of case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(m: Column, key: str, match_case: bool = False, prefix: bool = False) -> Column:
    """The value of the first key that equals, or with prefix begins with, the key; null if none does."""
    fold = (lambda c: c) if match_case else F.lower
    want = key if match_case else key.lower()
    hit = (lambda k: F.startswith(fold(k), F.lit(want))) if prefix else (lambda k: fold(k) == want)
    return F.get(F.map_values(F.map_filter(m, lambda k, v: hit(k))), F.lit(0))


def put(m: Column, key: str, value: Column, mode: str = "overwrite") -> Column:
    """mode: overwrite, keep (an old value stays), append (to the old value)."""
    old = F.element_at(m, F.lit(key))
    new = {"overwrite": value, "keep": F.coalesce(old, value), "append": F.concat(F.coalesce(old, F.lit("")), value)}[mode]
    return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(F.lit(key), new))


def fold_keys(m: Column) -> Column:
    return F.transform_keys(m, lambda k, v: F.lower(k))


def rename_keys(m: Column, names: dict[str, str]) -> Column:
    """Keys of the table get their new names, others stay."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(m, lambda k, v: F.coalesce(F.element_at(table, k), k))


def parse(text: Column, pair: str = "&", value: str = "=") -> Column:
    return F.str_to_map(text, F.lit(pair), F.lit(value))


def show(m: Column, pair: str = "&", value: str = "=") -> Column:
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(value), e["value"])), pair)


def count(m: Column) -> Column:
    return F.size(m)


def json_get(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def json_size(text: Column) -> Column:
    return F.json_array_length(text)
