"""Sequential steps along each key's rows in order, for what no window can say: each row's result depends on a state that
the rows before it left."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

Step = Callable[[Any, tuple], tuple[Any, list[tuple]]]


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Any, step: Step, out: str, end: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """keys and `out` of the rows that the steps make: step(state, values of `columns`) gives the next state and rows, and
    end(state) those after a key's last row.

    One exchange on the keys, sorted by key and order; a task holds a batch and the state of one key, whatever a key's size.
    """
    rows = df.select(*dict.fromkeys([*keys, *order, *columns]))
    spark = df.sparkSession
    kinds = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
    schema = spark.createDataFrame([], f"{kinds}, {out}").schema
    at = {c: i for i, c in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, made = None, start, []
        names = [f.name for f in schema.fields]
        kind = _arrow(schema)

        def write() -> pa.RecordBatch:
            columns_ = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kind, strict=True)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns_, names=names)

        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            used = [lists[at[c]] for c in columns]
            for k, values in zip(zip(*[lists[at[c]] for c in keys], strict=True), zip(*used, strict=True), strict=True):
                if k != key:
                    if key is not None and end is not None:
                        made.extend((*key, *r) for r in end(state))
                    key, state = k, start
                state, rows_ = step(state, values)
                made.extend((*k, *r) for r in rows_)
                if len(made) >= 8192:
                    yield write()
        if key is not None and end is not None:
            made.extend((*key, *r) for r in end(state))
        if made:
            yield write()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
