"""Scans along ordered streams whose keys may be hot: a key with most of the rows is many tasks' work.

Rows are dealt by ranges of (keys, order), so that a key's rows lie in neighbouring ranges, in order. Each range is worked
through as if nothing came before it, and written once with what that gives; its last key's summary goes with it. The
summaries, one for each range, are put together in order (they form a monoid: affine maps, counts, tails), which tells
what the rows of a range's first key have before them; that is then added to each row where it lies. So one exchange and
one written table do for any skew, and no task holds more than a batch and a state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import materialize

_AGE, _PART, _FIRST, _END = "_scan_age", "_scan_part", "_scan_first", "_scan_end"
#: Rows that an IIR block has; blocks of a batch are worked through beside each other.
BLOCK = 64


class Scan:
    """columns: what is read. made: name and SQL type of what local() makes of a key's next rows (a dict of arrays or Arrow
    arrays) with the state that its rows in this range left; out: of what finish() makes of that, each row's place in its
    range (from 0) and the state of the ranges before, which is None where there are none. combine() joins the states of
    two stretches of a key; start is that of no rows."""

    columns: list[str] = []
    made: dict[str, str] = {}
    out: dict[str, str] = {}
    start: Any = None

    def local(self, rows: dict[str, Any], state: Any) -> tuple[dict[str, Any], Any]:
        raise NotImplementedError

    def combine(self, before: Any, after: Any) -> Any:
        raise NotImplementedError

    def finish(self, made: dict[str, Any], age: np.ndarray, before: Any) -> dict[str, Any]:
        return made


def _borders(batch: pa.RecordBatch, at: list[int]) -> list[int]:
    """Where runs of equal keys begin in a batch, and its end."""
    change = np.zeros(max(batch.num_rows - 1, 0), bool)
    for i in at:
        codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change |= codes[1:] != codes[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]


def _array(values: Any) -> pa.Array:
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def scan(df: DataFrame, keys: list[str], order: list[str], work: Scan, parts: int | None = None) -> DataFrame:
    """df with the columns that the scan makes along each key's rows by `order`, which must be unique within a key.

    parts: how many ranges; by default as many as the session's shuffles have. No rows: no rows. A null key is a key.
    """
    if clash := {_AGE, _PART, _FIRST, _END, *work.made, *work.out} & set(df.columns):
        raise ValueError(f"columns with names of this operator: {sorted(clash)}")
    spark, names = df.sparkSession, df.columns
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, used = [names.index(k) for k in keys], {c: names.index(c) for c in work.columns}
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    made = [f"`{k}` {v}" for k, v in work.made.items()]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, state, seen, whole, waiting = TaskContext.get().partitionId(), None, None, work.start, 0, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting is not None:
                yield waiting
            edges = _borders(batch, at)
            outs, ages, of_first = [], [], []
            for a, b in zip(edges[:-1], edges[1:]):
                key = tuple(batch.column(i)[a].as_py() for i in at)
                if first is None:
                    first = (key,)
                if last is not None and key != last[0]:
                    state, seen, whole = work.start, 0, False
                last = (key,)
                rows = {c: batch.column(i).slice(a, b - a) for c, i in used.items()}
                out, state = work.local(rows, state)
                outs.append(out)
                ages.append(np.arange(seen, seen + b - a))
                of_first.append(np.full(b - a, whole))
                seen += b - a
            columns = [pa.concat_arrays([_array(o[k]) for o in outs]) for k in work.made]
            end = [None] * batch.num_rows
            end[-1] = pickle.dumps((first[0], last[0], whole, state))
            plain = [np.concatenate(ages), np.full(batch.num_rows, part), np.concatenate(of_first)]
            columns = [*batch.columns, *columns, *map(pa.array, plain), pa.array([None] * batch.num_rows, pa.binary())]
            waiting, closing = (pa.RecordBatch.from_arrays(c, names=[*names, *work.made, _AGE, _PART, _FIRST, _END]) for c in (columns, [*columns[:-1], pa.array(end, pa.binary())]))
            last_batch = closing
        if waiting is not None:
            yield last_batch

    schema = ", ".join([*kinds, *made, f"{_AGE} long, {_PART} long, {_FIRST} boolean, {_END} binary"])
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    written = materialize(dealt.mapInArrow(first_pass, schema), "scan")
    before = _befores({r[_PART]: pickle.loads(r[_END]) for r in written.filter(F.col(_END).isNotNull()).select(_PART, _END).collect()}, work)  # a row for each range

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.where(batch.column(_FIRST).to_numpy(zero_copy_only=False), batch.column(_PART).to_numpy(), -1)
            edges = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            outs: dict[str, list[pa.Array]] = {k: [] for k in work.out}
            for a, b in zip(edges[:-1], edges[1:]):
                piece = batch.slice(a, b - a)
                out = work.finish({k: piece.column(k) for k in work.made}, piece.column(_AGE).to_numpy(), before.get(int(where[a])))
                for k in work.out:
                    outs[k].append(_array(out[k]))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.concat_arrays(outs[k]) for k in work.out)], names=[*names, *work.out])

    return written.drop(_END).mapInArrow(second_pass, ", ".join([*kinds, *(f"`{k}` {v}" for k, v in work.out.items())]))


def _befores(ends: dict[int, tuple], work: Scan) -> dict[int, Any]:
    """What comes before the first key of each range that goes on with its predecessor's last one."""
    out: dict[int, Any] = {}
    last, state = None, None
    for part in sorted(ends):
        first, final, whole, own = ends[part]
        goes_on = last is not None and last[0] == first
        if goes_on:
            out[part] = state
        state = work.combine(state, own) if goes_on and whole else own
        last = (final,)
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    """Doubles; a null counts as 0."""
    return column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)


class _Number(Scan):
    """Needs only how many rows there are, so any column serves."""

    def __init__(self, name: str, column: str):
        self.columns, self.name, self.made, self.out, self.start = [column], name, {}, {name: "long"}, 0

    def local(self, rows, state):
        return {}, state + len(rows[self.columns[0]])

    def combine(self, before, after):
        return before + after

    def finish(self, made, age, before):
        return {self.name: age + 1 + (before or 0)}


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "seq", parts: int | None = None) -> DataFrame:
    """Each row's place in its key's order, from 1: what row_number() gives, without a task for a whole key."""
    return scan(df, keys, order, _Number(name, order[0]), parts)


class _Last(Scan):
    def __init__(self, column: str, name: str, kind: str):
        self.columns, self.name, self.made, self.out, self.start = [column], name, {name: kind}, {name: kind}, None

    def local(self, rows, state):
        column = rows[self.columns[0]]
        known = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), np.arange(len(column)), -1))
        found = column.take(pa.array(np.where(known < 0, 0, known), mask=known < 0))
        if state is not None and known[0] < 0:
            ahead = int((known < 0).sum())
            found = pa.concat_arrays([pa.array([state[0]] * ahead, column.type), found.slice(ahead)])
        return {self.name: found}, ((found[len(found) - 1].as_py(),) if found[len(found) - 1].is_valid else state)

    def combine(self, before, after):
        return before if after is None else after

    def finish(self, made, age, before):
        found = made[self.name]
        if before is None or not found.null_count:
            return {self.name: found}
        return {self.name: pa.array([before[0] if x is None else x for x in found.to_pylist()], found.type)}


def last_known(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, parts: int | None = None) -> DataFrame:
    """The last value of a column that is not null, up to and with each row of its key; as-of for keys of any size."""
    return scan(df, keys, order, _Last(column, name, df.schema[column].dataType.simpleString()), parts)


class _Linear(Scan):
    """y = Cs + Dx, s' = As + Bx, for one input: the direct form of a filter with taps b and feedback a."""

    def __init__(self, x: str, b: list[float], a: list[float], name: str):
        n = max(len(b), len(a) + 1)
        b, a = np.pad(np.array(b, float), (0, n - len(b))), np.pad(np.array(a, float), (0, n - 1 - len(a)))
        self.order = n - 1
        self.A = np.zeros((n - 1, n - 1))
        self.A[:, :1] = -a[:, None]
        self.A[:-1, 1:] += np.eye(max(n - 2, 0))
        self.B, self.D = b[1:] - a * b[0], b[0]
        self.columns, self.name, self.made, self.out, self.start = [x], name, {name: "double"}, {name: "double"}, (0, np.zeros(n - 1))
        self.powers = [np.eye(n - 1)]
        for _ in range(BLOCK):
            self.powers.append(self.A @ self.powers[-1])
        self.rows = np.array([p[0] for p in self.powers]) if self.order else np.zeros((BLOCK + 1, 0))  # what a state gives after t rows

    def local(self, rows, state):
        x = _numbers(rows[self.columns[0]])
        n, s = len(x), state[1]
        if not self.order:
            return {self.name: self.D * x}, (state[0] + n, s)
        blocks = -(-n // BLOCK)
        grid = np.pad(x, (0, blocks * BLOCK - n)).reshape(blocks, BLOCK)
        states, y = np.zeros((blocks, self.order)), np.empty((blocks, BLOCK))
        ends = np.zeros((blocks, self.order))
        rest = n - (blocks - 1) * BLOCK  # rows of the last block
        for t in range(BLOCK):  # all blocks beside each other, each from an empty state
            y[:, t] = states[:, 0] + self.D * grid[:, t]
            states = states @ self.A.T + grid[:, t, None] * self.B
            if t == rest - 1:
                ends[-1] = states[-1]
        ends[:-1] = states[:-1]
        begins = np.empty((blocks, self.order))
        for k in range(blocks):
            begins[k] = s
            s = self.powers[BLOCK if k < blocks - 1 else rest] @ s + ends[k]
        y += begins @ self.rows[:BLOCK].T
        return {self.name: y.reshape(-1)[:n]}, (state[0] + n, s)

    def _power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.A, n) if self.order else self.A

    def combine(self, before, after):
        return before[0] + after[0], self._power(after[0]) @ before[1] + after[1]

    def finish(self, made, age, before):
        y = made[self.name]
        if before is None or not self.order:
            return {self.name: y}
        base, first = np.divmod(age, BLOCK)
        starts = {k: self._power(int(k) * BLOCK) @ before[1] for k in np.unique(base)}
        states = np.array([starts[k] for k in base.tolist()]).reshape(len(age), self.order)
        return {self.name: y.to_numpy(zero_copy_only=False) + np.einsum("ij,ij->i", self.rows[first], states)}


def linear_filter(df: DataFrame, keys: list[str], order: list[str], x: str, b: list[float], a: list[float], name: str = "y", parts: int | None = None) -> DataFrame:
    """The recursive filter y[n] = b0 x[n] + b1 x[n-1] + ... - a1 y[n-1] - a2 y[n-2] - ... along each key's rows (`a` from a1
    on), from rest. A null x counts as 0."""
    if not b:
        raise ValueError("a filter has a tap at least")
    return scan(df, keys, order, _Linear(x, b, a, name), parts)


class _Tail(Scan):
    """What needs the last `size` values of a column."""

    def __init__(self, x: str, size: int, name: str):
        self.columns, self.size, self.name, self.start = [x], size, name, (0, np.zeros(0))
        self.out = {name: "double"}

    def combine(self, before, after):
        return before[0] + after[0], self._keep(np.concatenate([before[1], after[1]]))

    def _keep(self, values: np.ndarray) -> np.ndarray:
        return values[max(0, len(values) - self.size) :]


def _filtered(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """All sums of taps and values that lie whole within x; by blocks of transforms where there are many taps."""
    if len(taps) < 64:
        return np.convolve(x, taps, "valid")
    n = 1 << (4 * len(taps) - 1).bit_length()
    step, spectrum, out = n - len(taps) + 1, np.fft.rfft(taps, n), []
    for at in range(0, len(x) - len(taps) + 1, step):
        piece = x[at : at + n]
        out.append(np.fft.irfft(np.fft.rfft(piece, n) * spectrum, n)[len(taps) - 1 : len(piece)])
    return np.concatenate(out)


class _Convolution(_Tail):
    def __init__(self, x: str, taps: list[float], name: str):
        super().__init__(x, len(taps) - 1, name)
        self.taps, self.made = np.array(taps, float), {name: "double"}

    def local(self, rows, state):
        x = _numbers(rows[self.columns[0]])
        tail = np.pad(state[1], (self.size - len(state[1]), 0))
        both = np.concatenate([tail, x])
        return {self.name: _filtered(both, self.taps)}, (state[0] + len(x), self._keep(np.concatenate([state[1], x])))

    def finish(self, made, age, before):
        y = made[self.name]
        near = age < self.size
        if before is None or not near.any():
            return {self.name: y}
        tail = np.pad(before[1], (self.size - len(before[1]), self.size))
        extra = np.convolve(tail, self.taps, "valid")[: self.size] if self.size else np.zeros(0)
        y = y.to_numpy(zero_copy_only=False).copy()
        y[near] += extra[age[near]]
        return {self.name: y}


def convolve(df: DataFrame, keys: list[str], order: list[str], x: str, taps: list[float], name: str = "y", parts: int | None = None) -> DataFrame:
    """The sum of taps[k] x[n-k] along each key's rows; what lies before a key's first row, and a null, is 0. With 64 taps or
    more by overlap-save, in blocks of four times the taps."""
    if not taps:
        raise ValueError("a convolution has a tap at least")
    return scan(df, keys, order, _Convolution(x, taps, name), parts)


class _DelayedValues(_Tail):
    """made: the last `size` values up to each row of its range, as a list; finish() completes it from the tail before."""

    def __init__(self, x: str, period: int, depth: float, name: str):
        super().__init__(x, int(np.floor(2 * depth)) + 2, name)
        self.period, self.depth = period, depth
        self.made = {f"{name}_near": "array<double>"}

    def local(self, rows, state):
        x = _numbers(rows[self.columns[0]])
        both = np.concatenate([np.zeros(self.size - 1 - min(len(state[1]), self.size - 1)), state[1][max(0, len(state[1]) - self.size + 1) :], x])
        near = np.lib.stride_tricks.sliding_window_view(both, self.size)
        ends = pa.array(np.arange(len(x) + 1) * self.size, pa.int32())
        return {f"{self.name}_near": pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(near).reshape(-1)))}, (state[0] + len(x), self._keep(np.concatenate([state[1], x])))

    def finish(self, made, age, before):
        lists = made[f"{self.name}_near"]
        near = lists.flatten().to_numpy().reshape(len(age), self.size).copy()
        first = 0
        if before is not None:
            first, tail = before[0], np.pad(before[1], (self.size - len(before[1]), 0))
            for t in np.unique(age[age < self.size - 1]):
                near[age == t, : self.size - 1 - t] = tail[t + 1 :]
        place = age + first
        delay = self.depth * (1 + np.sin(2 * np.pi * (place % self.period) / self.period))
        whole, part = np.divmod(delay, 1.0)
        at, row = self.size - 1 - whole.astype(np.int64), np.arange(len(age))
        return {self.name: (1 - part) * near[row, at] + part * near[row, at - 1]}


def vibrato(df: DataFrame, keys: list[str], order: list[str], x: str, period: int, depth: float, name: str = "y", parts: int | None = None) -> DataFrame:
    """The stream read at a place that swings with a period (in rows) up to 2 depth rows behind each row, between two rows by
    their distance; what lies before a key's first row is 0."""
    if period < 1 or depth < 0:
        raise ValueError("a period has a row at least, and no place lies ahead")
    return scan(df, keys, order, _DelayedValues(x, period, depth, name), parts)


class _Tremolo(_Number):
    def __init__(self, x: str, period: int, depth: float, name: str):
        super().__init__(name, x)
        self.period, self.depth, self.made, self.out = period, depth, {f"{name}_x": "double"}, {name: "double"}

    def local(self, rows, state):
        x = _numbers(rows[self.columns[0]])
        return {f"{self.name}_x": x}, state + len(x)

    def finish(self, made, age, before):
        place = age + (before or 0)
        gain = 1 - self.depth / 2 * (1 - np.cos(2 * np.pi * (place % self.period) / self.period))
        return {self.name: made[f"{self.name}_x"].to_numpy(zero_copy_only=False) * gain}


def tremolo(df: DataFrame, keys: list[str], order: list[str], x: str, period: int, depth: float, name: str = "y", parts: int | None = None) -> DataFrame:
    """The stream times a gain that swings between 1 and 1 - depth with a period in rows."""
    return scan(df, keys, order, _Tremolo(x, period, depth, name), parts)


def crossfeed(df: DataFrame, keys: list[str], order: list[str], left: str, right: str, hertz: float, rate: float, level: float, parts: int | None = None) -> DataFrame:
    """Two channels, each with the lower part (below `hertz`) of the other one mixed in at a level from 0 to 1, and as much of
    its own lower part taken back: columns out_left and out_right."""
    q = float(np.exp(-2 * np.pi * hertz / rate))
    low = linear_filter(linear_filter(df, keys, order, left, [1 - q], [-q], "_low_left", parts), keys, order, right, [1 - q], [-q], "_low_right", parts)
    mix = lambda own, low_own, low_other: F.col(own) - level / 2 * F.col(low_own) + level / 2 * F.col(low_other)
    return low.withColumn("out_left", mix(left, "_low_left", "_low_right")).withColumn("out_right", mix(right, "_low_right", "_low_left")).drop("_low_left", "_low_right")
