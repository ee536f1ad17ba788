"""Adaptive bitrate: replays a log of segment downloads against a ladder."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folds import fold

#: Fixed values of the rule.
RISE_DELAY_MS, DROP_BUFFER_MS = 20_000, 18_000
FIRST_LIMIT, LIMIT = 3_000_000, 10_000_000
HEADROOM_TENTHS, TRANSFER_TENTHS, DROP_PERCENT = 13, 11, 80
#: A ladder is short by nature; one of more rungs is refused.
MOST_RUNGS = 1000
LOG = ["n", "measured", "transfer_ms", "start_ms", "buffer_ms"]


class State(NamedTuple):
    """The rung, how often it was changed, and the start of the segment at which it was changed last."""

    at: int = 0
    n_changes: int = 0
    last_change: int = 0


def ladder(rungs: DataFrame, key: str = "stream_id", bitrate: str = "bitrate") -> list[tuple[int, int]]:
    """(stream, bitrate) by rising bitrate; of equal ones the later stream comes first."""
    rows = rungs.select(key, bitrate).orderBy(F.col(bitrate).asc(), F.col(key).desc()).limit(MOST_RUNGS + 1).collect()
    if len(rows) > MOST_RUNGS:
        raise ValueError(f"a ladder has at most {MOST_RUNGS} rungs")
    return [(r[0], r[1]) for r in rows]


def decide(state: State, rates: list[int], measured: int, transfer_ms: int, start_ms: int, buffer_ms: int, strict: bool) -> tuple[State, bool]:
    """The state after one download, and whether the rung changed."""
    limit = FIRST_LIMIT if state.n_changes == 0 and len(rates) > 2 else LIMIT
    fit = sum(b * HEADROOM_TENTHS <= measured * 10 and b < limit for b in rates)
    want = max(0, fit - 1)
    cur, new = rates[state.at], rates[want]
    if measured <= 0 or want == state.at:
        return state, False
    if new > cur and (start_ms < state.last_change + RISE_DELAY_MS or transfer_ms * (new // cur) * TRANSFER_TENTHS // 10 > buffer_ms):
        return state, False
    ample = cur * DROP_PERCENT * 100 < measured if strict else cur * DROP_PERCENT < measured * 100
    if new < cur and buffer_ms > DROP_BUFFER_MS and ample:
        return state, False
    return State(want, state.n_changes + 1, start_ms), True


def replay(log: DataFrame, rungs: list[tuple[int, int]], keys: list[str], start_rung: int = 0, forced_stream: int | None = None, strict_reference: bool = True) -> DataFrame:
    """The rung after each download: keys, n, stream_id, bitrate, changed.

    log: keys, n (order), measured (bits a second), transfer_ms, start_ms, buffer_ms, as whole numbers. The highest rung
    with 1.3 times its bitrate measured and under the limit is wanted, else the lowest. A rise waits 20 s of media from
    the last change and needs the buffer to last the longer transfer; a drop is put off while the buffer is long and the
    measured rate is ample. strict_reference keeps the original's factor of 8000 for "ample", else it is 80 %. A measured
    rate of 0 decides nothing. Each key's downloads are read one after another.
    """
    ids, rates = [s for s, _ in rungs], [int(b) for _, b in rungs]
    if forced_stream is not None and forced_stream not in ids:
        raise ValueError(f"no stream {forced_stream} in the ladder")
    start = State(ids.index(forced_stream) if forced_stream is not None else start_rung)

    def step(state: State, row: tuple) -> tuple[State, list[tuple]]:
        n, *measure = row
        changed = False
        if forced_stream is None:
            state, changed = decide(state, rates, *measure, strict_reference)
        return state, [(n, ids[state.at], rates[state.at], changed)]

    rows = log.select(*keys, *[F.col(c).cast("long").alias(c) for c in LOG])
    return fold(rows, keys, LOG, LOG, start, step, "n long, stream_id int, bitrate long, changed boolean")
