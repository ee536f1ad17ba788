"""Packing by minimum bin slack.

A document becomes its ids and a closing id, cut into full windows and a rest shorter than the window. How often each rest
length occurs is one small histogram (fewer rows than the window is long), whatever the corpus holds. On the driver, a
bitset subset-sum dynamic programme takes the longest rest that is left and finds the multiset of remaining lengths that
fills the window closest to its capacity, walks back to count each length's uses, and applies that pattern as often as
the counts allow. The rests themselves stay distributed: each has a rank within its length, and the rank alone says which
pattern, which repetition and which offset it has. Ranks come from narrow rows, numbered within the parts that the tasks
wrote, so there are as many parts as the corpus asks for; the ids join their places last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.byte_encoder import encoder
from tidemark.llm.shared import keyed, materialize, tidy
from tidemark.llm.token_counts import byte_balanced

def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How often to use each length so that the sum is the largest at most `capacity`; no length more often than it occurs."""
    reach, steps = 1, []
    full = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], capacity // length)
        part = 1
        while left > 0:  # 1, 2, 4, ... and the rest: every number of uses up to the count is a sum of these
            take = min(part, left)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & full
            left -= take
            part *= 2
        if reach >> capacity:
            break
    at, uses = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            uses[length] = uses.get(length, 0) + take
            at -= length * take
    return uses


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repetitions, uses of each length): every rest is used exactly once over all repetitions."""
    left = {k: v for k, v in counts.items() if v > 0}
    made = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        uses = best_fill({k: v for k, v in rest.items() if v and k <= capacity - longest}, capacity - longest)
        uses[longest] = uses.get(longest, 0) + 1
        times = min(left[k] // n for k, n in uses.items())
        made.append((times, uses))
        for k, n in uses.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return made


def layout(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Rows (length, first rank, ranks, uses, first sequence, offset), and the number of sequences."""
    rows, taken, sequences = [], dict.fromkeys(counts, 0), 0
    for times, uses in patterns(counts, capacity):
        offset = 0
        for length in sorted(uses, reverse=True):
            n = uses[length]
            rows.append((length, taken[length], n * times, n, sequences, offset))
            taken[length] += n * times
            offset += n * length
        sequences += times
    return rows, sequences


def _shrink(ids: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Ids as they travel: 2 bytes each where they fit, with a leading byte that tells, compressed."""
    small = int(ids.max(initial=0)) < 1 << 16
    return bytes([2 if small else 4]) + squeeze.compress(ids.astype("<u2" if small else "<u4").tobytes())


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each piece, in place of its payload (the fourth column)."""
    spread = zstandard.ZstdDecompressor()
    for batch in batches:
        ids = [np.frombuffer(spread.decompress(x[1:]), f"<u{x[0]}").astype(np.int32) for x in batch.column(3).to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
        columns = [lists if k == 3 else c for k, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def ids_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The CRC-32 of each packed piece's ids, as little-endian words of 4 bytes, in place of the ids (the fourth column)."""
    for batch in batches:
        ids = batch.column(3)
        ends, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        digests = pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())
        columns = [digests if k == 3 else c for k, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _pieces(tokenizer_path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [x or "" for x in texts]
            for part in byte_balanced(sizes, 8 << 20):
                tokens, payload = [], []
                for text in texts[part]:
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    cuts = range(0, len(ids), capacity)
                    tokens.append(len(ids))
                    payload.append([_shrink(ids[a : a + capacity], squeeze) for a in cuts] if with_ids else [zlib.crc32(ids[a : a + capacity]) for a in cuts])
                kind = pa.list_(pa.binary()) if with_ids else pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(tokens, pa.int64()), pa.array(payload, kind)], names=["doc_id", "doc_tokens", "payload"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (or, without with_ids, only ids_crc32), doc_tokens, sequence_id, offset.

    Sequences hold at most `capacity` ids; their pieces lie one after another from offset 0. A null text is an empty one
    and gives the closing id alone. Texts of any length are cut into as many pieces as they need. Repeated rows are
    documents of their own; of rests of one length those of lower rows come first. No rows: no rows. Other columns are
    dropped.
    """
    spark = docs.sparkSession
    rows = keyed(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long"), "text")
    kind = "array<binary>" if with_ids else "array<bigint>"
    cut = rows.mapInArrow(tidy(_pieces(tokenizer_path, capacity, end_id, with_ids)), f"doc_id long, doc_tokens long, payload {kind}")
    base = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    narrow = base.select("row", F.shiftright("row", 33).alias("part"), F.expr(f"doc_tokens div {capacity}").alias("n_full"), (F.col("doc_tokens") % capacity).cast("int").alias("rest"))

    counted = materialize(narrow.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum("n_full").alias("n_full")), "rest-counts")
    counts = {r["rest"]: r["n"] for r in counted.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    counts.pop(0, None)
    table, sequences = layout(counts, capacity)  # a pattern uses up a length at least, and has fewer lengths than sqrt(2 * capacity)
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    first_rank = F.coalesce(F.sum("n").over(so_far(Window.partitionBy("rest").orderBy("part"))), F.lit(0))
    first_full = F.coalesce(F.sum("n_full").over(so_far(Window.partitionBy(F.lit(0)).orderBy("part"))), F.lit(0)) + sequences  # a row for each part
    ranks = counted.filter("rest > 0").select("part", "rest", first_rank.alias("first_of_part"))
    fulls = counted.groupBy("part").agg(F.sum("n_full").alias("n_full")).select("part", first_full.alias("first_full"))
    places = F.broadcast(spark.createDataFrame(table, "of int, first_rank long, n_ranks long, uses long, first_sequence long, base long"))

    before = F.sum("n_full").over(so_far(Window.partitionBy("part").orderBy("row")))
    full = narrow.filter("n_full > 0").withColumn("before", F.coalesce(before, F.lit(0))).join(fulls, "part").select("row", (F.col("first_full") + F.col("before")).alias("full_at"))
    nth = F.row_number().over(Window.partitionBy("part", "rest").orderBy("row")) - 1
    rest = narrow.filter("rest > 0").withColumn("nth", nth).join(ranks, ["part", "rest"]).select("row", "rest", (F.col("first_of_part") + F.col("nth")).alias("rank"))
    rest = rest.join(places, (F.col("rest") == F.col("of")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n_ranks")))
    rest = rest.select("row", (F.col("first_sequence") + F.expr("(rank - first_rank) div uses")).alias("rest_at"), (F.col("base") + F.expr("(rank - first_rank) % uses") * F.col("rest")).cast("long").alias("rest_offset"))

    whole = F.size("payload") - F.when(F.col("rest_at").isNull(), 0).otherwise(1)
    placed = base.join(full.join(rest, "row", "full_outer"), "row").withColumn("whole", whole)
    each = placed.select("doc_id", "doc_tokens", "full_at", "rest_at", "rest_offset", "whole", F.posexplode("payload").alias("k", "payload"))
    last = F.col("k") == F.col("whole")
    out = each.select(
        "doc_id", (F.col("k") * F.lit(capacity)).cast("long").alias("start"), F.when(last, F.col("doc_tokens") % capacity).otherwise(F.lit(capacity)).cast("long").alias("length"), "payload", "doc_tokens",
        F.when(last, F.col("rest_at")).otherwise(F.col("full_at") + F.col("k")).cast("long").alias("sequence_id"), F.when(last, F.col("rest_offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )
    if not with_ids:
        return out.withColumnRenamed("payload", "ids_crc32")
    return out.mapInArrow(tidy(_grow), "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long")
