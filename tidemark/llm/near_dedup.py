"""MinHash near-duplicates with odd sketches.

1. Every text's set of word shingles gives MinHash samples; runs of samples make band keys, and all samples folded into a
   parity bitmap make an odd sketch, of which two differ in as many bits as a high similarity predicts.
2. Documents with equal sets count as one from here on, however many they are.
3. Documents that share a band key meet in blocks of bounded size. Their sketches alone say which pairs may be similar; a
   block gives back a spanning forest of these pairs, never all of them. Its components are families.
4. Only members of families have their sets built again. They meet in blocks of bounded size, and every pair of a family is
   decided on the full sets, except those that links found before connect already. A block gives back a spanning forest of
   the links, and the components of all forests are the classes.

A bucket or family of more than one block is dealt to blocks twice, by two hashes, so that its links, if they are many, make
one component of it. Then only what is outside that component meets all of the others, and nothing does if nothing is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import ascii_lower, grouped, keyed, materialize, tidy
from tidemark.llm.token_counts import balanced

#: 32 bands of 5 samples miss a pair of similarity 0.8 with a chance of 3 in a million.
BANDS, ROWS, BITS = 32, 5, 512
SAMPLES = BANDS * ROWS
#: A pair with a lower estimate is not looked at again; for one of similarity 0.8 that is 5 standard deviations off.
LEAST_ESTIMATE = 0.6
#: In hundredths: 0.75 is 4 standard deviations above that estimate, and 32 bands of 5 miss it with a chance of 1 in 5,000.
LEAST_SHARE = 75
#: Documents of a bucket, and shingles and documents of a family, in one block.
BUCKET_BLOCK, FAMILY_SHINGLES, FAMILY_BLOCK = 1024, 600_000, 2000
#: Rows of buckets, and shingles of families, that one task is meant for.
TASK_ROWS, TASK_SHINGLES = 40_000, 4_000_000
SALTS = 16
_STEP = 512
_rng = np.random.default_rng(20)
_XOR = _rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_MULTIPLY = _rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * _ODD
    return x ^ (x >> np.uint64(32))


def _split(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words, which of them each word is, and the number of words of each text; null texts have none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = split.flatten().cast(pa.large_binary()).dictionary_encode()
    words = flat.dictionary.to_pylist()
    index, sizes = flat.indices.to_numpy(zero_copy_only=False), np.diff(split.offsets.to_numpy())
    empty = np.fromiter((not w for w in words), bool, len(words))
    if empty.any():  # what is left of white space at the ends
        stay = ~empty[index]
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[stay], minlength=len(sizes))
        index = index[stay]
    return words, index, sizes.astype(np.int64)


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each text; null texts have none."""
    import xxhash

    words, index, sizes = _split(texts)
    # Letters are lowered word by word: Arrow's own ascii_lower garbles arrays whose offsets do not begin at 0.
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(ascii_lower(w) if lower else w) for w in words), np.uint64, len(words))
    return hashes[index] if len(words) else np.zeros(0, np.uint64), sizes


def wide_word_hashes(texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The lower and the upper halves of 128-bit hashes of all words, and the number of words of each text."""
    import xxhash

    words, index, sizes = _split(texts)
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words), ">u8").reshape(-1, 2).astype(np.uint64)
    return (both[index, 1], both[index, 0]), sizes


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; fewer words than `size` make one shingle."""
    hashes, counts = word_hashes(texts, lower=True)
    at = 0
    for n in counts.tolist():
        words = hashes[at : at + n]
        at += n
        if not n:
            yield words
            continue
        k = min(n, size)
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = mix(h * _ODD + words[i : n - k + 1 + i])
        yield np.unique(h)


def samples_of(shingles: np.ndarray) -> np.ndarray:
    """The least value under each of SAMPLES scramblings of the shingles' upper halves."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), _STEP):
        part = (x[a : a + _STEP, None] ^ _XOR) * _MULTIPLY
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row of samples and band."""
    rows = samples.astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * _ODD + rows[:, :, i])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Each row's samples folded into BITS parity bits."""
    spot = mix(samples.astype(np.uint64) * _ODD + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)
    cell = np.arange(len(samples), dtype=np.int64)[:, None] * BITS + spot.astype(np.int64)
    odd = np.bincount(cell.ravel(), minlength=len(samples) * BITS).reshape(-1, BITS) & 1
    return np.packbits(odd.astype(bool), axis=1)


def most_differing(least: float) -> int:
    """The number of differing bits that two odd sketches of this similarity are expected to have."""
    return math.floor(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - least) / BITS)))


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for part in balanced(lengths, 4 << 20):
                n = part.stop - part.start
                sets = list(shingle_sets(batch.column(1).slice(part.start, n), size))
                samples = np.array([samples_of(s) for s in sets], np.uint32)
                keys = band_keys(samples)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.ravel())), pa.array([x.tobytes() for x in odd_sketches(samples)], pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "keys", "sketch"],
                )

    return run


def _forest(label: np.ndarray, similar: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Edges between similar rows that join what their labels do not join yet: all of the largest label is tried last, and
    so not at all."""
    n, made, tried = len(label), [], np.zeros(len(label), bool)
    while True:
        left = np.flatnonzero(~tried & (label != np.bincount(label, minlength=n).argmax()))
        if not len(left):
            return made
        p = int(left[0])
        tried[p] = True
        for q in np.flatnonzero(similar(p) & (label != label[p])).tolist():
            if label[q] != label[p]:
                made.append((p, q))
                label[label == label[q]] = label[p]


_LINKS = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _as_links(rows: pa.Table, similar: Callable[[int], np.ndarray]) -> pa.Table | None:
    ids = rows.column("id").to_numpy()
    made = _forest(np.unique(rows.column("label").to_numpy(), return_inverse=True)[1], similar)
    return pa.table([pa.array([ids[i] for i, _ in made], pa.int64()), pa.array([ids[j] for _, j in made], pa.int64())], schema=_LINKS) if made else None


def _bucket_links(limit: int):
    """Per block: a spanning forest of the pairs whose sketches differ in at most `limit` bits."""

    def work(rows: pa.Table) -> pa.Table | None:
        bits = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        return _as_links(rows, lambda p: np.bitwise_count(bits ^ bits[p]).sum(axis=1, dtype=np.int64) <= limit)

    return lambda batches: grouped(batches, ["group", "block"], work, _LINKS)


def _set_links(share: tuple[int, int]):
    """Per block: a spanning forest of the links, decided on full sets."""
    much, of = share

    def work(rows: pa.Table) -> pa.Table | None:
        lists = pa.concat_arrays(rows.column("shingles").chunks)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words, code = np.unique(lists.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True)
        start = offsets - offsets[0]
        sizes, mark = np.diff(start), np.zeros(len(words), np.int32)

        def similar(p: int) -> np.ndarray:
            own = code[start[p] : start[p + 1]]
            mark[own] = 1
            shared = np.add.reduceat(mark[code], start[:-1])
            mark[own] = 0
            return of * shared >= much * (sizes + sizes[p] - shared)

        return _as_links(rows, similar)

    return lambda batches: grouped(batches, ["group", "block"], work, _LINKS)


def _sets(size: int):
    """id, text, group, block, label -> the set in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for part in balanced(lengths, 4 << 20):
                n = part.stop - part.start
                sets = [s.view(np.int64) for s in shingle_sets(batch.column(1).slice(part.start, n), size)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                shingles = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                columns = [batch.column(k).slice(part.start, n) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*columns, shingles], names=["id", "blocks", "shingles"])

    return run


def _twice(members: DataFrame) -> DataFrame:
    """group, id, n_blocks -> group, block, id, label: a row's block by one hash, and where there are more, by a second."""
    spot = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col("n_blocks"))
    where = F.when(F.col("n_blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array(spot(1), F.col("n_blocks") + spot(2)))
    return members.select("group", F.explode(where).alias("block"), "id", F.col("id").alias("label"))


def _outsiders(members: DataFrame, classes: DataFrame, tag: str) -> DataFrame:
    """group, id, n_blocks of groups of several blocks -> group, block, id, label for what is outside the group's largest
    class, in blocks, with each block of the group."""
    named = members.filter("n_blocks > 1").join(classes.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = materialize(named, f"{tag}-labels")
    sizes = named.groupBy("group", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("out"), F.sum("n").alias("n")).filter("out > 0")
    rows = named.join(materialize(main, f"{tag}-main"), "group").withColumn("few", F.ceil(F.col("out") * F.col("n_blocks") / F.col("n")))
    block = lambda r, a: F.col(r).cast("long") * (1 << 31) + F.col(a).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = rows.filter(F.col("label") != F.col("main")).withColumn("r", F.pmod(F.xxhash64("id", F.lit(3)), F.col("few"))).withColumn("a", every("n_blocks"))
    alls = rows.withColumn("a", F.pmod(F.xxhash64("id", F.lit(4)), F.col("n_blocks"))).withColumn("r", every("few"))
    columns = ["group", block("r", "a").alias("block"), "id", "label"]
    return rest.select(*columns).unionByName(alls.select(*columns)).distinct()


def _classes(links_of: Callable[[DataFrame], DataFrame], members: DataFrame, large: bool, tag: str) -> DataFrame:
    """id and component of what the links in the members' blocks reach; large: some group has several blocks."""
    classes = materialize(connected_components(links_of(_twice(members)), tag), tag)
    if large:
        more = materialize(links_of(_outsiders(members, classes, tag)), f"{tag}-more")
        if not more.isEmpty():
            stars = classes.select(F.col("id").alias("src"), F.col("component").alias("dst"))
            classes = materialize(connected_components(stars.unionByName(more), tag), tag)
    return classes


def _tasks(spark: SparkSession, work: int | None, each: int) -> int:
    """How many tasks share so much work; Spark would deal by bytes, of which sketches have few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), (work or 0) // each + 1)


def _in_blocks(rows: DataFrame, tasks: int, *columns: str) -> DataFrame:
    return rows.repartition(tasks, "group", "block").sortWithinPartitions("group", "block", "id").select("group", "block", "id", "label", *columns)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (it is that one) of every row.

    Two documents are linked when share[1] * intersection >= share[0] * union of their sets of shingles (A-Z in lower
    case), of 64-bit hashes; equal sets are those with equal 128-bit digests. share is 0.8 here, and refused under
    LEAST_SHARE, for which the bands are not made. Texts without words and null texts have an empty set and no link. Texts
    of any length are read whole. Rows with equal doc_id are one document with several texts. A null doc_id has no link, a
    null component and is kept. Other columns are dropped. No rows: no rows.
    """
    if share[0] * 100 < LEAST_SHARE * share[1]:
        raise ValueError(f"{BANDS} bands of {ROWS} are for shares of {LEAST_SHARE} % and more")
    rows = keyed(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_shingles long, digest binary, keys array<long>, sketch binary"
    features = materialize(rows.mapInArrow(tidy(_features(shingle_words)), schema), "minhash")

    able = features.filter("n_shingles > 0 and doc_id is not null")
    same = able.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same = materialize(same, "equal-sets")
    salted = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    class_of = able.select("doc_id", "digest", salt.alias("salt")).join(salted, ["digest", "salt"]).select("doc_id", "digest", "rep", "salt").distinct()
    class_of = materialize(class_of, "copies")
    several = able.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a != b")  # rows of one doc_id
    bridges = class_of.join(several, "doc_id").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    alone = able.join(class_of.filter("doc_id != rep").select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
    sketches = alone.select(F.col("doc_id").alias("id"), "sketch")

    banded = alone.select(F.col("doc_id").alias("id"), F.explode("keys").alias("group"))
    shared = materialize(banded.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1"), "shared-keys")
    met = banded.join(shared, "group").select("group", "id", F.ceil(F.col("n") / BUCKET_BLOCK).alias("n_blocks"))
    links = tidy(_bucket_links(most_differing(LEAST_ESTIMATE)))
    tasks = _tasks(docs.sparkSession, shared.agg(F.sum("n")).first()[0], TASK_ROWS)
    pairs = lambda blocks: _in_blocks(blocks.join(sketches, "id"), tasks, "sketch").mapInArrow(links, "src long, dst long")
    family = _classes(pairs, met, not shared.filter(F.col("n") > BUCKET_BLOCK).isEmpty(), "families").withColumnRenamed("component", "group")

    weighed = family.join(alone.select(F.col("doc_id").alias("id"), "n_shingles"), "id").groupBy("group").agg(F.sum("n_shingles").alias("w"), F.count("*").alias("n"))
    blocks = weighed.select("group", "w", F.greatest(F.ceil(F.col("w") / FAMILY_SHINGLES), F.ceil(F.col("n") / FAMILY_BLOCK)).cast("long").alias("n_blocks"))
    blocks = materialize(blocks, "family-blocks")
    set_tasks = _tasks(docs.sparkSession, blocks.agg(F.sum("w")).first()[0], TASK_SHINGLES)
    member = materialize(family.join(blocks.drop("w"), "group"), "members")

    def decided(where: DataFrame) -> DataFrame:
        """Links of the blocks that members are dealt to: a member's set is built once and sent to each of its blocks."""
        where = where.groupBy("id").agg(F.collect_list(F.struct("group", "block", "label")).alias("blocks"))
        texts = rows.join(where, rows["doc_id"] == where["id"]).select("id", "text", "blocks")
        built = texts.mapInArrow(tidy(_sets(shingle_words)), "id long, blocks array<struct<group:long,block:long,label:long>>, shingles array<long>").filter(F.size("shingles") > 0)
        dealt = built.select("id", "shingles", F.explode("blocks").alias("b")).select("id", "shingles", "b.*")
        return _in_blocks(dealt, set_tasks, "shingles").mapInArrow(tidy(_set_links(share)), "src long, dst long")

    together = lambda where: decided(where).unionByName(bridges)
    classes = _classes(together, member, not member.filter("n_blocks > 1").isEmpty(), "near-classes")
    # A copy is in the class of its set's first document, whose id is the smallest.
    of_reps = same.join(classes, same["rep"] == classes["id"]).select("rep", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of_copies = class_of.filter("doc_id != rep").join(of_reps, ["rep", "salt"], "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("component"))
    classes = classes.unionByName(of_copies).groupBy("id").agg(F.min("component").alias("component"))
    out = features.select("doc_id", "n_shingles").join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
