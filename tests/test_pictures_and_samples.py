"""Pictures and samples against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import samples
from tidemark.operators import pictures


def test_the_best_place_is_that_of_brute_force():
    rnd = np.random.default_rng(2)
    for trial in range(300):
        most = [2, 4, 256][trial % 3]
        picture = rnd.integers(0, most, rnd.integers(1, 14, 2)).astype(np.uint8)
        small = rnd.integers(0, most, rnd.integers(1, 8, 2)).astype(np.uint8)
        if trial % 4 == 0 and min(picture.shape) > 3:
            small = picture[1:3, 1:4].copy()
        rows, columns = picture.shape[0] - small.shape[0] + 1, picture.shape[1] - small.shape[1] + 1
        every = [(int(np.abs(picture[r : r + small.shape[0], c : c + small.shape[1]].astype(int) - small).sum()), r, c) for r in range(rows) for c in range(columns)]
        want = (min(every)[1], min(every)[2], min(every)[0]) if every else None
        assert pictures.best_place(picture, small) == want


def test_turns_and_colours_of_odd_sizes(spark):
    plane = np.arange(15, dtype=np.uint8).reshape(3, 5)
    rows = spark.createDataFrame([(plane.tobytes(), 5, 3), (None, 5, 3)], "p binary, w int, h int")
    for degrees, k in ((90, -1), (180, 2), (270, 1)):
        got = rows.select(pictures.turned(F.col("p"), F.col("w"), F.col("h"), degrees).alias("t")).collect()
        assert bytes(got[0]["t"]) == np.rot90(plane, k).tobytes() and got[1]["t"] is None
    with pytest.raises(ValueError):
        pictures.turned(F.col("p"), F.col("w"), F.col("h"), 45)
    data = bytes([16, 235, 81, 255, 0, 145, 41, 200, 100, 90, 81, 120, 50, 60, 70]) + bytes([128, 90, 240, 255, 128, 0]) + bytes([128, 240, 110, 0, 255, 128])
    got = bytes(spark.createDataFrame([(data,)], "p binary").select(pictures.rgba_of(F.col("p"), F.lit(5), F.lit(3)).alias("c")).first()["c"])
    want = b""
    for r in range(3):
        for c in range(5):
            y, u, v = data[r * 5 + c] - 16, data[15 + r // 2 * 3 + c // 2] - 128, data[21 + r // 2 * 3 + c // 2] - 128
            red, green, blue = y * pictures.LUMA + v * pictures.RED_V, y * pictures.LUMA - v * pictures.GREEN_V - u * pictures.GREEN_U, y * pictures.LUMA + u * pictures.BLUE_U
            want += bytes([*(min(255, max(0, x >> 20)) for x in (red, green, blue)), 255])
    assert got == want
    with pytest.raises(Exception, match="bytes for a plane"):
        rows.select(pictures.rgba_of(F.col("p"), F.lit(50), F.lit(3))).collect()


def test_a_picture_that_does_not_fit(spark):
    rows = spark.createDataFrame([(bytes(4), 2, 2, bytes(9), 3, 3), (bytes(9), 3, 3, bytes(4), 2, 2), (None, 3, 3, bytes(4), 2, 2)], "a binary, w int, h int, b binary, v int, g int")
    got = rows.select(pictures.found_in(*[F.col(c) for c in ("a", "w", "h", "b", "v", "g")]).alias("f")).collect()
    assert got[0]["f"] is None and tuple(got[1]["f"]) == (0, 0, 0) and got[2]["f"] is None


def test_sample_layouts_and_formats(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first()["x"]
    ints = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    assert one(samples.planar(ints(1, 2, 3, 4, 5, 6, 7), 2)) == [[1, 3, 5], [2, 4, 6]]
    assert one(samples.interleaved(samples.planar(ints(1, 2, 3, 4, 5, 6, 7), 3))) == [1, 2, 3, 4, 5, 6]
    assert one(samples.planar(ints(1), 2)) == [[], []] and one(samples.interleaved(F.array(ints(1), F.array().cast("array<bigint>")))) == []
    floats = F.array(*[F.lit(x) for x in (0.0, 1.0, -1.0, 2.0, -2.0, 0.5 / 32768, 1.5 / 32768, -0.5 / 32768)])
    assert one(samples.converted(floats, "flt", "s16")) == [0, 32767, -32768, 32767, -32768, 0, 2, 0]
    assert one(samples.converted(floats, "flt", "u8")) == [128, 255, 0, 255, 0, 128, 128, 128]
    assert one(samples.converted(ints(0, 255, 127), "u8", "s16")) == [-32768, 32512, -256] and one(samples.converted(ints(-32768, -1, 32767), "s16", "u8")) == [0, 127, 255]
    assert one(samples.converted(ints(-1, 1), "s16", "s32")) == [-65536, 65536] and one(samples.converted(ints(-32768, 16384), "s16", "flt")) == [-1.0, 0.5]
    planes = F.array(ints(30000, -30000, 1), ints(10000, -10000, 2))
    assert one(samples.mixed(planes, [[1.0, 1.0], [0.5, 0.0], [0.0, 0.0]], 16)) == [[32767, -32768, 3], [15000, -15000, 0], [0, 0, 0]]
