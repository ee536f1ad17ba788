"""Conversions of audio samples in array columns: layouts, number formats and channel mixes, rounded and saturated.

A format is s16, s32 or u8 (whole numbers) or flt (from -1 to 1). From flt values are rounded half to even and saturated;
between whole formats bits are added as zeros or cut off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of each format, and what silence is in it.
FORMATS = {"u8": (8, 128), "s16": (16, 0), "s32": (32, 0)}


def planar(samples: Column, channels: int) -> Column:
    """An array for each channel of interleaved samples; a last, incomplete group of them is left out."""
    n = F.floor(F.size(samples) / channels).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def of(channel: int) -> Column:
        return F.transform(places, lambda i: F.get(samples, i * channels + channel))

    return F.when(samples.isNotNull(), F.array(*[of(c) for c in range(channels)]))


def interleaved(planes: Column) -> Column:
    """The samples of all channels in turn; as many of each as the shortest has."""
    n = F.array_min(F.transform(planes, lambda p: F.size(p)))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(places, lambda i: F.transform(planes, lambda p: F.get(p, i))))


def _saturated(value: Column, bits: int, middle: int) -> Column:
    half = 1 << (bits - 1)
    return F.least(F.greatest(value, F.lit(-half)), F.lit(half - 1)) + middle


def converted(samples: Column, old: str, new: str) -> Column:
    """Samples of one format in another: bigint for whole formats, double for flt."""
    if old == new:
        return samples
    if old == "flt":
        bits, middle = FORMATS[new]
        return F.transform(samples, lambda x: _saturated(F.rint(x * float(1 << (bits - 1))), bits, middle).cast("long"))
    bits, middle = FORMATS[old]
    if new == "flt":
        return F.transform(samples, lambda x: (x - middle) / float(1 << (bits - 1)))
    more, to = FORMATS[new]
    scale = (lambda x: F.shiftleft(x, more - bits)) if more > bits else (lambda x: F.shiftright(x, bits - more))
    return F.transform(samples, lambda x: scale(x.cast("long") - middle) + to)


def mixed(planes: Column, matrix: list[list[float]], bits: int | None = None) -> Column:
    """Planes whose samples are sums of those of `planes` times a row of the matrix each; with `bits` whole numbers, rounded
    half to even and saturated."""
    places = F.sequence(F.lit(0), F.array_min(F.transform(planes, lambda p: F.size(p))) - 1)

    def one(row: list[float]) -> Column:
        def at(i: Column) -> Column:
            total = F.lit(0.0)
            for k, weight in enumerate(row):
                if weight:
                    total = total + F.get(F.get(planes, F.lit(k)), i) * weight
            return _saturated(F.rint(total), bits, 0).cast("long") if bits else total

        return F.transform(places, at)

    return F.array(*[one(r) for r in matrix])
