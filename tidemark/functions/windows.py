"""Coefficients of windows for signals, as expressions of the index."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cosine terms of the usual windows.
COSINES = {
    "rect": (1.0,),
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "bharris": (0.35875, 0.48829, 0.14128, 0.01168),
    "bnuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "nuttall": (0.355768, 0.487396, 0.144232, 0.012604),
    "flattop": (1.0, 1.985844164102, 1.791176438506, 1.282075284005, 0.667777530266, 0.240160796576, 0.056656381764, 0.008134974479, 0.000624544650, 0.000019808998, 0.000000132974),
}


def coefficient(name: str, n: Column, size: int) -> Column:
    """Coefficient n (from 0) of `size`: the cosine windows above, and bartlett, welch, sine, lanczos, gauss, tukey, bhann."""
    x = n.cast("double")
    last, half = size - 1, (size - 1) / 2
    if name in COSINES:
        total = F.lit(0.0)
        for k, a in enumerate(COSINES[name]):
            total = total + F.lit((-1) ** k * a) * F.cos(x * (2 * math.pi * k / last))
        return total
    if name == "bartlett":
        return 1 - F.abs((x - half) / half)
    if name == "welch":
        return 1 - F.pow((x - half) / half, F.lit(2))
    if name == "sine":
        return F.sin(x * (math.pi / last))
    if name == "bhann":
        return 0.62 - 0.48 * F.abs(x / last - 0.5) - 0.38 * F.cos(x * (2 * math.pi / last))
    if name == "lanczos":
        t = (2 * x / last - 1) * math.pi
        return F.when(t == 0, F.lit(1.0)).otherwise(F.sin(t) / t)
    if name == "gauss":
        return F.exp(-0.5 * F.pow((x - half) / (0.4 * half), F.lit(2)))
    if name == "tukey":
        edge = F.abs(x - half)
        return F.when(edge < 0.3 * half, F.lit(1.0)).otherwise(0.5 * (1 + F.cos(math.pi * (edge - 0.3 * half) / (0.7 * half))))
    raise ValueError(f"no window named {name!r}")
