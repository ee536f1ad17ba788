"""Pictures in binary columns: colours, turns, and the search for a small picture in a large one. Each row is a picture; its
bytes go through numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shares of brightness and of the two colour differences in red, green and blue, in 20 bits below the point.
SHIFT = 20
LUMA, RED_V, GREEN_V, GREEN_U, BLUE_U = 1220542, 1673527, 852492, 411041, 2114977


def to_rgba(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Red, green, blue and 255 of each pixel of a picture whose colour planes have half its width and height."""
    wide = lambda p: np.repeat(np.repeat(p.astype(np.int64) - 128, 2, 0), 2, 1)[: y.shape[0], : y.shape[1]]
    bright, du, dv = (y.astype(np.int64) - 16) * LUMA, wide(u), wide(v)
    parts = [bright + dv * RED_V, bright - dv * GREEN_V - du * GREEN_U, bright + du * BLUE_U]
    return np.stack([*(np.clip(p >> SHIFT, 0, 255) for p in parts), np.full(y.shape, 255)], axis=-1).astype(np.uint8)


def _plane(data: bytes, width: int, height: int) -> np.ndarray:
    if len(data) < width * height:
        raise ValueError(f"{len(data)} bytes for a plane of {width} by {height}")
    return np.frombuffer(data, np.uint8, width * height).reshape(height, width)


def rgba_of(picture: Column, width: Column, height: Column) -> Column:
    """The pixels, of four bytes each, of a picture of three planes one after another: brightness, and two colour differences
    of half its width and height, rounded up. Null gives null; fewer bytes than the planes have are an error."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for d, x, y in zip(data, w, h):
            if d is None:
                out.append(None)
                continue
            d, x, y = bytes(d), int(x), int(y)
            cx, cy = -(-x // 2), -(-y // 2)
            out.append(to_rgba(_plane(d, x, y), _plane(d[x * y :], cx, cy), _plane(d[x * y + cx * cy :], cx, cy)).tobytes())
        return pd.Series(out, dtype=object)

    return run(picture, width, height)


def turned(plane: Column, width: Column, height: Column, degrees: int, size: int = 1) -> Column:
    """A plane of pixels of `size` bytes turned clockwise by 90, 180 or 270 degrees."""
    if degrees not in (90, 180, 270):
        raise ValueError("a turn is one of 90, 180 or 270 degrees")

    @F.pandas_udf("binary")
    def run(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        one = lambda d, x, y: np.ascontiguousarray(np.rot90(_plane(bytes(d), x * size, y).reshape(y, x, size), -(degrees // 90))).tobytes()
        return pd.Series([None if d is None else one(d, int(x), int(y)) for d, x, y in zip(data, w, h)], dtype=object)

    return run(plane, width, height)


def _sums(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """The sum of each rectangle of a size, from the picture's integral image."""
    total = np.zeros((picture.shape[0] + 1, picture.shape[1] + 1), np.int64)
    total[1:, 1:] = picture.astype(np.int64).cumsum(0).cumsum(1)
    return total[height:, width:] - total[:-height, width:] - total[height:, :-width] + total[:-height, :-width]


def best_place(picture: np.ndarray, small: np.ndarray) -> tuple[int, int, int] | None:
    """(row, column, sum of absolute differences) of the place where the small picture fits best, the first of equal ones.

    The difference of the sums of a part can be no more than the sum of its differences. So places are sifted from coarse
    to fine, first by the sums of the whole, then of its halves and so on, and compared pixel by pixel only where these
    leave hope.
    """
    rows, columns = picture.shape[0] - small.shape[0] + 1, picture.shape[1] - small.shape[1] + 1
    if rows < 1 or columns < 1 or not small.size:
        return None
    picture, small = picture.astype(np.int64), small.astype(np.int64)
    exact = lambda r, c: int(np.abs(picture[r : r + small.shape[0], c : c + small.shape[1]] - small).sum())
    least = np.zeros((rows, columns), np.int64)
    parts = 1
    best: tuple[int, int, int] | None = None
    while True:
        ys, xs = (np.unique(np.linspace(0, n, min(parts, n) + 1).astype(int)) for n in small.shape)
        bound = np.zeros((rows, columns), np.int64)
        for a, b in zip(ys[:-1], ys[1:]):
            for c, d in zip(xs[:-1], xs[1:]):
                bound += np.abs(_sums(picture, b - a, d - c)[a : a + rows, c : c + columns] - small[a:b, c:d].sum())
        least = np.maximum(least, bound)
        r, c = divmod(int(least.argmin()), columns)
        found = (exact(r, c), r, c)
        best = min(found, best) if best else found
        if parts >= 4 or parts >= max(small.shape):
            break
        parts *= 2
    for at in np.flatnonzero(least.reshape(-1) <= best[0]).tolist():
        r, c = divmod(at, columns)
        if least[r, c] <= best[0]:
            best = min(best, (exact(r, c), r, c))
    return best[1], best[2], best[0]


def found_in(picture: Column, width: Column, height: Column, small: Column, small_width: Column, small_height: Column) -> Column:
    """struct<row, column, difference> of the best place of one plane of bytes in another; null where it does not fit in."""

    @F.pandas_udf("row int, column int, difference long")
    def run(d: pd.Series, w: pd.Series, h: pd.Series, s: pd.Series, v: pd.Series, g: pd.Series) -> pd.DataFrame:
        found = [None if a is None or b is None else best_place(_plane(bytes(a), int(x), int(y)), _plane(bytes(b), int(p), int(q))) for a, x, y, b, p, q in zip(d, w, h, s, v, g)]
        made = pd.DataFrame([f or (None, None, None) for f in found], columns=["row", "column", "difference"])
        return made.astype({"row": "Int32", "column": "Int32", "difference": "Int64"})

    made = run(picture, width, height, small, small_width, small_height)
    return F.when(made["row"].isNotNull(), made)
