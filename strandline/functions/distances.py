"""Distances between array columns, and dynamic time warping."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.arrays import normalize, norm, total


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def centred_cosine(a: Column, b: Column) -> Column:
    """Cosine after the means are taken off: Pearson's correlation."""
    x, y = normalize(a, "mean"), normalize(b, "mean")
    return dot(x, y) / (norm(x) * norm(y))


def hamming_bits(a: Column, b: Column) -> Column:
    """Bits in which two longs differ."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two arrays differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l1": l1, "l2": l2, "l2sq": l2_squared, "dot": dot}


def envelope(a: Column, radius: int) -> tuple[Column, Column]:
    """Least and largest values within ``radius`` of each index."""
    part = lambda i: F.slice(a, F.greatest(i - radius, F.lit(0)) + 1, i + radius + 1 - F.greatest(i - radius, F.lit(0)))
    return F.transform(a, lambda x, i: F.array_min(part(i))), F.transform(a, lambda x, i: F.array_max(part(i)))


def lb_keogh(a: Column, b: Column, radius: int) -> Column:
    """A lower bound of the squared warped distance: what ``a`` exceeds the envelope of ``b``."""
    low, high = envelope(b, radius)
    over = F.zip_with(a, high, lambda x, u: F.greatest(x - u, F.lit(0.0)))
    under = F.zip_with(a, low, lambda x, v: F.greatest(v - x, F.lit(0.0)))
    return total(F.zip_with(over, under, lambda x, y: x * x + y * y))


def dtw_rows(a: np.ndarray, b: np.ndarray, radius: int, cost: Callable = lambda x, y: (x - y) ** 2) -> np.ndarray:
    """Warped distances of pairs of rows of equal length: the band is filled diagonal by diagonal, for all pairs at once."""
    n, m = a.shape
    before = np.full((n, m + 1), np.inf)
    before[:, 0] = 0
    for i in range(m):
        now = np.full((n, m + 1), np.inf)
        for j in range(max(0, i - radius), min(m, i + radius + 1)):
            now[:, j + 1] = cost(a[:, i], b[:, j]) + np.minimum(np.minimum(before[:, j], before[:, j + 1]), now[:, j])
        before = now
    return before[:, m]


def envelopes(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest values within ``radius`` of each place, of each row."""
    padded = lambda fill: np.pad(x, ((0, 0), (radius, radius)), constant_values=fill)
    windows = lambda a: np.lib.stride_tricks.sliding_window_view(a, 2 * radius + 1, axis=1)
    return windows(padded(np.inf)).min(2), windows(padded(-np.inf)).max(2)


def warping_example(a: Column, radius: int) -> Column:
    """(z, low, high, order): what a search by warping keeps of an example: its z-form, the envelope of that, and the places in the order in which a standard normal
    value is least likely to lie within it."""
    from strandline.functions.arrays import let, normal_cdf

    def whole(z: Column) -> Column:
        low, high = envelope(z, radius)
        ends = F.struct(z.alias("z"), low.alias("low"), high.alias("high"))
        likely = lambda e: F.zip_with(e["low"], e["high"], lambda x, y: normal_cdf(y) - normal_cdf(x))
        order = lambda e: F.transform(F.array_sort(F.transform(likely(e), lambda p, i: F.struct(F.round(p, 12).alias("p"), i.alias("i")))), lambda s: s["i"])
        return let(ends, lambda e: F.struct(e["z"].alias("z"), e["low"].alias("low"), e["high"].alias("high"), order(e).alias("order")))

    return let(normalize(a, "z"), whole)


def dtw(radius: int, cost: Callable = lambda x, y: (x - y) ** 2):
    """A vectorized function of two array columns: squared point costs by default, warped within a band."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out, sizes = np.full(len(a), np.nan), a.map(lambda x: -1 if x is None else len(x)).to_numpy()
        same = sizes == b.map(lambda x: -2 if x is None else len(x)).to_numpy()
        for m in np.unique(sizes[same]):
            rows = np.flatnonzero(same & (sizes == m))
            out[rows] = dtw_rows(np.stack(a.iloc[rows].tolist()), np.stack(b.iloc[rows].tolist()), radius, cost) if m else 0.0
        return pd.Series(out)

    return run
