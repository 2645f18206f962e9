"""Functions over array columns: elementwise, statistics, tests, slicing, padding and windows. All stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, where an expression inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def doubles(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def sum_squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def variance(a: Column) -> Column:
    """Population variance, from the mean and the mean of squares about it."""
    return let(mean(a), lambda m: total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a))


def stdev(a: Column) -> Column:
    return F.sqrt(variance(a))


def norm(a: Column, p: float = 2) -> Column:
    if p == 1:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
    if p == 2:
        return F.sqrt(sum_squares(a))
    return F.pow(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), F.lit(float(p)))), F.lit(1.0 / p))


def elementwise(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` of two arrays, or of an array and a scalar on either side."""
    return F.zip_with(a, b, op)


def scalar(a: Column, c: float | Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.transform(a, lambda x: op(x, F.lit(c) if not isinstance(c, Column) else c))


def argmin(a: Column) -> Column:
    """Index from 0 of the first least value."""
    return F.array_position(a, F.array_min(a)) - 1


def argmax(a: Column) -> Column:
    return F.array_position(a, F.array_max(a)) - 1


def find(a: Column, value: Column | float) -> Column:
    """Index of the first equal element, -1 if there is none."""
    return F.array_position(a, value) - 1


def rfind(a: Column, value: Column | float) -> Column:
    at = F.array_position(F.reverse(a), value)
    return F.when(at == 0, F.lit(-1)).otherwise(F.size(a) - at).cast("long")


def where(a: Column, test: Callable[[Column], Column]) -> Column:
    """Indices of the elements that pass."""
    pairs = F.transform(a, lambda x, i: F.when(test(x), i).otherwise(F.lit(-1)))
    return F.filter(pairs, lambda i: i >= 0)


def take(a: Column, indices: Column) -> Column:
    """Elements at the indices; those out of bounds are left out."""
    inside = F.filter(indices, lambda i: (i >= 0) & (i < F.size(a)))
    return F.transform(inside, lambda i: F.get(a, i))


def argsort(a: Column, descending: bool = False) -> Column:
    """Stable order: ties by index."""
    sign = -1 if descending else 1
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct((x * sign).alias("v"), i.alias("i")))), lambda s: s["i"])


def sort_by_magnitude(a: Column, descending: bool = True) -> Column:
    sign = -1 if descending else 1
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct((F.abs(x) * sign).alias("k"), i.alias("i"), x.alias("v")))), lambda s: s["v"])


def pad(a: Column, left: int, right: int, kind: str = "zero", value: float = 0.0) -> Column:
    """Pad with zeros, a constant, the edge values, or the array itself wrapped around."""
    if kind == "edge":
        l, r = F.array_repeat(F.get(a, F.lit(0)), left), F.array_repeat(F.element_at(a, -1), right)
    elif kind == "wrap":
        n = F.size(a)
        l = F.transform(F.sequence(F.lit(0), F.lit(left - 1)), lambda i: F.get(a, F.pmod(i - left, n))) if left else F.slice(a, 1, 0)
        r = F.transform(F.sequence(F.lit(0), F.lit(right - 1)), lambda i: F.get(a, F.pmod(i, n))) if right else F.slice(a, 1, 0)
    else:
        fill = F.lit(0.0 if kind == "zero" else value)
        l, r = F.array_repeat(fill, left), F.array_repeat(fill, right)
    return F.concat(l, a, r)


def resample(a: Column, length: int) -> Column:
    """``length`` elements, the i-th from index floor(i * n / length)."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(a, F.floor(i * F.size(a) / F.lit(length)).cast("int")))


def deinterleave(a: Column, dims: int) -> Column:
    """An array for each of ``dims`` interleaved dimensions."""
    def every(k: int) -> Column:
        return F.filter(a, lambda x, i: i % dims == k)

    return F.array(*map(every, range(dims)))


def pad_columns(a: Column, multiple: int) -> Column:
    """Zeros at the end, up to a multiple of ``multiple`` elements."""
    return F.concat(a, F.array_repeat(F.lit(0.0), F.pmod(-F.size(a), F.lit(multiple))))


def normalize(a: Column, kind: str = "z", threshold: float = 1e-3) -> Column:
    """Normalized by ``z``, ``mean``, ``l1`` (sum of magnitudes), ``sum``, ``l2``, ``max`` or ``zero_one``; unchanged below the threshold."""
    if kind == "mean":
        return let(mean(a), lambda m: F.transform(a, lambda x: x - m))
    if kind == "z":
        m, s = mean(a), stdev(a)
        return let(F.struct(m.alias("m"), s.alias("s")), lambda p: F.when(p["s"] < threshold, a).otherwise(F.transform(a, lambda x: (x - p["m"]) / p["s"])))
    if kind == "zero_one":
        ends = F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))
        return let(ends, lambda p: F.when(p["hi"] - p["lo"] < threshold, a).otherwise(F.transform(a, lambda x: (x - p["lo"]) / (p["hi"] - p["lo"]))))
    by = {"l1": lambda: norm(a, 1), "sum": lambda: total(a), "l2": lambda: norm(a), "max": lambda: F.array_max(a)}[kind]()
    return let(by, lambda n: F.when(F.abs(n) < threshold, a).otherwise(F.transform(a, lambda x: x / n)))


def augment_for_inner_product(a: Column, scale: Column | float, query: bool = False) -> Column:
    """Two more elements that make inner-product search a search by distance: sqrt(1 - n2) and 0 for data, 0 and sqrt(1 - n2) for queries."""
    scaled = F.transform(a, lambda x: x / (F.lit(scale) if not isinstance(scale, Column) else scale))
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - sum_squares(scaled)))
    return F.concat(scaled, F.array(F.lit(0.0), rest) if query else F.array(rest, F.lit(0.0)))


def subsequences(a: Column, length: int, stride: int = 1) -> Column:
    """All windows of ``length`` elements; none if the array is shorter."""
    n = F.size(a) - length
    return F.when(n < 0, F.slice(F.array(a), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0)), F.lit(stride)), lambda i: F.slice(a, i + 1, length)))


def cumulative(a: Column) -> Column:
    """Running sums, in one walk over the array."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("sum"))
    walked = F.aggregate(a, start, lambda s, x: F.struct(F.concat(s["out"], F.array(s["sum"] + x)).alias("out"), (s["sum"] + x).alias("sum")))
    return walked["out"]


def windows_nd(a: Column, rows: int, cols: int, height: int, width: int, step: tuple[int, int] = (1, 1), flatten: bool = True) -> Column:
    """All windows of ``height`` x ``width`` of a matrix that is given row by row, themselves row by row; flat, or as arrays of rows."""
    down, along = F.sequence(F.lit(0), F.lit(rows - height), F.lit(step[0])), F.sequence(F.lit(0), F.lit(cols - width), F.lit(step[1]))
    if rows < height or cols < width:
        return F.slice(F.array(a), 1, 0)
    part = lambda i, j: F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.slice(a, (i + r) * cols + j + 1, width))
    each = F.flatten(F.transform(down, lambda i: F.transform(along, lambda j: part(i, j))))
    return F.transform(each, F.flatten) if flatten else each


def blurred(a: Column, weights: list[float], reach: int) -> Column:
    """Correlation with centred weights (nothing beyond the ends), over the largest result within ``reach``, at least 1."""
    half, n = len(weights) // 2, F.size(a)
    soft = F.transform(a, lambda x, i: sum((F.coalesce(F.get(a, i + k - half), F.lit(0.0)) * w for k, w in enumerate(weights)), F.lit(0.0)))
    around = lambda s, i: F.array_max(F.slice(s, F.greatest(i - reach, F.lit(0)) + 1, F.least(i + reach + 1, n) - F.greatest(i - reach, F.lit(0))))
    return let(soft, lambda s: F.transform(s, lambda x, i: x / F.greatest(F.lit(1.0), around(s, i))))


def window_weights(kind: str, n: int, alpha: float = 0.54, sigma: float = 0.4) -> list[float]:
    """hann, hamming, generalized hamming (alpha) or gaussian (sigma of the half width) weights."""
    if n == 1:
        return [1.0]
    if kind == "gaussian":
        half = (n - 1) / 2
        return [math.exp(-0.5 * ((i - half) / (sigma * half)) ** 2) for i in range(n)]
    a = {"hann": 0.5, "hamming": 0.54}.get(kind, alpha)
    return [a - (1 - a) * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]


def maximum_subarray(a: Column) -> Column:
    """(start, end, sum) of the first subarray of largest sum; the empty one, [0, 0), where nothing is positive."""
    zero = F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0.0).alias("run"), F.lit(0).alias("from"), F.lit(0).alias("i"))

    def step(st: Column, x: Column) -> Column:
        fresh = st["run"] <= 0
        run, begin = F.when(fresh, x).otherwise(st["run"] + x), F.when(fresh, st["i"]).otherwise(st["from"])
        better = run > st["best"]
        return F.struct(F.when(better, run).otherwise(st["best"]).alias("best"), F.when(better, begin).otherwise(st["s"]).alias("s"), F.when(better, st["i"] + 1).otherwise(st["e"]).alias("e"), run.alias("run"), begin.alias("from"), (st["i"] + 1).alias("i"))

    return F.aggregate(a, zero, step, lambda st: F.struct(st["s"].alias("start"), st["e"].alias("end"), st["best"].alias("sum")))


def local_maxima(a: Column, spacing: int = 1) -> Column:
    """Indices of peaks (no smaller than their neighbours, ends included), left to right; of peaks closer than ``spacing`` the larger, later on ties."""
    n = F.size(a)
    peak = lambda x, i: (x >= F.coalesce(F.get(a, i - 1), x)) & (x >= F.coalesce(F.get(a, i + 1), x))
    found = F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("v"), peak(x, i).alias("p"))), lambda s: s["p"] & (n > 0))
    empty = F.slice(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("v"))), 1, 0)

    def step(kept: Column, s: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        item = F.struct(s["i"].alias("i"), s["v"].alias("v"))
        near = last.isNotNull() & (s["i"] - last["i"] < spacing)
        return F.when(~near, F.concat(kept, F.array(item))).when(s["v"] >= last["v"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(item))).otherwise(kept)

    return F.transform(F.aggregate(found, empty, step), lambda s: s["i"])


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by a rational approximation of the error function (error below 1.5e-7)."""
    # fixed values of formula 7.1.26 in Abramowitz and Stegun
    p, c = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + p * z)
    tail = F.lit(0.0)
    for k in reversed(c):
        tail = (tail + k) * t
    erf = 1 - tail * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def highest_bit(x: Column) -> Column:
    """Index of the highest set bit of a long that isn't negative, -1 for 0."""
    return F.when(x == 0, F.lit(-1)).otherwise(F.length(F.bin(x)) - 1)


def lowest_bit(x: Column) -> Column:
    return F.when(x == 0, F.lit(-1)).otherwise(F.bit_count((x.bitwiseAND(-x)) - 1))
