"""Tables of vectors (vec_id, embedding) as matrices: normalization by rows, columns or as a whole, rows and columns that go or come, matches, and draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import arrays as A
from strandline.operators import linear

FLAT = 1e-3


def _set(data: DataFrame, value: Column) -> DataFrame:
    return data.withColumn("embedding", value)


def _row(values: np.ndarray) -> Column:
    """A row of numbers as a column; it has one entry for each dimension."""
    return F.array(*(F.lit(float(v)) for v in values))


def column_moments(data: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each dimension: two numbers a dimension reach the driver."""
    mean, cov = linear.covariance_matrix(data.select(F.col("embedding").cast("array<double>").alias("embedding")))
    return mean, np.sqrt(np.maximum(np.diag(cov), 0))


def centred(data: DataFrame, fitted: DataFrame) -> DataFrame:
    """``data`` less the column means of ``fitted`` (training means, applied to queries too)."""
    return _set(data, F.zip_with(A.doubles("embedding"), _row(column_moments(fitted)[0]), lambda x, m: x - m))


def one_scale(data: DataFrame, fitted: DataFrame) -> DataFrame:
    """``data`` less the column means, over the largest column deviation of ``fitted``."""
    mean, sd = column_moments(fitted)
    by = float(sd.max()) or 1.0
    return _set(data, F.zip_with(A.doubles("embedding"), _row(mean), lambda x, m: (x - m) / by))


def variance_order(data: DataFrame) -> DataFrame:
    """dim, place: dimensions by falling variance, ties to the smaller one."""
    each = data.select(F.posexplode(A.doubles("embedding")).alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("v"))
    one = each.agg(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("k"), "dim"))).alias("o"))
    return one.select(F.posexplode("o").alias("place", "s")).select(F.col("s.dim").alias("dim"), "place")


def normalized_columns(data: DataFrame, kind: str = "z", flat: float = FLAT) -> DataFrame:
    """Columns less their means (``mean``), over their deviations (``std``), both (``z``), or over their norms (``l2``). What is below ``flat`` counts as 1."""
    mean, sd = column_moments(data)
    sd = np.where(sd < flat, 1.0, sd)
    x = A.doubles("embedding")
    if kind == "mean":
        return _set(data, F.zip_with(x, _row(mean), lambda v, m: v - m))
    if kind == "std":
        return _set(data, F.zip_with(x, _row(sd), lambda v, s: v / s))
    if kind == "z":
        return _set(data, F.zip_with(F.zip_with(x, _row(mean), lambda v, m: v - m), _row(sd), lambda v, s: v / s))
    if kind == "l2":
        norms = np.sqrt(np.diag(linear.moment_matrix(data))[:-1])
        return _set(data, F.zip_with(x, _row(np.where(norms < flat, 1.0, norms)), lambda v, s: v / s))
    raise ValueError("mean, std, z or l2")


def normalized_rows(data: DataFrame, kind: str = "z", flat: float = FLAT) -> DataFrame:
    """Rows by a kind of ``arrays.normalize``, or over their deviation (``std``, below ``flat``: unchanged), or ``mean_l2``: less their mean, then over their norm."""
    x = A.doubles("embedding")
    if kind == "std":
        return _set(data, A.let(A.stdev(x), lambda s: F.when(s < flat, x).otherwise(F.transform(x, lambda v: v / s))))
    if kind == "mean_l2":
        return _set(data, A.let(A.normalize(x, "mean"), lambda m: A.normalize(m, "l2", flat)))
    return _set(data, A.normalize(x, kind, flat))


def normalized_parts(data: DataFrame, dims: int, kind: str = "z", flat: float = FLAT) -> DataFrame:
    """Each of the ``dims`` interleaved dimensions of a row by itself, then interleaved again."""
    parts = F.transform(A.deinterleave(A.doubles("embedding"), dims), lambda p: A.normalize(p, kind, flat))
    woven = lambda p: F.transform(F.sequence(F.lit(0), F.size(F.flatten(p)) - 1), lambda i: F.get(F.get(p, i % dims), F.floor(i / dims).cast("int")))
    return _set(data, A.let(parts, woven))


#: What ``normalized`` understands: each row by itself or all values alike, wholly or by the mean alone; and the forms for inner products.
HOWS = ("each", "all", "each_mean", "all_mean", "l2", "mips", "mips_data", "mips_query")


def normalized(data: DataFrame, how: str, dims: int = 1) -> DataFrame:
    """``each``: the z-form of each row (of each of its interleaved ``dims``); ``all``: all values less their mean over their deviation; ``each_mean`` and ``all_mean``
    take the mean off alone; ``l2``: rows of length 1; ``mips``, ``mips_data`` and ``mips_query``: scaled by the largest norm and augmented."""
    if how in ("each", "each_mean"):
        kind = "z" if how == "each" else "mean"
        return normalized_parts(data, dims, kind) if dims > 1 else normalized_rows(data, kind)
    if how == "l2":
        return normalized_rows(data, "l2")
    x = A.doubles("embedding")
    if how in ("all", "all_mean"):
        n = F.sum(F.size(x))
        one = data.agg((F.sum(A.total(x)) / n).alias("_m"), (F.sum(A.sum_squares(x)) / n).alias("_s"))
        met = data.join(F.broadcast(one))  # one row
        sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_s") - F.col("_m") * F.col("_m")))
        by = F.when(sd < FLAT, F.lit(1.0)).otherwise(sd) if how == "all" else F.lit(1.0)
        return _set(met, F.transform(x, lambda v: (v - F.col("_m")) / by)).select(data.columns)
    if how in ("mips", "mips_data", "mips_query"):
        one = data.agg(F.max(A.norm(x)).alias("_n"))
        return _set(data.join(F.broadcast(one)), A.augment_for_inner_product(x, F.col("_n"), how == "mips_query")).select(data.columns)  # one row
    raise ValueError(", ".join(HOWS))


def c_znormalized(a: Column) -> Column:
    """The older z-form: a deviation of zero counts as the smallest positive double, so that a constant array becomes zeros."""
    return A.let(F.struct(A.mean(a).alias("m"), A.stdev(a).alias("s")), lambda p: F.transform(a, lambda x: (x - p["m"]) / F.when(p["s"] == 0, F.lit(2.2250738585072014e-308)).otherwise(p["s"])))


def without_zero_rows(data: DataFrame, flat: float = 0.0) -> DataFrame:
    """Rows with a value whose magnitude is above ``flat``."""
    return data.filter(F.exists(A.doubles("embedding"), lambda x: F.abs(x) > flat))


def without_flat_rows(data: DataFrame, flat: float = FLAT) -> DataFrame:
    """Rows whose deviation is at least ``flat``."""
    return data.filter(A.stdev(A.doubles("embedding")) >= flat)


def zero_columns(data: DataFrame, flat: float = 0.0) -> list[int]:
    """Dimensions in which no value's magnitude is above ``flat``."""
    each = data.select(F.posexplode(A.doubles("embedding")).alias("dim", "x")).groupBy("dim").agg(F.max(F.abs("x")).alias("most"))
    return sorted(r["dim"] for r in each.filter(F.col("most") <= flat).collect())  # dimensions at most


def without_columns(data: DataFrame, dims: list[int]) -> DataFrame:
    return _set(data, F.filter("embedding", lambda x, i: ~i.isin(*dims)) if dims else F.col("embedding"))


def only_columns(data: DataFrame, dims: list[int]) -> tuple[DataFrame, DataFrame]:
    """The vectors split in two: the named dimensions, and the others."""
    return _set(data, F.filter("embedding", lambda x, i: i.isin(*dims))), without_columns(data, dims)


def with_columns(data: DataFrame, zeros: int = 0, ones: int = 0, front: bool = False) -> DataFrame:
    """Dimensions of zeros and then of ones, behind the others or in front of them."""
    more = F.concat(F.array_repeat(F.lit(0.0), zeros), F.array_repeat(F.lit(1.0), ones))
    return _set(data, F.concat(more, A.doubles("embedding")) if front else F.concat(A.doubles("embedding"), more))


def with_rows(data: DataFrame, count: int, value: float = 0.0, first_id: int = 0) -> DataFrame:
    """``count`` more rows of one value, of the length of the others, with ids from ``first_id`` on."""
    width = data.agg(F.max(F.size("embedding")).alias("w"))
    new = data.sparkSession.range(first_id, first_id + count).withColumnRenamed("id", "vec_id").join(F.broadcast(width))  # one row
    return data.select("vec_id", A.doubles("embedding").alias("embedding")).unionByName(new.select("vec_id", F.array_repeat(F.lit(float(value)), F.col("w")).alias("embedding")))


def centred_in(data: DataFrame, rows: int, cols: int) -> DataFrame:
    """The matrix (rows by vec_id from 0) in the middle of a larger one of zeros; an odd rest goes behind."""
    size = data.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("w"))
    met = data.select("vec_id", A.doubles("embedding").alias("embedding")).join(F.broadcast(size))  # one row
    above, left = F.floor((F.lit(rows) - F.col("n")) / 2).cast("long"), F.floor((F.lit(cols) - F.col("w")) / 2).cast("int")
    inner = met.select((F.col("vec_id") + above).alias("vec_id"), F.concat(F.array_repeat(F.lit(0.0), left), "embedding", F.array_repeat(F.lit(0.0), F.lit(cols) - F.col("w") - left)).alias("embedding"))
    other = data.sparkSession.range(rows).withColumnRenamed("id", "vec_id").join(inner, "vec_id", "left_anti").withColumn("embedding", F.array_repeat(F.lit(0.0), cols))
    return inner.unionByName(other)


def matching_rows(data: DataFrame, wanted: list[float]) -> DataFrame:
    """Rows equal to a vector, value by value."""
    return data.filter(A.doubles("embedding") == _row(np.asarray(wanted, float)))


def contiguous_rows(data: DataFrame, n: int, start: int | None = None, seed: int = 0, order: str = "vec_id") -> DataFrame:
    """``n`` rows that follow one another in order, from a given place on or from a drawn one. Only rows before the end of the stretch are numbered."""
    if start is None:
        rows = data.count()
        start = int(np.random.default_rng(seed).integers(0, max(1, rows - n + 1)))
    return data.orderBy(order).offset(start).limit(n)


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1] for each key, the same on any cluster: from the first 32 bits of an MD5 digest."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") + 1) / 4294967296.0


def choice(df: DataFrame, k: int, key: str, weight: str | None = None, replace: bool = False, seed: int = 0) -> DataFrame:
    """A draw of ``k`` rows, with chances by ``weight`` (not negative) on request; column ``draw`` counts from 0.

    The row with the least -ln(u) / weight wins a draw: without replacement the first ``k`` of one race are taken, a top-k; with replacement each
    draw is a race of its own, of which a task sends one row.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    some = df.filter(w > 0)
    if not replace:
        drawn = some.withColumn("_key", -F.ln(uniform(F.col(key), seed)) / w).orderBy("_key", key).limit(k)
        return drawn.withColumn("draw", F.row_number().over(Window.orderBy("_key", key)) - 1).drop("_key")  # k rows
    each = some.select(F.struct(*df.columns).alias("_row"), F.col(key).alias("_k"), w.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("draw"))
    race = F.struct((-F.ln(uniform(F.concat_ws("/", F.col("_k").cast("string"), F.col("draw").cast("string")), seed)) / F.col("_w")).alias("at"), F.col("_k"), F.col("_row"))
    return each.groupBy("draw").agg(F.min(race).alias("_least")).select("_least._row.*", "draw")


def variance_nd(a: Column, dims: int) -> Column:
    """Variance of interleaved dimensions, each about its own mean, over all values."""
    return A.mean(F.transform(A.deinterleave(a, dims), lambda p: A.variance(p)))


def grouped_lists(df: DataFrame, group: Column, place: str, value: str) -> DataFrame:
    """group, places and values of the rows of each group, in the order of their places; a group must fit a row."""
    each = df.groupBy(group.alias("group")).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).alias("v")))).alias("s"))
    return each.select("group", F.transform("s", lambda r: r["p"]).alias("places"), F.transform("s", lambda r: r["v"]).alias("values"))
