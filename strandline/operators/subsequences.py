"""Windows of a series (rows series, t, x) that meet a condition, what lies around and between them, and series joined end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import arrays
from strandline.operators import series as S


def _apart(starts: Column, length: int) -> Column:
    """Of increasing starts, those that begin no earlier than the last kept one ends."""
    none = F.slice(starts, 1, 0)
    return F.aggregate(starts, none, lambda kept, s: F.when(F.size(kept) == 0, F.array(s)).when(s - F.element_at(kept, -1) >= length, F.concat(kept, F.array(s))).otherwise(kept))


def where(df: DataFrame, length: int, test: Callable[[Column], Column], value: str = "x", overlapping: bool = True) -> DataFrame:
    """series, start of the windows of ``length`` rows whose values (an array) meet the test; on request only such that don't overlap, from the left."""
    hits = S.ngrams(df, length, value).filter(test(F.col("gram"))).select("series", F.col("t").alias("start"))
    if overlapping:
        return hits
    starts = hits.groupBy("series").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    return starts.select("series", F.explode(_apart(F.col("starts"), length)).alias("start"))


def find(df: DataFrame, wanted: list, value: str = "x", overlapping: bool = True) -> DataFrame:
    """series, start of each place at which the wanted values stand."""
    return where(df, len(wanted), lambda g: g == F.array(*(F.lit(w) for w in wanted)), value, overlapping)


def between(df: DataFrame, matches: DataFrame, length: int) -> DataFrame:
    """series, start, end of the stretches before, between and after matches that don't overlap; empty ones are left out."""
    last = df.groupBy("series").agg((F.max("t") + 1).alias("n"))
    w = Window.partitionBy("series").orderBy("start")
    marks = matches.select("series", F.col("start"), (F.col("start") + length).alias("stop"))
    cut = marks.unionByName(last.select("series", F.col("n").alias("start"), F.col("n").alias("stop")))
    return cut.select("series", F.coalesce(F.lag("stop").over(w), F.lit(0)).cast("long").alias("begin"), F.col("start").alias("end")).filter("end > begin").withColumnRenamed("begin", "start")


def around(df: DataFrame, matches: DataFrame, before: int, after: int, value: str = "x") -> DataFrame:
    """series, start, near: the values from ``before`` rows before each match to ``after`` rows from it on; matches too near an end are left out."""
    near = df.withColumn("near", F.collect_list(value).over(S.order().rowsBetween(-before, after - 1))).filter(F.size("near") == before + after)
    return near.join(matches, (near["series"] == matches["series"]) & (near["t"] == matches["start"]), "left_semi").select("series", F.col("t").alias("start"), "near")


def separate_maxima(a: Column, length: int) -> Column:
    """Indices of the values that are larger than all others less than ``length`` away (equal ones exclude each other)."""
    near = lambda i: F.concat(F.slice(a, F.greatest(i - length + 1, F.lit(0)) + 1, i - F.greatest(i - length + 1, F.lit(0))), F.slice(a, i + 2, F.lit(length - 1)))
    return F.filter(F.transform(a, lambda x, i: F.when(F.coalesce(x > F.array_max(near(i)), F.lit(True)), i)), lambda i: i.isNotNull())


def labelled_windows(df: DataFrame, length: int, stride: int = 1, normalization: str | None = None) -> DataFrame:
    """series, start, window: all windows of rows (series, values), normalized by a kind of ``arrays.normalize`` on request."""
    each = df.select("series", F.posexplode(arrays.subsequences(arrays.doubles("values"), length, stride)).alias("i", "window"))
    window = arrays.normalize(F.col("window"), normalization) if normalization else F.col("window")
    return each.select("series", (F.col("i") * stride).cast("long").alias("start"), window.alias("window"))


def concatenated(df: DataFrame, by: str, order: str, pad: int = 0, aligned: bool = False) -> DataFrame:
    """``df`` (values) with offset: where each series begins when those of a group are joined in order, ``pad`` samples apart.

    aligned: each is moved up or down so that it begins at the value with which the one before ended.
    """
    w = Window.partitionBy(by).orderBy(order)
    out = df.withColumn("offset", F.coalesce(F.sum(F.size("values") + pad).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    if aligned:
        first, last = F.get("values", F.lit(0)), F.element_at("values", -1)
        jump = F.coalesce(F.lag(last).over(w) - first, F.lit(0.0))
        out = out.withColumn("_jump", jump).withColumn("_shift", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("values", F.transform("values", lambda v: v + F.col("_shift"))).drop("_jump", "_shift")
    return out


def chunked(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """``df`` with chunk: the rows of a group, in order, ``size`` to a chunk."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size).cast("long"))
