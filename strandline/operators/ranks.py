"""Exact percentiles without a task that holds a key's values: counts in bins narrow down where a rank lies, then the few values left are ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def percentiles(df: DataFrame, key: str, value: str, cuts: list[float], rounds: int = 2, bins: int = 1024) -> DataFrame:
    """key, cuts: the percentiles of each key's values (null and NaN aside), with the two nearest ranks interpolated.

    Each round is one aggregation to at most ``bins`` rows a key and cut; it narrows the range of values that holds the rank by about that factor. The ranges
    (a row for each key and cut) are broadcast, so keys must be few, such as dimensions or kinds.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    ends = rows.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    place = (F.col("n") - 1) * F.col("cut")
    ranges = ends.select("k", "lo", "hi", "n", F.posexplode(F.array(*(F.lit(float(c)) for c in cuts))).alias("c", "cut"))
    # below: values that are smaller than the range; first and last: the ranks on both sides of the place
    ranges = ranges.select("k", "c", "lo", "hi", F.lit(0).cast("long").alias("below"), F.floor(place).alias("first"), F.ceil(place).alias("last"), (place - F.floor(place)).alias("part"))
    inside = rows.join(F.broadcast(ranges), "k").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    for _ in range(rounds):
        width = F.col("hi") - F.col("lo")
        at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width * bins))).otherwise(F.lit(0)).cast("int")
        counts = inside.groupBy("k", "c", "below", "first", "last", "part", at.alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        w = Window.partitionBy("k", "c").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("upto", F.col("below") + F.sum("n").over(w))
        held = upto.filter((F.col("upto") > F.col("first")) & (F.col("upto") - F.col("n") <= F.col("last")))
        ranges = held.groupBy("k", "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.col("upto") - F.col("n")).alias("below"), F.first("first").alias("first"), F.first("last").alias("last"), F.first("part").alias("part"))
        inside = rows.join(F.broadcast(ranges), "k").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    each = inside.groupBy("k", "c", "below", "first", "last", "part", "v").agg(F.count("*").alias("n"))
    upto = each.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("k", "c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda rank: F.max(F.when((F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("n") <= F.col(rank)), F.col("v")))
    found = upto.groupBy("k", "c").agg(at("first").alias("x"), at("last").alias("y"), F.first("part").alias("part"))
    found = found.select("k", "c", (F.col("x") + (F.col("y") - F.col("x")) * F.col("part")).alias("p"))
    return found.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "p"))), lambda s: s["p"]).alias("cuts")).withColumnRenamed("k", key)
