"""Intervals (series, start, end), end exclusive: unions, overlaps, matching and scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    both = intersection(s1, e1, s2, e2)
    union = (e1 - s1) + (e2 - s2) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def union_of_ranges(df: DataFrame, pad: int = 0, limit: int | None = None) -> DataFrame:
    """series, start, end of the union of padded intervals, cut to [0, limit]; those that only touch stay apart."""
    lo, hi = F.greatest(F.lit(0), F.col("start") - pad), F.col("end") + pad
    padded = df.select("series", lo.alias("start"), (F.least(F.lit(limit), hi) if limit is not None else hi).alias("end"))
    w = Window.partitionBy("series").orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = padded.withColumn("new", F.coalesce((F.col("start") >= seen).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("series", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def samples_near(samples: DataFrame, ranges: DataFrame, pad: int) -> DataFrame:
    """The samples (series, t, ...) within ``pad`` of an interval, each once."""
    near = union_of_ranges(ranges, pad)
    marks = near.select("series", F.col("start").alias("t"), F.lit(1).alias("step")).unionAll(near.select("series", F.col("end").alias("t"), F.lit(-1).alias("step")))
    both = samples.select("series", "t", F.lit(0).alias("step"), F.struct(*samples.columns).alias("row")).unionByName(marks.withColumn("row", F.lit(None).cast(samples.select(F.struct(*samples.columns)).schema[0].dataType)))
    depth = F.sum("step").over(Window.partitionBy("series").orderBy("t", F.when(F.col("step") == 0, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("depth", depth).filter((F.col("depth") > 0) & (F.col("step") == 0)).select("row.*")


def best_overlaps(reported: DataFrame, truth: DataFrame) -> DataFrame:
    """id, overlap: for each reported interval (series, id, start, end) its largest intersection with a true one (0 if there is none)."""
    t = truth.select(F.col("series").alias("tser"), F.col("start").alias("ts"), F.col("end").alias("te"))
    met = reported.join(t, (F.col("series") == F.col("tser")) & (F.col("start") < F.col("te")) & (F.col("ts") < F.col("end")), "left")
    size = F.coalesce(intersection(F.col("start"), F.col("end"), F.col("ts"), F.col("te")), F.lit(0))
    return met.groupBy("id").agg(F.max(F.when(F.col("ts").isNull(), 0).otherwise(size)).alias("overlap"))


def contained(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Intervals of ``df`` that lie in a range (series, lo, hi), with that range's ends."""
    r = ranges.select(F.col("series").alias("rs"), "lo", "hi")
    return df.join(r, (F.col("series") == F.col("rs")) & (F.col("start") >= F.col("lo")) & (F.col("end") <= F.col("hi"))).drop("rs")


def overlaps_enough(least: float = 0.5) -> Callable[[Column, Column, Column, Column], Column]:
    """The usual test of a match: intersection over union."""
    return lambda s1, e1, s2, e2: iou(s1, e1, s2, e2) >= least


def covers(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Another test: the reported interval holds the true one, or is held by it."""
    return ((s1 <= s2) & (e2 <= e1)) | ((s2 <= s1) & (e1 <= e2))


def holds_point(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """A third one: the truth is a point, its start, which lies in the reported interval."""
    return (s1 <= s2) & (s2 < e1)


def greedy_matches(reported: DataFrame, truth: DataFrame, least: float = 0.5, with_labels: bool = True, test: Callable[[Column, Column, Column, Column], Column] | None = None) -> DataFrame:
    """series, reported id, truth id: in order of the reported ids, each takes the first true interval that is free and passes the test.

    test: of (start, end) of both; ``overlaps_enough(least)`` by default. Only pairs that pass reach the sequential step. It runs for each island by itself:
    pairs can only compete within a stretch of a series that overlapping intervals cover without a gap.
    """
    test = test or overlaps_enough(least)
    all_ = reported.select("series", "start", "end").unionByName(truth.select("series", "start", "end"))
    island = union_of_ranges(all_).select(F.col("series").alias("iser"), F.col("start").alias("island"))
    # an island's number is its start: the last one at or before an interval's own start
    marks = island.select(F.col("iser").alias("series"), F.col("island").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(reported.select(F.struct(*reported.columns)).schema[0].dataType).alias("row"), F.col("island"))
    mine = reported.select("series", F.col("start").alias("at"), F.lit(1).alias("side"), F.struct(*reported.columns).alias("row"), F.lit(None).cast("long").alias("island"))
    w = Window.partitionBy("series").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.unionByName(mine).withColumn("island", F.last("island", ignorenulls=True).over(w)).filter("side = 1").select("row.*", "island")
    t = truth.select(F.col("series").alias("tser"), F.col("id").alias("tid"), F.col("start").alias("ts"), F.col("end").alias("te"), F.col("label").alias("tl"))
    met = (F.col("series") == F.col("tser")) & (F.col("start") < F.col("te")) & (F.col("ts") < F.col("end")) & test(F.col("start"), F.col("end"), F.col("ts"), F.col("te"))
    pairs = placed.join(t, met & (F.col("label") == F.col("tl")) if with_labels else met).select("series", "island", F.col("id").alias("rid"), "tid")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out, done = set(), [], set()
        for s, _, r, x in pdf.sort_values(["rid", "tid"]).itertuples(index=False):
            if r not in done and x not in taken:
                taken.add(x)
                done.add(r)
                out.append((s, r, x))
        return pd.DataFrame(out, columns=["series", "rid", "tid"])

    kinds = dict(pairs.dtypes)
    return pairs.groupBy("series", "island").applyInPandas(pick, f"series {kinds['series']}, rid {kinds['rid']}, tid {kinds['tid']}")


def scores(matches: Column, reported: Column, true: Column) -> dict[str, Column]:
    """precision, recall and f1 from counts; 0 where nothing was reported or nothing is true."""
    p = F.when(reported > 0, matches / reported).otherwise(F.lit(0.0))
    r = F.when(true > 0, matches / true).otherwise(F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))}
