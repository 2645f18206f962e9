"""Scores of reported intervals and of compressed search, and grids of parameters."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators import intervals


def total_iou(reported: DataFrame, truth: DataFrame) -> DataFrame:
    """inter, total, iou over all series: samples in both unions of intervals, samples in either, and their ratio (0 where there are none)."""
    a, b = intervals.union_of_ranges(reported), intervals.union_of_ranges(truth)
    size = lambda df, n: df.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias(n))
    t = b.select(F.col("series").alias("ts"), F.col("start").alias("s"), F.col("end").alias("e"))
    both = a.join(t, (F.col("series") == F.col("ts")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")))
    common = both.agg(F.coalesce(F.sum(intervals.intersection(F.col("start"), F.col("end"), F.col("s"), F.col("e"))), F.lit(0)).alias("inter"))
    one = common.join(F.broadcast(size(a, "na"))).join(F.broadcast(size(b, "nb")))  # one row each
    total = F.col("na") + F.col("nb") - F.col("inter")
    return one.select("inter", total.alias("total"), F.when(total > 0, F.col("inter") / total).otherwise(F.lit(0.0)).alias("iou"))


def label_pairs(reported: DataFrame, truth: DataFrame) -> DataFrame:
    """label, true_label, inter: for each reported label the true label that it covers most (ties: the smaller)."""
    t = truth.select(F.col("series").alias("ts"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("label").alias("true_label"))
    met = reported.join(t, (F.col("series") == F.col("ts")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")))
    sums = met.groupBy("label", "true_label").agg(F.sum(intervals.intersection(F.col("start"), F.col("end"), F.col("s"), F.col("e"))).alias("inter"))
    first = Window.partitionBy("label").orderBy(F.desc("inter"), "true_label")
    return sums.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def match_stats(reported: DataFrame, truth: DataFrame, least: float = 0.5, fewest: int = 2) -> DataFrame:
    """reported, true_n, matches, precision, recall, f1. A reported label stands for the true label that it covers most; labels with fewer than
    ``fewest`` reported intervals are left out."""
    often = reported.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest).select("label")
    kept = reported.join(often, "label", "left_semi")
    named = kept.join(label_pairs(kept, truth).select("label", "true_label"), "label").drop("label").withColumnRenamed("true_label", "label")
    hits = intervals.greedy_matches(named.select("series", "id", "start", "end", "label"), truth, least)
    one = kept.agg(F.count("*").alias("reported")).join(F.broadcast(truth.agg(F.count("*").alias("true_n")))).join(F.broadcast(hits.agg(F.count("*").alias("matches"))))  # one row each
    s = intervals.scores(F.col("matches"), F.col("reported"), F.col("true_n"))
    return one.select("reported", "true_n", "matches", *(c.alias(n) for n, c in s.items()))


def fidelity(pairs: DataFrame, truth: str = "true", found: str = "dist") -> DataFrame:
    """corr, mse, rel_error of distances by codes against true ones."""
    t, f = F.col(truth), F.col(found)
    return pairs.agg(F.corr(t, f).alias("corr"), F.avg((t - f) * (t - f)).alias("mse"), F.avg(F.when(t != 0, F.abs(t - f) / F.abs(t))).alias("rel_error"))


def share_within(pairs: DataFrame, k: int, truth: str = "true", found: str = "dist") -> DataFrame:
    """qid, share: what part of all vectors has codes no further than the worst code distance among the ``k`` truly nearest."""
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(truth, "vec_id"))).filter(F.col("r") <= k)
    worst = ranked.groupBy("qid").agg(F.max(found).alias("worst"))
    return pairs.join(worst, "qid").groupBy("qid").agg(F.avg((F.col(found) <= F.col("worst")).cast("double")).alias("share"))


def grid(**options: Iterable) -> list[dict]:
    """All combinations of the options' values; a value that is no list or tuple stands for itself."""
    lists = {k: v if isinstance(v, list | tuple) else [v] for k, v in options.items()}
    return [dict(zip(lists, chosen, strict=True)) for chosen in itertools.product(*lists.values())]


def experiment(f: Callable[..., DataFrame], **options: Iterable) -> DataFrame:
    """The rows that ``f`` gives for each combination, with the options as columns."""
    out = None
    for chosen in grid(**options):
        rows = f(**chosen).withColumns({k: F.lit(v) for k, v in chosen.items()})
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("an option has no values")
    return out


def folds(df: DataFrame, k: int, label: str, order: str) -> DataFrame:
    """``df`` with fold: each label's rows, in order, dealt to ``k`` folds in turn."""
    return df.withColumn("fold", (F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1).cast("long") % k)
