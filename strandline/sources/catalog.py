"""Labelled sets by name: made-up ones, archive sets, and recordings in folders, with limits on instances and length on request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.sources import recordings, vectors

#: Named sets of vectors and the folder of each, below a root.
VECTOR_SETS = {n: n.lower() for n in ("Gist", "Sift1M", "Sift10M", "Deep1M", "Convnet1M", "Mnist", "LabelMe", "Glove")}
SHAPES = ("cylinder", "bell", "funnel", "triangle", "rect", "sine", "walk")


def vector_set(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame | None]:
    """The tables of a named set of vectors: train, test, queries, truth."""
    if name not in VECTOR_SETS:
        raise KeyError(f"no set {name}; there are {', '.join(VECTOR_SETS)}")
    return vectors.load_bundle(spark, root, VECTOR_SETS[name])


def _planted(spark: SparkSession, root: str, kind: str, seed: int) -> DataFrame:
    """Each instance of a shape, and the stretches between them, as a labelled series."""
    starts = [100, 330, 560, 790, 1020]
    x = vectors.planted_series(kind, 1200, 60, starts, seed=seed)
    cuts = sorted({0, 1200, *starts, *(s + 60 for s in starts)})
    rows = [(i, 1 if a in starts else 0, x[a:b].tolist()) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return spark.createDataFrame(rows, "series long, label int, values array<double>")


def _walks(spark: SparkSession, root: str, kind: str, seed: int) -> DataFrame:
    made = vectors.synthetic(spark, "walk", 10, 100, seed)
    return made.select(F.col("vec_id").alias("series"), F.lit(0).alias("label"), F.col("embedding").alias("values"))


def _archive(spark: SparkSession, root: str, kind: str, seed: int) -> DataFrame:
    return recordings.labelled_series(spark, root, kind)


def _recording(spark: SparkSession, root: str, kind: str, seed: int) -> DataFrame:
    """A folder of samples (``samples.csv``: place, value) and annotations (``labels.txt``: start, end, label): each annotated stretch of the first dimension."""
    folder = f"{root}/{kind}" if kind else root
    marks = vectors.read_annotations(spark, f"{folder}/labels.txt").withColumn("series", F.row_number().over(Window.orderBy("start", "end", "label")))  # a file of annotations
    numbered = spark.read.csv(f"{folder}/samples.csv", schema="t long, x double")
    met = marks.join(numbered, (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    each = met.groupBy("series", "label").agg(F.array_sort(F.collect_list(F.struct(F.col("t"), F.col("x")))).alias("s"))
    return each.select(F.col("series").cast("long").alias("series"), "label", F.transform("s", lambda r: r["x"]).alias("values"))


#: What a name begins with, and who reads the rest of it.
LOADERS: dict[str, Callable[[SparkSession, str, str, int], DataFrame]] = {"planted_": _planted, "randwalk": _walks, "archive_": _archive, "recording": _recording}


def load(spark: SparkSession, name: str, root: str = "", seed: int = 0, fewest: int = 1, most: int | None = None, longest: int | None = None) -> DataFrame:
    """series, label, values of a set: ``planted_<shape>``, ``randwalk``, ``archive_<set>`` or ``recording_<folder>``. Labels with fewer than ``fewest`` series are left
    out, at most ``most`` of each are kept, and values are cut to the first ``longest``."""
    for start, loader in LOADERS.items():
        if name.startswith(start):
            rows = recordings.instances(loader(spark, root, name[len(start) :].lstrip("_"), seed), fewest, most)
            return rows.withColumn("values", F.slice("values", 1, longest)) if longest is not None else rows
    raise KeyError(f"no set {name}; names begin with {', '.join(LOADERS)}")


def load_all(spark: SparkSession, names: list[str], root: str = "", **options) -> DataFrame:
    """Several sets, with their names."""
    out = None
    for n in names:
        part = load(spark, n, root, **options).select(F.lit(n).alias("name"), F.col("series").cast("string").alias("series"), F.col("label").cast("string").alias("label"), "values")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no names")
    return out
