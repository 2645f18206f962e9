"""Vector files, text series, synthetic data and the table sink."""

from __future__ import annotations

import math
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_KINDS = {"fvecs": ("<f4", 4), "ivecs": ("<i4", 4), "bvecs": ("u1", 1)}


def read_vecs(spark: SparkSession, path: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Vectors with a 32-bit length before each (``fvecs``, ``ivecs`` or ``bvecs``, by the ending): path, row, embedding. All must have one length.

    Files are the unit of work: a large collection is kept as many of them.
    """
    kind = kind or path.rstrip("/*").rsplit(".", 1)[-1]
    dtype, width = _KINDS[kind]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if not content:
                    continue
                dim = int(np.frombuffer(content, "<i4", 1)[0])
                rows = np.frombuffer(content, np.uint8).reshape(-1, 4 + dim * width)[:limit]
                if (rows[:, :4].copy().view("<i4") != dim).any():
                    raise ValueError("vectors of different lengths")
                x = rows[:, 4:].copy().view(dtype).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float32()))], names=["path", "row", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row long, embedding array<float>")


def read_vecs_split(spark: SparkSession, path: str, dim: int, kind: str | None = None) -> DataFrame:
    """vec_id, embedding of ``read_vecs`` files whose vectors have ``dim`` components: all records are of one length, so files are read in pieces, whatever their
    size. vec_id counts the records in the order of files and places."""
    kind = kind or path.rstrip("/*").rsplit(".", 1)[-1]
    dtype, width = _KINDS[kind]

    def decoded(rows):
        for record, i in rows:
            if int.from_bytes(record[:4], "little") != dim:
                raise ValueError("vectors of different lengths")
            yield i, np.frombuffer(record, dtype, dim, 4).astype(float).tolist()

    records = spark.sparkContext.binaryRecords(path, 4 + dim * width)  # the one reader of fixed records that Spark has is an RDD
    return spark.createDataFrame(records.zipWithIndex().mapPartitions(decoded), "vec_id long, embedding array<double>")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """row, embedding: white-space text for ``.txt``, NumPy's format otherwise (one array for each file)."""
    if path.endswith(".txt"):
        lines = spark.read.text(path).withColumn("row", F.monotonically_increasing_id())
        return lines.select("row", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("embedding"))

    def run(batches):
        import io

        for b in batches:
            for content in b.column("content").to_pylist():
                x = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float64()))], names=["row", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, embedding array<double>")


def read_labelled_series(spark: SparkSession, path: str) -> DataFrame:
    """series, label, values: archive text in which each line is a whole-number label and then the values, between commas or white space."""
    parts = F.split(F.trim("value"), r"[,\s]+")
    rows = spark.read.text(path).filter(F.trim("value") != "").withColumn("series", F.monotonically_increasing_id())
    return rows.select("series", parts[0].cast("double").cast("int").alias("label"), F.transform(F.filter(parts, lambda x, i: i > 0), lambda x: x.cast("double")).alias("values"))


def read_recording(spark: SparkSession, path: str, sep: str = ",", sentinel: float | dict[str, float] | None = None, clip: tuple[float, float] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table of samples without its time column; a sentinel (one for all columns, or by column) is missing (null), columns named ``null*`` go, and values are clipped."""
    df = spark.read.csv(path, sep=sep, inferSchema=True)
    df = df.toDF(*columns) if columns else df.drop(df.columns[0])
    df = df.drop(*[c for c in df.columns if c.startswith("null")])

    def clean(c: str) -> Column:
        x = F.col(c).cast("double")
        missing = sentinel.get(c) if isinstance(sentinel, dict) else sentinel
        x = F.when(x == missing, None).otherwise(x) if missing is not None else x
        return F.when(x.isNotNull(), F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), x))) if clip else x

    return df.select(*(clean(c).alias(c) for c in df.columns))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """start, end, label from white-space lines."""
    return spark.read.csv(path, sep=" ", schema="start long, end long, label string")


def composite_labels(df: DataFrame, first: tuple[str, ...], then: str, within: int, name: str) -> DataFrame:
    """Annotations (series, start, end, label) with one more for each ``first`` that a ``then`` follows within some samples."""
    w = Window.partitionBy("series").orderBy("start", "end", "label")
    pairs = df.withColumns({"_l": F.lead("label").over(w), "_s": F.lead("start").over(w), "_e": F.lead("end").over(w)})
    hit = pairs.filter(F.col("label").isin(*first) & (F.col("_l") == then) & (F.col("_s") - F.col("end") <= within))
    return df.unionByName(hit.select("series", "start", F.col("_e").alias("end"), F.lit(name).alias("label")))


def profiler_times(spark: SparkSession, path: str) -> DataFrame:
    """name, trial, ms from lines like ``name (10x5): 1.2 (3.4/s), 1.3 (3.2/s)``."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"\(\d+x\d+\):"))
    tail = F.regexp_extract_all("value", F.lit(r"([0-9.]+) \([^)x]*/s\)"), 1)
    return lines.select(F.trim(F.regexp_extract("value", r"^(.*?)\s*\(\d+x\d+\):", 1)).alias("name"), F.posexplode(tail).alias("trial", "ms")).withColumn("ms", F.col("ms").cast("double"))


def synthetic(spark: SparkSession, kind: str, rows: int, dims: int, seed: int = 0) -> DataFrame:
    """vec_id, embedding: ``uniform``, ``gauss``, ``walk`` (running sums) or ``blobs`` (gauss about the points of a grid)."""
    value = {"uniform": F.rand, "gauss": F.randn, "walk": F.randn, "blobs": F.randn}[kind]
    cells = [value(seed + j) for j in range(dims)]
    if kind == "walk":
        for j in range(1, dims):
            cells[j] = cells[j - 1] + cells[j]
    if kind == "blobs":
        cells = [c * 0.1 + F.pmod(F.floor(F.col("vec_id") / 2**j), F.lit(2)) for j, c in enumerate(cells)]
    return spark.range(rows).withColumnRenamed("id", "vec_id").select("vec_id", F.array(*cells).alias("embedding"))


def shapes(kind: str, n: int, rng: np.random.Generator | None = None) -> np.ndarray:
    """A pattern of ``n`` values: cylinder, bell, funnel, triangle, rect, sine or walk."""
    t = np.linspace(0, 1, n)
    rng = rng or np.random.default_rng(0)
    return {"cylinder": np.ones(n), "bell": t, "funnel": 1 - t, "triangle": 1 - np.abs(2 * t - 1), "rect": (np.abs(t - 0.5) < 0.25).astype(float), "sine": np.sin(2 * math.pi * t), "walk": np.cumsum(rng.normal(size=n))}[kind]


def planted_series(kind: str, length: int, instance: int, starts: list[int], noise: float = 0.05, seed: int = 0) -> np.ndarray:
    """A noisy series with instances of a shape at known places."""
    rng = np.random.default_rng(seed)
    x = rng.normal(scale=noise, size=length)
    for s in starts:
        x[s : s + instance] += shapes(kind, instance)
    return x


def save_table(df: DataFrame, path: str, stamp: bool = False, keys: list[str] | None = None) -> str:
    """Write CSV with sorted columns, under a time-stamped name or in a folder for each key on request; the path that was written."""
    to = f"{path}_{time.strftime('%Y-%m-%dT%H_%M_%S')}" if stamp else path
    writer = df.select(*sorted(df.columns)).write.option("header", True)
    (writer.partitionBy(*keys) if keys else writer).csv(to)
    return to


#: Named sets: a folder for each, with these tables in it where they exist.
TABLES = ("train", "test", "queries", "truth")


def load_bundle(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame | None]:
    """The four tables of a named set; training rows fall back to the test rows, and truth may be missing."""
    if not re.fullmatch(r"[\w-]+", name):
        raise ValueError("a set's name is letters, digits, _ and -")

    def read(part: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{root}/{name}/{part}.parquet")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    out = {part: read(part) for part in TABLES}
    out["train"] = out["train"] if out["train"] is not None else out["test"]
    return out
