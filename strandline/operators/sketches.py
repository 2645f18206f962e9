"""Sketches of vectors: projections on given or drawn planes, their signs, stripes and bins, and lookup tables learned for bins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import linear, quantize, ranks


def circulant_planes(first: np.ndarray, signs: np.ndarray, bits: int) -> np.ndarray:
    """Planes whose products are those of a circulant matrix with the vector after its signs are flipped."""
    dim = len(first)
    if bits > dim:
        raise ValueError("a circulant matrix has as many rows as the vector has dimensions")
    return np.stack([np.roll(first, i) for i in range(bits)]) * signs


def superbit_planes(dim: int, bits: int, depth: int, seed: int = 0) -> np.ndarray:
    """Random planes in blocks of ``depth`` that are orthonormal within a block."""
    if depth > dim:
        raise ValueError("a block has at most as many planes as there are dimensions")
    rng = np.random.default_rng(seed)
    blocks = [linear.orthonormal_rows(rng.normal(size=(depth, dim))) for _ in range(-(-bits // depth))]
    return np.concatenate(blocks)[:bits]


def random_planes(dim: int, count: int, seed: int = 0, orthogonal: bool = False) -> np.ndarray:
    planes = np.random.default_rng(seed).normal(size=(count, dim))
    return linear.orthonormal_rows(planes) if orthogonal else planes / np.sqrt(dim)


def principal_planes(data: DataFrame, count: int, rotate: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Means and principal axes; after a random rotation all have about the same variance."""
    mean, axes, _ = linear.principal_axes(data, count)
    return mean, linear.random_rotation(len(axes), seed) @ axes if rotate else axes


def project(data: DataFrame, planes: np.ndarray, mean: np.ndarray | None = None, vec: str = "embedding", name: str = "p") -> DataFrame:
    """``data`` with the products of its vectors, less ``mean``, with each plane. The planes are parameters of a fixed size."""
    fields = [(f.name, f.dataType.simpleString()) for f in data.schema if f.name != name]

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = linear.vectors(b.column(vec))
                p = (x - mean if mean is not None else x) @ planes.T
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in fields), pa.array(p.tolist(), pa.list_(pa.float64()))], names=[*(n for n, _ in fields), name])

    return data.filter(F.col(vec).isNotNull()).select(*(n for n, _ in fields)).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*fields, (name, "array<double>")]))


def sample_dims(vector: Column, dims: list[int]) -> Column:
    """The named dimensions, which may repeat."""
    return F.transform(F.array(*(F.lit(d) for d in dims)), lambda d: F.get(vector, d))


def stripe_widths(projected: DataFrame, stripes: int = 3, name: str = "p") -> list[float]:
    """Width of a stripe on each plane: the range of the fitted data, in ``stripes`` parts. Queries use the widths of the data."""
    each = projected.select(F.posexplode(name).alias("i", "v")).groupBy("i").agg((F.max("v") - F.min("v")).alias("w")).orderBy("i").collect()
    return [max(float(r["w"]), 1e-12) / stripes for r in each]


def striped_bits(p: Column, widths: list[float]) -> Column:
    """A bit for each plane (the first is the lowest, at most 63): whether the projection lies in an odd stripe."""
    out = F.lit(0).cast("bigint")
    for i, w in enumerate(widths):
        out = out.bitwiseOR(F.shiftleft(F.pmod(F.floor(F.get(p, F.lit(i)) / w), F.lit(2)).cast("bigint"), i))
    return out


def sign_of(p: Column, planes: int) -> Column:
    """A bit for each projection: whether it is positive."""
    out = F.lit(0).cast("bigint")
    for i in range(planes):
        out = out.bitwiseOR(F.when(F.get(p, F.lit(i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return out


def thresholds_kmeans(data: DataFrame, bins: int, rounds: int = 10) -> DataFrame:
    """dim, thresholds: midpoints between the sorted means of one-dimensional k-means, begun at quantiles. Each round is one aggregation."""
    each = data.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "v"))
    start = ranks.percentiles(each, "dim", "v", [(i + 0.5) / bins for i in range(bins)]).withColumnRenamed("cuts", "centres")
    centres = {r["dim"]: list(r["centres"]) for r in start.collect()}
    spark = data.sparkSession

    def middles():
        return spark.createDataFrame([(d, [(a + b) / 2 for a, b in zip(c, c[1:], strict=False)]) for d, c in sorted(centres.items())], "dim int, thresholds array<double>")

    for _ in range(rounds):
        near = each.join(F.broadcast(middles()), "dim").groupBy("dim", quantize.digitize(F.col("v"), F.col("thresholds")).alias("bin")).agg(F.avg("v").alias("m"))  # one row for each dimension
        moved = {d: list(c) for d, c in centres.items()}
        for r in near.collect():
            moved[r["dim"]][r["bin"]] = r["m"]
        moved = {d: sorted(c) for d, c in moved.items()}
        if moved == centres:
            break
        centres = moved
    return middles()


def thresholds(data: DataFrame, kind: str, bins: int) -> DataFrame:
    """dim, thresholds of a scalar quantizer: ``gauss``, ``quantile``, ``kmeans`` or ``dbq`` (three bins, cut at the thirds)."""
    if kind == "gauss":
        return quantize.thresholds_gauss(data, bins)
    if kind == "kmeans":
        return thresholds_kmeans(data, bins)
    if kind == "dbq":
        return quantize.thresholds_quantile(data, [1 / 3, 2 / 3])
    if kind == "quantile":
        return quantize.thresholds_quantile(data, [i / bins for i in range(1, bins)])
    raise ValueError("gauss, quantile, kmeans or dbq")


def scaled_bins(v: Column, mean: Column, deviation: Column, bins: int, spread: float = 2.0) -> Column:
    """Equal bins over ``spread`` deviations on each side of the mean; what lies outside goes to the ends."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(((v - mean) / deviation + spread) * bins / (2 * spread)))).cast("int")


def digitized(data: DataFrame, cuts: DataFrame) -> DataFrame:
    """vec_id, codes: the bin of each dimension."""
    arrays = cuts.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "thresholds"))), lambda s: s["thresholds"]).alias("cuts"))
    met = data.join(F.broadcast(arrays))  # one row, of a size that the parameters fix
    return met.select("vec_id", F.zip_with(F.col("embedding").cast("array<double>"), "cuts", lambda v, t: quantize.digitize(v, t)).alias("codes"))


def bin_moments(data: DataFrame, cuts: DataFrame) -> DataFrame:
    """dim, bin, n, m1, m2: count, mean and mean square of the values in each bin: all that the learned tables need."""
    each = data.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "v")).join(F.broadcast(cuts), "dim")  # one row for each dimension
    return each.groupBy("dim", quantize.digitize(F.col("v"), F.col("thresholds")).alias("bin")).agg(F.count("*").alias("n"), F.avg("v").alias("m1"), F.avg(F.col("v") * F.col("v")).alias("m2"))


def learned_tables(moments: DataFrame, queries: DataFrame, metric: str = "l2sq") -> DataFrame:
    """qid, dim, bin, d: the mean distance of a query's component to the values of a bin, exactly, without meeting the values again."""
    parts = queries.select("qid", F.posexplode(F.col("q").cast("array<double>")).alias("dim", "v")).join(F.broadcast(moments), "dim")  # bins x dimensions rows
    d = F.col("v") * F.col("m1") if metric == "dot" else F.col("m2") - 2 * F.col("v") * F.col("m1") + F.col("v") * F.col("v")
    return parts.select("qid", "dim", "bin", d.alias("d"))


def table_arrays(tables: DataFrame, bins: int) -> DataFrame:
    """qid, lut for ``quantize.Codec.distances``: a row of ``bins`` entries for each dimension; bins without values have 0."""
    full = F.map_from_entries(F.collect_list(F.struct("bin", "d")))
    rows = tables.groupBy("qid", "dim").agg(full.alias("e")).select("qid", "dim", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("e", b), F.lit(0.0))).alias("row"))
    return rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "row"))), lambda s: s["row"]).alias("lut"))
