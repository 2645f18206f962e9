"""Nearest-neighbour, range and inner-product joins between a stated set of queries and a table of vectors.

All of them are one scan of the data, whatever the number of queries: ``meet`` holds each batch of vectors against the queries in blocks. Up to one block
of queries is broadcast; more are packed into a row for each block, and packed batches of data meet these rows, so that what a task holds never
grows with the queries. What is kept of each block (the k best so far, say) leaves the task once, at its end.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries of a block, vectors of a packed batch, and rows of results that a task holds before it lets go of the oldest blocks.
BLOCK, BATCH, HELD = 4096, 4096, 1_000_000


def rows_of(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a column as rows of a matrix of doubles, and which of the column's rows they are: whole arrays of the width (or of the first's)."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if not len(sizes) or not (sizes >= 0).any():
        return np.zeros((0, width or 0)), np.zeros(0, np.int64)
    width = width if width is not None else int(sizes[sizes >= 0][0])
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        x, at = values.reshape(len(sizes), width), np.arange(len(sizes))
    else:
        held = np.maximum(sizes, 0)
        at = np.flatnonzero(sizes == width)
        begins = (np.cumsum(held) - held)[at]
        x = values[begins[:, None] + np.arange(width)] if len(at) else np.zeros((0, width))
    if flat.null_count:
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        if (sizes == width).all():
            fine = known.reshape(x.shape).all(1)
        else:
            fine = known[begins[:, None] + np.arange(width)].all(1) if len(at) else np.zeros(0, bool)
        x, at = x[fine], at[fine]
    return x, at


class Kernel:
    """What a scan does with a block of queries and a batch of vectors. ``columns`` of the data are given as (ids, matrix, the others)."""

    schema = "qid long, vec_id long, dist double"
    #: Whether vectors have the length of a query (or one of their own, that of the batch's first).
    same_width = True

    def start(self, ids: np.ndarray, q: np.ndarray):
        """What is kept of a block; ``held`` says how many rows that is."""
        return None

    def meet(self, kept, ids: np.ndarray, q: np.ndarray, vec: np.ndarray, x: np.ndarray, more: list) -> Iterator[list]:
        """Columns of rows that can leave at once."""
        return iter(())

    def end(self, kept, ids: np.ndarray, q: np.ndarray) -> Iterator[list]:
        return iter(())

    def held(self, kept) -> int:
        return 0


def meet(spark: SparkSession, data: DataFrame, queries: DataFrame, kernel: Kernel, vec: str = "embedding", extra: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """The rows that ``kernel`` gives for all queries (qid, q) and all vectors (vec_id and ``vec``, with ``extra`` columns), in one scan of the data.

    Queries and vectors that are null, hold a null, or are of another length than the first query of a block take no part.
    """
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(kernel.schema).fields]
    asked = queries.filter("qid is not null and q is not null").select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q"))
    asked = asked.filter(F.forall("q", lambda v: v.isNotNull()))
    slim = data.filter(F.col(vec).isNotNull()).select("vec_id", F.col(vec), *extra)
    first = asked.limit(block + 1).collect()  # a block at most, and one row that tells whether there are more
    if not first:
        return spark.createDataFrame([], kernel.schema)

    def batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c) for c in columns], names=names)

    if len(first) <= block:
        width = len(first[0]["q"])
        rows = [r for r in first if len(r["q"]) == width]
        shared = spark.sparkContext.broadcast((np.array([r["qid"] for r in rows], np.int64), np.array([r["q"] for r in rows], float).reshape(len(rows), width)))

        def run(batches):
            ids, q = shared.value
            kept = kernel.start(ids, q)
            for whole in batches:
                for lo in range(0, whole.num_rows, BATCH):
                    b = whole.slice(lo, BATCH)
                    x, at = rows_of(b.column(1), width if kernel.same_width else None)
                    take = pa.array(at)
                    for out in kernel.meet(kept, ids, q, b.column(0).take(take).to_numpy(zero_copy_only=False), x, [b.column(2 + i).take(take) for i in range(len(extra))]):
                        yield batch(out)
            for out in kernel.end(kept, ids, q):
                yield batch(out)

        return slim.mapInArrow(run, kernel.schema)

    number = -(-asked.count() // block)
    # A block is one row of about ``block`` queries; blocks and packed batches of data meet, and no row of data is sent more than once a block.
    blocks = asked.groupBy(F.pmod(F.xxhash64("qid"), F.lit(number)).alias("b")).agg(F.collect_list("qid").alias("ids"), F.collect_list("q").alias("q"))
    kinds = dict(slim.dtypes)
    packed = "vec array<bigint>, x array<array<double>>" + "".join(f", m{i} array<{kinds[e]}>" for i, e in enumerate(extra))

    def pack(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                b = whole.slice(lo, BATCH)
                one = pa.array([0, b.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(one, c.cast(pa.int64()) if i == 0 else c.cast(pa.list_(pa.float64())) if i == 1 else c) for i, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays(lists, names=["vec", "x", *(f"m{i}" for i in range(len(extra)))])

    pairs = slim.mapInArrow(pack, packed).crossJoin(blocks)  # a stated set of queries against all rows, in blocks

    def run_pairs(batches):
        live: dict = {}  # block: ids, queries, what is kept
        for whole in batches:
            for r in range(whole.num_rows):
                row = whole.slice(r, 1)
                col = lambda n: row.column(row.schema.get_field_index(n)).flatten()  # noqa: E731, B023
                b = row.column(row.schema.get_field_index("b"))[0].as_py()
                if b not in live:
                    q, at = rows_of(col("q"))
                    ids = col("ids").to_numpy()[at]
                    live[b] = (ids, q, kernel.start(ids, q))
                ids, q, kept = live[b]
                x, at = rows_of(col("x"), q.shape[1] if kernel.same_width else None)
                take = pa.array(at)
                for out in kernel.meet(kept, ids, q, col("vec").take(take).to_numpy(zero_copy_only=False), x, [col(f"m{i}").take(take) for i in range(len(extra))]):
                    yield batch(out)
                while len(live) > 1 and sum(kernel.held(k) for *_, k in live.values()) > HELD:
                    i, p, k = live.pop(next(iter(live)))
                    for out in kernel.end(k, i, p):
                        yield batch(out)
        for i, p, k in live.values():
            for out in kernel.end(k, i, p):
                yield batch(out)

    return pairs.mapInArrow(run_pairs, kernel.schema)


def exact_pairs(x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs (q[i], x[j]) by differences (expanded squares lose the small ones), or inner products, each summed in one order."""
    out = np.empty(len(i))
    step = max(1, (1 << 22) // max(1, x.shape[1]))
    for lo in range(0, len(i), step):
        a, b = q[i[lo : lo + step]], x[j[lo : lo + step]]
        out[lo : lo + step] = (a * b).sum(1) if metric == "dot" else np.abs(a - b).sum(1) if metric == "l1" else ((a - b) ** 2).sum(1)
    return out


def rough(x: np.ndarray, q: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """queries x vectors: distances from one matrix product and the norms, and how far off they can be (for ``l1``: exact ones)."""
    if metric == "l1":
        return np.stack([np.abs(x - v).sum(1) for v in q]) if len(q) else np.zeros((0, len(x))), 0.0
    products, nx, nq = q @ x.T, (x * x).sum(1), (q * q).sum(1)
    off = 1e-12 * (x.shape[1] + 4) * float(nx.max(initial=0) + nq.max(initial=0))
    return (products, off) if metric == "dot" else (nq[:, None] + nx[None] - 2 * products, off)


def rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """To so many decimals, halves away from zero, as databases round."""
    scaled = d * 10.0**digits
    whole = np.trunc(scaled)
    return (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0)) / 10.0**digits


class Nearest(Kernel):
    """The k nearest of each query: a product of matrices bounds them, and what may be among the k is computed exactly.

    digits: distances count as equal if they are so at that many decimals.
    how: ``product``; ``naive`` computes every pair by differences; ``abandon`` adds up dimensions in the order of falling variance, a stretch at a time, and
    leaves a pair as soon as it is beyond the k-th best so far.
    """

    def __init__(self, k: int, metric: str = "l2sq", not_self: bool = False, how: str = "product", extra: str = "", digits: int | None = None):
        self.k, self.metric, self.not_self, self.how, self.digits = k, metric, not_self, how, digits
        #: How much farther than the k-th best a pair may lie and still equal it when rounded.
        self.slack = 0.0 if digits is None else 1.01 * 10.0**-digits
        self.schema = Kernel.schema + extra

    def start(self, ids, q):
        return {"i": np.zeros(0, np.int64), "vec": np.zeros(0, np.int64), "d": np.zeros(0), "more": [], "worst": np.full(len(ids), np.inf)}

    def held(self, kept):
        return len(kept["i"])

    def _candidates(self, worst: np.ndarray, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.how == "naive":
            return tuple(a.ravel() for a in np.indices((len(q), len(x))))
        if self.how == "abandon" and self.metric != "dot" and np.isfinite(worst).any():
            order = np.argsort(-x.var(0), kind="stable")
            i, j = (a.ravel() for a in np.indices((len(q), len(x))))
            total = np.zeros(len(i))
            for lo in range(0, len(order), 16):
                at = order[lo : lo + 16]
                step = np.abs(q[i][:, at] - x[j][:, at]) if self.metric == "l1" else (q[i][:, at] - x[j][:, at]) ** 2
                total += step.sum(1)
                near = np.flatnonzero(total <= worst[i] * (1 + 1e-9) + self.slack)
                i, j, total = i[near], j[near], total[near]
            return i, j
        d, off = rough(x, q, self.metric)
        d = -d if self.metric == "dot" else d
        bound = worst if len(x) <= self.k + 1 else np.minimum(worst, np.partition(d, self.k + self.not_self - 1, axis=1)[:, self.k + self.not_self - 1])
        return np.nonzero(d <= bound[:, None] + 2 * off + self.slack)

    def meet(self, kept, ids, q, vec, x, more):
        if len(x):
            for lo in range(0, len(q), 512):
                i, j = self._candidates(kept["worst"][lo : lo + 512], q[lo : lo + 512], x)
                i = i + lo
                if self.not_self:
                    i, j = (a[vec[j] != ids[i]] for a in (i, j))
                d = exact_pairs(x, q, i, j, self.metric)
                d = d if self.digits is None else rounded(d, self.digits)
                self._merge(kept, i, vec[j], -d if self.metric == "dot" else d, [m.take(pa.array(j)) for m in more])
        return iter(())

    def _merge(self, kept, i, vec, d, more):
        i, vec, d = (np.concatenate([kept[n], a]) for n, a in (("i", i), ("vec", vec), ("d", d)))
        more = [pa.concat_arrays([a, b.combine_chunks() if isinstance(b, pa.ChunkedArray) else b]) for a, b in zip(kept["more"], more, strict=True)] if kept["more"] else [m.combine_chunks() if isinstance(m, pa.ChunkedArray) else m for m in more]
        order = np.lexsort((vec, d, i))
        i = i[order]
        begins = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
        place = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
        keep = place < self.k
        order = order[keep]
        kept["i"], kept["vec"], kept["d"], kept["more"] = i[keep], vec[order], d[order], [m.take(pa.array(order)) for m in more]
        full = place[keep] == self.k - 1
        kept["worst"][kept["i"][full]] = kept["d"][full]

    def end(self, kept, ids, q):
        if len(kept["i"]):
            yield [ids[kept["i"]], kept["vec"], -kept["d"] if self.metric == "dot" else kept["d"], *kept["more"]]


class Within(Kernel):
    """All pairs whose distance is below the bound, or equal to it on request; none left out where the bound is infinite."""

    def __init__(self, bound: float, metric: str = "l2sq", inclusive: bool = False):
        self.bound, self.metric, self.inclusive = bound, metric, inclusive

    def meet(self, kept, ids, q, vec, x, more):
        for lo in range(0, len(q) if len(x) else 0, 256):
            part = q[lo : lo + 256]
            if np.isinf(self.bound):
                i, j = (a.ravel() for a in np.indices((len(part), len(x))))
            else:
                d, off = rough(x, part, self.metric)
                i, j = np.nonzero(d <= self.bound + 2 * off)
            d = exact_pairs(x, part, i, j, self.metric)
            fine = d <= self.bound if self.inclusive or np.isinf(self.bound) else d < self.bound
            yield [ids[lo + i[fine]], vec[j[fine]], d[fine]]


def products(spark: SparkSession, data: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """qid, vec_id, dist: the inner product of each query with each vector, a product of two matrices in long form."""
    return meet(spark, data, queries, Within(float("inf"), "dot"), block=block)


def rank_within(df: DataFrame, part: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each part; Spark bounds them before and after its shuffle."""
    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_join(spark: SparkSession, data: DataFrame, queries: DataFrame, k: int, metric: str = "l2sq", exclude_self: bool = False, block: int = BLOCK, how: str = "product", carry: str | None = None, digits: int | None = None) -> DataFrame:
    """qid, rank, vec_id, dist: the k nearest vectors of each query (largest inner products for ``dot``), ties to the smaller id.

    data: vec_id, embedding, and a column to ``carry`` along on request; queries: qid, q. With ``digits``, distances are rounded before they are ranked. A task keeps its k best of each query, so only these are shuffled.
    """
    extra = f", `{carry}` {dict(data.dtypes)[carry]}" if carry else ""
    found = meet(spark, data, queries, Nearest(k, metric, exclude_self, how, extra, digits), extra=(carry,) if carry else (), block=block)
    ranked = rank_within(found, "qid", [F.desc("dist") if metric == "dot" else F.col("dist"), F.col("vec_id")], k)
    return ranked.select("qid", "rank", "vec_id", "dist", *([carry] if carry else []))


def radius_join(spark: SparkSession, data: DataFrame, queries: DataFrame, radius_squared: float, inclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """qid, vec_id, dist: all vectors whose squared distance is below ``radius_squared`` (or equal to it, on request)."""
    return meet(spark, data, queries, Within(radius_squared, "l2sq", inclusive), block=block)


def _nearest_rows(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Number of each row's nearest row of ``matrix``, the first on ties; only rows that a product of matrices can't tell apart are compared exactly."""
    out = np.empty(len(x), np.int64)
    for lo in range(0, len(x), 1024):
        part = x[lo : lo + 1024]
        d, off = rough(matrix, part, "l2sq")
        i, j = np.nonzero(d <= d.min(1)[:, None] + 4 * off)
        order = np.lexsort((j, exact_pairs(matrix, part, i, j, "l2sq"), i))
        first = np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1]]))
        out[lo : lo + 1024] = j[order][first]
    return out


def assign_cells(data: DataFrame, centroids: DataFrame, vec: str = "embedding", dims: int | None = None) -> DataFrame:
    """``data`` with the nearest centroid's cell, ties to the smaller cell. The centroids are a model of bounded size and are collected."""
    table = sorted((r["cell"], list(r["centroid"])) for r in centroids.select("cell", "centroid").collect())
    cells, matrix = np.array([c for c, _ in table]), np.array([v for _, v in table], float)
    fields = [(f.name, f.dataType.simpleString()) for f in data.schema if f.name != "cell"]

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(vec).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                near = np.stack([((x - c) ** 2).sum(1) for c in matrix], 1).argmin(1) if len(matrix) < 64 else _nearest_rows(x, matrix)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in fields), pa.array(cells[near].astype(np.int32))], names=[*(n for n, _ in fields), "cell"])

    return data.select(*(n for n, _ in fields)).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*fields, ("cell", "int")]))


def probes(cells: int, fraction: float, default: float = 1.0) -> int:
    """Cells that a query probes: a share above 0 never rounds to none; 0 or less takes the default share, and that at 0 or less all."""
    share = fraction if fraction > 0 else default
    return cells if share <= 0 else max(1, min(cells, int(share * cells)))


def pruned_knn_join(spark: SparkSession, data: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, fraction: float, digits: int | None = None) -> DataFrame:
    """kNN over the cells nearest to each query: an equi-join on the cell, so that tables laid out by cell are pruned."""
    from strandline.functions.distances import l2_squared

    n = centroids.count()
    ranked = knn_join(spark, centroids.select(F.col("cell").cast("long").alias("vec_id"), F.col("centroid").alias("embedding")), queries, probes(n, fraction))
    wanted = ranked.select("qid", F.col("vec_id").cast("int").alias("cell")).join(queries, "qid")
    met = assign_cells(data, centroids).join(wanted, "cell").select("qid", "vec_id", l2_squared(F.col("embedding").cast("array<double>"), F.col("q").cast("array<double>")).alias("dist"))
    met = met if digits is None else met.withColumn("dist", F.round("dist", digits))
    return rank_within(met, "qid", [F.col("dist"), F.col("vec_id")], k).select("qid", "rank", "vec_id", "dist")


def lloyd(data: DataFrame, centroids: DataFrame, rounds: int = 1) -> DataFrame:
    """Centroids after some rounds of k-means; an empty cell keeps its centroid."""
    spark = data.sparkSession
    for _ in range(rounds):
        each = assign_cells(data, centroids).select("cell", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
        means = each.groupBy("cell", "d").agg(F.avg("x").alias("m")).groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("new"))
        rows = centroids.join(means, "cell", "left").select("cell", F.coalesce("new", F.col("centroid").cast("array<double>")).alias("centroid")).collect()
        centroids = spark.createDataFrame(rows, "cell int, centroid array<double>")
    return centroids


def classify(spark: SparkSession, examples: DataFrame, queries: DataFrame, metric: str = "l2sq", exclude_self: bool = False, digits: int | None = None) -> DataFrame:
    """qid, label of the nearest example (vec_id, embedding, label), the query's own row aside on request; a warped distance goes through ``distances.dtw`` instead."""
    return knn_join(spark, examples, queries, 1, metric, exclude_self, carry="label", digits=digits).select("qid", "label")


def recall(found: DataFrame, truth: DataFrame, at: list[int]) -> DataFrame:
    """r, recall: share of the queries whose true nearest vector is among the first r found."""
    best = truth.filter("rank = 1").select("qid", "vec_id")
    hit = best.join(found.select("qid", "vec_id", "rank"), ["qid", "vec_id"], "left")
    return hit.select(F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.coalesce((F.col("rank") <= r).cast("double"), F.lit(0.0)).alias("h")) for r in at))).alias("x")).groupBy(F.col("x.r").alias("r")).agg(F.avg("x.h").alias("recall"))


def pruned_radius_join(spark: SparkSession, data: DataFrame, queries: DataFrame, centroids: DataFrame, radius_squared: float, fraction: float) -> DataFrame:
    """qid, vec_id, dist of the vectors below a squared distance, among those in the cells nearest to each query."""
    from strandline.functions.distances import l2_squared

    n = centroids.count()
    ranked = knn_join(spark, centroids.select(F.col("cell").cast("long").alias("vec_id"), F.col("centroid").alias("embedding")), queries, probes(n, fraction))
    wanted = ranked.select("qid", F.col("vec_id").cast("int").alias("cell")).join(queries, "qid")
    dist = l2_squared(F.col("embedding").cast("array<double>"), F.col("q").cast("array<double>"))
    return assign_cells(data, centroids).join(wanted, "cell").select("qid", "vec_id", dist.alias("dist")).filter(F.col("dist") < radius_squared)


def first_centroids(data: DataFrame, k: int, seed: int | None = None) -> DataFrame:
    """cell, centroid: ``k`` different vectors to start from: those of the smallest ids, or drawn by a hash of their values."""
    rows = data.filter("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("centroid"))
    one = rows.groupBy("centroid").agg(F.min("vec_id").alias("vec_id"))
    order = [F.xxhash64(F.lit(seed), "centroid"), F.col("vec_id")] if seed is not None else [F.col("vec_id")]
    first = one.orderBy(*order).limit(k)
    return first.withColumn("cell", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int")).select("cell", "centroid")  # k rows


def within_cells(data: DataFrame, centroids: DataFrame) -> float:
    """Sum of squared distances of vectors to their cells' centroids."""
    from strandline.functions.distances import l2_squared

    met = assign_cells(data, centroids).join(F.broadcast(centroids), "cell")  # one row for each cell
    return float(met.agg(F.coalesce(F.sum(l2_squared(F.col("embedding").cast("array<double>"), F.col("centroid").cast("array<double>"))), F.lit(0.0))).first()[0])


def kmeans(data: DataFrame, k: int, rounds: int = 10, seed: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """cell, centroid after at most ``rounds`` rounds, or as soon as the total distance stays the same; k = 1 is the mean. An empty cell keeps its centroid."""
    centroids, before = start if start is not None else first_centroids(data, k, seed), None
    for _ in range(1 if k == 1 else rounds):
        centroids = lloyd(data, centroids)
        if k > 1 and rounds > 3:  # a look at the total costs a scan
            now = within_cells(data, centroids)
            if before is not None and now >= before * (1 - 1e-12):
                break
            before = now
    return centroids


def kmeans_minibatch(data: DataFrame, k: int, batch: int = 1024, steps: int = 50, seed: int = 0, chain: int = 200, subspaces: bool = False) -> DataFrame:
    """cell, centroid by k-means on small batches of a bounded sample: starts by Markov chains over it (a vector is the likelier the further it lies
    from the starts so far), or, on request, as combinations of sqrt(k) centroids of each half of the dimensions; each step moves the centroids
    towards their part of a batch by rates that fall with their number of vectors."""
    spark, bound = data.sparkSession, max(batch * steps, 20 * k)
    n = data.count()
    some = data.filter("embedding is not null").filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, bound / max(n, 1)) * (1 << 20)) + 1)
    x = np.array([r["embedding"] for r in sorted(some.select("vec_id", "embedding").collect(), key=lambda r: r["vec_id"])], float)
    rng = np.random.default_rng(seed)
    if not len(x):
        return spark.createDataFrame([], "cell int, centroid array<double>")

    def chained(x: np.ndarray, k: int) -> np.ndarray:
        c = x[[rng.integers(len(x))]]
        near = ((x - c[0]) ** 2).sum(1)
        while len(c) < k:
            at = rng.integers(0, len(x), chain)
            here = at[0]
            for j in at[1:]:
                if near[here] <= 0 or rng.random() < near[j] / near[here]:
                    here = j
            c = np.concatenate([c, x[[here]]])
            near = np.minimum(near, ((x - x[here]) ** 2).sum(1))
        return c

    if subspaces:
        root, half = int(round(k**0.5)), x.shape[1] // 2
        if root * root != k:
            raise ValueError("starts by halves need a square number of cells")
        left, right = chained(x[:, :half], root), chained(x[:, half:], root)
        c = np.concatenate([np.repeat(left, root, 0), np.tile(right, (root, 1))], 1)
    else:
        c = chained(x, k)
    seen = np.zeros(len(c))
    for _ in range(steps):
        part = x[rng.integers(0, len(x), min(batch, len(x)))]
        near = _nearest_rows(part, c)
        n_new = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, part)
        seen += n_new
        hit = n_new > 0
        c[hit] += (sums[hit] - n_new[hit, None] * c[hit]) / seen[hit, None]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, centroid array<double>")


class Warped(Nearest):
    """The k nearest by dynamic time warping within a band: the two lower bounds of a pair decide which pairs are warped at all."""

    def __init__(self, k: int, radius: int, not_self: bool = False, extra: str = "", bound: float = np.inf):
        super().__init__(k, "l2sq", not_self, extra=extra)
        self.radius, self.bound = radius, bound

    def start(self, ids, q):
        kept = super().start(ids, q)
        kept["worst"][:] = self.bound
        return kept

    def meet(self, kept, ids, q, vec, x, more):
        from strandline.functions.distances import dtw_rows, envelopes

        if not len(x):
            return iter(())
        low, high = envelopes(x, self.radius)
        for i, v in enumerate(q):
            own = np.flatnonzero(vec != ids[i]) if self.not_self else np.arange(len(x))
            l, h = envelopes(v[None], self.radius)
            far = lambda a, lo, hi: (np.maximum(np.maximum(a - hi, lo - a), 0) ** 2).sum(1)
            least = np.maximum(far(x[own], l, h), far(v[None], low[own], high[own])) * (1 - 1e-12)
            order = own[np.argsort(least, kind="stable")]
            least = np.sort(least, kind="stable")
            done, step = 0, max(2 * self.k, 16) if np.isfinite(self.k) else len(order)
            while done < len(order) and least[done] <= kept["worst"][i]:
                upto = min(len(order), done + step)
                some = order[done:upto][least[done:upto] <= kept["worst"][i]]
                d = dtw_rows(np.tile(v, (len(some), 1)), x[some], self.radius)
                fine = d <= kept["worst"][i]
                self._merge(kept, np.full(int(fine.sum()), i), vec[some[fine]], d[fine], [m.take(pa.array(some[fine])) for m in more])
                done, step = upto, min(4 * step, 1024)
        return iter(())


def warped_knn_join(spark: SparkSession, data: DataFrame, queries: DataFrame, k: int, radius: int, exclude_self: bool = False, normalized: bool = False, carry: str | None = None, block: int = BLOCK) -> DataFrame:
    """qid, rank, vec_id, dist: the k nearest by squared-cost dynamic time warping within a band; on request of the z-forms of both."""
    from strandline.functions import arrays

    if normalized:
        data = data.withColumn("embedding", arrays.normalize(F.col("embedding").cast("array<double>"), "z"))
        queries = queries.withColumn("q", arrays.normalize(F.col("q").cast("array<double>"), "z"))
    extra = f", `{carry}` {dict(data.dtypes)[carry]}" if carry else ""
    found = meet(spark, data, queries, Warped(k, radius, exclude_self, extra), extra=(carry,) if carry else (), block=block)
    return rank_within(found, "qid", [F.col("dist"), F.col("vec_id")], k).select("qid", "rank", "vec_id", "dist", *([carry] if carry else []))


def warped_within(spark: SparkSession, data: DataFrame, queries: DataFrame, bound: float, radius: int, block: int = BLOCK) -> DataFrame:
    """qid, vec_id, dist of all pairs whose warped distance is at most ``bound``."""
    return meet(spark, data, queries, Warped(1 << 40, radius, bound=bound), block=block)


def classify_warped(spark: SparkSession, examples: DataFrame, queries: DataFrame, radius: int = 1, exclude_self: bool = False, normalized: bool = False) -> DataFrame:
    """qid, label of the nearest example by warping."""
    return warped_knn_join(spark, examples, queries, 1, radius, exclude_self, normalized, "label").select("qid", "label")


def grouped_cells(data: DataFrame, fine: DataFrame) -> DataFrame:
    """``data`` (with cell) with the nearest of its cell's own ``fine`` centroids (cell, sub, centroid): sub, ties to the smaller one."""
    models: dict = {}
    for r in fine.select("cell", "sub", "centroid").orderBy("cell", "sub").collect():
        models.setdefault(r["cell"], ([], []))[0].append(r["sub"])
        models[r["cell"]][1].append(list(r["centroid"]))
    models = {c: (np.array(s), np.array(v, float)) for c, (s, v) in models.items()}
    fields = [(f.name, f.dataType.simpleString()) for f in data.schema if f.name != "sub"]

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, cell = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1), b.column("cell").to_numpy()
                sub = np.zeros(len(x), np.int32)
                for c in np.unique(cell):
                    names, centres = models[int(c)]
                    at = np.flatnonzero(cell == c)
                    sub[at] = names[np.stack([((x[at] - v) ** 2).sum(1) for v in centres], 1).argmin(1)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in fields), pa.array(sub)], names=[*(n for n, _ in fields), "sub"])

    return data.select(*(n for n, _ in fields)).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*fields, ("sub", "int")]))


def two_level_knn_join(spark: SparkSession, data: DataFrame, queries: DataFrame, coarse: DataFrame, fine: DataFrame, k: int, share: float, fine_share: float) -> DataFrame:
    """kNN over the nearest fine cells of the nearest coarse cells: one equi-join on both. The centroids are models of bounded size."""
    from strandline.functions.distances import l2_squared

    vec = lambda c: F.col(c).cast("array<double>")
    near = knn_join(spark, coarse.select(F.col("cell").cast("long").alias("vec_id"), F.col("centroid").alias("embedding")), queries, probes(coarse.count(), share))
    met = near.select("qid", F.col("vec_id").cast("int").alias("cell")).join(fine, "cell").join(queries, "qid").withColumn("d", l2_squared(vec("centroid"), vec("q")))
    count = F.count("*").over(Window.partitionBy("qid"))
    wanted = met.withColumn("most", count).withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d", "cell", "sub")))
    wanted = wanted.filter(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("most") * (fine_share if fine_share > 0 else 1.0)))).select("qid", "q", "cell", "sub")
    placed = grouped_cells(assign_cells(data, coarse), fine)
    found = placed.join(wanted, ["cell", "sub"]).select("qid", "vec_id", l2_squared(vec("embedding"), vec("q")).alias("dist"))
    return rank_within(found, "qid", [F.col("dist"), F.col("vec_id")], k).select("qid", "rank", "vec_id", "dist")


class Index:
    """A search made of parts: what is done to vectors first (``prepare``, learned from the data), what is done to queries, the join, and what is done to its rows.

    ``prepare`` takes the data and gives two functions of a DataFrame: for the data (column embedding) and for queries (column q). ``fit_seconds`` and
    ``query_seconds`` tell how long fitting took and the last search that was collected by ``timed``.
    """

    def __init__(self, spark: SparkSession, data: DataFrame, prepare=None, join=None, finish=None):
        began = time.time()
        own, theirs = prepare(data) if prepare else (lambda df: df, lambda df: df)
        self.spark, self.data, self.queries_as, self.join, self.finish = spark, own(data), theirs, join or knn_join, finish or (lambda df: df)
        self.fit_seconds, self.query_seconds = time.time() - began, 0.0

    def knn(self, queries: DataFrame, k: int, **options) -> DataFrame:
        return self.finish(self.join(self.spark, self.data, self.queries_as(queries), k, **options))

    def radius(self, queries: DataFrame, radius_squared: float, **options) -> DataFrame:
        return self.finish(radius_join(self.spark, self.data, self.queries_as(queries), radius_squared, **options))

    def timed(self, found: DataFrame) -> list:
        """The rows of a search, which are few enough to be collected; their time is kept."""
        began = time.time()
        rows = found.collect()
        self.query_seconds = time.time() - began
        return rows


def by_variance(data: DataFrame):
    """A ``prepare`` for ``Index``: dimensions by falling variance, so that sums of differences grow early."""
    from strandline.operators import vectors

    order = [r["dim"] for r in vectors.variance_order(data).orderBy("place").collect()]
    moved = lambda df, c: df.withColumn(c, F.transform(F.array(*(F.lit(d) for d in order)), lambda d: F.get(F.col(c), d)))
    return (lambda df: moved(df, "embedding")), (lambda df: moved(df, "q"))


def less_means(data: DataFrame):
    """A ``prepare`` for ``Index``: data and queries less the means of the data."""
    from strandline.operators import vectors

    mean = F.array(*(F.lit(float(m)) for m in vectors.column_moments(data)[0]))
    moved = lambda df, c: df.withColumn(c, F.zip_with(F.col(c).cast("array<double>"), mean, lambda x, m: x - m))
    return (lambda df: moved(df, "embedding")), (lambda df: moved(df, "q"))


class ProjectionIndex:
    """Vectors in bins of their principal axes. A range query meets only the bins of the first axis that it reaches (an equi-join); the other axes
    bound the distance from below before it is computed. Fitted on moments of all rows, so its model has a fixed size."""

    def __init__(self, spark: SparkSession, data: DataFrame, axes: int = 16, bins: int = 16):
        from strandline.operators import linear

        self.spark, (self.mean, self.axes, variances) = spark, linear.principal_axes(data, axes)
        self.width = max(float(np.sqrt(max(variances[0], 0.0))) * 4 / bins, 1e-9) if len(variances) else 1.0
        self.data = self._project(data.filter(F.col("embedding").isNotNull()).select("vec_id", "embedding"), "embedding").withColumn("bin", self._bin(F.get("p", F.lit(0))))

    def _bin(self, p: Column) -> Column:
        return F.floor(p / self.width).cast("long")

    def _project(self, df: DataFrame, vec: str) -> DataFrame:
        mean, axes = self.mean, self.axes  # bounded by the dimensions
        fields = [(f.name, f.dataType.simpleString()) for f in df.schema]

        def run(batches):
            for b in batches:
                if b.num_rows:
                    x = b.column(vec).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in fields), pa.array(((x - mean) @ axes.T).tolist(), pa.list_(pa.float64()))], names=[*(n for n, _ in fields), "p"])

        return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*fields, ("p", "array<double>")]))

    def within(self, queries: DataFrame, radius: float | Column) -> DataFrame:
        """qid, vec_id, dist (squared) of all vectors at most ``radius`` away; a column of ``queries`` may hold the radius."""
        from strandline.functions.distances import l2_squared

        reach = F.lit(float(radius)) if not isinstance(radius, Column) else radius
        rows = self._project(queries.withColumn("reach", reach).select("qid", "q", "reach"), "q").withColumnRenamed("p", "pq")
        first, slack = F.get("pq", F.lit(0)), F.col("reach") * (1 + 1e-9) + 1e-9
        asked = rows.withColumn("bin", F.explode(F.sequence(self._bin(first - slack), self._bin(first + slack))))
        vec = lambda c: F.col(c).cast("array<double>")
        met = self.data.join(asked, "bin").filter(l2_squared(F.col("p"), F.col("pq")) <= slack * slack)
        out = met.withColumn("dist", l2_squared(vec("embedding"), vec("q"))).filter(F.col("dist") <= F.col("reach") * F.col("reach"))
        return out.select("qid", "vec_id", "dist")

    def knn(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """qid, rank, vec_id, dist. The k-th nearest of each query in a bounded sample is an upper bound of its radius; then a range query."""
        rows = self.data.count()
        some = self.data.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(min(1.0, max(4096, 8 * k) / max(rows, 1)) * (1 << 20)) + 1)
        bound = knn_join(self.spark, some, queries, k, exclude_self=exclude_self).groupBy("qid").agg(F.max("dist").alias("far"), F.count("*").alias("n"))
        asked = queries.join(bound, "qid", "left").withColumn("radius", F.when(F.col("n") == k, F.sqrt("far") * (1 + 1e-9)))
        near = self.within(asked.filter("radius is not null"), F.col("radius"))
        near = near.filter("qid != vec_id") if exclude_self else near
        found = rank_within(near, "qid", [F.col("dist"), F.col("vec_id")], k).select("qid", "rank", "vec_id", "dist")
        # too few in the sample to bound the radius: all rows are met
        return found.unionByName(knn_join(self.spark, self.data, asked.filter("radius is null").select("qid", "q"), k, exclude_self=exclude_self).select(*found.columns))
