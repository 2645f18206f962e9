"""Vector quantization: codebooks, codes, lookup tables, scans and compressed search.

A codebook table has rows (m, c, centroid): centroid c of subspace m. It is a model whose size the parameters fix, so it is collected and sent to
the executors; vectors are encoded in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import linear, ranks, search
from strandline.operators.search import rank_within


def codebook_array(codebooks: DataFrame) -> np.ndarray:
    """subspaces x centroids x length."""
    rows = sorted((r["m"], r["c"], list(r["centroid"])) for r in codebooks.select("m", "c", "centroid").collect())
    m, c = 1 + max(r[0] for r in rows), 1 + max(r[1] for r in rows)
    return np.array([r[2] for r in rows], float).reshape(m, c, -1)


class Codec:
    """Product quantization by given or learned codebooks, after an optional rotation (rows times its transpose)."""

    def __init__(self, spark: SparkSession, books: np.ndarray, rotation: np.ndarray | None = None):
        self.spark, self.books, self.rotation = spark, books, rotation

    @classmethod
    def fit(cls, spark: SparkSession, data: DataFrame, subspaces: int, centroids: int = 16, rounds: int = 10, sample: int = 10_000, seed: int = 0, rotation: np.ndarray | None = None) -> Codec:
        """k-means in each subspace over a bounded sample, chosen by a hash of the id."""
        n = data.count()
        rows = data.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)) + 1).select("vec_id", "embedding").collect()
        x = np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"])], float)
        x = x @ rotation.T if rotation is not None else x
        if x.shape[1] % subspaces:
            raise ValueError("the length of a vector must be a multiple of the number of subspaces; pad it with zeros")
        rng, width, books = np.random.default_rng(seed), x.shape[1] // subspaces, []
        for m in range(subspaces):
            part = x[:, m * width : (m + 1) * width]
            c = part[rng.choice(len(part), centroids, replace=len(part) < centroids)]
            for _ in range(rounds):
                near = ((part[:, None] - c[None]) ** 2).sum(2).argmin(1)
                c = np.stack([part[near == j].mean(0) if (near == j).any() else c[j] for j in range(centroids)])
            books.append(c)
        return cls(spark, np.stack(books), rotation)

    @classmethod
    def fit_rotated(cls, spark: SparkSession, data: DataFrame, subspaces: int, centroids: int = 16, turns: int = 5, start: str = "identity", blocks: int = 1, **kw) -> Codec:
        """Alternate codebooks with the rotation that fits their reconstruction best (singular vectors of a sum over all rows of size D x D).

        start: a name of ``linear.initial_rotation``; blocks: stretches of dimensions that are rotated each by itself.
        """
        cov = linear.covariance_matrix(data)[1]
        rotation = linear.initial_rotation(cov, subspaces, start, kw.get("seed", 0))
        codec = cls.fit(spark, data, subspaces, centroids, rotation=rotation, **kw)
        for _ in range(turns):
            total, rotation = linear.moment_matrix(codec.reconstruct(codec.encode(data)), "approx", "embedding")[:-1, :-1], np.zeros_like(cov)
            if len(cov) % blocks:
                raise ValueError("the length of a vector must be a multiple of the number of blocks")
            for at in np.split(np.arange(len(cov)), blocks):
                u, _, vt = np.linalg.svd(total[np.ix_(at, at)])
                rotation[np.ix_(at, at)] = u @ vt
            codec = cls.fit(spark, data, subspaces, centroids, rotation=rotation, **kw)
        return codec

    @classmethod
    def fit_permuted(cls, spark: SparkSession, data: DataFrame, subspaces: int, centroids: int = 16, **kw) -> Codec:
        """Codebooks over the order of dimensions that ``linear.swap_order`` finds."""
        order = linear.swap_order(linear.covariance_matrix(data)[1], subspaces)
        return cls.fit(spark, data, subspaces, centroids, rotation=linear.permutation_rotation(order), **kw)

    def fit_mixing(self, data: DataFrame, keep: int) -> np.ndarray:
        """A sparse matrix (``keep`` nonzeros in a column) that takes reconstructions, in rotated space, nearer to the rotated vectors."""
        coded = self.reconstruct(self.encode(data))
        gram = linear.moment_matrix(coded, "approx", "approx")[:-1, :-1]
        cross = linear.moment_matrix(coded, "approx", "embedding")[:-1, :-1]
        return linear.hard_threshold_pursuit(gram, cross @ self.rotation.T if self.rotation is not None else cross, keep)

    def encode(self, data: DataFrame, int_round: bool = False) -> DataFrame:
        """``data`` with codes; ``int_round`` compares distances rounded to whole numbers. Ties go to the smaller code."""
        shared = self.spark.sparkContext.broadcast((self.books, self.rotation))
        fields, wide = [(f.name, f.dataType.simpleString()) for f in data.schema if f.name != "codes"], self.books.shape[1] > 1 << 15

        def run(batches):
            books, rotation = shared.value
            for b in batches:
                if b.num_rows:
                    x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                    codes = _encode(x @ rotation.T if rotation is not None else x, books, int_round)
                    lists = pa.ListArray.from_arrays(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1], codes.astype(np.int32 if wide else np.int16).ravel())
                    yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in fields), lists], names=[*(n for n, _ in fields), "codes"])

        return data.select(*(n for n, _ in fields)).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*fields, ("codes", "array<int>" if wide else "array<smallint>")]))

    def reconstruct(self, coded: DataFrame) -> DataFrame:
        """``coded`` with the vectors that the codes stand for."""
        shared = self.spark.sparkContext.broadcast(self.books)
        fields = [(f.name, f.dataType.simpleString()) for f in coded.schema if f.name != "approx"]

        def run(batches):
            for b in batches:
                if b.num_rows:
                    codes = b.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(int)
                    x = np.ascontiguousarray(_decode(codes, shared.value))
                    lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                    yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in fields), lists], names=[*(n for n, _ in fields), "approx"])

        return coded.select(*(n for n, _ in fields)).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*fields, ("approx", "array<double>")]))

    def tables(self, queries: DataFrame, metric: str = "l2sq", saturate: bool = False) -> DataFrame:
        """``queries`` (qid, q) with lut: for each subspace the distance to, or inner product with, each centroid; bytes from 0 to 255 on request."""
        shared = self.spark.sparkContext.broadcast((self.books, self.rotation))

        def run(batches):
            books, rotation = shared.value
            for b in batches:
                if b.num_rows:
                    q = b.column("q").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                    q = (q @ rotation.T if rotation is not None else q).reshape(len(q), books.shape[0], 1, -1)
                    lut = (q * books).sum(3) if metric == "dot" else ((q - books) ** 2).sum(3)
                    lut = np.clip(np.rint(lut), 0, 255) if saturate else lut
                    yield pa.RecordBatch.from_arrays([b.column("qid"), pa.array(lut.tolist(), pa.list_(pa.list_(pa.float64())))], names=["qid", "lut"])

        return queries.select("qid", "q").mapInArrow(run, "qid long, lut array<array<double>>")

    def distances(self, coded: DataFrame, tables: DataFrame, modes: tuple[str, ...] = ("safe",), block: int = 1024) -> DataFrame:
        """qid, vec_id and a column for each mode of ``scan``: all queries (qid, lut) against all codes, in one scan of the codes."""
        return search.meet(self.spark, coded, _flat(tables), TableSums(modes), vec="codes", block=block)

    def products(self, coded: DataFrame, queries: DataFrame, block: int = 1024) -> DataFrame:
        """qid, vec_id, product: a matrix product by codes: vectors are encoded once, and each query costs a table and a scan."""
        return self.distances(coded, self.tables(queries, "dot"), block=block).withColumnRenamed("safe", "product")

    def knn(self, coded: DataFrame, queries: DataFrame, k: int, metric: str = "l2sq", block: int = 1024) -> DataFrame:
        """qid, rank, vec_id, dist: compressed search. A task keeps its best for each query, by distances rounded to 12 places."""
        out = search.meet(self.spark, coded, _flat(self.tables(queries, metric)), TableNearest(k, metric), vec="codes", block=block)
        d = F.col("dist")
        return rank_within(out, "qid", [d.desc() if metric == "dot" else d, F.col("vec_id")], k).select("qid", "rank", "vec_id", "dist")

    def fidelity(self, coded: DataFrame, queries: DataFrame, block: int = 1024) -> DataFrame:
        """corr, mse, rel_error of squared distances by codes against true ones (``coded`` with embedding): nine sums leave a task, and no pairs."""
        asked = self.tables(queries).join(queries.select("qid", "q"), "qid")
        whole = asked.select("qid", F.concat(F.flatten("lut"), F.col("q").cast("array<double>")).alias("q"))
        entries = self.books.shape[0] * self.books.shape[1]
        sums = search.meet(self.spark, coded, whole, FidelitySums(entries), vec="codes", extra=("embedding",), block=block)
        n, t, f, tt, ff, tf, sq, rel, nrel = (F.sum(c) for c in FidelitySums.names)
        corr = (tf / n - t / n * f / n) / F.sqrt((tt / n - t / n * t / n) * (ff / n - f / n * f / n))
        return sums.agg(F.when(n > 0, corr).alias("corr"), F.when(n > 0, sq / n).alias("mse"), F.when(nrel > 0, rel / nrel).alias("rel_error"))


def _flat(tables: DataFrame) -> DataFrame:
    return tables.select("qid", F.flatten("lut").alias("q"))


def table_entries(luts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """subspaces x queries x vectors: the entries of tables (queries x subspaces x centroids) for codes (vectors x subspaces)."""
    return np.stack([np.take(luts[:, m], codes[:, m], axis=1) for m in range(codes.shape[1])])


class TableSums(search.Kernel):
    """All sums of table entries, by the modes of ``scan``."""

    same_width = False

    def __init__(self, modes: tuple[str, ...]):
        self.modes, self.schema = modes, "qid long, vec_id long, " + ", ".join(f"{m} double" for m in modes)

    def meet(self, kept, ids, q, vec, x, more):
        codes = x.astype(np.int64)
        luts = q.reshape(len(q), codes.shape[1], -1) if len(codes) else q
        for lo in range(0, len(ids) if len(codes) else 0, 32):
            found = table_entries(luts[lo : lo + 32], codes)
            yield [np.repeat(ids[lo : lo + 32], len(vec)), np.tile(vec, found.shape[1]), *(_sums(found, m).ravel() for m in self.modes)]


class TableNearest(search.Nearest):
    """The k nearest by sums of table entries."""

    same_width = False

    def __init__(self, k: int, metric: str):
        super().__init__(k, metric)

    def meet(self, kept, ids, q, vec, x, more):
        """Sums in single precision bound what may be among the k; only that is summed again in double precision."""
        codes = x.astype(np.int64)
        if not len(codes):
            return iter(())
        if "tables" not in kept:  # an entry of all queries lies together
            kept["luts"] = (-1.0 if self.metric == "dot" else 1.0) * q.reshape(len(q), codes.shape[1], -1)
            kept["tables"] = np.ascontiguousarray(kept["luts"].transpose(1, 2, 0), dtype=np.float32)
            kept["off"] = 1e-6 * codes.shape[1] * float(np.abs(kept["tables"]).max(initial=0)) + 1e-12
        luts, tables, off = kept["luts"], kept["tables"], kept["off"]
        step = max(256, (1 << 19) // max(1, len(q)))
        for lo in range(0, len(codes), step):
            part = codes[lo : lo + step]
            total = tables[0][part[:, 0]]
            for m in range(1, part.shape[1]):
                total += tables[m][part[:, m]]
            d = np.ascontiguousarray(total.T)
            bound = kept["worst"] if len(part) <= self.k else np.minimum(kept["worst"], np.partition(d, self.k - 1, axis=1)[:, self.k - 1].astype(float) + off)
            i, j = np.nonzero(d <= (bound + off)[:, None])
            exact = np.zeros(len(i))
            for m in range(part.shape[1]):
                exact += luts[i, m, part[j, m]]
            self._merge(kept, i, vec[lo + j], np.round(exact, 12), [])
        return iter(())


class FidelitySums(search.Kernel):
    """Sums over all pairs of true distances t and those by codes f."""

    names = ("n", "t", "f", "tt", "ff", "tf", "sq", "rel", "nrel")
    schema = ", ".join(f"{c} double" for c in names)
    same_width = False

    def __init__(self, entries: int):
        self.entries = entries

    def start(self, ids, q):
        return np.zeros(len(self.names))

    def meet(self, kept, ids, q, vec, x, more):
        codes = x.astype(np.int64)
        e, at = search.rows_of(more[0], q.shape[1] - self.entries)
        codes = codes[at]
        for lo in range(0, len(ids) if len(codes) else 0, 64):
            part = q[lo : lo + 64]
            f = table_entries(part[:, : self.entries].reshape(len(part), codes.shape[1], -1), codes).sum(0).ravel()
            i, j = (a.ravel() for a in np.indices((len(part), len(e))))
            t = search.exact_pairs(e, part[:, self.entries :], i, j, "l2sq")
            some = t != 0
            kept += [len(t), t.sum(), f.sum(), (t * t).sum(), (f * f).sum(), (t * f).sum(), ((t - f) ** 2).sum(), (np.abs(t - f)[some] / t[some]).sum(), some.sum()]
        return iter(())

    def end(self, kept, ids, q):
        yield [np.array([v]) for v in kept]


def _sums(found: np.ndarray, mode: str) -> np.ndarray:
    """What ``scan`` gives, for table entries whose first axis is the subspace."""
    if mode == "u8":
        return np.minimum(found.sum(0), 255)
    if mode == "u16":
        even = np.pad(found, ((0, found.shape[0] % 2), *((0, 0),) * (found.ndim - 1)))
        return np.minimum(np.minimum(even[::2] + even[1::2], 255).sum(0), 65535)
    return found.sum(0)


def _encode(x: np.ndarray, books: np.ndarray, int_round: bool = False) -> np.ndarray:
    """Nearest centroid of each stretch, the first on ties: a matrix product per subspace, and exact distances where it can't decide."""
    parts = x.reshape(len(x), books.shape[0], -1)
    if int_round:
        return np.rint(((parts[:, :, None] - books) ** 2).sum(3)).argmin(2)
    out = np.empty(parts.shape[:2], np.int64)
    for m in range(books.shape[0]):
        d, off = search.rough(books[m], parts[:, m], "l2sq")
        best = d.argmin(1)
        out[:, m] = best
        near = (d <= d[np.arange(len(d)), best][:, None] + 4 * off).sum(1) > 1
        if near.any():
            out[near, m] = ((parts[near, m][:, None] - books[m]) ** 2).sum(2).argmin(1)
    return out


def _decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([books[m][codes[:, m]] for m in range(codes.shape[1])], 1)


def scan(codes: Column, lut: Column, mode: str = "safe") -> Column:
    """Sum of the table's entries for the codes: ``u8`` saturates at 255, ``u16`` saturates each pair at 255, ``safe`` not at all."""
    found = F.transform(codes, lambda c, m: F.get(F.get(lut, m), c.cast("int")))
    if mode == "u8":
        return F.aggregate(found, F.lit(0.0), lambda s, v: F.least(F.lit(255.0), s + v))
    if mode == "u16":
        pairs = F.transform(F.sequence(F.lit(0), F.size(found) - 1, F.lit(2)), lambda i: F.least(F.lit(255.0), F.get(found, i) + F.coalesce(F.get(found, i + 1), F.lit(0.0))))
        return F.least(F.lit(65535.0), F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v))
    return F.aggregate(found, F.lit(0.0), lambda s, v: s + v)


def quantize_tables(tables: DataFrame, alpha: float) -> DataFrame:
    """lut with each subspace's floor (its percentile ``alpha`` over all queries and centroids) taken off and one scale to 255, as whole numbers, the
    floors, and the scale. For inner products, whose entries may be negative, alpha = 0 makes the floor the subspace's least entry."""
    each = tables.select(F.posexplode("lut").alias("m", "row")).select("m", F.explode("row").alias("v"))
    low = ranks.percentiles(each, "m", "v", [alpha]).select("m", F.get("cuts", F.lit(0)).alias("lo"))
    ends = each.groupBy("m").agg(F.max("v").alias("hi")).join(low, "m")
    one = ends.agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "lo"))), lambda s: s["lo"]).alias("floors"), (255 / F.max(F.col("hi") - F.col("lo"))).alias("scale"))
    scaled = lambda row, lo, k: F.transform(row, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.rint((v - lo) * k).cast("int"))))
    return tables.join(F.broadcast(one)).select("qid", F.transform("lut", lambda row, m: scaled(row, F.get(F.col("floors"), m), F.col("scale"))).alias("lut"), "floors", "scale")  # one row


#: The percentiles among which ``best_floor`` looks.
ALPHAS = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05)


def best_floor(tables: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """alpha, error: for each percentile the mean squared error of tables that ``quantize_tables`` made by it, put back to scale; least error first."""
    out = None
    for alpha in alphas:
        q = quantize_tables(tables, alpha).withColumnRenamed("lut", "bytes")
        met = tables.join(q, "qid").select(F.posexplode(F.arrays_zip("lut", "bytes")).alias("m", "z"), "floors", "scale")
        back = F.zip_with(F.col("z.lut"), F.col("z.bytes"), lambda v, b: (v - (b / F.col("scale") + F.get(F.col("floors"), F.col("m")))) * (v - (b / F.col("scale") + F.get(F.col("floors"), F.col("m")))))
        one = met.select(F.explode(back).alias("e")).agg(F.lit(float(alpha)).alias("alpha"), F.avg("e").alias("error"))
        out = one if out is None else out.unionAll(one)
    return out.orderBy("error", "alpha")


def affine_dot_tables(queries: DataFrame, books: np.ndarray, offsets: list[float], scale: float) -> DataFrame:
    """lut of inner products with the query's components shifted and scaled first: (q_j - offsets[j]) * scale, j counted within a subvector."""
    codec = Codec(queries.sparkSession, books)
    width = books.shape[2]
    shifts = F.array(*(F.lit(float(v)) for v in offsets))
    moved = F.transform(F.col("q").cast("array<double>"), lambda v, i: (v - F.get(shifts, i % width)) * scale)
    return codec.tables(queries.withColumn("q", moved), "dot")


def pack12(codes: np.ndarray) -> np.ndarray:
    """Rows of an even number of codes below 4096, two in three bytes: the low byte of each of both, then their high four bits side by side."""
    a, b = codes[:, ::2].astype(np.uint16), codes[:, 1::2].astype(np.uint16)
    return np.stack([a & 255, b & 255, (a >> 8) | (b >> 8 << 4)], 2).astype(np.uint8).reshape(len(codes), -1)


def unpack12(packed: np.ndarray) -> np.ndarray:
    """The codes of ``pack12``."""
    p = packed.reshape(len(packed), -1, 3).astype(np.int64)
    return np.stack([p[:, :, 0] | (p[:, :, 2] & 15) << 8, p[:, :, 1] | p[:, :, 2] >> 4 << 8], 2).reshape(len(packed), -1)


def packed_codes(coded: DataFrame, bits: int) -> DataFrame:
    """vec_id, packed: codes of 12 bits (two in three bytes) or 16 bits (two bytes each, the low one first) as bytes."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                codes = b.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64) & 0xFFFF
                rows = pack12(codes) if bits == 12 else codes.astype("<u2").view(np.uint8).reshape(len(codes), -1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "packed"])

    if bits not in (12, 16):
        raise ValueError("codes of 12 or 16 bits")
    return coded.select("vec_id", "codes").mapInArrow(run, "vec_id long, packed binary")


def unpacked_codes(packed: DataFrame, bits: int) -> DataFrame:
    """vec_id, codes (whole numbers) of ``packed_codes``, for ``Codec.distances`` and ``Codec.knn``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                rows = np.frombuffer(b"".join(b.column("packed").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                codes = unpack12(rows) if bits == 12 else rows.view("<u2").astype(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1], codes.astype(np.int32).ravel())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), lists], names=["vec_id", "codes"])

    return packed.mapInArrow(run, "vec_id long, codes array<int>")


def quantize_tables_between(tables: DataFrame, low: float, high: float) -> DataFrame:
    """lut as bytes, such that a total distance of ``low`` comes near 0 and one of ``high`` near 255: the offset is shared by the subspaces."""
    scaled = lambda row, n: F.transform(row, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.rint((v - low / n) * 255 / (high - low)).cast("int"))))
    return tables.withColumn("lut", F.transform("lut", lambda row: scaled(row, F.size("lut"))))


def thresholds_quantile(data: DataFrame, cuts: list[float]) -> DataFrame:
    """dim, thresholds: percentiles of each dimension."""
    each = data.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "v"))
    return ranks.percentiles(each, "dim", "v", cuts).select("dim", F.col("cuts").alias("thresholds"))


def thresholds_gauss(data: DataFrame, bins: int) -> DataFrame:
    """dim, thresholds: mean plus deviation times the normal quantiles of ``bins`` equal shares."""
    from statistics import NormalDist

    cuts = [NormalDist().inv_cdf(i / bins) for i in range(1, bins)]
    each = data.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "v"))
    return each.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).select("dim", F.array(*(F.col("m") + F.col("s") * c for c in cuts)).alias("thresholds"))


def digitize(value: Column, thresholds: Column) -> Column:
    """Number of thresholds at or below the value."""
    return F.size(F.filter(thresholds, lambda t: t <= value))


def reconstruction_error(pairs: DataFrame) -> DataFrame:
    """error: mean squared distance between embedding and approx over the mean variance of the embeddings."""
    from strandline.functions.arrays import variance
    from strandline.functions.distances import l2_squared

    x = F.col("embedding").cast("array<double>")
    return pairs.agg((F.avg(l2_squared(x, F.col("approx")) / F.size(x)) / F.avg(variance(x))).alias("error"))


def overlapped(vector: Column, subspaces: int, extra: int) -> Column:
    """The subspaces' stretches one after the other, each begun ``extra`` dimensions early; the first one's come from the vector's end."""
    n = F.size(vector)
    width = (n / subspaces).cast("int")
    at = lambda m, j: F.get(vector, F.pmod(m * width + j - extra, n))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda m: F.transform(F.sequence(F.lit(0), width + extra - 1), lambda j: at(m, j))))


def merged(stretches: Column, subspaces: int, extra: int) -> Column:
    """The vector of ``overlapped`` stretches (``extra`` no longer than a subspace): a dimension that stands in two is their mean."""
    from strandline.functions.arrays import let

    each = (F.size(stretches) / subspaces).cast("int")
    width = each - extra

    def dimension(all_: Column, d: Column) -> Column:
        m, j = (d / width).cast("int"), F.pmod(d, width)
        own, late = F.get(all_, m * each + j + extra), j - (width - extra)
        return F.when(late < 0, own).otherwise((own + F.get(all_, F.pmod(m + 1, F.lit(subspaces)) * each + late)) / 2)

    return let(stretches, lambda all_: F.transform(F.sequence(F.lit(0), width * subspaces - 1), lambda d: dimension(all_, d)))


def chained_codes(distances: np.ndarray, shared_bits: int) -> np.ndarray:
    """Codes (rows x subspaces) of least total distance among those whose last ``shared_bits`` are the first of the next code: a shortest path.

    distances: rows x subspaces x centroids, the number of centroids a power of two. Shared bits need storing once only.
    """
    n, parts, k = distances.shape
    states, bits = 1 << shared_bits, k.bit_length() - 1
    codes = np.arange(k)
    begins, ends = codes >> (bits - shared_bits), codes & (states - 1)
    cost, back = np.zeros((n, states)), []
    for m in range(parts):
        reach = cost[:, begins] + distances[:, m]
        into = np.stack([np.where(ends == s, reach, np.inf).argmin(1) for s in range(states)], 1)
        back.append(into)
        cost = np.take_along_axis(reach, into, 1)
    out, state = np.zeros((n, parts), int), cost.argmin(1)
    for m in range(parts - 1, -1, -1):
        out[:, m] = back[m][np.arange(n), state]
        state = begins[out[:, m]]
    return out
