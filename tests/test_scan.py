"""The scan that all searches share, exact percentiles, and tables of vectors, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals, quantize, ranks, search, vectors

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def x():
    return np.round(RNG.normal(size=(300, 10)), 1)  # ties


@pytest.fixture(scope="module")
def data(spark, x):
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, None, 0), (901, [1.0], 0), (902, [None] * 10, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)


@pytest.fixture(scope="module")
def queries(spark, x):
    return spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 10)] + [(7, None), (None, x[0].tolist())], "qid long, q array<double>")


def plain(x, k, metric, exclude):
    out = []
    for i in range(0, 300, 10):
        d = {"l2sq": lambda: ((x - x[i]) ** 2).sum(1), "l1": lambda: np.abs(x - x[i]).sum(1), "dot": lambda: -(x * x[i]).sum(1)}[metric]()
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if not exclude or j != i][:k]
        out += [(i, r + 1, int(j)) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize(("metric", "how"), [("l2sq", "product"), ("l2sq", "naive"), ("l2sq", "abandon"), ("l1", "abandon"), ("l1", "product"), ("dot", "product")])
def test_knn(spark, data, queries, x, metric, how, block):
    got = search.knn_join(spark, data, queries, 6, metric, True, block, how)
    assert sorted((r.qid, r.rank, r.vec_id) for r in got.collect()) == plain(x, 6, metric, True)


def test_one_scan_of_the_data(spark, data, queries, x, tmp_path):
    data.write.parquet(str(tmp_path / "data"))
    found = search.knn_join(spark, spark.read.parquet(str(tmp_path / "data")), queries, 3, block=4)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


@pytest.mark.parametrize("block", [4096, 7])
def test_radius_and_products(spark, data, queries, x, block):
    got = {(r.qid, r.vec_id) for r in search.radius_join(spark, data, queries, 9.0, block=block).collect()}
    assert got == {(i, j) for i in range(0, 300, 10) for j in range(300) if ((x[j] - x[i]) ** 2).sum() < 9.0}
    product = {(r.qid, r.vec_id): r.dist for r in search.products(spark, data, queries, block).collect()}
    assert len(product) == 9000 and all(abs(v - x[i] @ x[j]) < 1e-9 for (i, j), v in product.items())
    assert search.knn_join(spark, data, queries.filter("false"), 3).count() == 0 and search.knn_join(spark, data.filter("false"), queries, 3).count() == 0


def test_labels_are_carried(spark, data, queries, x):
    got = {r.qid: r.label for r in search.classify(spark, data, queries, exclude_self=True).collect()}
    assert got == {i: j % 3 for i, _, j in plain(x, 1, "l2sq", True)}


@pytest.mark.parametrize("block", [1024, 7])
def test_compressed_scans(spark, data, queries, x, block):
    books = RNG.normal(size=(5, 16, 2))
    codec = quantize.Codec(spark, books)
    coded = codec.encode(data.filter("vec_id < 300"))
    codes = {r.vec_id: list(r.codes) for r in coded.collect()}
    for i in range(300):
        assert codes[i] == [int(((books[m] - x[i, 2 * m : 2 * m + 2]) ** 2).sum(1).argmin()) for m in range(5)]
    lut = {i: ((books - x[i].reshape(5, 1, 2)) ** 2).sum(2) for i in range(0, 300, 10)}
    asked = queries.filter("qid is not null and q is not null")
    got = {(r.qid, r.vec_id): r for r in codec.distances(coded, codec.tables(asked), ("safe", "u8"), block).collect()}
    assert len(got) == 9000
    for (i, j), r in got.items():
        assert abs(r.safe - lut[i][range(5), codes[j]].sum()) < 1e-9 and r.u8 == min(255, r.safe)
    near = [(r.qid, r["rank"], r.vec_id) for r in codec.knn(coded, asked, 4, block=block).collect()]
    want = [(i, n + 1, j) for i in range(0, 300, 10) for n, j in enumerate(sorted(range(300), key=lambda j: (round(lut[i][range(5), codes[j]].sum(), 12), j))[:4])]
    assert sorted(near) == sorted(want)
    t = np.array([((x[j] - x[i]) ** 2).sum() for i, j in got])
    f = np.array([r.safe for r in got.values()])
    one = codec.fidelity(coded, asked, block).first()
    assert abs(one.corr - np.corrcoef(t, f)[0, 1]) < 1e-9 and abs(one.mse - ((t - f) ** 2).mean()) < 1e-9 and abs(one.rel_error - (np.abs(t - f) / np.where(t, t, 1))[t != 0].mean()) < 1e-9
    back = {r.vec_id: r.approx for r in codec.reconstruct(coded).collect()}
    assert np.allclose([back[i] for i in range(300)], [np.concatenate([books[m][codes[i][m]] for m in range(5)]) for i in range(300)])


def test_packed_codes(spark):
    codes = RNG.integers(0, 4096, (50, 6))
    assert (quantize.unpack12(quantize.pack12(codes)) == codes).all() and quantize.pack12(codes).shape == (50, 9)
    assert quantize.pack12(np.array([[0xABC, 0x123]])).tolist() == [[0xBC, 0x23, 0x1A]]
    table = spark.createDataFrame([(i, c) for i, c in enumerate(codes.tolist())], "vec_id long, codes array<int>")
    for bits in (12, 16):
        got = quantize.unpacked_codes(quantize.packed_codes(table, bits), bits).collect()
        assert {r.vec_id: r.codes for r in got} == dict(enumerate(codes.tolist()))


@pytest.mark.parametrize("rounds", [1, 2])
def test_percentiles(spark, rounds):
    parts = {"a": RNG.normal(size=5000), "b": RNG.integers(0, 3, 4000).astype(float), "c": np.array([4.0]), "d": np.array([1.0, 2.0]), "e": np.exp(RNG.normal(size=3000) * 5)}
    rows = spark.createDataFrame([(k, float(v)) for k, p in parts.items() for v in p] + [("a", None), ("b", float("nan"))], "k string, v double")
    cuts = [0.0, 0.1, 0.33, 0.5, 0.999, 1.0]
    got = {r.k: r.cuts for r in ranks.percentiles(rows, "k", "v", cuts, rounds, 16).collect()}
    assert got.keys() == parts.keys()
    for k, p in parts.items():
        assert np.allclose(got[k], np.quantile(p, cuts), rtol=1e-12, atol=1e-12)


def test_normalization_and_shapes(spark, x):
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    back = lambda df: np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    sd = x.std(0)
    assert np.allclose(back(vectors.normalized_columns(data, "z")), (x - x.mean(0)) / sd)
    assert np.allclose(back(vectors.normalized_columns(data, "l2")), x / np.linalg.norm(x, axis=0))
    flat = data.withColumn("embedding", F.transform("embedding", lambda v, i: F.when(i == 2, 5.0).otherwise(v)))
    assert np.allclose(back(vectors.normalized_columns(flat, "std"))[:, 2], 5)  # a deviation below the threshold counts as 1
    assert np.allclose(back(vectors.normalized(data, "all")), (x - x.mean()) / x.std())
    halves = x.reshape(300, 5, 2)
    assert np.allclose(back(vectors.normalized(data, "each_mean", 2)), (halves - halves.mean(1, keepdims=True)).reshape(300, 10))
    most = np.linalg.norm(x, axis=1).max()
    for how, place in (("mips_data", 10), ("mips_query", 11)):
        got = back(vectors.normalized(data, how))
        assert np.allclose(got[:, :10], x / most) and np.allclose(got[:, place], np.sqrt(np.maximum(0, 1 - (x * x).sum(1) / most**2)))
    assert np.allclose(back(vectors.normalized_rows(data, "mean_l2"))[0], (x[0] - x[0].mean()) / np.linalg.norm(x[0] - x[0].mean()))
    one = spark.createDataFrame([([3.0, 3.0],), ([1.0, 3.0],)], "a array<double>").select(vectors.c_znormalized(F.col("a")).alias("z")).collect()
    assert [r.z for r in one] == [[0.0, 0.0], [-1.0, 1.0]]
    some = spark.createDataFrame([(0, [0.0, 0.0, 1.0]), (1, [0.0, 0.0, 0.0]), (2, [0.0, 2.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vectors.without_zero_rows(some).collect()] == [0, 2] and vectors.zero_columns(some) == [0]
    assert back(vectors.without_columns(some, [0])).tolist() == [[0, 1], [0, 0], [2, 2]]
    assert [r.vec_id for r in vectors.without_flat_rows(some).collect()] == [0, 2]
    assert back(vectors.only_columns(some, [2])[0]).tolist() == [[1], [0], [2]]
    assert back(vectors.with_columns(some, 1, 1)).tolist() == [[0, 0, 1, 0, 1], [0, 0, 0, 0, 1], [0, 2, 2, 0, 1]]
    assert back(vectors.with_rows(some, 1, 1.0, 9)).tolist()[-1] == [1, 1, 1]
    middle = back(vectors.centred_in(some, 6, 5))
    assert middle.shape == (6, 5) and middle[1:4, 1:4].tolist() == back(some).tolist() and middle.sum() == 5
    assert [r.vec_id for r in vectors.matching_rows(some, [0, 2, 2]).collect()] == [2]
    assert [r.vec_id for r in vectors.contiguous_rows(data, 4, 100).collect()] == [100, 101, 102, 103]
    drawn = [r.vec_id for r in vectors.contiguous_rows(data, 5, seed=3).collect()]
    assert drawn == list(range(drawn[0], drawn[0] + 5))


def test_variance_groups_and_draws(spark):
    a = RNG.normal(size=(1, 12))
    got = spark.createDataFrame([(a[0].tolist(),)], "a array<double>").select(vectors.variance_nd(F.col("a"), 3).alias("v")).first().v
    assert abs(got - np.mean([a[0][i::3].var() for i in range(3)])) < 1e-12
    rows = spark.createDataFrame([(i, v) for i, v in enumerate("abcab")], "i int, v string")
    lists = {r.group: (r.places, r["values"]) for r in vectors.grouped_lists(rows, F.col("v"), "i", "v").collect()}
    assert lists == {"a": ([0, 3], ["a", "a"]), "b": ([1, 4], ["b", "b"]), "c": ([2], ["c"])}
    many = spark.range(2000).withColumn("w", F.when(F.col("id") < 1000, 3.0).otherwise(1.0)).withColumn("w", F.when(F.col("id") % 10 == 0, 0.0).otherwise(F.col("w")))
    for replace in (False, True):
        chosen = vectors.choice(many, 400, "id", "w", replace, seed=1).collect()
        ids = [r.id for r in chosen]
        assert sorted(r.draw for r in chosen) == list(range(400)) and not any(i % 10 == 0 for i in ids)
        assert (len(set(ids)) == 400) != replace and 0.62 < np.mean([i < 1000 for i in ids]) < 0.85
        assert ids == [r.id for r in vectors.choice(many, 400, "id", "w", replace, seed=1).collect()]


def test_pluggable_match(spark):
    reported = spark.createDataFrame([("s", 1, 0, 10, "a"), ("s", 2, 20, 30, "a"), ("t", 3, 0, 4, "a")], "series string, id long, start long, end long, label string")
    truth = spark.createDataFrame([("s", 7, 2, 4, "a"), ("s", 8, 24, 40, "a"), ("t", 9, 3, 9, "b")], "series string, id long, start long, end long, label string")
    pairs = lambda **kw: sorted((r.rid, r.tid) for r in intervals.greedy_matches(reported, truth, **kw).collect())
    assert pairs() == [] and pairs(test=intervals.covers) == [(1, 7)]
    assert pairs(test=intervals.holds_point, with_labels=False) == [(1, 7), (2, 8), (3, 9)]
    assert pairs(least=0.25) == [(2, 8)]
