"""Fitted models, warped search, the pattern learner's parts, and special functions, against plain versions."""

import math

import numpy as np
import pytest

from strandline.functions import distances, special
from strandline.operators import motif, search
from strandline.sources import vectors as files

RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def x():
    return RNG.normal(size=(120, 8))


@pytest.fixture(scope="module")
def data(spark, x):
    return spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)


def plain_dtw(a, b, radius):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(max(0, i - radius), min(len(b), i + radius + 1)):
            d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


@pytest.mark.parametrize("block", [4096, 3])
def test_warped_search(spark, data, x, block):
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 120, 15)], "qid long, q array<double>")
    d = {i: [plain_dtw(x[i], v, 2) for v in x] for i in range(0, 120, 15)}
    got = sorted((r.qid, r["rank"], r.vec_id) for r in search.warped_knn_join(spark, data, queries, 4, 2, True, block=block).collect())
    want = [(i, r + 1, j) for i in d for r, j in enumerate([j for j in sorted(range(120), key=lambda j: (d[i][j], j)) if j != i][:4])]
    assert got == sorted(want)
    near = {(r.qid, r.vec_id) for r in search.warped_within(spark, data, queries, 5.0, 2, block).collect()}
    assert near == {(i, j) for i in d for j in range(120) if d[i][j] <= 5.0}


def test_classifier_by_three_distances(spark):
    """The nearest example depends on the distance: by warping, by squares, by magnitudes."""
    rows = [(1, [5, 2, 2, 3, 5], 1), (2, [5, 2, 2.5, 2.5, 5], 2), (3, [5, 2, 2.2, 2.9, 5], 3)]
    examples = spark.createDataFrame([(i, [float(v) for v in e], c) for i, e, c in rows], "vec_id long, embedding array<double>, label int")
    query = spark.createDataFrame([(9, [5.0, 2.0, 3.0, 3.0, 5.0])], "qid long, q array<double>")
    assert search.classify_warped(spark, examples, query, 1).first().label == 1
    assert search.classify(spark, examples, query, "l2sq").first().label == 2
    assert search.classify(spark, examples, query, "l1").first().label == 3
    assert abs(distances.dtw_rows(np.array([[5, 2, 2, 3, 5.1]]), np.array([[5.0, 2, 3, 3, 4]]), 1)[0] - 1.21) < 1e-9


def test_kmeans(spark, data, x):
    def plain(c, rounds):
        for _ in range(rounds):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        return c

    table = lambda df: np.array([r.centroid for r in df.orderBy("cell").collect()])
    assert np.allclose(table(search.kmeans(data, 5, 3)), plain(x[:5], 3))
    assert np.allclose(table(search.kmeans(data, 1)), [x.mean(0)])
    stopped = search.kmeans(data, 3, 60)
    assert np.allclose(table(search.lloyd(data, stopped)), table(stopped), atol=1e-6)  # it ended because nothing moved
    for halves in (False, True):
        small = search.kmeans_minibatch(data, 4, 64, 30, subspaces=halves)
        assert search.within_cells(data, small) < search.within_cells(data, search.kmeans(data, 1))
    with pytest.raises(ValueError):
        search.kmeans_minibatch(data, 5, subspaces=True)


def test_features_of_a_series():
    x = np.cumsum(RNG.normal(size=400))
    m, chosen = 16, np.array([3, 100, 250])
    w = np.stack([x[i : i + m] - x[i : i + m].mean() for i in range(400 - m + 1)])
    rows = motif.alike(x, m, chosen)
    for r, i in zip(rows, chosen.tolist(), strict=True):
        want = ((w - w[i]) ** 2).sum(1) / ((w[i] ** 2).mean() * m) < motif.SIMILAR
        assert (r[(400 - len(w)) // 2 :][: len(w)] == want).all() and r.sum() == want.sum()
    walks = motif.random_walks(1.0, m, RNG, 5)
    assert np.allclose(walks.mean(1), 0) and np.allclose(motif.structure_scores(x, walks), ((w[:, None] - walks[None]) ** 2).sum(2).min(1))
    soft = motif.blur(rows, 9)
    assert soft.shape == rows.shape and soft.min() >= 0 and soft.max() <= 1 + 1e-12
    v = np.round(RNG.normal(size=200), 1)
    for spacing in (1, 2, 5):
        want = [i for i in range(200) if all(v[i] > v[j] for j in range(max(0, i - spacing + 1), min(200, i + spacing)) if j != i)]
        assert sorted(motif.separate_peaks(v, spacing).tolist()) == want


def test_growth_and_trim():
    plain, window = (RNG.random((6, 300)) < 0.2).astype(float), 20
    soft = motif.blur(plain, 5)
    order = np.array([40, 120, 200, 260])
    score, starts, weights = motif.grow(plain, soft, order, window)
    best, counts, total = -np.inf, plain[:, 40:60].copy(), soft[:, 40:60] + 1e-4
    for k in range(2, 5):
        counts, total = counts + plain[:, order[k - 1] : order[k - 1] + window], total + soft[:, order[k - 1] : order[k - 1] + window]
        gain = np.log(total / k) - np.log(soft.mean(1, keepdims=True))
        w = gain * (counts * gain > 0) * (total / k > 0.5)
        rival = (w * plain[:, order[k] : order[k] + window]).sum() * k if k < 4 else -np.inf
        now = (counts * w).sum() - max(w.sum() * soft.mean() * k, rival)
        if now > best:
            best, at = now, k
    assert abs(score - best) < 1e-9 and starts == order[:at].tolist()
    cols = np.array([0.0, 0.0, 3.0, 3.0, 3.0, 0.0, 1.0, 0.0])
    assert motif.trimmed(cols[None], 3, 0.1, 2, 6) == (2, 7)
    assert motif.trimmed(cols[None], 3, 0.1, 6, 7) == (1, 7) or motif.trimmed(cols[None], 3, 0.1, 6, 7) == (2, 8)
    assert motif.trimmed(cols[None], 3, 0.1, 1, 2) in ((2, 4), (3, 5))
    scores = np.zeros(100)
    scores[50], scores[52], scores[80] = 3, 2.9, 2
    got = motif.seeds(scores, 10, 20, 95)
    assert {50, 80, 48, 52, 78, 82} <= set(got) and max(got) <= 95 and 100 not in got


@pytest.mark.parametrize("kind", ["triangle", "sine", "bell"])
def test_planted_patterns_are_found(kind):
    starts = [100, 330, 560, 790, 1020]
    for seed in range(3):
        found = motif.learn([files.planted_series(kind, 1200, 60, starts, seed=seed)], 50, 70, seed=seed)
        assert found.window == 77 and found.features.shape == found.blurred.shape and found.weights.shape == (len(found.features), 77)
        hits = {s for s in starts if any(min(s + 60, e) - max(s, b) >= 25 for b, e in found.instances)}
        assert len(hits) >= 4 and len(found.instances) <= 6


def test_learner_without_a_pattern():
    assert motif.learn([np.zeros(500)], 20, 30).instances == [] and motif.learn([np.arange(30.0)], 20, 30).instances == []


def test_special_functions():
    x = np.concatenate([RNG.normal(scale=3, size=500), [0.0, -0.0, 2.0, 3.0, -3.0, 6.0]])
    assert np.allclose(special.erf_values(x), [math.erf(v) for v in x], rtol=1e-13, atol=1e-15)
    assert np.allclose(special.erfc_values(x), [math.erfc(v) for v in x], rtol=1e-10, atol=0)
    y = np.concatenate([RNG.uniform(-20, 120, 500), [0.5, 1.0, 2.0, 12.0]])
    assert np.allclose(special.lgamma_values(y), [math.lgamma(v) for v in y], rtol=1e-11, atol=1e-12)
    assert np.allclose(special.tgamma_values(y), [math.gamma(v) for v in y], rtol=1e-10)
    with np.errstate(all="ignore"):
        assert np.isnan(special.tgamma_values(np.array([0.0, -3.0]))).all() and special.lgamma_values(np.array([math.inf]))[0] == math.inf
