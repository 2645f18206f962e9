"""Learners, indexes, sketches, windows, scores and recordings against values known by construction or by brute force."""

import itertools
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import special
from strandline.operators import evaluate, linear, quantize, search, sketches, subsequences
from strandline.sources import recordings, vectors


def rows(spark, **columns):
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(1).normal(size=(300, 8)) * np.array([4, 3, 2, 2, 1, 1, 0.5, 0.5])
    return x, rows(spark, vec_id=list(range(300)), embedding=x.tolist()).cache()


def test_moments_and_axes(spark, cloud):
    x, df = cloud
    mean, cov = linear.covariance_matrix(df)
    assert np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    _, axes, variances = linear.principal_axes(df, 3)
    assert np.allclose(axes @ axes.T, np.eye(3)) and np.allclose(((x - mean) @ axes.T).var(0), variances)
    assert linear.moment_matrix(df.filter("vec_id < 0")).shape == (1, 1)


def test_rotations_start_as_asked():
    cov = np.diag([9.0, 4.0, 1.0, 0.25])
    for how in linear.HOWS:
        r = linear.initial_rotation(cov, 2, how)
        assert np.allclose(r @ r.T, np.eye(4))
    with pytest.raises(ValueError):
        linear.initial_rotation(cov, 2, "other")
    x, order = np.arange(12.0).reshape(3, 4), [1, 3, 0, 2]
    assert (x[:, order] == x @ linear.permutation_rotation(order).T).all()
    assert sorted(len(g) for g in linear.allocate(np.array([9.0, 4.0, 1.0, 0.25]), 2)) == [2, 2]
    assert linear.allocate(np.array([9.0, 4.0, 1.0, 0.25]), 2) == [[0, 3], [1, 2]]


def test_groups_join_what_belongs_together():
    cov = np.eye(4) + 0.9 * (np.eye(4)[[2, 3, 0, 1]])
    assert linear.group_dims(cov, 2) == [[0, 2], [1, 3]] == linear.group_dims(cov, 2, "edges")
    for how in ("doubling", "edges", "balanced", "random"):
        assert sorted(itertools.chain(*linear.group_dims(cov, 2, how))) == [0, 1, 2, 3]
    assert sorted(map(sorted, np.reshape(linear.swap_order(cov, 2), (2, 2)).tolist())) == [[0, 2], [1, 3]]


def test_hard_thresholding_keeps_so_many():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(100, 60)), np.zeros((60, 2))
    w[:5] = 1
    found = linear.hard_threshold_pursuit(x.T @ x, x.T @ (x @ w), 5)
    assert np.allclose(found, w) and ((linear.hard_threshold_pursuit(x.T @ x, x.T @ x, 30) != 0).sum(0) <= 30).all()


def test_learned_quantizers_reconstruct(spark, cloud):
    x, df = cloud
    plain = quantize.reconstruction_error(_approx(spark, quantize.Codec.fit(spark, df, 4), x)).first()[0]
    for codec in (
        quantize.Codec.fit_rotated(spark, df, 4, turns=1, start="gauss", rounds=4),
        quantize.Codec.fit_rotated(spark, df, 4, turns=1, blocks=2, rounds=4),
        quantize.Codec.fit_permuted(spark, df, 4),
    ):
        assert np.allclose(codec.rotation @ codec.rotation.T, np.eye(8))
        assert quantize.reconstruction_error(_approx(spark, codec, x)).first()[0] < 1.5 * plain
    mixing = quantize.Codec.fit(spark, df, 4).fit_mixing(df, 3)
    assert ((mixing != 0).sum(0) <= 3).all() and mixing.shape == (8, 8)


def _approx(spark, codec, x):
    turned = x @ codec.rotation.T if codec.rotation is not None else x
    df = rows(spark, vec_id=list(range(len(x))), embedding=turned.tolist())
    return codec.reconstruct(quantize.Codec(spark, codec.books).encode(df))


def test_chained_codes_are_the_best_that_fit_together():
    d = np.random.default_rng(3).random((5, 3, 8))
    for bits in (0, 1, 2):
        found = quantize.chained_codes(d, bits)
        for i, codes in enumerate(found):
            fit = [c for c in itertools.product(range(8), repeat=3) if all(a % (1 << bits) == b >> (3 - bits) for a, b in zip(c, c[1:], strict=False))]
            assert tuple(codes) in fit
            assert sum(d[i, m, c] for m, c in enumerate(codes)) == pytest.approx(min(sum(d[i, m, v] for m, v in enumerate(c)) for c in fit))


def test_overlapping_round_trip(spark):
    df = rows(spark, a=[[float(i) for i in range(20)]])
    o = df.select(quantize.overlapped(F.col("a"), 4, 2).alias("o"))
    assert o.first()[0][:4] == [18.0, 19.0, 0.0, 1.0] and o.select(quantize.merged(F.col("o"), 4, 2)).first()[0] == df.first()[0]


def test_projection_index_equals_brute_force(spark, cloud):
    _, df = cloud
    q = df.filter("vec_id % 50 = 0").selectExpr("vec_id as qid", "embedding as q")
    index = search.ProjectionIndex(spark, df, axes=4)
    assert {(r[0], r[1]) for r in index.within(q, 3.0).collect()} == {(r[0], r[1]) for r in search.radius_join(spark, df, q, 9.0, inclusive=True).collect()}
    for exclude in (False, True):
        want = {(r["qid"], r["rank"], r["vec_id"]) for r in search.knn_join(spark, df, q, 4, exclude_self=exclude).collect()}
        assert {(r["qid"], r["rank"], r["vec_id"]) for r in index.knn(q, 4, exclude_self=exclude).collect()} == want
    assert index.knn(q, 400).count() == 6 * 300  # more than there are


def test_distances_by_codes_equal_the_scan(spark, cloud):
    _, df = cloud
    codec = quantize.Codec.fit(spark, df, 4)
    tables = codec.tables(df.filter("vec_id < 3").selectExpr("vec_id as qid", "embedding as q"))
    got = codec.distances(codec.encode(df), tables, ("safe", "u8", "u16"), block=2)
    want = codec.encode(df).join(F.broadcast(tables)).select("qid", "vec_id", *(quantize.scan(F.col("codes"), F.col("lut"), m).alias(m) for m in ("safe", "u8", "u16")))
    assert {(r[0], r[1], *(round(v, 6) for v in r[2:])) for r in got.collect()} == {(r[0], r[1], *(round(v, 6) for v in r[2:])) for r in want.collect()}


def test_sketches(spark, cloud):
    x, df = cloud
    planes = sketches.superbit_planes(8, 12, 4)
    assert np.allclose(planes[:4] @ planes[:4].T, np.eye(4))
    assert np.allclose(sketches.circulant_planes(np.arange(8.0), np.ones(8), 3)[1], np.roll(np.arange(8.0), 1))
    p = sketches.project(df, planes)
    bits = {r["vec_id"]: r["b"] for r in p.select("vec_id", sketches.sign_of(F.col("p"), 12).alias("b")).collect()}
    assert bits[7] == sum(int(v > 0) << i for i, v in enumerate(planes @ x[7]))
    for kind in ("gauss", "quantile", "kmeans", "dbq"):
        cuts = sketches.thresholds(df, kind, 4)
        codes = sketches.digitized(df, cuts).first()["codes"]
        assert len(codes) == 8 and all(0 <= c <= 3 for c in codes)
    with pytest.raises(ValueError):
        sketches.thresholds(df, "other", 4)


def test_find_and_what_lies_around(spark):
    s = rows(spark, series=["s"] * 6, t=list(range(6)), x=list("cababa"))
    starts = lambda **k: sorted(r["start"] for r in subsequences.find(s, list("aba"), **k).collect())
    assert starts() == [1, 3] and starts(overlapping=False) == [1]
    cut = subsequences.between(s, subsequences.find(s, ["c"]), 1).collect()
    assert [(r["start"], r["end"]) for r in cut] == [(1, 6)]
    near = subsequences.around(s, subsequences.find(s, ["b"]), 1, 2).collect()
    assert sorted((r["start"], "".join(r["near"])) for r in near) == [(2, "aba"), (4, "aba")]
    a = rows(spark, a=[[1.0, 3.0, 2.0, 2.0, 5.0]])
    assert a.select(subsequences.separate_maxima(F.col("a"), 2)).first()[0] == [1, 4]
    joined = subsequences.concatenated(rows(spark, g=[1, 1], i=[0, 1], values=[[1.0, 2.0], [5.0, 6.0, 7.0]]), "g", "i", 3, aligned=True).orderBy("i").collect()
    assert [r["offset"] for r in joined] == [0, 5] and joined[1]["values"] == [2.0, 3.0, 4.0]


def test_scores_and_grids(spark):
    assert evaluate.grid(a=[1, 2], b="x") == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    out = evaluate.experiment(lambda a: spark.range(a), a=[1, 2])
    assert sorted((r["a"], r["id"]) for r in out.collect()) == [(1, 0), (2, 0), (2, 1)]
    r = rows(spark, series=["a"] * 2, id=[1, 2], start=[0, 20], end=[10, 30], label=["p", "p"])
    t = rows(spark, series=["a"] * 2, id=[1, 2], start=[0, 21], end=[10, 31], label=["x", "x"])
    one = evaluate.match_stats(r, t).first()
    assert (one["reported"], one["true_n"], one["matches"], one["f1"]) == (2, 2, 2, 1.0)
    assert tuple(evaluate.total_iou(r, t).first())[:2] == (19, 21)
    pairs = rows(spark, qid=[0] * 3, vec_id=[1, 2, 3], true=[1.0, 2.0, 3.0], dist=[5.0, 1.0, 4.0])
    assert evaluate.share_within(pairs, 1).first()["share"] == 1.0


def test_special_functions(spark):
    df = rows(spark, x=[0.5, 3.0], p=[0.975, 0.025])
    got = df.select(special.erf(F.col("x")), special.erfc(F.col("x")), special.lgamma(F.col("x")), special.tgamma(F.col("x")), special.normal_quantile(F.col("p"))).collect()
    for r, x in zip(got, (0.5, 3.0), strict=True):
        assert tuple(r)[:4] == pytest.approx((math.erf(x), math.erfc(x), math.lgamma(x), math.gamma(x)))
    assert [r[4] for r in got] == pytest.approx([1.96, -1.96], abs=5e-4)
    m = F.create_map(F.lit(2), F.lit("a"), F.lit(9), F.lit("b"))
    one = spark.range(1).select(special.keys_below(m, F.lit(9)), special.keys_from(m, F.lit(3)), special.map_get(m, F.lit(5), F.lit("-")), F.size(special.map_erase(m, F.lit(2))), special.has_bit(special.set_bit(F.lit(0), 5), 5), special.unset_lowest(F.lit(12))).first()
    assert tuple(one) == (2, 9, "-", 1, True, 8)


def test_recordings(spark, tmp_path):
    (tmp_path / "f.csv").write_text("1 0 0\n2 0.5 1\n3 1 1\n")
    assert [(r["time"], r["values"]) for r in recordings.read_frames(spark, str(tmp_path / "f.csv")).orderBy("line").collect()] == [(2.0, [0.5, 1.0]), (3.0, [1.0, 1.0])]
    (tmp_path / "f.tags").write_text("XQPCTick;Tag\n200;Wave\n")
    assert [(r["time"], r["label"]) for r in recordings.read_tags(spark, str(tmp_path / "f.tags"), 100).collect()] == [(2.0, "Wave")]
    tone = np.sin(np.arange(4000) * 2 * np.pi * 1000 / 8000) * 0.5
    with wave.open(str(tmp_path / "man_7.wav"), "wb") as w:
        w.setparams((1, 2, 8000, 0, "NONE", ""))
        w.writeframes((tone * 32767).astype("<i2").tobytes())
    sound = recordings.read_audio(spark, str(tmp_path / "man_7.wav"))
    assert sound.select(*recordings.name_parts(F.col("path"), r"^([a-z]+)_(\d)", ["who", "digit"])).first() == ("man", "7")
    spectrum = recordings.audio_features(sound, "stft").collect()
    assert all(np.argmax(r["features"]) == 64 for r in spectrum)  # 1000 Hz of 8000 in 512 values
    assert {len(r["features"]) for r in recordings.audio_features(sound).collect()} == {13}
    assert tuple(rows(spark, p=[[0.0, 0.0, 1.0, 2.0, 0.0]]).select(recordings.utterance(F.col("p")).alias("u")).select("u.*").first()) == (2, 4)
    assert np.allclose(recordings.decimated(np.full(50, 3.0), 5), 3.0) and len(recordings.decimated(np.arange(50.0), 5)) == 10
    assert len(recordings.decimate(rows(spark, values=[[1.0] * 50]), 5).first()["values"]) == 10
    bad = recordings.check_annotations(rows(spark, series=["a"] * 2, start=[0, 10], end=[20, 10], label=["Z", ""]))
    assert {r["problem"]: r["n"] for r in bad.collect()} == {"length": 1, "order": 1, "label": 1}
    (tmp_path / "set").mkdir()
    for part in ("TRAIN", "TEST"):
        (tmp_path / "set" / f"set_{part}").write_text("1,2,3\n1,3,4\n2,5,6\n")
    train = recordings.read_archive(spark, str(tmp_path), "set")["train"]
    assert tuple(recordings.archive_size(train).first()) == (3, 2, 6) and recordings.instances(train, 2).count() == 2


def test_generated_series(spark):
    rng = np.random.default_rng(0)
    x = vectors.shapes("sine", 64)
    path = recordings.warping_path(64, 0.5, rng)
    assert path[0] == 0 and path[-1] == pytest.approx(63) and (np.diff(path) > 0).all()
    assert len(recordings.warped(x, 0.2, rng)) == 64
    assert np.allclose(np.abs(np.fft.rfft(recordings.phases_shuffled(x, rng)))[1:-1], np.abs(np.fft.rfft(x))[1:-1])
    f = np.abs(np.fft.rfft(recordings.band_passed_walk(64, 0.1, 0.2, rng)))
    assert np.allclose(f[np.fft.rfftfreq(64) > 0.21], 0)
    assert recordings.planted_dims(["sine", "rect"], 200, 30, [10, 90], noise_dims=1).shape == (3, 200)
    out = recordings.prepared(vectors.synthetic(spark, "uniform", 20, 6), rows=10, dims=5, unit=True, multiple=4)
    assert out.count() == 10 and len(out.first()["embedding"]) == 8
