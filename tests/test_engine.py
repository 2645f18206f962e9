"""The engine's queries against DuckDB, and its operators against values known by construction."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import distances as D
from strandline.operators import intervals, motif, quantize, search, series
from strandline.plans import registry
from strandline.sources import vectors
from strandline.streaming import buffers

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df, want = registry.QUERIES[name](spark, str(DATA)), duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def rows(spark, **columns):
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))


def test_warped_distance_and_classifier(spark):
    pair = rows(spark, a=[[5.0, 2.0, 2.0, 3.0, 5.1]], b=[[5.0, 2.0, 3.0, 3.0, 4.0]])
    assert pair.select(D.dtw(1)("a", "b")).first()[0] == pytest.approx(1.21)
    examples = rows(spark, vec_id=[1, 2, 3], embedding=[[5.0, 2.0, 2.0, 3.0, 5.0], [5.0, 2.0, 2.5, 2.5, 5.0], [5.0, 2.0, 2.2, 2.9, 5.0]], label=[1, 2, 3])
    q = rows(spark, qid=[0], q=[[5.0, 2.0, 3.0, 3.0, 5.0]])
    assert search.classify(spark, examples, q, "l2sq").first()["label"] == 2
    assert search.classify(spark, examples, q, "l1").first()["label"] == 3


def test_codec_closed_form(spark):
    books = np.array([[[i + 16 * m + j for j in range(3)] for i in range(16)] for m in range(4)], float)
    codec = quantize.Codec(spark, books)
    q = rows(spark, qid=[0], q=[[float(16 * m + j + 8) for m in range(4) for j in range(3)]])
    assert codec.tables(q).first()["lut"] == [[3.0 * (i - 8) ** 2 for i in range(16)]] * 4
    x = rows(spark, vec_id=list(range(10)), embedding=[[float(16 * m + j + m + i % 5) for m in range(4) for j in range(3)] for i in range(10)])
    assert all(r["codes"] == [m + r["vec_id"] % 5 for m in range(4)] for r in codec.encode(x).collect())
    lut = rows(spark, codes=[[0, 1]], lut=[[[10.0, 11.0], [20.0, 21.0]]])
    assert lut.select(quantize.scan(F.col("codes"), F.col("lut"))).first()[0] == 31


def test_learned_codec_beats_chance(spark):
    x = np.random.default_rng(0).normal(size=(400, 8))
    data = rows(spark, vec_id=list(range(400)), embedding=x.tolist())
    for codec in (quantize.Codec.fit(spark, data, 4), quantize.Codec.fit_rotated(spark, data, 4, turns=1)):
        rotated = data if codec.rotation is None else rows(spark, vec_id=list(range(400)), embedding=(x @ codec.rotation.T).tolist())
        coded = codec.reconstruct(quantize.Codec(spark, codec.books).encode(rotated))
        assert quantize.reconstruction_error(coded).first()[0] < 0.5


def test_array_functions(spark):
    df = rows(spark, a=[[3.0, -1.0, 4.0, -5.0, 9.0, 2.0]])
    one = lambda c: df.select(c).first()[0]
    a = F.col("a")
    assert one(A.pad(a, 2, 2, "wrap")) == [9.0, 2.0, 3.0, -1.0, 4.0, -5.0, 9.0, 2.0, 3.0, -1.0]
    assert tuple(one(A.maximum_subarray(a))) == (0, 6, 12.0)
    assert one(A.local_maxima(a)) == [0, 2, 4] and one(A.local_maxima(a, 3)) == [4]
    assert one(A.rfind(a, F.lit(4.0))) == 2 and one(A.where(a, lambda x: x < 0)) == [1, 3]
    assert one(A.take(a, F.array(F.lit(5), F.lit(9), F.lit(0)))) == [2.0, 3.0] and one(A.argsort(a)) == [3, 1, 5, 0, 2, 4]
    assert len(one(A.pad_columns(a, 4))) == 8 and one(A.subsequences(a, 7)) == []
    assert one(A.normal_cdf(F.lit(1.96))) == pytest.approx(0.9750021, abs=2e-7)


def test_intervals(spark):
    r = rows(spark, series=["a"] * 4, start=[0, 6, 10, 20], end=[4, 9, 15, 30])
    assert sorted((x["start"], x["end"]) for x in intervals.union_of_ranges(r, 1, 100).collect()) == [(0, 5), (5, 16), (19, 31)]
    reported = rows(spark, series=["a", "a"], id=[1, 2], start=[0, 1], end=[10, 11], label=["x", "x"])
    truth = rows(spark, series=["a"], id=[7], start=[0], end=[10], label=["x"])
    assert [(x["rid"], x["tid"]) for x in intervals.greedy_matches(reported, truth).collect()] == [(1, 7)]


def test_series(spark):
    s = rows(spark, series=["a"] * 4, t=[0, 1, 2, 3], x=[1.0, 1.0, 4.0, 3.0])
    assert sorted((r["start"], r["end"]) for r in series.runs(s, "x").collect()) == [(0, 2), (2, 3), (3, 4)]
    labels = rows(spark, series=["a"] * 2, start=[0, 20], end=[10, 30], label=["Z", "C"])
    assert [(r["start"], r["end"]) for r in vectors.composite_labels(labels, ("Z", "Z2"), "C", 150, "ZC").filter("label = 'ZC'").collect()] == [(0, 30)]


def test_pattern_is_found_where_it_was_planted(spark):
    x = vectors.planted_series("triangle", 400, 50, [60, 250])
    df = rows(spark, series=["s"] * 400, dim=[0] * 400, t=list(range(400)), x=[float(v) for v in x])
    found = sorted((r["start"], r["end"]) for r in motif.patterns(df, 40, 60).collect())
    assert any(min(e, 110) - max(s, 60) > 20 for s, e in found) and any(min(e, 300) - max(s, 250) > 20 for s, e in found)


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "a.fvecs").write_bytes(b"".join(np.array([4], "<i4").tobytes() + v.tobytes() for v in x))
    assert [r["embedding"] for r in vectors.read_vecs(spark, str(tmp_path / "a.fvecs")).orderBy("row").collect()] == x.tolist()
    (tmp_path / "b.txt").write_text("1 0.5 2\n2 3 4\n")
    assert [(r["label"], r["values"]) for r in vectors.read_labelled_series(spark, str(tmp_path / "b.txt")).orderBy("series").collect()] == [(1, [0.5, 2.0]), (2, [3.0, 4.0])]
    np.save(tmp_path / "c.npy", x)
    assert vectors.read_matrix(spark, str(tmp_path / "c.npy")).count() == 3
    assert spark.read.csv(vectors.save_table(rows(spark, b=[1], a=[2]), str(tmp_path / "out")), header=True).columns == ["a", "b"]
    assert vectors.synthetic(spark, "walk", 10, 3).count() == 10


def test_stream_keeps_the_last_values(spark, tmp_path):
    rows(spark, series=["a"] * 5 + ["b"], t=[0, 1, 2, 3, 4, 0], x=[float(i) for i in range(6)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series string, t long, x double").parquet(str(tmp_path / "in"))
    q = buffers.last_values(stream, 3).writeStream.format("memory").queryName("held").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["series"]: r["buffer"] for r in spark.table("held").collect()} == {"a": [2.0, 3.0, 4.0], "b": [5.0]}
