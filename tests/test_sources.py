"""Readers, named sets, an index made of parts, and patterns learned on a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import search
from strandline.sources import catalog, recordings, vectors
from strandline.streaming import buffers

RNG = np.random.default_rng(9)


@pytest.mark.parametrize(("kind", "dtype"), [("fvecs", "<f4"), ("ivecs", "<i4"), ("bvecs", "u1")])
def test_vectors_are_read_in_pieces(spark, tmp_path, kind, dtype):
    x = RNG.integers(0, 200, (500, 6)).astype(dtype)
    path = str(tmp_path / f"x.{kind}")
    with open(path, "wb") as f:
        for row in x:
            f.write((6).to_bytes(4, "little") + row.tobytes())
    got = {r.vec_id: r.embedding for r in vectors.read_vecs_split(spark, path, 6).collect()}
    assert got == {i: row.astype(float).tolist() for i, row in enumerate(x)}
    whole = {r.row: r.embedding for r in vectors.read_vecs(spark, path).collect()}
    assert whole == got


def test_archive_sets(spark, tmp_path):
    for name, rows in (("Small", 4), ("Large", 400)):
        (tmp_path / name).mkdir()
        for part in ("TRAIN", "TEST"):
            (tmp_path / name / f"{name}_{part}").write_text("".join(f"{i % 2},{i},{i + 1},{i + 2}\n" for i in range(rows)))
    assert {r.name for r in recordings.archive_sets(spark, str(tmp_path)).collect()} == {"Small", "Large"}
    assert {r.name for r in recordings.archive_sets(spark, str(tmp_path), 1000).collect()} == {"Small"}
    got = recordings.labelled_series(spark, str(tmp_path), "Small", 2).collect()
    assert sorted((r.label, r["values"]) for r in got) == [(0, [0.0, 1.0, 2.0, 2.0, 3.0, 4.0]), (1, [1.0, 2.0, 3.0, 3.0, 4.0, 5.0])]
    assert catalog.load(spark, "archive_Large", str(tmp_path), most=7, longest=2).count() == 14


def test_long_series_are_whole(spark, tmp_path):
    (tmp_path / "long").write_text("1," + ",".join(map(str, range(1_000_010))) + "\n")
    row = vectors.read_labelled_series(spark, str(tmp_path / "long")).select("label", F.size("values").alias("n"), F.element_at("values", -1).alias("last")).first()
    assert (row.label, row.n, row["last"]) == (1, 1_000_010, 1_000_009.0)


def test_named_sets(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "samples.csv").write_text("".join(f"{t},{t / 2}\n" for t in range(20)))
    (tmp_path / "run" / "labels.txt").write_text("2 5 a\n7 9 b\n15 18 a\n")
    got = catalog.load(spark, "recording_run", str(tmp_path), fewest=2).orderBy("series").collect()
    assert [(r.label, r["values"]) for r in got] == [("a", [1.0, 1.5, 2.0]), ("a", [7.5, 8.0, 8.5])]
    both = catalog.load_all(spark, ["randwalk", "planted_sine"], longest=50)
    assert {(r.name, r.n) for r in both.groupBy("name").agg(F.count("*").alias("n")).collect()} == {("randwalk", 10), ("planted_sine", 11)}
    spark.range(3).write.parquet(str(tmp_path / "mnist" / "test.parquet"))
    found = catalog.vector_set(spark, str(tmp_path), "Mnist")
    assert found["train"].count() == 3 and found["truth"] is None
    for bad in (lambda: catalog.load(spark, "nothing"), lambda: catalog.vector_set(spark, "", "nothing")):
        with pytest.raises(KeyError):
            bad()


def test_index_of_parts(spark):
    x = RNG.normal(size=(80, 5)) * [1, 5, 0.1, 3, 1]
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = data.filter("vec_id < 5").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    plain = {(i, j) for i in range(5) for j in np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:3].tolist()}
    for prepare in (None, search.by_variance, search.less_means):
        index = search.Index(spark, data, prepare, finish=lambda df: df.select("qid", "vec_id"))
        assert {tuple(r) for r in index.timed(index.knn(queries, 3))} == plain and index.query_seconds > 0


def test_patterns_on_a_stream(spark, tmp_path):
    x = vectors.planted_series("triangle", 1200, 60, [100, 330, 560, 790, 1020], seed=1)
    folder, seen = tmp_path / "in", []
    for n, (a, b) in enumerate(((0, 700), (700, 1200))):
        spark.createDataFrame([("s", t, float(x[t])) for t in range(a, b)], "series string, t long, x double").coalesce(1).write.parquet(str(folder / f"part{n}"))
    stream = spark.readStream.schema("series string, t long, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    query = buffers.online_patterns(stream, 1000, 50, 70, lambda df, n: seen.append((n, df.collect())), str(tmp_path / "checkpoint"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert len(seen) == 2 and seen[-1][1]
    found = [(r.start + 200, r.end + 200) for r in seen[-1][1]]  # the last thousand samples are kept
    assert sum(any(min(s + 60, e) - max(s, b) >= 25 for b, e in found) for s in (330, 560, 790, 1020)) >= 3
