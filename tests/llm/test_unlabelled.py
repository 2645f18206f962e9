"""The pipeline's language stage on tables that give nothing to learn from."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

TEXTS = ["the river and the house", "le fleuve et la maison", None, "", "12 34", "é"]


@pytest.mark.parametrize("labelled", [False, True])
def test_only_texts_without_a_letter_go(spark, labelled):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]  # all held out
    docs = spark.createDataFrame([(i, t, "en" if labelled else None) for i, t in zip(ids, TEXTS)], "doc_id long, text string, lang string")
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.text for r in got.collect()) == sorted(TEXTS[i] for i in (0, 1, 5))


def test_the_pipeline_runs_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    docs.withColumn("lang", F.lit(None).cast("string")).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 1, 5}
