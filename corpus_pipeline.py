"""From raw documents to packed training sequences: language, near copies, repeated passages, personal data, packing.

Each stage takes what its predecessor kept and returns the columns of documents, the last one the packed pieces. A stage's own docstring in
``strandline.llm`` says what becomes of null, empty, very long, tied and repeated rows; an empty table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common, langid, near, packing, pii, queries, suffix


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language can't be told, go; where no row has a label to learn from, only the former."""
    model = langid.train(docs)
    if not model[0]:
        return langid.lettered(docs)
    said, likely = _common.free_names(docs, 2)  # no column of the documents' own is touched
    found = langid.identify(spark, docs, model, names=(said, likely))
    return found.filter((F.col(said) != langid.UNKNOWN) & (F.col(likely) >= langid.ACCEPT)).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash over five-word shingles, and an exact check of similarity 0.8 or more."""
    return near.keep_one(spark, docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand elsewhere, too, go from the text; documents without any other text stay as empty ones."""
    return _counted(suffix.scrub(spark, docs))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _counted(pii.scrub(spark, docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096 ids."""
    return packing.pack(spark, docs, queries.tokenizer_file(queries.WORDS))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("privacy", privacy), ("packing", pack)]
#: SQL can't say what the learned, hashed and iterated stages do; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _common.materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}", _common.TEXT_ROWS)
    return STAGES[-1][1](spark, docs, sf_dir)
