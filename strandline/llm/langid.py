"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every run of characters counts letter by letter, all other characters as one blank. The 1-, 2- and 3-grams with a
letter in them are hashed into ``BUCKETS`` columns. Training sums the columns for each language over a bounded sample of the labelled rows;
the matrix of log-probabilities, languages x buckets, is broadcast (its size is fixed but for the number of languages). Scoring gathers
the log-probabilities of a batch's n-grams and sums them for each text. Whole texts are scored; a batch holds about a MiB, or one text that is
longer, and takes about 60 bytes for each of its characters.

A null text or one without letters is ``und`` with score 0; so is every text when there is nothing to learn from. Labels that are null take
no part in training. Repeated rows, null ids and other columns do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common

BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
#: The most labelled rows that training reads.
TRAINING_ROWS = 20_000
#: In the corpus pipeline, a text whose language is less likely than this is rejected.
ACCEPT = 0.5
UNKNOWN = "und"
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram that starts at each character (``buckets``: none), the texts' first characters, and their letters.

    A blank closes each text, so that n-grams never depend on the next one.
    """
    texts = [t.lower() for t in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    points = np.frombuffer("".join(t + " " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    points = np.where(is_letter, points, 32).astype(np.uint64)
    ends = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(points))  # characters to the end of the text, its blank included
    out, hashed, some = [], np.zeros(len(points), np.uint64), np.zeros(len(points), bool)
    for n in range(1, max(ORDERS) + 1):
        past = max(0, len(points) - n + 1)
        hashed[:past] = (hashed[:past] + points[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        some[:past] |= is_letter[n - 1 :]
        if n in ORDERS:
            column = ((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64)
            out.append(np.where(some & (ends >= n), column, buckets))
    return out, starts[:-1], np.add.reduceat(is_letter.astype(np.int64), starts[:-1]) if len(texts) else np.zeros(0, np.int64)


def counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """lang, bucket, n: how often each bucket occurs in the texts of a language; bucket -1 counts the texts."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in _common.slices(batches):
            langs = np.array(b.column("lang").to_pylist(), object)
            found, starts, _ = grams(_common.texts_of(b.column("text")), buckets)
            owner = np.repeat(np.arange(len(starts)), np.diff([*starts.tolist(), len(found[0])]))
            for lang in set(langs.tolist()):
                mine = langs == lang
                n = total.setdefault(lang, np.zeros(buckets + 1, np.int64))
                for column in found:
                    n += np.bincount(column[mine[owner]], minlength=buckets + 1)
                n[buckets] = n[buckets] - sum(int((c[mine[owner]] == buckets).sum()) for c in found) + int(mine.sum())
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == buckets, -1, at).astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    return _common.texts(rows).select("lang", F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, buckets: int = BUCKETS, bound: int = TRAINING_ROWS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (languages x buckets) and log-priors."""
    rows = _common.training_rows(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()), bound)
    table = counts(rows, buckets).toPandas()  # languages x buckets at most
    langs = sorted(table["lang"].unique().tolist())
    if not langs:
        return [], np.zeros((0, buckets)), np.zeros(0)
    n, priors = np.zeros((len(langs), buckets)), np.zeros(len(langs))
    at = table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)
    bucket, seen = table["bucket"].to_numpy(), table["n"].to_numpy()
    n[at[bucket >= 0], bucket[bucket >= 0]] = seen[bucket >= 0]
    priors[at[bucket < 0]] = seen[bucket < 0]
    logs = np.log((n + smoothing) / (n.sum(1, keepdims=True) + smoothing * buckets)) if langs else n
    return langs, logs, np.log(priors / priors.sum()) if langs else priors


def score(texts: list[str], langs: list[str], logs: np.ndarray, priors: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The most likely language of each text and its posterior probability."""
    if not texts:
        return [], np.zeros(0)
    found, starts, n_letters = grams(texts, logs.shape[1])
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total = np.tile(priors, (len(texts), 1))
    for k in range(len(langs)):
        weights = np.append(logs[k], 0.0)
        for column in found:
            total[:, k] += np.add.reduceat(weights[column], starts)
    total -= total.max(1, keepdims=True)
    likely = np.exp(total)
    best = total.argmax(1)
    posterior = likely[np.arange(len(texts)), best] / likely.sum(1)
    none = n_letters == 0
    return [UNKNOWN if no else langs[i] for i, no in zip(best.tolist(), none.tolist(), strict=True)], np.where(none, 0.0, posterior)


def identify(spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its probability under ``names``; the model is trained on ``docs`` where none is given."""
    shared = spark.sparkContext.broadcast(model or train(docs))
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name not in names]

    def run(batches):
        for b in _common.slices(batches):
            langs, likely = score(_common.texts_of(b.column("text")), *shared.value)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in kinds), pa.array(langs, pa.string()), pa.array(likely)], names=[*(n for n, _ in kinds), *names])

    return _common.texts(docs).select(*(n for n, _ in kinds)).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*kinds, (names[0], "string"), (names[1], "double")]))


def lettered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter."""

    def run(batches):
        for b in _common.slices(batches):
            yield b.filter(pa.array([any(map(str.isalpha, t)) for t in _common.texts_of(b.column("text"))], pa.bool_()))

    return _common.texts(docs).mapInArrow(run, docs.schema)


def predictions(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = train(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _common.held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(spark, slim, model).drop("text")
