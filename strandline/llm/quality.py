"""Quality classifier: supervised subword embeddings.

A document's features are its words (between white space), its pairs of neighbouring words, and its character 1- to 4-grams, case and punctuation
kept; they are hashed into ``BUCKETS`` rows of a matrix of vectors. The vectors are averaged, each feature as often as it occurs, and a softmax
layer gives the probability of either label. Vectors and layer are learned by stochastic gradient descent in numpy, on the driver, from a
bounded sample of the labelled rows (``TRAINING_ROWS``, a parameter): each step follows the gradient of one document's loss, with a larger
rate for the vectors, as each has only its small share of the average. The average and the layer are linear, so for scoring each row of
the matrix is projected to one number first: a document's logit is the mean of its features' numbers. Whole texts are scored.

A null text is an empty one; a text without features gets the score of the layer's bias. Without labelled rows all score one half. Null
labels take no part; repeated labels count as often as they stand there. Ids may be null or repeated: rows are scored by their text alone, and of rows
that share a labelled id the least text is learned from. Other columns are ignored; an empty table gives no rows. A batch holds about a MiB, or
one text that is longer, and takes about 100 bytes for each of its characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common

BUCKETS, DIMENSIONS, ORDERS = 1 << 16, 12, (1, 2, 3, 4)
TRAINING_ROWS, EPOCHS, SEED = 6_000, 8, 7
#: Rates of the layer, the bias and the vectors, which fall to 0 in the course of training.
RATE, BIAS_RATE, VECTOR_RATE = 0.5, 0.05, 60.0
THRESHOLD = 0.3
_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_ODD, pow(_ODD, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def features(texts: list[str], buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features: the bucket of each feature, and where each text's features begin."""
    points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    ends = np.repeat(starts + lengths, lengths) - np.arange(len(points)) - 1  # characters to the end of the text
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    out, hashed = [], np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        past = max(0, len(points) - n + 1)
        hashed[:past] = (hashed[:past] + points[n - 1 :] + np.uint64(n)) * np.uint64(_ODD)
        if n in ORDERS:
            mixed = ((hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
            out.append((np.where(ends >= n, mixed.astype(np.int64), buckets), starts))
    blank = (points <= 32) | (points == 0x85) | (points == 0xA0)
    change = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
    first, past = change[::2], change[1::2]  # each text ends with a blank, so words come in pairs of ends
    up, down = _power(len(points) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * up[:-1])])
    keys = (sums[past] - sums[first]) * down[first]
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    words = (keys >> shift).astype(np.int64)
    # each text gets one empty word at its end, so that none lacks an entry
    owner = np.searchsorted(starts, first, side="right") - 1
    where = np.searchsorted(owner, np.arange(len(texts)), side="left") + np.arange(len(texts))
    last = np.searchsorted(owner, np.arange(len(texts)), side="right")
    pairs = np.full(len(words), buckets, np.int64)
    both = ((keys[:-1] * np.uint64(_ODD) + keys[1:]) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
    pairs[:-1] = np.where(owner[1:] == owner[:-1], both.astype(np.int64), buckets)
    return [*out, (np.insert(words, last, buckets), where), (np.insert(pairs, last, buckets), where)]


def _bag(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares."""
    ids, n = np.unique(np.concatenate([x for x, _ in features([text], buckets)]), return_counts=True)
    keep = ids < buckets
    return ids[keep], n[keep] / max(1, n[keep].sum())


def loss(ids: np.ndarray, share: np.ndarray, label: int, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """A document's loss, the layer's error, its hidden vector, and the gradient by that."""
    hidden = share @ vectors[ids] if len(ids) else np.zeros(vectors.shape[1], vectors.dtype)
    logit = layer @ hidden + bias
    error = np.exp(logit - logit.max())
    error /= error.sum()
    cost = -float(np.log(max(error[label], 1e-300)))
    error[label] -= 1
    return cost, error, hidden, error @ layer


def fit(texts: list[str], labels: list[int], buckets: int = BUCKETS, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """The number of each bucket, and the bias."""
    if not texts:
        return np.zeros(buckets), 0.0
    rng = np.random.default_rng(seed)
    vectors, layer, bias = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (buckets, DIMENSIONS)).astype(np.float32), rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32), np.zeros(2)
    bags, steps = [(ids, share.astype(np.float32)) for ids, share in (_bag(t, buckets) for t in texts)], 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)).tolist():
            left = 1 - steps / (epochs * len(bags))
            steps += 1
            ids, share = bags[i]
            _, error, hidden, back = loss(ids, share, labels[i], vectors, layer, bias)
            layer -= (left * RATE * error[:, None] * hidden[None, :]).astype(np.float32)
            bias -= left * BIAS_RATE * error
            vectors[ids] -= (left * VECTOR_RATE * share)[:, None].astype(np.float32) * back[None, :].astype(np.float32)
    return (vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> tuple[np.ndarray, float]:
    """The model, from a bounded sample of the labelled documents outside the held-out fifth."""
    marks = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = _common.training_rows(marks, bound)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"), F.count("*").alias("n"))  # as many rows as there are chosen labels, at most
    got = sorted((r["doc_id"], r["quality"], r["text"]) for r in rows.toLocalIterator())
    return fit([x[2] for x in got], [x[1] for x in got])


def score(texts: list[str], values: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text."""
    if not texts:
        return np.zeros(0)
    padded, total, n = np.append(values, 0.0), np.zeros(len(texts)), np.zeros(len(texts))
    for ids, starts in features(texts, len(values)):
        total += np.add.reduceat(padded[ids], starts)
        n += np.add.reduceat((ids < len(values)).astype(np.int64), starts)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -500, 500)))


def classify(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with score; the broadcast model has a fixed size."""
    shared = spark.sparkContext.broadcast(model)
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name != "score"]

    def run(batches):
        for b in _common.slices(batches):
            got = score(_common.texts_of(b.column("text")), *shared.value)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in kinds), pa.array(got)], names=[*(n for n, _ in kinds), "score"])

    return _common.texts(docs).select(*(n for n, _ in kinds)).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*kinds, ("score", "double")]))


def predictions(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _common.held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = classify(spark, slim, train(docs, labels)).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
