"""The pattern that a series repeats most distinctly, whatever its length and noise: one learner for each series, distributed over series."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Variance below which a window is flat, largest distance (over variance and length) of a look-alike, and random walks to compare with.
FLAT, SIMILAR, WALKS = 1e-3, 0.25, 100
#: Shifts of a seed to each side, in tenths of the longest pattern.
SHIFTS = 10


@dataclass
class Pattern:
    """What was learned of a series: score, window length, instances (start, end), the features (rows x samples; plain and blurred), the weights of the
    pattern (rows x window), and the seeds that were tried."""

    score: float = 0.0
    window: int = 0
    instances: list[tuple[int, int]] = field(default_factory=list)
    features: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    blurred: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    seeds: list[int] = field(default_factory=list)


def lengths(n: int, shortest: float, longest: float) -> tuple[int, int, int]:
    """Shortest and longest pattern (below 1: shares of n), and the window that is searched: a tenth longer than the longest."""
    lo, hi = (int(v * n) if v < 1 else int(v) for v in (shortest, longest))
    return max(2, lo), max(2, hi), max(2, hi) + max(2, hi) // 10


def centred_windows(x: np.ndarray, m: int) -> np.ndarray:
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    return w - w.mean(1, keepdims=True)


def random_walks(step: float, m: int, rng: np.random.Generator, count: int = WALKS) -> np.ndarray:
    """Centred walks whose steps have the given deviation."""
    walks = np.cumsum(rng.normal(scale=step or 1.0, size=(count, m)), axis=1)
    return walks - walks.mean(1, keepdims=True)


def structure_scores(x: np.ndarray, walks: np.ndarray) -> np.ndarray:
    """Squared distance of each centred window to the nearest walk: what is near to one has no structure."""
    w = centred_windows(x, walks.shape[1])
    out = np.empty(len(w))
    for lo in range(0, len(w), 4096):
        part = w[lo : lo + 4096]
        out[lo : lo + 4096] = ((part * part).sum(1)[:, None] + (walks * walks).sum(1)[None] - 2 * part @ walks.T).min(1)
    return np.maximum(0, out)


def alike(x: np.ndarray, m: int, chosen: np.ndarray) -> np.ndarray:
    """A row for each chosen window, over all of the series: 1 where a window, told by its middle, looks like it. Flat ones have none."""
    w, rows = centred_windows(x, m), np.zeros((len(chosen), len(x)))
    norms = (w * w).sum(1)
    for r, i in enumerate(chosen):
        if norms[i] / m >= FLAT:
            rows[r, (len(x) - len(w)) // 2 :][: len(w)] = norms + norms[i] - 2 * w @ w[i] < SIMILAR * norms[i]
    return rows


def feature_rows(x: np.ndarray, longest: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of look-alikes of log2(n) windows, drawn by their structure scores, of each length 8, 16, ... up to the longest pattern."""
    if np.var(x) < FLAT:
        return np.zeros((0, len(x)))
    sizes = [2**k for k in range(3, max(4, int(np.log2(longest)) + 1)) if 2**k <= min(longest, len(x) // 2)] or [max(2, min(longest, len(x) // 2))]
    out = []
    for m in sizes:
        scores = structure_scores(x, random_walks(float(np.diff(x).std()), m, rng))
        some = int((scores > 0).sum())
        if some:
            out.append(alike(x, m, rng.choice(len(scores), min(int(np.log2(len(x))), some), replace=False, p=scores / scores.sum())))
    return np.concatenate(out) if out else np.zeros((0, len(x)))


def blur(rows: np.ndarray, width: int) -> np.ndarray:
    """Correlation with a Hamming window, over the largest value within a quarter of its width (at least 1)."""
    if not len(rows):
        return rows
    soft = np.stack([np.convolve(r, np.hamming(width), "same")[: len(r)] for r in rows])
    half = max(1, width // 4)
    peak = np.lib.stride_tricks.sliding_window_view(np.pad(soft, ((0, 0), (half, half))), 2 * half + 1, axis=1).max(2)
    return soft / np.maximum(1, peak)


def feature_matrix(dims: list[np.ndarray], longest: int, width: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Plain and blurred features. The series goes on with its end values for a longest pattern while they are built, so that ends count like all else;
    features that fire never, or at over half of the samples, are dropped, and so are those that fire only behind the ends."""
    pad = longest
    plain = np.concatenate([feature_rows(np.pad(d, pad, mode="edge"), longest, rng) for d in dims])
    share = plain.mean(1) if len(plain) else np.zeros(0)
    plain = plain[(share > 0) & (share <= 0.5)]
    soft = blur(plain, width)
    n = len(dims[0])
    plain, soft = plain[:, pad : pad + n], soft[:, pad : pad + n]
    keep = plain.sum(1) > 1
    return plain[keep], soft[keep]


def seed_scores(dims: list[np.ndarray], shortest: int, rng: np.random.Generator) -> np.ndarray:
    """For each place the sum, over dimensions and lengths (the shortest pattern over 1, 2, 4 and 8), of structure scores over their largest."""
    out = np.zeros(len(dims[0]))
    for d in dims:
        for m in sorted({max(2, shortest // k) for k in (1, 2, 4, 8)}):
            s = structure_scores(d, random_walks(float(np.diff(d).std()), m, rng))
            if s.max() > 0:
                out[: len(s)] += s / s.max()
    return out


def seeds(scores: np.ndarray, shortest: int, longest: int, last: int) -> list[int]:
    """The best place, the best one further than the shortest pattern from it, and shifts of both by tenths of the longest, as far as they are in bounds."""
    first, rest = int(scores.argmax()), scores.copy()
    rest[max(0, first - shortest) : first + shortest + 1] = -1
    step = longest // SHIFTS
    tries = {s + d * i * step for s in (first, int(rest.argmax())) for i in range(SHIFTS + 1) for d in (1, -1)}
    return sorted(s for s in tries if 0 <= s <= last)


def separate_peaks(v: np.ndarray, spacing: int) -> np.ndarray:
    """Places whose value is larger than all others less than ``spacing`` away, by falling value (ties: the earlier one first)."""
    if spacing < 2:
        at = np.arange(len(v))
    else:
        k = spacing - 1
        padded = np.pad(v, k, constant_values=-np.inf)
        around = np.lib.stride_tricks.sliding_window_view(padded, k).max(1)
        at = np.flatnonzero((v > around[: len(v)]) & (v > around[k + 1 : k + 1 + len(v)]))
    return at[np.argsort(-v[at], kind="stable")]


class _Dots:
    """Sliding products of a window of rows with all windows of a matrix, by Fourier transforms of its rows."""

    def __init__(self, rows: np.ndarray, window: int):
        self.n, self.window, self.size = rows.shape[1], window, 1 << (rows.shape[1] + window - 1).bit_length()
        self.spectrum = np.fft.rfft(rows, self.size, axis=1)

    def __call__(self, seed: np.ndarray) -> np.ndarray:
        turned = np.fft.rfft(seed[:, ::-1], self.size, axis=1)
        return np.round(np.fft.irfft((self.spectrum * turned).sum(0), self.size)[self.window - 1 : self.n], 9)


def grow(plain: np.ndarray, soft: np.ndarray, order: np.ndarray, window: int) -> tuple[float, list[int], np.ndarray]:
    """Score, starts and weights of the best number of instances, taken in the given order: the log odds of their features against each feature's mean,
    less those of the next window, or of chance, whichever are larger, as often as there are instances."""
    chance, mean = np.log(soft.mean(1, keepdims=True)), float(soft.mean())
    best: tuple[float, list[int], np.ndarray] = (-np.inf, [], np.zeros((len(plain), window)))
    if not len(order):
        return best
    counts, total = plain[:, order[0] : order[0] + window].copy(), soft[:, order[0] : order[0] + window] + 1e-4
    for k, at in enumerate(order[1:].tolist(), 2):
        counts += plain[:, at : at + window]
        total += soft[:, at : at + window]
        theta = total / k
        gain = np.log(theta) - chance
        weights = np.where((counts * gain > 0) & (theta > 0.5), gain, 0.0)
        rival = (weights * plain[:, order[k] : order[k] + window]).sum() * k if k < len(order) else -np.inf
        score = float((counts * weights).sum() - max(weights.sum() * mean * k, rival))
        if score > best[0]:
            best = (score, order[:k].tolist(), weights)
    return best


def trimmed(weights: np.ndarray, count: int, mean: float, shortest: int, longest: int) -> tuple[int, int]:
    """The stretch of the window that says more than chance would: columns' weights less what is expected of them, as a maximum subarray, then
    widened to the shortest pattern or cut to the longest, a column at a time where it gains most or loses least."""
    sums = weights.sum(0) - mean ** (count - 1) * len(weights)
    best, run, begin, span = 0.0, 0.0, 0, (0, 0)
    for i, g in enumerate(sums.tolist()):
        if run <= 0:
            run, begin = 0.0, i
        run += g
        if run > best:
            best, span = run, (begin, i + 1)
    s, e = span
    while e - s < min(shortest, len(sums)):
        before, after = sums[s - 1] if s else -np.inf, sums[e] if e < len(sums) else -np.inf
        s, e = (s - 1, e) if before > after else (s, e + 1)
    while e - s > longest:
        s, e = (s, e - 1) if sums[s] > sums[e - 1] else (s + 1, e)
    return s, e


def learn(dims: list, shortest: float, longest: float, width: float = 0, seed: int = 0) -> Pattern:
    """The pattern of a series, given as one array for each dimension. ``width`` of the blur: the shortest pattern, unless it is given."""
    xs = [np.asarray(d, float) for d in dims]
    n = len(xs[0])
    lo, hi, window = lengths(n, shortest, longest)
    if n < 2 * window:
        return Pattern(window=window)
    rng = np.random.default_rng(seed)
    blurred = int(width * n) if 0 < width < 1 else int(width)
    plain, soft = feature_matrix(xs, hi, blurred if blurred > 0 else lo, rng)
    out = Pattern(window=window, features=plain, blurred=soft, seeds=seeds(seed_scores(xs, lo, rng), lo, hi, n - window - 1))
    if not len(plain):
        return out
    dots, best = _Dots(plain, window), (0.0, [], np.zeros((len(plain), window)))
    for s in out.seeds:
        found = grow(plain, soft, separate_peaks(dots(soft[:, s : s + window]), lo), window)
        best = found if found[0] > best[0] else best
    out.score, starts, out.weights = best
    if starts:
        s, e = trimmed(out.weights, len(starts), float(soft.mean()), lo, hi)
        out.instances = [(a + s, a + e) for a in sorted(starts)]
    return out


def find_pattern(dims: list, shortest: float, longest: float, seed: int = 0) -> tuple[float, list[tuple[int, int]]]:
    """Score and (start, end) of the instances of the best pattern."""
    found = learn(dims, shortest, longest, seed=seed)
    return found.score, found.instances


def _by_series(series: DataFrame, run, schema: str) -> DataFrame:
    kind = dict(series.dtypes)["series"]
    slim = series.select("series", "dim", "t", F.col("x").cast("double"))
    return slim.groupBy("series").applyInPandas(lambda pdf: run(pdf["series"].iloc[0], [g.sort_values("t")["x"].to_numpy() for _, g in pdf.groupby("dim")]), f"series {kind}, {schema}")


def patterns(series: DataFrame, shortest: float, longest: float, seed: int = 0) -> DataFrame:
    """series, start, end, score of each instance, for rows (series, dim, t, x). A series is a unit of work; its length is bounded by a task's memory."""

    def run(key, dims: list) -> pd.DataFrame:
        score, found = find_pattern(dims, shortest, longest, seed)
        return pd.DataFrame([(key, s, e, score) for s, e in found], columns=["series", "start", "end", "score"])

    return _by_series(series, run, "start long, end long, score double")


def feature_table(series: DataFrame, shortest: float, longest: float, seed: int = 0) -> DataFrame:
    """series, feature, t, plain, blurred, of the features' nonzero entries."""

    def run(key, dims: list) -> pd.DataFrame:
        found = learn(dims, shortest, longest, seed=seed)
        f, t = np.nonzero((found.features != 0) | (found.blurred != 0)) if found.features.size else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"series": [key] * len(f), "feature": f, "t": t, "plain": found.features[f, t] if len(f) else [], "blurred": found.blurred[f, t] if len(f) else []})

    return _by_series(series, run, "feature long, t long, plain double, blurred double")
