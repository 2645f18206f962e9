"""Moments, axes, rotations and groups of dimensions: sums of size D x D over all rows, then small linear algebra on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOWS = ("gauss", "gauss_flat", "gauss_shuffle", "identity", "random", "permute")


def vectors(column: pa.Array) -> np.ndarray:
    """A batch's vectors as rows; all have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def co_moments(data: DataFrame, left: str = "embedding", right: str = "embedding") -> DataFrame:
    """i, j, v: sums of left_i * right_j over all rows, where each side has a last component of 1, so that the counts and sums come with it.

    Each task sends one row for each pair of components, whatever its number of vectors.
    """

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x, y = (np.pad(vectors(b.column(c)), ((0, 0), (0, 1)), constant_values=1.0) for c in ("x", "y"))
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i, j, total)], names=["i", "j", "v"])

    rows = data.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x is not null and y is not null")
    return rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def moment_matrix(data: DataFrame, left: str = "embedding", right: str = "embedding") -> np.ndarray:
    """``co_moments`` as a matrix with one more row and column than there are dimensions."""
    rows = co_moments(data, left, right).collect()
    out = np.zeros((1 + max((r["i"] for r in rows), default=0), 1 + max((r["j"] for r in rows), default=0)))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def covariance_matrix(data: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means, and population covariances."""
    m = moment_matrix(data)
    n = max(m[-1, -1], 1.0)
    mean = m[-1, :-1] / n
    return mean, m[:-1, :-1] / n - np.outer(mean, mean)


def principal_axes(data: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, the ``count`` axes of largest variance as rows, and their variances. An axis points to where its largest component is positive."""
    mean, cov = covariance_matrix(data)
    values, axes = np.linalg.eigh(cov)
    axes = axes.T[::-1][:count]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return mean, axes * signs[:, None], values[::-1][:count]


def orthonormal_rows(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x.T)[0].T


def random_rotation(dim: int, seed: int = 0) -> np.ndarray:
    return orthonormal_rows(np.random.default_rng(seed).normal(size=(dim, dim)))


def allocate(values: np.ndarray, groups: int) -> list[list[int]]:
    """Places of the values, largest first, each to the open group with the smallest product so far; all groups have one size."""
    size, out, logs = len(values) // groups, [[] for _ in range(groups)], np.zeros(groups)
    weights = np.log(np.maximum(values, 1e-12) / max(values.max(), 1e-12)) + 30  # positive, so that an open group grows with each value
    for i in np.argsort(-values, kind="stable"):
        g = min((g for g in range(groups) if len(out[g]) < size), key=lambda g: (logs[g], g))
        out[g].append(int(i))
        logs[g] += weights[i]
    return out


def permutation_rotation(order: list[int] | np.ndarray) -> np.ndarray:
    """The rotation R with x[order] = x R'."""
    return np.eye(len(order))[np.asarray(order)]


def initial_rotation(cov: np.ndarray, groups: int, how: str = "gauss", seed: int = 0) -> np.ndarray:
    """Where the learning of a rotation starts: principal axes dealt to groups of equal products (``gauss``), in order of variance (``gauss_flat``)
    or at random (``gauss_shuffle``); the ``identity``; a ``random`` rotation; or a random order of the dimensions (``permute``)."""
    dim, rng = len(cov), np.random.default_rng(seed)
    if how == "identity":
        return np.eye(dim)
    if how == "random":
        return random_rotation(dim, seed)
    if how == "permute":
        return permutation_rotation(rng.permutation(dim))
    if how not in HOWS:
        raise ValueError(f"one of {', '.join(HOWS)}")
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes.T[::-1]
    if how == "gauss_flat":
        return axes
    if how == "gauss_shuffle":
        return axes[rng.permutation(dim)]
    return axes[np.concatenate(allocate(values, groups))]


def _log_det(cov: np.ndarray, dims: list[int]) -> float:
    return float(np.linalg.slogdet(cov[np.ix_(dims, dims)] + 1e-9 * np.eye(len(dims)))[1])


def group_dims(cov: np.ndarray, size: int, how: str = "doubling", seed: int = 0) -> list[list[int]]:
    """Groups of ``size`` dimensions each. ``doubling`` joins the two groups that depend on each other most (pairs, then pairs of pairs; size is a
    power of two); ``edges`` takes the strongest links first while groups stay small enough; ``balanced`` deals out variances; ``random`` shuffles."""
    dim = len(cov)
    if dim % size:
        raise ValueError("the number of dimensions must be a multiple of the size of a group")
    if how == "random":
        return np.random.default_rng(seed).permutation(dim).reshape(-1, size).tolist()
    if how == "balanced":
        return allocate(np.diag(cov), dim // size)
    groups = [[i] for i in range(dim)]
    if how == "doubling":
        while len(groups[0]) < size:
            alone = [_log_det(cov, g) for g in groups]
            gain = sorted((_log_det(cov, groups[a] + groups[b]) - alone[a] - alone[b], a, b) for a in range(len(groups)) for b in range(a))
            used, joined = set(), []
            for _, a, b in gain:
                if a not in used and b not in used:
                    used |= {a, b}
                    joined.append(sorted(groups[a] + groups[b]))
            groups = joined
        return sorted(groups)
    if how != "edges":
        raise ValueError("doubling, edges, balanced or random")
    home = list(range(dim))
    for _, i, j in sorted((-abs(cov[i, j]), i, j) for i in range(dim) for j in range(i)):
        a, b = home[i], home[j]
        if a != b and len(groups[a]) + len(groups[b]) <= size:
            groups[a] += groups[b]
            for x in groups[b]:
                home[x] = a
            groups[b] = []
    full = [sorted(g) for g in groups if len(g) == size]
    rest = [x for g in sorted(groups, key=len, reverse=True) if 0 < len(g) < size for x in g]
    return sorted(full + [rest[i : i + size] for i in range(0, len(rest), size)])


def swap_order(cov: np.ndarray, groups: int, most: int = 1000) -> list[int]:
    """An order of the dimensions whose ``groups`` stretches have the smallest sum of generalized variances: the best swap of two dimensions is made
    until none helps (or ``most`` were made)."""
    dim = len(cov)
    width = dim // groups
    parts = [list(range(g * width, (g + 1) * width)) for g in range(groups)]
    cost = lambda p: np.exp(_log_det(cov, p) / width)
    costs = [cost(p) for p in parts]
    for _ in range(most):
        best = (-1e-12, None)
        for a in range(groups):
            for b in range(a):
                for i in range(width):
                    for j in range(width):
                        pa_, pb = parts[a].copy(), parts[b].copy()
                        pa_[i], pb[j] = pb[j], pa_[i]
                        gain = cost(pa_) + cost(pb) - costs[a] - costs[b]
                        if gain < best[0]:
                            best = (gain, (a, b, pa_, pb))
        if best[1] is None:
            break
        a, b, parts[a], parts[b] = best[1]
        costs[a], costs[b] = cost(parts[a]), cost(parts[b])
    return [x for p in parts for x in p]


def hard_threshold_pursuit(gram: np.ndarray, cross: np.ndarray, keep: int, rounds: int = 20) -> np.ndarray:
    """W with exactly ``keep`` nonzeros in each column (where a column has as many dimensions) that makes X W close to Y, from X'X and X'Y alone."""
    dim = len(gram)
    keep = min(keep, dim)
    step = 1 / max(np.linalg.norm(gram, 2), 1e-12)
    out = np.zeros_like(cross)
    for c in range(cross.shape[1]):
        w, before = np.zeros(dim), None
        for _ in range(rounds):
            at = np.sort(np.argsort(-np.abs(w + step * (cross[:, c] - gram @ w)), kind="stable")[:keep])
            if before is not None and (at == before).all():
                break
            w, before = np.zeros(dim), at
            w[at] = np.linalg.lstsq(gram[np.ix_(at, at)], cross[at, c], rcond=None)[0]
        out[:, c] = w
    return out
