"""Approximate nearest neighbours by inner product: a forest of random-projection trees and exact reranking.

The trees split a bounded sample of the vectors at the median of random projections, so a leaf holds about the same share of any data like
the sample. Every vector is put into one leaf of each tree. A query searches all trees through one priority queue until the leaves that it took hold
``share`` of all vectors; a branch's priority is its squared distance from the query along the projections that lead away from it. Leaf sizes
are counted, not guessed. The members of these leaves are its candidates, and all of them are reranked by their exact inner product: a block
of a leaf's members (of bounded size, by salting) meets the leaf's queries, which stream by, in one task, which keeps the best of each query.
Equal vectors are searched once: of such a class only the first ``k + 1`` ids can be among a query's k nearest, so the others needn't be compared.

Vectors that are null, zero, of another length than the most frequent one, without an id, or hold null or non-finite components take no
part, neither as query nor as candidate. Ids may be repeated: an id stands for all vectors of its rows, and the score of two ids is the largest among
theirs; a query leaves out all rows of its own id, and no id is listed twice. A query with fewer candidates gets all of them. Other columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm import _common

#: Trees, the most leaves of each, and the most vectors that the trees are fitted on. A tree has about as many leaves as a leaf has members.
TREES, MOST_LEAVES, SAMPLE = 4, 4096, 65_536
#: Share of all vectors, counted in each tree, that a query's leaves hold: recall against cost. Vectors without structure need this much.
SHARE = 0.3
#: Members of a leaf that meet its queries at once, and rows of results that a task holds before it keeps only the best.
BLOCK, HELD = 4096, 500_000


class Tree:
    """A balanced tree: node i has children 2i+1 and 2i+2; the last level are leaves. A vector goes right where its projection is above the cut."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth, self.nodes = depth, (1 << depth) - 1
        self.normals, self.cuts = rng.normal(size=(self.nodes, sample.shape[1])), np.zeros(self.nodes)
        self.normals /= np.linalg.norm(self.normals, axis=1, keepdims=True)
        rows = {0: np.arange(len(sample))}
        for node in range(self.nodes):
            mine = rows.pop(node)
            if len(mine) > 1:  # the difference of two vectors follows the data's own directions
                a, b = sample[rng.choice(mine, 2, replace=False)]
                if (length := np.linalg.norm(a - b)) > 0:
                    self.normals[node] = (a - b) / length
            projected = sample[mine] @ self.normals[node]
            self.cuts[node] = np.median(projected) if len(mine) else 0.0
            above = projected > self.cuts[node]
            rows[2 * node + 1], rows[2 * node + 2] = mine[~above], mine[above]

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.normals.T - self.cuts

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        margins, node = self.margins(vectors), np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (margins[np.arange(len(vectors)), node] > 0)
        return node - self.nodes


def fit(sample: np.ndarray, leaves: int, trees: int = TREES, seed: int = 11) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [Tree(sample, max(0, int(leaves).bit_length() - 1), rng) for _ in range(trees)]


def search(margins: list[np.ndarray], trees: list[Tree], sizes: np.ndarray, enough: float) -> list[int]:
    """Cells (tree x leaves + leaf) of one query, in the order in which the queue shared by all trees gives them."""
    width, held, out = trees[0].nodes + 1, 0, []
    queue = [(0.0, t, 0) for t in range(len(trees))]
    heapq.heapify(queue)
    while queue and held < enough:
        priority, t, node = heapq.heappop(queue)
        if node >= trees[t].nodes:
            cell = t * width + node - trees[t].nodes
            if sizes[cell]:
                out.append(cell)
                held += sizes[cell]
            continue
        margin = margins[t][node]
        near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
        heapq.heappush(queue, (priority, t, near))
        heapq.heappush(queue, (priority + margin * margin, t, far))
    return out


def leaves(n: int) -> int:
    """Leaves of each tree for ``n`` vectors: a power of two near the root of their number, so that there are always several."""
    return min(MOST_LEAVES, 1 << max(0, round(np.log2(max(1, n)) / 2)))


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best of each query: larger scores first, ties to the smaller id; of rows of one query and id the best."""
    order = np.lexsort((-score, vec, query))
    q, v = query[order], vec[order]
    again = np.zeros(len(q), bool)
    again[1:] = (q[1:] == q[:-1]) & (v[1:] == v[:-1])
    order = order[~again]
    order = order[np.lexsort((vec[order], -score[order], query[order]))]
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff([*first.tolist(), len(q)]))
    return order[place < k]


def top(members: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query at least its k best members: row of the query, id, and inner product, always summed in the same order."""
    rough, most, single = queries @ members.T, k, len(np.unique(ids)) == len(ids)
    while True:  # where ids are repeated, the first k rows may be too few
        if len(ids) > most:
            least = np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most]
            q, m = np.nonzero(rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
        else:
            q, m = (x.ravel() for x in np.indices(rough.shape))
        score = np.add.reduce(queries[q] * members[m], axis=1)
        if single:  # a few more than k at most; whoever merges them cuts them off
            return q, ids[m], score
        keep = best(q, ids[m], score, k)
        if len(ids) <= most or np.bincount(q[keep], minlength=len(queries)).min(initial=k) >= k:
            return q[keep], ids[m[keep]], score[keep]
        most *= 4


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def clean(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id") -> tuple[DataFrame, int, int]:
    """(vec_id, v) of the vectors that take part, their number and their length."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0)
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("v")).filter(ok)
    sizes = [(r["n"], -r["d"]) for r in good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()]
    n, d = max(sizes, default=(0, 0))
    return good.filter(F.size("v") == -d), n, -d


def neighbours(spark: SparkSession, vectors: DataFrame, is_query, k: int = 20, trees: int = TREES, share: float = SHARE, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each vector for whose vec_id ``is_query`` (a Column of vec_id) holds."""
    good, n, dim = clean(vectors, vec, vec_id)
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    kind = dict(good.dtypes)["v"]
    some = good.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) <= min(1.0, SAMPLE / n) * (1 << 30)).limit(2 * SAMPLE)  # a hash's share: the bound holds but for chance
    sample = np.array([r["v"] for r in some.select("v").toLocalIterator()], float).reshape(-1, dim)
    forest = fit(sample, leaves(n), trees)
    width = forest[0].nodes + 1
    shared = spark.sparkContext.broadcast(forest)
    # At most the first k + 1 of equal vectors can be among the k nearest of one query.
    first = Window.partitionBy("v").orderBy("vec_id")
    members = good.withColumn("_n", F.dense_rank().over(first)).filter(F.col("_n") <= k + 1).select("vec_id", "v").distinct()

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), dim)
            at = np.tile(np.arange(len(x)), len(shared.value))
            cells = np.concatenate([t * width + tree.leaves(x) for t, tree in enumerate(shared.value)])
            yield pa.RecordBatch.from_arrays([pa.array(cells), b.column("vec_id").take(pa.array(at)), b.column("v").take(pa.array(at))], names=["cell", "id", "v"])

    placed = members.mapInArrow(place, f"cell long, id long, v {kind}")
    sizes = np.zeros(trees * width, np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row for each leaf of the forest
        sizes[r["cell"]] = r["n"]
    blocks = np.maximum(1, -(-sizes // BLOCK))
    shared_sizes = spark.sparkContext.broadcast((sizes, blocks))
    queries = good.filter(is_query(F.col("vec_id")))
    asked = queries.groupBy("v").agg(F.min("vec_id").alias("id"))

    def probe(batches):
        size, many = shared_sizes.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                margins = [tree.margins(_matrix(b.column("v"), dim)) for tree in shared.value]
                cells, blocks_, at = [], [], []
                for i in range(b.num_rows):
                    for c in search([m[i] for m in margins], shared.value, size, share * size.sum()):
                        cells += [c] * int(many[c])
                        blocks_ += range(int(many[c]))
                        at += [i] * int(many[c])
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(blocks_, pa.int64()), b.column("id").take(pa.array(at, pa.int64())), b.column("v").take(pa.array(at, pa.int64()))], names=["cell", "block", "id", "v"])

    def salt(batches):
        many = shared_sizes.value[1]
        for b in batches:
            cells, ids = (b.column(c).to_numpy() for c in ("cell", "id"))
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([b.column("cell"), pa.array((mixed % many[cells].astype(np.uint64)).astype(np.int64)), b.column("id"), b.column("v")], names=["cell", "block", "id", "v"])

    four = f"cell long, block long, id long, v {kind}"
    left = placed.mapInArrow(salt, four).withColumn("asks", F.lit(0))
    right = asked.select("id", "v").mapInArrow(probe, four).withColumn("asks", F.lit(1))
    met = left.unionByName(right).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")

    def rerank(batches):
        now, x, ids, held = None, [], [], [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        parts, many, full = [], 0, [np.zeros(0, np.int64), np.zeros(0)]  # what is not merged yet; queries with enough results, and the least of these

        def out():
            held[:] = [np.concatenate(c) for c in zip(held, *parts, strict=True)] if parts else held
            parts.clear()
            keep = best(*held, k + 1)
            held[:] = [h[keep] for h in held]
            asked, n = np.unique(held[0], return_counts=True)
            last = np.cumsum(n) - 1  # rows are by query and falling score
            full[:] = [asked[n == k + 1], held[2][last[n == k + 1]]]

        for b in batches:
            cell, block, asks, id_ = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "asks", "id"))
            v = _matrix(b.column("v"), dim)
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1).tolist(), len(cell)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if (cell[lo], block[lo]) != now:
                    now, x, ids = (cell[lo], block[lo]), [], []
                if not asks[lo]:
                    x.append(v[lo:hi])
                    ids.append(id_[lo:hi])
                    continue
                if len(x) > 1:
                    x, ids = [np.concatenate(x)], [np.concatenate(ids)]
                for s in range(lo, hi if x else lo, 512):
                    q, m, score = top(x[0], ids[0], v[s : min(hi, s + 512)], k + 1)
                    q = id_[s + q]
                    if len(full[0]):
                        at = np.minimum(np.searchsorted(full[0], q), len(full[0]) - 1)
                        fine = (full[0][at] != q) | (score >= full[1][at])
                        q, m, score = q[fine], m[fine], score[fine]
                    parts.append((q, m, score))
                    many += len(q)
                    if many > HELD // 4:
                        out()
                        many = 0
                        if len(held[0]) > HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=["id", "vec_id", "score"])
                            held[:], full[:] = [h[:0] for h in held], [f[:0] for f in full]
        out()
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=["id", "vec_id", "score"])

    found = met.mapInArrow(rerank, "id long, vec_id long, score double").groupBy("id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).drop("_n")
    each = queries.join(asked.select(F.col("id").alias("asked"), "v"), "v").select(F.col("vec_id").alias("query_id"), F.col("asked").alias("id")).distinct()
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scored = each.join(found, "id").filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(own))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
