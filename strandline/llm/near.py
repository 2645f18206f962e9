"""SimHash near copies as the corpus pipeline means them: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and chains of these.

Words are told as in ``simhash``; a text of fewer than five words is one shingle. Texts of one set are one item from the start. An item's
fingerprint has ``BITS`` bits: a bit is 1 if it is set in over half of its shingles' hashes. Two sets of similarity 0.8 have a cosine of 0.89,
so their bits differ with a probability of 0.152. A table sorts the items by ``width`` of the bits, drawn for that table; two such sets meet in
one with a probability of 0.848^width, and there are so many tables that they miss each other in all with one of ``MISS`` at most (sets that are
more alike far more rarely). What meets is compared over the first ``PLANES`` bits by ``simhash.linked``, bit-sliced and abandoned block by
block; the radius lies 4.5 deviations above what a similarity of 0.8 gives. An item meets the more others by chance, the larger the table is, so
there are as many planes as keep these out: with half as many, chance links made one component of a large part of the items. Links are joined to
components, and each component's texts are then compared exactly: the shingles are ordered by rarity in it, and two sets that reach 0.8 meet in
the rarest fifth of both.

The width follows the logarithm of the number of items, so that a bucket of chance meetings stays small. A bucket of more than ``BLOCK`` items is
dealt into blocks, and each two blocks are compared in a task of their own; so is a component of more than ``CROWD`` shingles. Nothing is capped.

Null text counts as empty; all texts without a word are copies of one another. Ids may be repeated or null, rows repeated; other columns are
kept, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm import _common, simhash
from strandline.llm.simhash import components

WORDS, SEED, CROWD = 5, 42, 1 << 19
#: Bits of a fingerprint, and how many of them are compared; what similarity 0.8 may miss; the radius.
BITS, PLANES, MISS, RADIUS = 512, 256, 0.0005, 65
#: Probability that a bit of two sets of similarity 0.8 is the same; the narrowest table; items that a table's buckets hold by chance.
SAME, NARROWEST, CHANCE = 1 - math.acos(1.6 / 1.8) / math.pi, 16, 64
#: Items of a bucket that one task compares, and the most buckets that are dealt into blocks (a bound of what is broadcast).
BLOCK, HOT = 4096, 1_000_000
_FACTORS, _MASKS = np.random.default_rng(SEED).integers(0, 2**64, (2, BITS // 64), np.uint64)
_FACTORS |= np.uint64(1)
#: For each byte value, its bits.
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The set of each text's shingles, as sorted unsigned 64-bit hashes."""
    import xxhash

    parts = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: only A-Z, and only ASCII white space
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(chain.from_iterable(parts))}
    word = np.fromiter((known[w] for w in chain.from_iterable(parts)), np.uint64)
    counts = np.array([len(p) for p in parts], np.int64)
    place, count = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts), np.repeat(counts, counts)
    hashed = np.zeros(len(word), np.uint64)
    for k in range(words):
        more = _mixed(hashed[: len(word) - k] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
        hashed[: len(word) - k] = np.where(count[: len(word) - k] > k, more, hashed[: len(word) - k])
    hashed = hashed[(place + words <= count) | ((place == 0) & (count < words))]
    ends = np.cumsum(np.where(counts, np.maximum(1, counts - words + 1), 0))
    return [np.unique(x) for x in np.split(hashed, ends[:-1])] if texts else []


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprints (sets x 64-bit words) of sets that aren't empty: bytes of the hashes are counted, and bits summed from the counts."""
    out = np.zeros((len(sets), BITS // 64), np.uint64)
    if not sets:
        return out
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    place = np.repeat(np.arange(len(sets)) << 8, sizes)
    for w in range(BITS // 64):
        bytes_ = _mixed(_mixed((flat ^ _MASKS[w]) * _FACTORS[w]) * _FACTORS[w]).view(np.uint8).reshape(-1, 8)
        ones = np.empty((len(sets), 8, 8), np.float32)
        for k in range(8):
            ones[:, k] = np.bincount(place + bytes_[:, k], minlength=len(sets) << 8).reshape(len(sets), 256).astype(np.float32) @ _BITS_OF
        out[:, w] = np.packbits((ones.reshape(len(sets), 64) * 2 > sizes[:, None]), axis=1, bitorder="little").view("<u8").ravel()
    return out


def tables(items: int) -> list[np.ndarray]:
    """The bits by which each table sorts that many items."""
    width = max(NARROWEST, math.ceil(math.log2(max(items, 1) / CHANCE)))
    count = math.ceil(math.log(1 / MISS) / SAME**width)
    rng = np.random.default_rng((SEED, width))
    return [rng.choice(BITS, width, replace=False) for _ in range(count)]


def links_in(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets (that aren't empty) which join all of similarity 0.8 or more: trees, found from each set outwards."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, begin = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes) - sizes
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = rank[token]
    token = token[np.lexsort((token, owner))]
    prefix = sizes + 1 + -4 * sizes // 5  # two sets that reach 0.8 share one of so many of the rarest
    early = np.flatnonzero(np.arange(len(token)) - begin[owner] < prefix[owner])
    early = early[np.argsort(token[early], kind="stable")]
    at, who = token[early], owner[early]
    mark, free, n_free, indexed = np.zeros(len(often), bool), np.ones(len(sets), bool), len(sets), len(sets)
    left, right = [], []
    for root in range(len(sets)):
        todo = [root] if free[root] else []
        n_free, free[root] = n_free - len(todo), False
        while todo and n_free:
            if 2 * n_free < indexed:  # what is reached need not be met again
                at, who, indexed = at[free[who]], who[free[who]], n_free
            x = todo.pop()
            mine = token[begin[x] : begin[x] + sizes[x]]
            lo, hi = (np.searchsorted(at, mine[: prefix[x]], side=side) for side in ("left", "right"))
            near = np.unique(who[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))])
            near = near[free[near] & (5 * np.minimum(sizes[near], sizes[x]) >= 4 * np.maximum(sizes[near], sizes[x]))]
            if not len(near):
                continue
            mark[mine] = True
            n, ends = sizes[near], np.cumsum(sizes[near])
            shared = np.add.reduceat(mark[token[np.repeat(begin[near] - ends + n, n) + np.arange(ends[-1])]].astype(np.int64), ends - n)
            mark[mine] = False
            near = near[9 * shared >= 4 * (n + sizes[x])]
            free[near] = False
            n_free -= len(near)
            left += near.tolist()
            right += [x] * len(near)
            todo += near.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, th, item (hash of the set of shingles), n (its size) and fp (its fingerprint; null without shingles), of doc_id, th and text."""

    @_common.task
    def run(batches):
        import xxhash

        for b in _common.slices(batches):
            sets = shingles(_common.texts_of(b.column("text")))
            n = np.array([len(s) for s in sets], np.int64)
            items = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            found = iter(fingerprints([s for s in sets if len(s)]))
            fps = [next(found).tobytes() if k else None for k in n.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(items), pa.array(n), pa.array(fps, pa.binary())], names=["doc_id", "th", "item", "n", "fp"])

    return docs.mapInArrow(run, "doc_id bigint, th bigint, item bigint, n bigint, fp binary")


def _tabled(items: DataFrame, picks: list[np.ndarray], one_in: int = 1) -> DataFrame:
    """key, item, fp (the bits that are compared) of each item in each table; on request of the tables' items one in so many, by their hash."""
    weights, most = [np.uint64(1) << np.arange(len(p), dtype=np.uint64) for p in picks], 1 << 18

    @_common.task
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, max(1, most // len(picks))):
                b = whole.slice(lo, max(1, most // len(picks)))
                words = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                bits = np.unpackbits(words, axis=1, bitorder="little")
                keys = np.stack([_mixed((bits[:, p].astype(np.uint64) @ w) * np.uint64(2 * t + 1) + np.uint64(t)) for t, (p, w) in enumerate(zip(picks, weights, strict=True))], 1)
                at = pa.array(np.repeat(np.arange(b.num_rows), len(picks)))
                short = pa.array([x.tobytes() for x in words[:, : PLANES // 8]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), b.column("item").take(at), short.take(at)], names=["k", "item", "fp"])

    some = items.filter(F.pmod(F.xxhash64("item"), F.lit(one_in)) == 0) if one_in > 1 else items
    return some.select("item", "fp").mapInArrow(run, "k bigint, item bigint, fp binary")


def _met(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join, in each run of rows of one (k, i, j), what is within the radius."""

    def compared(key: list[np.ndarray], items: list[np.ndarray], fps: list[np.ndarray]) -> pa.RecordBatch:
        key, items, fps = np.concatenate(key), np.concatenate(items), np.concatenate(fps)
        sizes = np.diff(np.concatenate([[0], np.flatnonzero(key) + 1, [len(items)]])) if len(items) else np.zeros(0, np.int64)
        keep = np.repeat(sizes > 1, sizes)
        items = items[keep]
        label = simhash.linked(sizes[sizes > 1], fps[keep], RADIUS)
        apart = label != np.arange(len(items))
        return pa.RecordBatch.from_arrays([pa.array(items[apart]), pa.array(items[label[apart]])], names=["a", "b"])

    @_common.task
    def run(batches):
        key, items, fps, held, last = [], [], [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in ("k", "i", "j")], 1)
            item, fp = b.column("item").to_numpy(), np.frombuffer(b"".join(b.column("fp").to_pylist()), "<u8").reshape(b.num_rows, -1)
            new = (k[1:] != k[:-1]).any(1)  # whether the next row belongs to another run
            if items and (k[0] != last).any():
                key.append(np.ones(1, bool))
            elif items:
                key.append(np.zeros(1, bool))
            if held >= 1 << 15 and ((cuts := np.flatnonzero(new)).size or key[-1][0]):
                at = 0 if key[-1][0] else int(cuts[0]) + 1  # the run that was begun ends here
                yield compared([*key[:-1], *([key[-1], new[: at - 1]] if at else [])], [*items, item[:at]], [*fps, fp[:at]])
                key, items, fps, held = [], [], [], 0
                item, fp, new = item[at:], fp[at:], new[at:]
            key.append(new)
            items.append(item)
            fps.append(fp)
            held, last = held + len(item), k[-1]
        if items:
            yield compared(key, items, fps)

    # In a bucket the smallest item of a component comes first, so it is the one that the others are linked to.
    return _few(rows.sortWithinPartitions("k", "i", "j", "item").mapInArrow(run, "a bigint, b bigint"))


def _few(links: DataFrame) -> DataFrame:
    """The same components with fewer links: an item has one at most from each table's buckets; it keeps the least, and the others' ends are linked to that one."""
    each = links.groupBy("a").agg(F.collect_set("b").alias("b")).select("a", "b", F.array_min("b").alias("m"))
    ends = F.concat(F.array(F.struct("a", F.col("m").alias("b"))), F.transform(F.filter("b", lambda x: x != F.col("m")), lambda x: F.struct(x.alias("a"), F.col("m").alias("b"))))
    return each.select(F.explode(ends).alias("e")).select("e.*").distinct()


def _near_items(spark: SparkSession, marked: DataFrame, block: int) -> DataFrame:
    """Links (a, b) between items whose fingerprints are within the radius and meet in a table."""
    items = _common.materialize(spark, marked.filter("fp is not null").groupBy("item").agg(F.first("fp").alias("fp")), "near-items")
    n = items.count()
    picks = tables(n)
    # Buckets of more than a block are found in one item of 64; at most HOT of them can be so large, as there are only n * tables rows.
    large = max(block, 64 * n * len(picks) // (32 * HOT))
    counted = _tabled(items, picks, 64).groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") >= max(2, large // 128))
    hot = counted.select("k", F.ceil(F.col("n") * 64 / block).cast("int").alias("blocks"))
    rows = _tabled(items, picks).join(F.broadcast(hot), "k", "left").withColumn("mine", F.coalesce(F.pmod(F.xxhash64("item", "k"), F.col("blocks")), F.lit(0)).cast("int"))
    other = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    dealt = rows.select("k", "item", "fp", "mine", F.explode(other).alias("other")).select("k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "item", "fp")
    return _met(dealt.repartition("k", "i", "j"))


def _links(spark: SparkSession, slim: DataFrame, marked: DataFrame, crowd: int, block: int) -> DataFrame:
    """Links (a, b) between items that join all of similarity 0.8 or more."""
    stars = components(spark, _near_items(spark, marked, block))
    member = stars.select(F.col("a").alias("item"), F.col("b").alias("part")).unionAll(stars.select(F.col("b").alias("item"), F.col("b").alias("part")).distinct())
    one = marked.join(member, "item").groupBy("item", "part").agg(F.min("th").alias("th"), F.max("n").alias("n"))
    blocks = one.groupBy("part").agg(F.ceil(F.sum("n") / F.lit(crowd)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    dealt = one.join(blocks, "part").withColumn("mine", mine).select("item", "part", "th", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # one text of each item, from whichever of its copies
    texts = slim.join(one.select("th", "item"), "th").groupBy("item").agg(F.min("text").alias("text"))
    dealt = dealt.select("item", "part", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).join(texts, "item")

    def run(group: pa.Table) -> pa.Table:
        items = group.column("item").to_numpy()
        left, right = links_in(shingles(group.column("text").to_pylist()))
        return pa.table({"a": items[left], "b": items[right]})

    return dealt.groupBy("part", "i", "j").applyInArrow(run, "a bigint, b bigint")


def grouped(spark: SparkSession, docs: DataFrame, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """doc_id, th (hash of the text) and root (item that stands for the component) of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    marked = _common.materialize(spark, _marked(slim), "near", _common.TEXT_ROWS)
    stars = components(spark, _links(spark, slim.select("th", "text"), marked, crowd, block))
    return marked.join(stars.select(F.col("a").alias("item"), F.col("b").alias("root")), "item", "left").select("doc_id", "th", F.coalesce("root", "item").alias("root"))


def keep_one(spark: SparkSession, docs: DataFrame, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """The documents without the near copies: of each component the row of the smallest id stays (null is the largest), of rows that share it one.

    Ids needn't be unique: rows of one id whose texts lie in different components are different documents.
    """
    found = grouped(spark, docs, crowd, block)
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("k")).select("k.*").distinct()
    its_id, its_th, its_key, number, c_id, c_th, c_key = _common.free_names(docs, 7)
    # Joined and numbered by one hash of id and text, so that the texts move once; within it, ids and texts themselves decide, by comparisons that
    # Spark doesn't take for further keys. A null id counts as -1 there, which its hash tells from that number.
    known = lambda c: F.coalesce(c, F.lit(-1).cast("long"))
    chosen = chosen.select(known(F.col("doc_id")).alias(c_id), F.col("th").alias(c_th), F.xxhash64("doc_id", "th").alias(c_key))
    marked = docs.withColumns({its_id: F.col("doc_id").cast("long"), its_th: F.xxhash64("text")}).withColumn(its_key, F.xxhash64(its_id, its_th)).withColumn(its_id, known(F.col(its_id)))
    same = lambda a, b: (F.col(a) <= F.col(b)) & (F.col(a) >= F.col(b))
    kept = marked.join(chosen, (F.col(its_key) == F.col(c_key)) & same(its_th, c_th) & same(its_id, c_id), "left_semi")
    first = kept.withColumn(number, F.row_number().over(Window.partitionBy(its_key, its_th, its_id).orderBy("text"))).filter(F.col(number) == 1)
    return first.select(*(F.col(f"`{c}`") for c in docs.columns))
