"""SimHash near-duplicates: fingerprints of word shingles, bit-sliced comparison, and connected components.

A fingerprint bit is 1 if it is set in over half of the XXH64 values of the text's shingles. Equal fingerprints are one class from the start.
Two fingerprints that differ in at most ``RADIUS`` = 2 of 64 bits agree on two of four 16-bit blocks, so each distinct fingerprint joins
six buckets, one for each pair of blocks. A bucket is compared in one task only if it holds at most ``BUCKET`` fingerprints; the
fingerprints of a larger one agree on 32 bits, so among the other 32 bits they agree on two of four 8-bit blocks: they join six inner
buckets, which by then share 48 bits and so can't hold more than 65,536 different fingerprints. Nothing is capped, and no pair is lost.

In a bucket, bit planes are stored vertically: word w of plane b holds bit b of 64 fingerprints. For a fingerprint, the planes it differs in
are added into carry-save counters (ones, twos, and an overflow that stays), which counts the distances to a block of 64 fingerprints at
once; a block is abandoned once all of them, the fingerprint itself aside, have exceeded the radius. Each bucket gives a spanning forest, not all pairs. The forests are joined by
alternating large-star and small-star steps over tables in the shared folder, until nothing changes.

Null text counts as empty; texts without words have fingerprint zero and are linked like any other. Ids may be repeated or null; a component's
id is its smallest id that is not null; rows of one id whose texts lie in different components each get their own. Other columns are ignored,
whatever their names; an empty table gives no rows. A batch holds about a MiB, or one text that is longer, and takes about 100 bytes for each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common

WORDS, SEED, RADIUS, BUCKET = 3, 42, 2, 256
#: Planes between two looks at what can be abandoned; comparisons (a fingerprint with a word of 64 others) and pairs found that are held at once.
EVERY, MEETINGS, FOUND = 8, 1 << 18, 1 << 19
#: Shingles of a text whose bits are held at once.
LONG = 1 << 16
_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def fingerprints(texts: list[str], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers."""
    import xxhash

    digest, hashes, n, late = xxhash.xxh64_intdigest, [], [], {}

    def ones_of(some: list[int]) -> np.ndarray:
        return np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")

    for i, text in enumerate(texts):
        parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and only ASCII white space
        data = b" ".join(parts)
        if len(parts) <= words:
            n.append(1 if parts else 0)
            hashes += [digest(data, seed)] if parts else []
            continue
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts, stops = np.concatenate([[0], ends[:-words]]), ends[words - 1 :] - 1
        if len(starts) > LONG:  # a long text's bits are summed in stretches
            late[i] = sum(ones_of([digest(data[s:e], seed) for s, e in zip(starts[lo : lo + LONG].tolist(), stops[lo : lo + LONG].tolist(), strict=True)]).sum(0, dtype=np.int64) for lo in range(0, len(starts), LONG)) * 2 > len(starts)
            n.append(0)
            continue
        hashes += [digest(data[s:e], seed) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
        n.append(len(parts) - words + 1)
    out, counts = np.zeros(len(texts), np.uint64), np.array(n, np.int64)
    for i, bits in late.items():
        out[i] = np.packbits(bits, bitorder="little").view("<u8")[0]
    if not hashes:
        return out
    some, bits = np.flatnonzero(counts), ones_of(hashes)
    ends = np.cumsum(counts[some])
    ones = np.stack([bits[e - c : e].sum(0, dtype=np.int64) for e, c in zip(ends.tolist(), counts[some].tolist(), strict=True)])
    out[some] = np.packbits(ones * 2 > counts[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def add_fingerprint(docs: DataFrame, words: int = WORDS, seed: int = SEED, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint, as a signed 64-bit integer, in place of the text."""
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name not in (out, "text")]

    def run(batches):
        for b in _common.slices(batches):
            got = fingerprints(_common.texts_of(b.column("text")), words, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in kinds), pa.array(got)], names=[*(n for n, _ in kinds), out])

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*kinds, (out, "bigint")]))


def near(planes: np.ndarray, values: np.ndarray, word: np.ndarray, settled: np.ndarray, radius: int = RADIUS, done: list[int] | None = None) -> np.ndarray:
    """For each comparison of a fingerprint (a row of ``values``: its 64-bit words) with one word of the planes, the lanes within the radius.

    planes: bits x words; settled: lanes that need no answer, such as the fingerprint's own. A comparison is a block of 64 fingerprints: it
    leaves as soon as every lane is settled or beyond the radius, and its answer is 0. ``done`` counts the steps that were taken.
    """
    out, live, over = np.zeros(len(word), np.uint64), np.arange(len(word)), settled.copy()
    counts = [np.zeros(len(word), np.uint64) for _ in range(int(radius).bit_length())]
    for b in range(len(planes)):
        bit = (values[live, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)
        carry = planes[b, word[live]] ^ (np.uint64(0) - bit)
        for c in counts:
            c ^= carry
            carry &= ~c  # what was set before and got another one
        over |= carry
        if b % EVERY == EVERY - 1 or b == len(planes) - 1:
            if done is not None:
                done.append(len(live) * (b % EVERY + 1))
            more, same = np.zeros(len(live), np.uint64), np.full(len(live), ~np.uint64(0))
            for i in range(len(counts) - 1, -1, -1):  # lanes whose count is larger than the radius, from the highest bit on
                if radius >> i & 1:
                    same &= counts[i]
                else:
                    more |= same & counts[i]
                    same &= ~counts[i]
            over |= more
            keep = np.flatnonzero(~over)
            if len(keep) < len(live):
                live, over, counts = live[keep], over[keep], [c[keep] for c in counts]
            if not len(live):
                break
    out[live] = ~over
    return out


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest item of each item's component, for links among n items."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    return label


def _pairs(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and lane of each bit that is set."""
    some = np.flatnonzero(masks)
    row, lane = np.nonzero(np.unpackbits(masks[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return some[row], lane


def planes_of(values: np.ndarray, word: np.ndarray, lane: np.ndarray, words: int) -> np.ndarray:
    """Bit planes (bits x words) of fingerprints (rows x 64-bit words), each at a lane of a word; lanes are filled in order."""
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros((64 * values.shape[1], words), np.uint64)
    for b in range(len(out)):
        bit = (values[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)
        out[b, word[starts]] = np.bitwise_or.reduceat(bit << lane.astype(np.uint64), starts)
    return out


def linked(sizes: np.ndarray, values: np.ndarray, radius: int = RADIUS, done: list[int] | None = None) -> np.ndarray:
    """For fingerprints (rows x 64-bit words) of buckets that lie one after the other, the first row of each one's component within its bucket.

    Each fingerprint meets the lanes behind its own, a word of 64 at a time. Words are never shared by buckets.
    """
    n, label = len(values), np.arange(len(values))
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    place, each = np.arange(n) - starts[owner], -(-sizes // 64)
    first = np.cumsum(each) - each
    word, lane = first[owner] + place // 64, place % 64
    planes = planes_of(values, word, lane, int(each.sum())) if n else np.zeros((0, 0), np.uint64)
    used = np.bincount(word, minlength=int(each.sum())).astype(np.uint64)
    unused = np.where(used == 64, np.uint64(0), ~np.uint64(0) << np.minimum(used, np.uint64(63)))
    meets = each[owner] - place // 64  # words that a fingerprint meets: its own and those behind it
    ends = np.cumsum(meets)
    for lo in range(0, n, max(1, min(n, MEETINGS * n // max(1, int(ends[-1]) if n else 1)))):
        hi = min(n, lo + max(1, MEETINGS * n // int(ends[-1])))
        row = np.repeat(np.arange(lo, hi), meets[lo:hi])
        at = word[row] + np.arange(len(row)) - np.repeat(ends[lo:hi] - meets[lo:hi] - (ends[lo] - meets[lo]), meets[lo:hi])
        own = at == word[row]
        settled = unused[at] | np.where(own, ~np.uint64(0) >> (np.uint64(63) - lane[row].astype(np.uint64)), np.uint64(0))
        masks = near(planes, values[row], at, settled, radius, done)
        some = np.flatnonzero(masks)
        part = np.cumsum(np.bitwise_count(masks[some]), dtype=np.int64) // FOUND  # where most are alike, 64 pairs of each comparison
        for these in np.split(some, np.flatnonzero(np.diff(part)) + 1) if len(some) else ():
            q, j = _pairs(masks[these])
            q = these[q]
            other = starts[owner[row[q]]] + (at[q] - first[owner[row[q]]]) * 64 + j
            label = _forest(np.concatenate([np.arange(n), row[q]]), np.concatenate([label, other]), n)
    return label


def links_in(buckets: list[np.ndarray], radius: int = RADIUS, done: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smaller fingerprint) that join what is within the radius in each bucket: a spanning forest of stars."""
    some = [np.sort(b) for b in buckets if len(b) > 1]
    if not some:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    values = np.concatenate(some)
    label = linked(np.array([len(b) for b in some]), values[:, None], radius, done)
    apart = label != np.arange(len(values))
    return values[apart], values[label[apart]]


def _blocks(value, width: int):
    """(number of the pair, the pair's bits) for each two of the four blocks of ``width`` bits at the lower end of ``value``."""
    mask = (1 << width) - 1
    part = [F.shiftrightunsigned(value, k * width).bitwiseAND(F.lit(mask).cast("bigint")) for k in range(4)]
    return F.array(*(F.struct(F.lit(i).alias("pair"), (F.shiftleft(part[a], width).bitwiseOR(part[b])).alias("bits")) for i, (a, b) in enumerate(_PAIRS)))


def _rest(pair, value):
    """The 32 bits of the two 16-bit blocks that a pair leaves out."""
    out = None
    for i, (a, b) in enumerate(_PAIRS):
        c, d = (k for k in range(4) if k not in (a, b))
        bits = F.shiftleft(F.shiftrightunsigned(value, 16 * c).bitwiseAND(F.lit(0xFFFF).cast("bigint")), 16).bitwiseOR(F.shiftrightunsigned(value, 16 * d).bitwiseAND(F.lit(0xFFFF).cast("bigint")))
        out = F.when(pair == i, bits) if out is None else out.when(pair == i, bits)
    return out


def _compare(buckets: DataFrame, radius: int) -> DataFrame:
    """Links in buckets that are given as arrays."""

    def run(batches):
        for b in batches:
            values, offsets = b.column("fps").flatten().to_numpy(zero_copy_only=False).view(np.uint64), b.column("fps").offsets.to_numpy()
            offsets = offsets - offsets[0]
            left, right = links_in([values[lo:hi] for lo, hi in zip(offsets, offsets[1:], strict=False)], radius)
            yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a bigint, b bigint")


def links(spark: SparkSession, distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all within the radius of one another."""
    keyed = distinct.select("fp", F.explode(_blocks(F.col("fp"), 16)).alias("k")).select("fp", F.col("k.pair").alias("pair"), F.col("k.bits").alias("bits"))
    sizes = keyed.groupBy("pair", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    shared = _common.materialize(spark, keyed.join(sizes, ["pair", "bits"]), "simhash-buckets")
    cold = shared.filter(F.col("n") <= bucket).groupBy("pair", "bits").agg(F.collect_list("fp").alias("fps"))
    hot = shared.filter(F.col("n") > bucket).select("fp", "pair", "bits", F.explode(_blocks(_rest(F.col("pair"), F.col("fp")), 8)).alias("k"))
    inner = hot.groupBy("pair", "bits", F.col("k.pair").alias("pair2"), F.col("k.bits").alias("bits2")).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return _compare(cold.select("fps").unionAll(inner.select("fps")), radius).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(a, b): each node with links, except the smallest of its component, and that smallest node."""
    edges = _common.materialize(spark, edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = _state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()  # large star
        edges = _common.materialize(spark, edges, "components")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = _common.materialize(spark, small.distinct(), "components")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges


def _grouped(spark: SparkSession, docs: DataFrame, words: int, seed: int, radius: int) -> DataFrame:
    """doc_id, th (hash of the text), fp, root (fingerprint that stands for the component), component_id of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    marked = _common.materialize(spark, add_fingerprint(slim, words, seed), "simhash", _common.TEXT_ROWS)
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = components(spark, links(spark, classes.select("fp"), radius))
    rooted = classes.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
    # Only classes that are linked need their component's smallest id; a star's size has no bound, so it is found by partial sums.
    grouped = rooted.withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = grouped.join(smallest, "root").select("fp", "root", "component_id")
    return marked.join(ids, "fp")


def clusters(spark: SparkSession, docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return _grouped(spark, docs, words, seed, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
