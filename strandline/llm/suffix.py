"""Exact substring deduplication with suffix arrays over shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere, in the same text or another. Suffix arrays over whole corpora
don't fit one machine, so strings that can be equal are brought together first, without losing any:

1. Each window of ``LENGTH`` bytes has an anchor: the leftmost of its ``GRAM``-byte strings whose hash is least. Equal windows have equal
   anchors, so only windows whose anchors have the same hash can be equal. Neighbouring windows mostly share an anchor; their common stretch
   of text is a segment, one row with the anchor's hash and the segment's 128-bit digest. Equal segments that follow one another (a run of one
   character, say) are one row with their number.
2. Anchors that occur once are settled: none of their windows repeats. Equal segments are collapsed to one with its number; where that is
   above one, all of its windows repeat.
3. The rest go by anchor into shards. In a shard the distinct segments are laid end to end and their suffix array is built by induced sorting:
   suffixes are classified, the leftmost-smaller ones are sorted (their substrings are induced, named by comparison, and sorted recursively
   where names repeat), and the others are induced from them in linear passes. The common prefix of each window with the one before it in
   the array, permuted to text order, tells which windows repeat.
4. An anchor with more than ``CROWD`` different segments (a passage that begins or ends in very many contexts) would make a shard too large. Equal
   windows lie equally far before their anchor, so its windows are taken in blocks of ``STEP`` such distances; all windows of a block share
   a core, and blocks whose cores have equal digests form the shards. Only where more than ``CROWDED`` different blocks share one core are
   single windows brought together by their 128-bit digests.

All of it is judged on the input. Texts are told apart by a 128-bit key, so ids may be null or repeated and rows too. Null text counts as empty. Texts
shorter than ``LENGTH`` keep all bytes; a very long one is hashed in pieces that overlap. An empty table gives no rows; other columns are ignored by
``removed_spans`` and kept by ``scrub``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common
from strandline.llm.quality import _power

LENGTH, GRAM = 200, 32
#: Different segments of an anchor that a shard takes, distances from the anchor in a block, and different blocks of a core that a shard takes.
CROWD, STEP, CROWDED = 512, 16, 2048
#: Bytes that a suffix array is built over, and bytes of a text that are hashed at once.
SHARD_BYTES, PIECE = 1 << 20, 1 << 22
_PLACE = 24  # bits of a place in a piece


def _grams(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on."""
    up, down = _power(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1 + seed)) * up[:-1])])
    h = (sums[size:] - sums[:-size]) * down[: len(data) - size + 1]
    h = (h ^ (h >> np.uint64(32)) ^ np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each place on: running minima of blocks from both ends."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments of texts that lie end to end in ``data``: text, hash of the anchor, first and last window (places in
    the text), and the anchor's distance from the first window."""
    empty = np.zeros(0, np.int64)
    if len(data) < length or not ((ends - starts) >= length).any():
        return empty, empty, empty, empty, empty
    h = _grams(data, GRAM)
    keys = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding_least(keys, length - GRAM + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    del keys
    n = np.maximum(0, ends - starts - length + 1)
    text = np.repeat(np.arange(len(starts)), n)
    window = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    at = at[window]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return text[first], h[at[first]].view(np.int64), window[first] - starts[text[first]], window[last] - starts[text[first]], at[first] - window[first]


def _split(texts: list[bytes], length: int):
    """Groups of pieces (text, place, bytes) of at most about a slice; longer texts are cut into pieces that overlap by a window less one."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - length + 1), PIECE):
            piece = t[lo : lo + PIECE + length - 1]
            if size + len(piece) > PIECE + length and group:
                yield group
                group, size = [], 0
            group.append((i, lo, piece))
            size += len(piece)
    if group:
        yield group


def digests(parts) -> np.ndarray:
    """128-bit digests of byte strings, as rows of two signed 64-bit integers."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """text, anchor, digest (two numbers), first window, windows, the anchor's distance from the first window, and number of equal segments from there on."""
    out = []
    for group in _split(texts, length):
        joined = b"".join(p for _, _, p in group)
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        text, h, first, last, far = anchors(np.frombuffer(joined, np.uint8), ends - sizes, ends, length)
        if not len(text):
            continue
        at, n = (ends - sizes)[text], last - first + 1
        d = digests(joined[s:e] for s, e in zip((at + first).tolist(), (at + last + length).tolist(), strict=True))
        same = (text[1:] == text[:-1]) & (h[1:] == h[:-1]) & (d[1:] == d[:-1]).all(1) & (n[1:] == n[:-1]) & (far[1:] == far[:-1])
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        owner, lead = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        out.append([x[begin] for x in (owner[text], h, d[:, 0], d[:, 1], first + lead[text], n, far)] + [np.diff(np.append(begin, len(text)))])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 8


def _scatter(chars: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Places for a run of suffixes that go to the heads of their buckets, in order; the heads move on."""
    n = len(chars)
    order = chars.argsort(kind="stable")
    c = chars[order]
    cut = (c[1:] != c[:-1]).nonzero()[0]
    if not len(cut):
        at = heads[c[0]]
        heads[c[0]] = at + n
        return np.arange(at, at + n)
    first = np.zeros(len(cut) + 1, np.int64)
    first[1:] = cut + 1
    keys = c[first]
    at, out = heads[keys], np.empty(n, np.int64)
    if len(first) == n:
        out[order] = at
        heads[keys] = at + 1
        return out
    counts = np.empty(len(first), np.int64)
    counts[:-1], counts[-1] = first[1:] - first[:-1], n - first[-1]
    out[order] = (at - first).repeat(counts) + np.arange(n)
    heads[keys] = at + counts
    return out


def _sweep(s: np.ndarray, sa: np.ndarray, wanted: np.ndarray, begins: np.ndarray, sizes: np.ndarray, sign: int) -> np.ndarray:
    """One pass of induction over the buckets in order (``sign`` 1) or, over the mirror image, from the last (-1): from each suffix whose ``wanted`` holds the
    one before it in the text goes to its bucket's head. The heads, as they are in the end.

    A stretch of buckets is taken at once as far as nothing that it induces falls into the stretch itself; a bucket that induces into itself (a
    run of one character) takes a wave for each step.
    """
    kinds, heads = len(sizes), begins.copy()
    c, step = (0, 1) if sign > 0 else (kinds - 1, 1)
    past = kinds if sign > 0 else -1
    begin, end = begins.tolist(), (begins + sizes).tolist()
    while c != past:
        upto = min(past, c + step) if sign > 0 else max(past, c - step)
        part = sa[begin[c] : end[upto - sign]]
        prev = part[wanted[part]] - 1
        if len(prev):
            chars = s[prev]
            nearest = int(chars.min()) if sign > 0 else int(chars.max())
            if nearest == c:
                done = begin[c]
                while True:  # what the bucket got before and from itself, wave by wave
                    part, done = sa[done : heads[c]], int(heads[c])
                    prev = part[wanted[part]] - 1
                    if not len(prev):
                        break
                    sa[_scatter(s[prev], heads)] = prev
                part = sa[done : end[c]]  # then what stood there from the start
                prev = part[wanted[part]] - 1
                if len(prev):
                    sa[_scatter(s[prev], heads)] = prev
                c, step = c + sign, 1
                continue
            if (upto - nearest) * sign > 0:
                upto = nearest
                part = sa[begin[c] : end[upto - sign]]
                prev = part[wanted[part]] - 1
                chars = s[prev]
            if len(prev):
                sa[_scatter(chars, heads)] = prev
        step, c = 2 * abs(upto - c), upto
    return heads


def _induce(s: np.ndarray, small: np.ndarray, sa: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """From sorted leftmost-smaller suffixes at the ends of their buckets, all suffixes in order; ``small``: suffix is less than the next one.

    Larger suffixes are induced from the left, smaller ones from the right.
    """
    n, ends = len(s), np.cumsum(sizes)
    wanted = np.zeros(n + 1, bool)  # the entry at -1 stands for an empty place
    wanted[1:n] = ~small[:-1]
    _sweep(s, sa, wanted, ends - sizes, sizes, 1)
    sa[(sa >= 0) & small[sa]] = -1
    sa[0] = n - 1
    wanted[1:n] = small[:-1]
    _sweep(s, sa[::-1], wanted, n - ends, sizes, -1)
    sa[0] = n - 1
    return sa


def _named(s: np.ndarray, order: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Numbers of sorted strings (places in ``s`` and widths), equal ones the same: neighbours are compared, long ones as whole."""
    same = width[1:] == width[:-1]
    at = np.flatnonzero(same)
    for k in range(32):
        at = at[width[at] > k]
        if not len(at):
            break
        differs = s[order[at] + k] != s[order[at + 1] + k]
        same[at[differs]] = False
        at = at[~differs]
    if len(at):
        data, unit = s.tobytes(), s.itemsize
        for i in at[width[at] > 32].tolist():
            x, y, w = int(order[i]) * unit, int(order[i + 1]) * unit, int(width[i]) * unit
            same[i] = data[x : x + w] == data[y : y + w]
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of ``s``: small integers, of which the last, 0, occurs only there."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    differs = np.flatnonzero(s[1:] != s[:-1])  # the type is that of the next place where neighbours differ
    rising = s[differs] < s[differs + 1]
    small = np.append(rising[np.searchsorted(differs, np.arange(n - 1))], True)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(s, minlength=int(s.max()) + 1)
    counts = np.bincount(s[lms], minlength=len(sizes))

    def placed(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int64)
        sa[_scatter(s[order], np.cumsum(sizes) - counts)] = order
        return _induce(s, small, sa, sizes)

    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = placed(lms)
    order = sa[is_lms[sa]]  # by their substrings up to the next one
    upto = np.full(n, n - 1, np.int64)
    upto[lms[:-1]] = lms[1:]
    names = np.empty(n, np.int32)
    names[order] = _named(s, order, upto[order] - order + 1)
    if names[order[-1]] < len(lms) - 1:
        order = lms[suffix_array(names[lms])]
    return placed(order)


def common_prefixes(data: bytes, here: np.ndarray, there: np.ndarray, most: int) -> np.ndarray:
    """How many bytes are the same from each two places on, ``most`` at most; ``data`` goes on for ``most`` bytes behind each place."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    out, live = np.full(len(here), most, np.int64), np.arange(len(here))
    for k in [*range(0, most - 7, 8), most - 8]:
        differs = words[here[live] + k] ^ words[there[live] + k]
        ended = np.flatnonzero(differs)
        low = differs[ended] & (~differs[ended] + np.uint64(1))  # the lowest bit that differs
        out[live[ended]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[differs == 0]
        if not len(live):
            break
    return out


def repeated(segments_: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For all windows of different segments, one after the other, whether the same window stands in another place of them."""
    joined = b"\xff".join(segments_) + b"\xff"  # a byte that UTF-8 never holds
    data = np.frombuffer(joined, np.uint8)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    number = np.zeros(256, np.int16)
    number[used] = np.arange(1, len(used) + 1)
    s = np.append(number[data], np.int16(0))
    sizes = np.array([len(x) for x in segments_])
    starts, n = np.cumsum(sizes + 1) - sizes - 1, sizes - length + 1
    windows = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    is_window = np.zeros(len(s), bool)
    is_window[windows] = True
    sa = suffix_array(s)
    sa = sa[is_window[sa]]
    before = np.full(len(s), -1, np.int64)  # permuted: the window above, by place in the text
    before[sa[1:]] = sa[:-1]
    here = windows[before[windows] >= 0]
    again = here[common_prefixes(joined, here, before[here], length) >= length]
    found = np.zeros(len(s), bool)
    found[again] = found[before[again]] = True
    return found[windows]


def _runs(flags: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int]]]:
    """First and last place of each run of true flags between the bounds, counted from the lower bound."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    out = []
    for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if not flags[lo:hi].any():
            out.append([])
            continue
        a, b = np.searchsorted(edges, [lo, hi])
        cut = [lo] * (a % 2) + [e for e in edges[a:b].tolist()] + [hi] * (b % 2)
        if len(cut) > 1 and cut[0] == cut[1]:
            cut = cut[2:]
        out.append([(x - lo, y - 1 - lo) for x, y in zip(cut[::2], cut[1::2], strict=True) if y > x])
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals, as maximal runs."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_KEY = ["u1", "u2"]
_SEG = "a bigint, d bigint, e bigint, u1 bigint, u2 bigint, first bigint, size int, far int, n int"


def _keyed(docs: DataFrame, *extra) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*extra, F.xxhash64(text).alias("u1"), F.xxhash64(F.lit(1), text).alias("u2"), text.cast("binary").alias("text"))


def _segments_of(keyed: DataFrame, length: int) -> DataFrame:
    names = [c.split()[0] for c in _SEG.split(", ")]

    @_common.task
    def run(batches):
        for b in _common.slices(batches):
            text, *rest = segments(b.column("text").to_pylist(), length)
            at = pa.array(text)
            h, d, e, first, size, far, n = rest
            narrow = [pa.array(x.astype(np.int32)) for x in (size, far, n)]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), pa.array(e), b.column("u1").take(at), b.column("u2").take(at), pa.array(first), *narrow], names=names)

    return keyed.select("u1", "u2", "text").mapInArrow(run, _SEG)


def _candidates(spark: SparkSession, keyed: DataFrame, length: int) -> DataFrame:
    """Segments whose anchor occurs more than once; alone: whether all segments of the anchor are the same text."""
    every = _common.materialize(spark, _segments_of(keyed, length), "suffix-segments", _common.TEXT_ROWS)
    which = F.struct("d", "e")
    shared = every.groupBy("a").agg(F.sum("n").alias("n"), F.min(which).alias("lo"), F.max(which).alias("hi")).filter("n > 1").select("a", (F.col("lo") == F.col("hi")).alias("alone"))
    shared = _common.materialize(spark, shared, "suffix-anchors")
    out = _common.materialize(spark, every.join(shared, "a"), "suffix-candidates")
    _common.discard(spark, every)
    return out


def _with_bytes(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The text of each wanted segment, read from one copy of its document."""
    lists = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("a", "n", "crowd", "far", "first", "size")).alias("w"))
    texts = keyed.groupBy(*_KEY).agg(F.first("text").alias("text"))

    @_common.task
    def run(batches):
        for b in _common.slices(batches):
            w = b.column("w")
            rows = w.flatten()
            owner = np.repeat(np.arange(b.num_rows), w.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            fields = {rows.type.field(i).name: rows.field(i) for i in range(rows.type.num_fields)}
            parts, last = b.column("text").to_pylist(), (fields["first"].to_numpy() + fields["size"].to_numpy() + length - 1).tolist()
            cut = [parts[i][s:e] for i, s, e in zip(owner.tolist(), fields["first"].to_pylist(), last, strict=True)]
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([fields["a"], fields["n"], fields["crowd"], fields["far"], b.column("u1").take(at), b.column("u2").take(at), fields["first"], pa.array(cut, pa.binary())], names=["a", "n", "crowd", "far", "u1", "u2", "first", "segment"])

    return texts.join(lists, _KEY).select(*_KEY, "text", "w").mapInArrow(run, "a bigint, n bigint, crowd boolean, far int, u1 bigint, u2 bigint, first bigint, segment binary")


def _shards(rows: DataFrame, length: int) -> DataFrame:
    """Windows that repeat within a shard, of segments that occur once: u1, u2, first, last. Segments of one ``a`` stay together."""

    @_common.task
    def run(batches):
        held, size = [], 0

        def out():
            n = np.array([len(x[4]) - length + 1 for x in held])
            bounds = np.concatenate([[0], np.cumsum(n)])
            found = _runs(repeated([x[4] for x in held], length), bounds)
            got = [(x[1], x[2], x[3] + lo, x[3] + hi) for x, runs in zip(held, found, strict=True) if x[5] == 1 for lo, hi in runs]
            columns = [*zip(*got, strict=True)] or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u1", "u2", "first", "last"])

        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("a", "u1", "u2", "first", "segment", "n")), strict=True):
                if size >= SHARD_BYTES and x[0] != held[-1][0]:  # a crowded anchor or core isn't here, so no shard grows without bound
                    yield out()
                    held, size = [], 0
                held.append(x)
                size += len(x[4])
        if held:
            yield out()

    return rows.select("a", "u1", "u2", "first", "segment", "n").repartition("a").sortWithinPartitions("a").mapInArrow(run, "u1 bigint, u2 bigint, first bigint, last bigint")


def _crowds(spark: SparkSession, rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """For anchors with very many segments: pieces for the shards, dealt by core, and windows that repeat (u1, u2, first, last).

    A piece holds a block's windows, whose distances from the anchor are from ``STEP`` times the block's number on. Where a core occurs once, none of them
    repeats; where a whole piece occurs twice, all of them do. The rest go to shards, or window by window where a core is crowded, too.
    """

    @_common.task
    def blocks(batches):
        for b in _common.slices(batches, "segment"):
            parts, place = b.column("segment").to_pylist(), b.column("far").to_numpy()
            n = np.array([len(x) for x in parts]) - length + 1
            near, far = (place - n + 1) // STEP, place // STEP  # numbers of the nearest and the farthest block
            owner = np.repeat(np.arange(len(parts)), far - near + 1)
            block = np.arange(len(owner)) - np.repeat(np.cumsum(far - near + 1) - (far - near + 1), far - near + 1) + near[owner]
            lo, hi = np.maximum(0, place[owner] - STEP * block - STEP + 1), np.minimum(n[owner] - 1, place[owner] - STEP * block)
            core = place[owner] - STEP * block  # where the block's last window begins; the core runs from there to the end of its first
            both = list(zip(owner.tolist(), core.tolist(), lo.tolist(), hi.tolist(), block.tolist(), strict=True))
            piece = [parts[i][s : e + length] for i, _, s, e, _ in both]
            cores = digests(parts[i][max(0, c) : c + length - STEP + 1] + k.to_bytes(4, "little", signed=True) for i, c, _, _, k in both)
            whole = digests(p + k.to_bytes(4, "little", signed=True) for p, (*_, k) in zip(piece, both, strict=True))
            take, first = pa.array(owner), b.column("first").to_numpy()[owner]
            columns = [*(pa.array(x[:, i]) for x in (cores, whole) for i in range(2)), b.column("u1").take(take), b.column("u2").take(take), pa.array(first + lo), pa.array(first + hi), b.column("n").take(take), pa.array(piece, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["c1", "c2", "w1", "w2", "u1", "u2", "first", "last", "n", "piece"])

    @_common.task
    def windows(batches):
        for b in _common.slices(batches, "piece"):
            parts = b.column("piece").to_pylist()
            n = np.array([len(x) - length + 1 for x in parts])
            owner = np.repeat(np.arange(len(parts)), n)
            lo = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            keys, take = digests(parts[i][j : j + length] for i, j in zip(owner.tolist(), lo.tolist(), strict=True)), pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), b.column("u1").take(take), b.column("u2").take(take), pa.array(b.column("first").to_numpy()[owner] + lo), b.column("times").take(take)], names=["k1", "k2", "u1", "u2", "first", "times"])

    four, where = ["c1", "c2", "w1", "w2"], ["u1", "u2", "first", "last"]
    rows = rows.select("u1", "u2", "first", "segment", "far", "n").repartition("u1", "u2", "first")
    found = _common.materialize(spark, rows.mapInArrow(blocks, "c1 bigint, c2 bigint, w1 bigint, w2 bigint, u1 bigint, u2 bigint, first bigint, last bigint, n bigint, piece binary"), "suffix-blocks")
    kinds = found.groupBy(*four).agg(F.sum("n").alias("times"), F.min(F.struct(*where)).alias("r")).select(*four, "times", "r.*")
    kinds = _common.materialize(spark, kinds, "suffix-block-kinds")
    several = kinds.groupBy("c1", "c2").agg(F.count("*").alias("m")).filter("m > 1")
    whole = found.filter("n = 1").join(kinds.filter("times > 1").select(*four), four, "left_semi").select(*where)
    mixed = kinds.join(several, ["c1", "c2"]).join(found.select(*where, "piece"), where)
    mixed = _common.materialize(spark, mixed.select(F.col("c1").alias("a"), "u1", "u2", "first", F.col("piece").alias("segment"), F.col("times").alias("n"), "m"), "suffix-mixed")
    each = mixed.filter(F.col("m") > CROWDED).select("u1", "u2", "first", F.col("segment").alias("piece"), F.col("n").alias("times")).mapInArrow(windows, "k1 bigint, k2 bigint, u1 bigint, u2 bigint, first bigint, times bigint")
    each = _common.materialize(spark, each, "suffix-windows")
    twice = each.groupBy("k1", "k2").agg(F.sum("times").alias("all")).filter(F.col("all") > 1).select("k1", "k2")
    single = each.filter("times = 1").join(twice, ["k1", "k2"], "left_semi").select("u1", "u2", "first", F.col("first").alias("last"))
    return mixed.filter(F.col("m") <= CROWDED).drop("m"), whole.unionByName(single)


def repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """u1, u2, spans: for each text, known by its key, the windows (first to last) that stand elsewhere, too. Texts without any are left out."""
    keyed = _keyed(docs)
    found = _candidates(spark, keyed, length)
    _common.release(spark)
    same = ["a", "d", "e"]
    kinds = found.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.struct("u1", "u2", "first", "size", "far")).alias("r"), F.first("alone").alias("alone"))
    # Written, so that both sides of the joins below are plain exchanges, whose large partitions Spark can split.
    kinds = _common.materialize(spark, kinds, "suffix-kinds")
    # Equal segments in different places: all their windows repeat.
    whole = found.join(kinds.filter("n > 1").select(*same), same, "left_semi").select(*_KEY, "first", (F.col("first") + F.col("size").cast("long") * F.col("n") - 1).alias("last"))
    open_ = kinds.filter("not alone").select("a", "n", "r.*")
    crowds = open_.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") > CROWD).select("a", F.lit(True).alias("crowd"))
    wanted = open_.join(crowds, "a", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    shown = _common.materialize(spark, _with_bytes(keyed, wanted, length), "suffix-shards", _common.TEXT_ROWS)
    _common.release(spark)
    pieces, others = _crowds(spark, shown.filter("crowd"), length)
    plain = shown.filter("not crowd").select("a", "u1", "u2", "first", "segment", "n")
    some = _shards(plain.unionByName(pieces), length).unionByName(others)
    spans = _common.materialize(spark, some.unionByName(whole).distinct().groupBy(*_KEY).agg(F.collect_list(F.struct("first", "last")).alias("spans")), "suffix-spans")
    _common.discard(spark, found)
    _common.discard(spark, shown)
    _common.release(spark)
    return spans


def _cut(data: bytes, spans: list[dict], length: int) -> list[tuple[int, int]]:
    return merged([(x["first"], x["last"] + length) for x in spans or ()])


def _kept(data: bytes, cut: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in cut)]
    return b"".join(data[e:s] for e, s in zip(ends, [*(s for s, _ in cut), len(data)], strict=True))


def removed_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and removed: the removed runs of bytes (end exclusive)."""
    spans = repeats(spark, docs, length)
    rows = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).join(spans, _KEY, "left").select("doc_id", "text", "spans")

    def run(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        for b in _common.slices(batches):
            out = []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                cut = _cut(text, found, length)
                out.append((len(text), sum(e - s for s, e in cut), len(cut), hashlib.sha256(_kept(text, cut)).hexdigest(), [{"start": s, "end": e} for s, e in cut]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=names)

    return _common.texts(rows).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>")


def scrub(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated bytes; of a character whose bytes are only partly repeated all stay. A null text stays null."""
    names = docs.columns
    spans = repeats(spark, docs, length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k1, k2, found_ = _common.free_names(docs, 3)
    rows = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit(1), text)}).join(spans.select(F.col("u1").alias(k1), F.col("u2").alias(k2), F.col("spans").alias(found_)), [k1, k2], "left").drop(k1, k2)

    @_common.task
    def run(batches):
        for b in _common.slices(batches):
            new = []
            for text, found in zip(b.column("text").to_pylist(), b.column(found_).to_pylist(), strict=True):
                if text is None or not found:
                    new.append(text)
                    continue
                data, cut = text.encode(), []
                for s, e in _cut(b"", found, length):
                    while s < e and data[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
                        e -= 1
                    cut.append((s, e))
                new.append(_kept(data, cut).decode())
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == "text" else b.column(n) for n in names], names=names)

    return _common.texts(rows).mapInArrow(run, docs.schema)
