"""Packing tokenized documents into windows by non-negative least squares over a histogram of lengths.

Documents longer than a window are cut into full windows and a rest; a piece of one window is a sequence by itself. The lengths of the
other pieces fall into bins whose width is about a hundredth of the length, each counted by its upper end. Only this histogram, of a
bounded number of bins, reaches the driver. There,

1. shallow combinations are enumerated: one or two lengths, each repeated, and at most one piece on top, that fill a window,
2. repeat counts x >= 0 are solved so that the combinations use up the histogram (active-set non-negative least squares),
3. the counts are rounded down to what the histogram holds,
4. what is left is packed greedily, longest first, into the fullest space that still takes it, again over counts of bins.

The plan is a table of runs: of bin b, the pieces ranked r0 to r1 go to slots of consecutive sequences. Pieces get their rank within their
bin from counts of chunks and bins, so no bin, however common, is gathered anywhere. Offsets come from sums within a sequence.

Null text counts as empty: its sequence of ids is the closing id alone. Ids may be null or repeated, rows too: a piece's place never depends on them.
A very long text is cut into as many windows as it fills; other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm import _common, bpe

WINDOW = 4096
#: Pieces that a worker remembers before it starts anew, and the longest that it remembers.
REMEMBERED, LONGEST = 500_000, 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, chunk long, bin int, place long"


class _WordMerges(bpe.ByteBPE):
    """The merges of a tokenizer file whose words end in a marked byte, for lower-case words of plain letters."""

    def __init__(self, model: dict):
        vocab, self.pairs = model["vocab"], {}
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self.pairs[vocab[a], vocab[b]] = vocab[a + b]
        if list(self.pairs.values()) != sorted(set(self.pairs.values())):
            raise ValueError("the ids of merged tokens must rise in the order of the merges")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.first = np.array([vocab[names[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[names[b] + "</w>"] for b in range(256)], np.int32)
        self.table = bpe.PairTable(self.pairs)

    def symbols(self, pieces: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids, ends = self.first[data], np.cumsum(list(map(len, pieces))) - 1
        ids[ends] = self.last[data[ends]]
        return ids


#: A character outside the plain ones: these are lower-cased one by one and composed already, so that a text of them can be split here.
_OTHER = re.compile(r"[^\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]|<\|")
#: The split pattern of this family of tokenizers over lower-case plain characters.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class WordIds:
    """Ids of texts by a tokenizer file whose tokens never hold white space, each distinct piece encoded once while it is remembered.

    Texts of plain characters are split here and words merged in numpy; the library encodes marks, and what stands between blanks in other texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.pieces = Tokenizer.from_file(path), {}, {}
        with open(path, encoding="utf-8") as f:
            self.merges = _WordMerges(json.load(f)["model"])

    def _by_library(self, parts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        words, marks = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        self.pieces.update(zip(words, self.merges.merge([w.encode() for w in words]), strict=True))
        self.pieces.update(zip(marks, self._by_library(marks), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        out, late = [], []
        fresh: tuple[set[str], set[str]] = (set(), set())
        for t in texts:
            plain = not _OTHER.search(t)
            table, parts = (self.pieces, _PLAIN.findall(t.lower())) if plain else (self.known, t.split(" "))
            got = list(map(table.get, parts))
            if None in got:
                missing = [(i, parts[i]) for i, x in enumerate(got) if x is None]
                fresh[plain].update([w for _, w in missing])
                late.append((got, table, missing))
            out.append(got)
        self._learn(fresh[True])
        rest = list(fresh[False])
        self.known.update(zip(rest, self._by_library(rest), strict=True))
        for got, table, missing in late:
            for i, w in missing:
                got[i] = table[w]
        done = [b"".join(got) for got in out]
        for table, new in ((self.known, fresh[False]), (self.pieces, fresh[True])):
            for w in new:
                if len(w) > LONGEST:
                    del table[w]
        return done


_loaded: dict[str, WordIds] = {}


def _words(path: str) -> WordIds:
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _loaded[path] = WordIds(path)
    return _loaded[path]


def edges(window: int) -> np.ndarray:
    """Upper ends of the bins: multiples of 4, each about a hundredth above the last."""
    ends = [1, 2, 3, 4]
    while ends[-1] < window:
        ends.append(min(window, ends[-1] + max(4, ends[-1] // 100 // 4 * 4)))
    return np.array(ends, np.int64)


def pieces_of(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row for each piece; its bin is the number of the upper end, and its place counts the pieces of that bin along the partition."""
    ends = edges(window)

    def run(batches):
        from pyspark import TaskContext

        words, chunk, last = _words(path), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(len(ends), np.int64)
        for b in _common.slices(batches):
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), words.encode(_common.texts_of(b.column("text"))), strict=True):
                ids += last
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n, part))
            length = np.array([r[2] for r in rows], np.int64)
            kind = np.searchsorted(ends, length)
            order = np.argsort(kind, kind="stable")
            counts = np.bincount(kind, minlength=len(ends))
            place = np.empty(len(rows), np.int64)
            place[order] = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            columns = [*zip(*rows, strict=True)]
            arrays = [pa.array(x, pa.int64()) for x in columns[:5]] + [pa.array(np.full(len(rows), chunk, np.int64)), pa.array(kind.astype(np.int32)), pa.array(place)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "chunk", "bin", "place"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def combinations(sizes: np.ndarray, window: int, slack: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Shallow combinations that fill a window but for ``slack`` of it: up to three bins each, and how often each of them."""
    repeats = [1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512, 1024, 2048, 4096]
    kinds, counts = [], []
    smaller = np.arange(len(sizes))
    for a in range(len(sizes)):
        for k in repeats:
            rest = window - k * sizes[a]
            if rest < 0:
                break
            b = smaller[:a]
            kb = rest // sizes[:a] if a else np.empty(0, np.int64)
            left = rest - kb * sizes[:a]
            top = np.searchsorted(sizes, left, side="right") - 1
            kc = (top >= 0) & (left > 0)
            waste = left - np.where(kc, sizes[np.maximum(top, 0)], 0)
            good = (waste <= slack * window) & (kb > 0)
            kinds.append(np.stack([np.full(good.sum(), a), b[good], np.where(kc[good], top[good], 0)], 1))
            counts.append(np.stack([np.full(good.sum(), k), kb[good], kc[good].astype(np.int64)], 1))
            if rest <= slack * window:
                kinds.append(np.array([[a, 0, 0]]))
                counts.append(np.array([[k, 0, 0]]))
    return (np.concatenate(kinds), np.concatenate(counts)) if kinds else (np.empty((0, 3), np.int64), np.empty((0, 3), np.int64))


def nnls(kinds: np.ndarray, counts: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Columns and their values x >= 0 that nearly minimize the weighted squares of A x - target; a column has up to three entries.

    Active-set method: the column of the steepest descent enters, least squares over the entered ones, values that fall to zero leave.
    """
    aim, active, values = target * weight, [], np.zeros(0)
    matrix = np.zeros((len(target), 0))
    norm = np.sqrt(((counts * weight[kinds]) ** 2).sum(1)) + 1e-12
    tried: set[int] = set()
    residual = aim.copy()
    for _ in range(rounds):
        gain = (counts * (residual * weight)[kinds]).sum(1) / norm
        gain[active] = -1
        if tried:
            gain[list(tried)] = -1
        j = int(gain.argmax()) if len(gain) else -1
        if j < 0 or gain[j] <= 1e-6 * (np.linalg.norm(aim) + 1e-12) or len(active) >= len(target):
            break
        column = np.zeros(len(target))
        np.add.at(column, kinds[j], counts[j] * weight[kinds[j]])
        active.append(j)
        matrix, values = np.column_stack([matrix, column]), np.append(values, 0.0)
        while active:
            gram = matrix.T @ matrix
            gram[np.diag_indices(len(gram))] += 1e-9 * np.trace(gram) / len(gram)
            new = np.linalg.solve(gram, matrix.T @ aim)
            if (new > 0).all():
                values = new
                break
            low = new <= 0
            step = np.min(values[low] / np.maximum(values[low] - new[low], 1e-300))
            values = values + step * (new - values)
            keep = values > 1e-9 * max(1.0, values.max())
            if keep.all():
                keep[int(np.where(low, values, np.inf).argmin())] = False
            if j in [a for a, k in zip(active, keep, strict=True) if not k]:
                tried.add(j)
            active = [a for a, k in zip(active, keep, strict=True) if k]
            matrix, values = matrix[:, keep], values[keep]
        residual = aim - matrix @ values
    return np.array(active, np.int64), values


def greedy(left: dict[int, int], sizes: np.ndarray, window: int) -> list[tuple[dict[int, int], int]]:
    """Pack counts of bins, longest first, into the fullest space that takes them: groups of equal sequences and how many of each."""
    spaces: dict[int, list[tuple[dict[int, int], int]]] = {}
    for b in sorted(left, key=lambda b: -sizes[b]):
        n, size = left[b], int(sizes[b])
        while n:
            room = min((r for r in spaces if r >= size), default=None)
            if room is None:
                each = window // size
                full, rest = divmod(n, each)
                if full:
                    spaces.setdefault(window - each * size, []).append(({b: each}, full))
                if rest:
                    spaces.setdefault(window - rest * size, []).append(({b: rest}, 1))
                n = 0
                continue
            held, many = spaces[room].pop()
            if not spaces[room]:
                del spaces[room]
            each = min(room // size, n)
            used = min(many, n // each)
            if many > used:
                spaces.setdefault(room, []).append((held, many - used))
            spaces.setdefault(room - each * size, []).append((held | {b: held.get(b, 0) + each}, used))
            n -= used * each
    return [x for group in spaces.values() for x in group]


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Runs (bin, first rank, pieces, pieces in each sequence, first sequence) for the pieces of the histogram's bins."""
    ends = edges(window)
    bins = np.array(sorted(b for b, n in histogram.items() if n), np.int64)
    left = {int(b): int(histogram[b]) for b in bins}
    groups: list[tuple[dict[int, int], int]] = []
    if len(bins):
        sizes = ends[bins]
        kinds, counts = combinations(sizes, window)
        target = np.array([left[int(b)] for b in bins], float)
        if len(kinds):
            chosen, x = nnls(kinds, counts, target, sizes / window)
            for j, value in sorted(zip(chosen.tolist(), x.tolist(), strict=True), key=lambda y: -y[1]):
                use: dict[int, int] = {}
                for k, c in zip(kinds[j].tolist(), counts[j].tolist(), strict=True):
                    if c:
                        use[int(bins[k])] = use.get(int(bins[k]), 0) + c
                many = min(int(value), *(left[b] // c for b, c in use.items()))
                if many > 0:
                    groups.append((use, many))
                    for b, c in use.items():
                        left[b] -= c * many
        groups += greedy({b: n for b, n in left.items() if n}, ends, window)
    runs, sequence, rank = [], 0, dict.fromkeys(histogram, 0)
    for use, many in groups:
        for b, each in use.items():
            runs.append((b, rank[b], each * many, each, sequence))
            rank[b] += each * many
        sequence += many
    return runs


def pack(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, on request) of every piece."""
    pieces = _common.materialize(spark, pieces_of(docs, path, end_id, window, with_ids), "packing")
    counts = pieces.groupBy("chunk", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bin").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    starts = counts.select("chunk", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"))
    histogram = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # a row for each bin
    runs = plan(histogram, window)
    ranked = pieces.join(starts, ["chunk", "bin"]).withColumn("rank", F.col("rank0") + F.col("place"))
    # The runs of a bin lie in one array, a bounded table; a piece finds its run by the sum over the runs that begin at or before its rank.
    by_bin: dict[int, list[tuple[int, int, int]]] = {}
    for b, rank, _, each, sequence in runs:
        by_bin.setdefault(b, []).append((rank, each, sequence))
    runs_df = spark.createDataFrame([(b, sorted(x)) for b, x in by_bin.items()], "bin int, runs array<struct<first:long,each:long,sequence:long>>")
    placed = ranked.join(F.broadcast(runs_df), "bin").withColumn("run", F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1))
    # broadcast: at most one row for each of the bins, whose number the window fixes
    placed = placed.withColumn("sequence_id", F.col("run.sequence") + F.floor((F.col("rank") - F.col("run.first")) / F.col("run.each")).cast("long"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "rank")
    offset = F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset, *(["ids"] if with_ids else []))
