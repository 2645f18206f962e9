"""Byte-level BPE encoding and decoding in numpy.

A text is split by the pattern into pieces; each distinct piece of a batch is merged once, and short ones are remembered. The pieces form padded
matrices, one per length class; in each round every row merges its leftmost pair of minimum rank, found by a hashed pair lookup, and rows
without a pair leave the matrix, which is then cut to the longest row left. Decoding gathers the bytes of the ids.

For patterns that never cross a single blank, but take it to the word behind it (``at_blanks``), texts are cut there first, so that each distinct word
is split only once. Null text counts as empty (no ids). Rows are independent: repeated, tied or unnumbered rows and other columns do no
harm, and an empty table gives no rows. A batch holds about a MiB, or one text that is longer.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import _common

#: Length classes of the matrices. A piece of more bytes than a page of text, without a blank in it, is merged with a heap, as a row's rounds cost the square
#: of its length; the ids are the same.
CLASSES = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1024, 2048, 4096)
#: Chunks that a worker remembers before it starts anew, and the longest that it remembers.
REMEMBERED, LONGEST = 300_000, 64
NONE = np.int32(2**31 - 1)
#: A blank next to white space on both sides: there the pattern may match across the blank.
UNSAFE = re.compile(r"(?:[\s\x85\x1c-\x1f] (?:[\s\x85\x1c-\x1f]|\Z))")
#: A word of plain letters, perhaps with marks behind it: any split pattern of this family cuts it there.
WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class PairTable:
    """Open addressing from a pair of ids to the merged id."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(8, (4 * max(1, len(pairs))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several the last stays
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, NONE where there is none; a negative id is padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(keys.ravel()[at])
        flat, keys = out.ravel(), keys.ravel()
        while len(at):
            found = self.keys[slot]
            hit = found == keys[at]
            flat[at[hit]] = self.values[slot[hit]]
            more = ~hit & (found != -1)
            at, slot = at[more], (slot[more] + 1) & self.mask
        return flat.reshape(left.shape)


class ByteBPE:
    """Encoder and decoder for a rank table: bytes of a token to its rank, which is also its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, at_blanks: bool = False):
        self.ranks, self.pattern, self.at_blanks = ranks, regex.compile(pattern), at_blanks
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        self.table = PairTable(self.pairs)
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        self.decimal = list(map(str, range(len(self.lengths))))
        self.spaced: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge_rows(self, ids: np.ndarray) -> list[bytes]:
        """Merge the rows of a matrix padded with -1; the ids of each row as 32-bit integers."""
        merged, widths = ids, np.zeros(len(ids), np.int64)
        rows, ranks = np.arange(len(ids)), self.table.get(ids[:, :-1], ids[:, 1:])
        ids, width = ids.copy(), (ids >= 0).sum(1)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                merged[rows[over], : ids.shape[1]], widths[rows[over]] = ids[over], width[over]
                keep = ~over
                rows, ids, ranks, width, at, best = rows[keep], ids[keep], ranks[keep], width[keep], at[keep], best[keep]
                if not len(rows):
                    break
                most = int(width.max())
                ids, ranks = ids[:, :most], ranks[:, : most - 1]
            n = np.arange(len(rows))
            ids[n, at] = best
            after = np.arange(ids.shape[1] - 1)[None, :] > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            moved = after[:, : ranks.shape[1] - 1]
            ranks[:, :-1] = np.where(moved, ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, NONE
            width -= 1
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < ids.shape[1])
                k, j = n[ok], left[ok]
                ranks[k, j] = self.table.get(ids[k, j], ids[k, j + 1])
        flat, step = np.ascontiguousarray(merged, "<i4").tobytes(), 4 * merged.shape[1]
        return [flat[i * step : i * step + 4 * w] for i, w in enumerate(widths.tolist())]

    def merge_long(self, ids: list[int]) -> bytes:
        """The same merges with a heap of pairs and links between neighbours."""
        after, before = list(range(1, len(ids))) + [-1], list(range(-1, len(ids) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.pairs.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := self.pairs.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], "<i4").tobytes()

    def symbols(self, pieces: list[bytes]) -> np.ndarray:
        """The ids that merging starts from, one for each byte of the pieces."""
        return self.first[np.frombuffer(b"".join(pieces), np.uint8)]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        kind = np.searchsorted(CLASSES, lengths)
        for k in np.unique(kind).tolist():
            rows = np.flatnonzero(kind == k).tolist()
            if k == len(CLASSES):
                for r in rows:
                    out[r] = self.merge_long(self.symbols([pieces[r]]).tolist())
                continue
            per = max(1, (1 << 20) // CLASSES[k])
            for lo in range(0, len(rows), per):
                some = rows[lo : lo + per]
                ids = np.full((len(some), CLASSES[k]), -1, np.int32)
                ids[np.arange(CLASSES[k])[None, :] < lengths[some][:, None]] = self.symbols([pieces[r] for r in some])
                for r, x in zip(some, self.merge_rows(ids), strict=True):
                    out[r] = x
        return out

    def _learn(self, known: dict[str, bytes], chunks: list[str], blank: str) -> None:
        """Add the ids of chunks, each behind ``blank``; most are a word with or without a mark."""
        split, cached, pattern, word = [], self.pieces, self.pattern, WORD.fullmatch
        if len(cached) > REMEMBERED:
            cached.clear()
        for c in chunks:
            m = word(c)
            split.append(((blank + m[1], m[2]) if m[2] else (blank + c,)) if m else [x[0] for x in pattern.finditer(blank + c)])
        new = list({p for x in split for p in x} - cached.keys())
        cached.update(zip(new, self.merge([p.encode() for p in new]), strict=True))
        for c, x in zip(chunks, split, strict=True):
            known[c] = cached[x[0]] if len(x) == 1 else b"".join([cached[p] for p in x])
        for p in new:
            if len(p) > LONGEST:
                del cached[p]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers."""
        if len(self.spaced) > REMEMBERED:
            self.spaced = {}
        spaced, plain, out, late, new = self.spaced, {}, [], [], set()
        for i, t in enumerate(texts):
            if not self.at_blanks or UNSAFE.search(t):
                pieces = [m[0] for m in self.pattern.finditer(t)]
                lone = list(set(pieces))
                ids = dict(zip(lone, self.merge([p.encode() for p in lone]), strict=True))
                out.append(b"".join(map(ids.__getitem__, pieces)))
                continue
            first, *rest = t.split(" ")
            plain[first] = b""
            got = list(map(spaced.get, rest))
            late.append((i, first, rest, got))
            if None in got:
                new.update(w for w, x in zip(rest, got, strict=True) if x is None)
            out.append(b"")
        self._learn(plain, list(plain), "")
        self._learn(spaced, list(new), " ")
        for i, first, rest, got in late:
            if None in got:
                got = map(spaced.__getitem__, rest)
            out[i] = plain[first] + b"".join(got)
        for w in new:
            if len(w) > LONGEST:
                del spaced[w]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<i4") for x in self.encode_bytes(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after the other."""
        if not len(ids):
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


_loaded: dict[tuple[str, str, bool], ByteBPE] = {}


def load(path: str, pattern: str, at_blanks: bool = False) -> ByteBPE:
    """The encoder of a rank file: on each line a token in base64 and its rank. Kept for the life of the worker."""
    if (path, pattern, at_blanks) not in _loaded:
        with open(path, "rb") as lines:
            _loaded[path, pattern, at_blanks] = ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern, at_blanks)
    return _loaded[path, pattern, at_blanks]


def tokenize(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", at_blanks: bool = False) -> DataFrame:
    """``docs`` with a column of token ids."""
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name != out]

    def run(batches):
        bpe = load(path, pattern, at_blanks)
        for b in _common.slices(batches, text):
            ids = pa.array(bpe.encode(_common.texts_of(b.column(text))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in kinds), ids], names=[*(n for n, _ in kinds), out])

    return docs.select(*(n for n, _ in kinds)).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*kinds, (out, "array<int>")]))


def detokenize(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the decoded bytes of the column of ids."""
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name != out]

    def run(batches):
        bpe = load(path, pattern)
        for b in batches:
            got = [bpe.decode(np.array(x or [], np.int32)) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in kinds), pa.array(got, pa.binary())], names=[*(n for n, _ in kinds), out])

    return rows.select(*(n for n, _ in kinds)).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*kinds, (out, "binary")]))


def digests(docs: DataFrame, path: str, pattern: str, at_blanks: bool = False) -> DataFrame:
    """Per document: number of tokens, digest of the ids, and digest of the bytes that the ids decode to. One narrow pass, no shuffle."""

    def run(batches):
        bpe = load(path, pattern, at_blanks)
        for b in _common.slices(batches):
            rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in bpe.encode(_common.texts_of(b.column("text"))):
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield _common.table(rows | {"doc_id": b.column("doc_id")}, SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
