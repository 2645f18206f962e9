"""Media columns as FLAC: encoding, decoding with checks, PCM blocks that can be sought, and features.

A stream is mono, 8 bits a sample, in blocks of ``BLOCK`` samples: a STREAMINFO block with the MD5 of the samples, a SEEKTABLE with one point for each
frame, then frames with Rice-coded residuals in four partitions, of whichever is shortest: a fixed predictor of order 0 to 2, a linear
predictor whose ``ORDER`` coefficients are fitted to the frame, or plain samples. The decoder also knows constant subframes, fixed predictors up to
order 4, linear predictors of any order and precision, any number of partitions, and partitions of plain residuals. Frames are found by the
seek points where these reach all samples; otherwise by their sync code, number and checksums. All frames of a batch are decoded side by
side: first where each code begins, one of each frame at a time, then all residuals at once, then one sample of each frame at a time; header and frame
checksums and the MD5 are verified.

Null text is an empty payload, which is padded like any other. Rows are independent, so repeated rows, null ids and other columns do no harm;
equal texts give equal streams, and an empty table no rows. A batch holds about a MiB, or one text that is longer: decoding takes about 31 bytes
of memory for each of its samples, encoding about 85 for each of those encoded at once (``ENCODED``, or one longer text). A stream that fails a check
raises ``ValueError``.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import _common

BLOCK, RATE, PAD = 4096, 8000, 64
#: Coefficients of a fitted predictor, bits of each, and the logarithm of the number of partitions.
ORDER, PRECISION, PARTS = 4, 8, 2
#: Bytes that are encoded at once (one longer payload is encoded alone).
ENCODED = 1 << 18
#: Coefficients of the fixed predictors of order 0 to 4.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, blocks array<struct<first_sample:bigint,stream_offset:bigint,samples:int>>"


def _table(poly: int, bits: int) -> np.ndarray:
    """The checksum of each byte."""
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
_crc8 = CRC8.tolist()
#: Bytes of a run that are looked at together; the checksum of two bytes, and what becomes of a checksum by 2, 4, .. bytes 0 and by a whole chunk of them.
CHUNK = 64
_pairs = ((CRC16 << 8)[:, None] ^ CRC16[(CRC16 >> 8)[:, None] ^ np.arange(256)]).reshape(-1)
_moves = [_pairs]
while 2 << len(_moves) <= CHUNK:
    _moves.append(_moves[-1][_moves[-1]])
#: The first bit 1 of a byte (8: none), and the bits 0 from each of the first eight bits of two bytes on, packed into one number.
_first = np.array([8 - b.bit_length() for b in range(256)], np.uint8)
_two = np.arange(1 << 16, dtype=np.int32)
_leading = np.stack([16 - j - np.floor(np.log2(np.maximum(_two & ((1 << (16 - j)) - 1), 0.5))).astype(np.int64) - 1 for j in range(8)], 1).astype(np.uint8).reshape(-1).view(np.uint64)
_far = [np.stack([np.arange(256, dtype=np.uint16) << 8, np.arange(256, dtype=np.uint16)])[None]]


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _crc8[c ^ b]
    return c


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of runs of ``data``. Bytes 0 in front change none, so they fill a run up to whole chunks; a chunk's halves are joined, beginning with
    pairs of bytes, until it is one checksum, whose share of its run depends on the distance from the end alone."""
    chunks = np.maximum(-(-sizes // CHUNK), 1)
    ends = np.cumsum(chunks)
    filled = np.zeros(int(chunks.sum()) * CHUNK, np.uint8)
    for start, size, end in zip(starts.tolist(), sizes.tolist(), (ends * CHUNK).tolist(), strict=True):
        filled[end - size : end] = data[start : start + size]
    share = _pairs.take(filled.view(">u2"))
    for move in _moves[:-1]:
        share = move.take(share[::2]) ^ share[1::2]
    most = int(chunks.max(initial=1))
    if len(_far[0]) < most:
        rows = list(_far[0])
        while len(rows) < most + 8:
            rows.append(_moves[-1][rows[-1]])
        _far[0] = np.stack(rows)
    distance = np.repeat(ends, chunks) - 1 - np.arange(len(share))
    return np.bitwise_xor.reduceat(_far[0][distance, 0, share >> 8] ^ _far[0][distance, 1, share & 0xFF], ends - chunks)


def _number(n: int) -> bytes:
    """A frame's number in the header: UTF-8 carried on to 36 bits."""
    if n < 128:
        return bytes([n])
    more, tail = 1, []
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < 1 << (6 - more):
            return bytes([(0xFF << (7 - more)) & 0xFF | n, *reversed(tail)])
        more += 1


@functools.lru_cache(1 << 14)
def _head(number: int, size: int) -> bytes:
    """A frame's header, with its checksum."""
    head = bytes([0xFF, 0xF8, (0xC0 if size == BLOCK else 0x70) | 4, 0x02]) + _number(number) + (b"" if size == BLOCK else (size - 1).to_bytes(2, "big"))
    return head + bytes([crc8(head)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _fitted(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (frames x ORDER, whole numbers) and shift of each frame's linear predictor: autocorrelation, solved by recursion for all frames at once.

    x: the samples, behind ``ORDER`` zeros. Sums are of whole numbers, over runs of ``PAD`` samples (so single precision holds them) and then over frames.
    """
    f = x.astype(np.float32)
    n = len(f) - ORDER
    r = np.empty((ORDER + 1, len(starts)))
    for k in range(ORDER + 1):
        runs = np.einsum("ij,ij->i", f[ORDER:].reshape(-1, PAD), f[ORDER - k : ORDER - k + n].reshape(-1, PAD))
        r[k] = np.add.reduceat(runs.astype(np.float64), starts // PAD)
        for j in range(k):  # but for products with samples of the frame before
            r[k] -= f[ORDER + starts + j] * f[ORDER + starts + j - k]
    error = np.where(r[0] > 0, r[0] * (1 + 1e-9), 1.0)
    a = np.zeros((ORDER, len(starts)))
    for i in range(ORDER):
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / error
        new = a.copy()
        new[i] = k
        for j in range(i):
            new[j] = a[j] - k * a[i - 1 - j]
        a, error = new, np.maximum(error * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(0), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(most)).astype(np.int64), 0, 15)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)), -top - 1, top).astype(np.int64).T, shift


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload of unsigned bytes, whose length must be a positive multiple of ``PAD``."""
    if any(len(p) % PAD or not p for p in payloads):
        raise ValueError(f"payloads are padded to a positive multiple of {PAD} bytes")
    out, some, size = [], [], 0
    for p in payloads:  # so many at once that their arrays stay near the processor
        if some and size + len(p) > ENCODED:
            out += _encode(some)
            some, size = [], 0
        some.append(p)
        size += len(p)
    return out + (_encode(some) if some else [])


def _encode(payloads: list[bytes]) -> list[bytes]:
    data = np.frombuffer(b"".join(payloads), np.uint8)
    lengths = np.array([len(p) for p in payloads], np.int64)
    counts = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.minimum(BLOCK, lengths[owner] - number * BLOCK)
    starts = np.cumsum(sizes) - sizes
    # Frames are whole runs of PAD samples and partitions whole cells of a quarter of that: what is said of these holds for all their samples.
    frame = np.repeat(np.arange(len(sizes)), sizes // PAD)
    cell = PAD >> PARTS
    many = np.repeat(sizes >> PARTS, 1 << PARTS)
    begins = np.cumsum(many) - many
    part = np.repeat(np.arange(len(many)), many // cell)
    first_part = np.arange(len(many)) % (1 << PARTS) == 0
    n = len(data)
    x = np.zeros(ORDER + n, np.int32)
    x[ORDER:] = data
    x[ORDER:] -= 128
    back = [x[ORDER - k : ORDER - k + n] for k in range(ORDER + 1)]  # the samples, and those 1 to ORDER places before
    taps, shift = _fitted(x, starts)
    kinds = [back[0], back[0] - back[1]]
    kinds.append(kinds[1] - back[1] + back[2])
    guess = np.zeros((len(frame), PAD), np.int32)
    for k in range(ORDER):
        guess += taps[frame, k].astype(np.int32)[:, None] * back[k + 1].reshape(-1, PAD)
    guess >>= shift[frame].astype(np.int32)[:, None]
    kinds.append(back[0] - guess.reshape(-1))
    kinds = [_zigzag(r) for r in kinds]
    orders, extra = np.array([0, 1, 2, ORDER]), np.array([0, 0, 0, 9 + ORDER * PRECISION])
    # The kind by the bits that its partitions' means tell, its parameters by the bits themselves: the best of two near the logarithm of the mean.
    guess, means = [], []
    for u, order in zip(kinds, orders.tolist(), strict=True):
        for j in range(order):  # a frame's first samples have no residual
            u[starts + j] = 0
        coded = many - np.where(first_part, order, 0)
        mean = np.maximum(np.add.reduceat(u, begins) / np.maximum(coded, 1), 1e-9)
        means.append(mean)
        guess.append((coded * (1.5 + np.maximum(0, np.log2(mean)))).reshape(-1, 1 << PARTS).sum(1) + 8 * order)
    kind = (np.stack(guess) + extra[:, None]).argmin(0)
    order, more = orders[kind], extra[kind]
    u = kinds[3].reshape(-1, PAD)
    for c in range(3):
        runs = np.flatnonzero(kind[frame] == c)
        u[runs] = kinds[c].reshape(-1, PAD)[runs]
    u = u.reshape(-1, cell)
    coded = many - np.where(first_part, np.repeat(order, 1 << PARTS), 0)
    best = np.clip(np.floor(np.log2(np.stack(means)[np.repeat(kind, 1 << PARTS), np.arange(len(begins))])), 0, 13).astype(np.int64)
    tries = np.stack([np.clip(best + d, 0, 14) for d in (-1, 0)])
    tops = [u >> k.astype(np.int32)[part][:, None] for k in tries]
    bits = np.stack([np.add.reduceat(t.reshape(-1), begins) + coded * (k + 1) for t, k in zip(tops, tries, strict=True)])  # samples without a residual have 0
    which = bits.argmin(0)
    rice = tries[which, np.arange(len(begins))]
    cost = bits.min(0).reshape(-1, 1 << PARTS).sum(1) + 6 + (4 << PARTS) + 8 * order + more
    plain = cost >= 8 * sizes
    body = np.where(plain, 1 + sizes, 1 - (-cost // 8))
    heads = [_head(*h) for h in zip(number.tolist(), sizes.tolist(), strict=True)]
    wide = np.array([len(h) for h in heads], np.int64)
    whole = wide + body + 2
    at = np.cumsum(whole) - whole  # where a frame begins
    lead = at + wide + 1 + order  # behind the subframe's first byte and first samples
    # Each residual's code: as many bits 0 as its top says, a bit 1, and its low bits. Codes are added up in words, where their bits never meet.
    k = rice.astype(np.int32)[part][:, None]
    top = np.where(which[part][:, None] == 0, tops[0], tops[1])
    code = (u - ((top - 1) << k)).reshape(-1)
    long = (top + (k + 1)).reshape(-1)
    for j in range(ORDER):
        none = starts[order > j] + j
        code[none], long[none] = 0, 0
    lost = np.flatnonzero(plain[frame])
    code.reshape(-1, PAD)[lost], long.reshape(-1, PAD)[lost] = 0, 0
    opens = np.where(first_part, begins + np.repeat(order, 1 << PARTS), begins)  # the first residual of a partition follows its parameter
    opened = np.flatnonzero(np.repeat(~plain, 1 << PARTS))
    long[opens[opened]] += 4
    end = np.cumsum(long, dtype=np.int64)
    before = end[opens] - long[opens]
    begun = end[starts] - long[starts]
    end.reshape(-1, PAD)[:] += (8 * lead + more + 6 - begun)[frame][:, None]
    words = np.zeros(-(-int(whole.sum()) // 4) + 1, np.int64)

    def write(end: np.ndarray, value: np.ndarray) -> None:
        last = (end - 1) >> 5
        value = value.astype(np.int64) << (-end & 31)
        words[:] += np.bincount(last, value & 0xFFFFFFFF, len(words)).astype(np.int64)
        over = np.flatnonzero(value >> 32)
        words[last[over] - 1] += value[over] >> 32  # one code at most crosses an edge

    write(end, code)
    write((before + np.repeat(8 * lead + more + 6 - begun, 1 << PARTS))[opened] + 4, rice[opened])
    out = words.astype(">u4").view(np.uint8)
    # Two bits of method (0) and the number of partitions; in front of these a fitted predictor's precision, shift and coefficients.
    own = np.flatnonzero(~plain & (kind == 3))
    fields = (PRECISION - 1) << 5 | shift[own]
    for j in range(ORDER):
        fields = fields << PRECISION | taps[own, j] & ((1 << PRECISION) - 1)
    fields, size = fields << 6 | PARTS, int(extra[3]) + 6
    for j in range(-(-size // 8)):
        out[lead[own] + j] |= (fields << (-size % 8) >> (8 * (-(-size // 8) - 1 - j)) & 0xFF).astype(np.uint8)
    fixed = np.flatnonzero(~plain & (kind < 3))
    out[lead[fixed]] |= PARTS << 2
    out[at + wide] = np.where(plain, 0x02, np.where(kind == 3, 32 + ORDER - 1, 8 + order) << 1)
    signed = data ^ 0x80
    for j in range(ORDER):
        some = np.flatnonzero(~plain & (order > j))
        out[(at + wide + 1)[some] + j] = signed[starts[some] + j]
    for f in np.flatnonzero(plain).tolist():
        begin = int(at[f] + wide[f]) + 1
        out[begin : begin + int(sizes[f])] = signed[starts[f] : starts[f] + sizes[f]]
    heads_at = np.repeat(at, wide) + np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
    out[heads_at] = np.frombuffer(b"".join(heads), np.uint8)
    checks = crc16(out, at, whole - 2)
    out[at + whole - 2], out[at + whole - 1] = checks >> 8, checks & 0xFF
    streams, signed = [], signed.tobytes()
    done = np.cumsum(lengths) - lengths
    firsts = np.cumsum(counts) - counts
    for i in range(len(payloads)):
        f, c = int(firsts[i]), int(counts[i])
        mine, begin = whole[f : f + c], int(at[f])
        info = BLOCK.to_bytes(2, "big") * 2 + int(mine.min()).to_bytes(3, "big") + int(mine.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | int(lengths[i])).to_bytes(8, "big") + hashlib.md5(signed[done[i] : done[i] + lengths[i]]).digest()
        points = b"".join((j * BLOCK).to_bytes(8, "big") + (int(at[f + j]) - begin).to_bytes(8, "big") + int(sizes[f + j]).to_bytes(2, "big") for j in range(c))
        streams.append(b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + out[begin : begin + int(mine.sum())].tobytes())
    return streams


class _Frame:
    __slots__ = ("stream", "at", "end", "first", "size", "order", "shift", "taps", "warm", "bits", "plain", "pcm")


def _header(stream: int, data: bytes, at: int, base: int) -> tuple[_Frame, int, int]:
    """The frame whose header stands at ``at``, its number, and where its subframe begins."""
    f = _Frame()
    if data[at : at + 2] != b"\xff\xf8":
        raise ValueError("no frame where one should begin")
    code, lead = data[at + 2] >> 4, data[at + 4]
    n, j = lead, at + 5
    if lead >= 0xC0:
        more = 8 - (~lead & 0xFF).bit_length() - 1
        n = lead & (0x3F >> more)
        for b in data[j : j + more]:
            n = n << 6 | b & 0x3F
        j += more
    extra = {6: 1, 7: 2}.get(code, 0)
    f.size = int.from_bytes(data[j : j + extra], "big") + 1 if extra else 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    j += extra
    if crc8(data[at:j]) != data[j]:
        raise ValueError("a frame header's checksum is wrong")
    f.stream, f.at = stream, base + at
    return f, n, j + 1


def _signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> (bits - 1) else value


def _by_sync(stream: int, data: bytes, at: int, base: int) -> list[tuple[int, int]]:
    """Place and end of each frame from ``at`` on: the next one begins where a sync code, the next number, and both checksums are right."""
    out, number, buffer = [], 0, np.frombuffer(data, np.uint8)
    while at < len(data):
        _header(stream, data, at, base)
        end = data.find(b"\xff\xf8", at + 2)
        while end >= 0:
            try:
                fits = _header(stream, data, end, base)[1] == number + 1
            except (ValueError, IndexError):
                fits = False
            if fits and int(crc16(buffer, np.array([at]), np.array([end - at - 2]))[0]) == int.from_bytes(data[end - 2 : end], "big"):
                break
            end = data.find(b"\xff\xf8", end + 1)
        out.append((at, end if end >= 0 else len(data)))
        at, number = out[-1][1], number + 1
    return out


def decode(streams: list[bytes]) -> list[list[tuple[int, int, bytes]]]:
    """For each stream its blocks: number of the first sample, place of the frame in the stream, and samples as signed bytes."""
    frames, base, infos = [], 0, []
    joined = b"".join(streams) + bytes(8)
    for s, data in enumerate(streams):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, points, info, last = 4, [], b"", False
        while not last:
            if at + 4 > len(data):
                raise ValueError("a stream ends within its metadata")
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + size]
            info = block if kind == 0 else info
            if kind == 3:
                points = [(int.from_bytes(block[p : p + 8], "big"), int.from_bytes(block[p + 8 : p + 16], "big"), int.from_bytes(block[p + 16 : p + 18], "big")) for p in range(0, size, 18)]
            at += 4 + size
        infos.append(info)
        samples, reached = int.from_bytes(info[10:18], "big") & ((1 << 36) - 1), 0
        for first, _, size in points:
            reached = reached + size if first == reached else -1
        if points and reached == samples:
            places = [at + p for _, p, _ in points]
            spots = list(zip(places, [*places[1:], len(data)], strict=True))
        else:
            spots = _by_sync(s, data, at, base)
        first = 0
        for p, e in spots:
            f, _, j = _header(s, data, p, base)
            f.first, f.end, kind = first, base + e, data[j]
            first += f.size
            j += 1
            f.order, f.shift, f.taps, f.warm, f.plain = 0, 0, (), b"", None
            code = kind >> 1
            if kind & 0x81:
                raise ValueError("a subframe of a kind that isn't supported")
            if code < 2:
                f.plain, width = (data[j : j + f.size], f.size) if code else (data[j : j + 1] * f.size, 1)
                if j + width + 2 != e:
                    raise ValueError("a frame doesn't end where its samples do")
            elif 8 <= code <= 12:
                f.order, f.taps = code - 8, FIXED[code - 8]
                f.warm, j = data[j : j + f.order], j + f.order
                f.bits = (base + j) * 8
            elif code >= 32:
                f.order = code - 31
                f.warm, j = data[j : j + f.order], j + f.order
                width = (data[j] >> 4) + 1
                value, total = int.from_bytes(data[j : j + 2 + (f.order * width + 14) // 8], "big"), 8 * (2 + (f.order * width + 14) // 8)
                f.shift = _signed(value >> (total - 9) & 31, 5)
                f.taps = tuple(_signed(value >> (total - 9 - (i + 1) * width) & ((1 << width) - 1), width) for i in range(f.order))
                f.bits = (base + j) * 8 + 9 + f.order * width
            else:
                raise ValueError("a subframe of a kind that isn't supported")
            frames.append(f)
        base += len(data)
    buffer = np.frombuffer(joined, np.uint8)
    if frames:
        starts, ends = np.array([f.at for f in frames]), np.array([f.end for f in frames])
        if (ends - starts < 8).any() or (crc16(buffer, starts, ends - starts - 2) != buffer[ends - 2].astype(np.uint16) << 8 | buffer[ends - 1]).any():
            raise ValueError("a frame's checksum is wrong")
    _samples(buffer, [f for f in frames if f.plain is None])
    out: list[list[tuple[int, int, bytes]]] = [[] for _ in streams]
    begins = np.cumsum([0, *(len(x) for x in streams)])
    for f in frames:
        out[f.stream].append((f.first, f.at - int(begins[f.stream]), f.plain if f.plain is not None else f.pcm))
    for info, blocks in zip(infos, out, strict=True):
        if hashlib.md5(b"".join(b[2] for b in blocks)).digest() != info[18:34]:
            raise ValueError("the samples' MD5 is wrong")
    return out


def _zeros(buffer: np.ndarray) -> np.ndarray:
    """How many bits 0 stand in ``buffer`` from each bit on, before the next bit 1 (or the end)."""
    last = np.append(buffer[1:], np.uint8(0))
    out = _leading.take(buffer.astype(np.int32) << 8 | last).view(np.uint8)
    rare = np.flatnonzero(last == 0)  # the next bit 1 may be farther away than the next byte
    if len(rare):
        nonzero = np.flatnonzero(buffer)
        near = np.searchsorted(nonzero, rare + 1)
        to = np.append(nonzero, len(buffer))[near]
        rest = 8 * (to - rare) + np.append(_first[buffer[nonzero]], 0)[near]
        places = np.arange(8)
        own = _leading[buffer[rare].astype(np.int32) << 8].view(np.uint8).reshape(-1, 8)
        far = np.where(places + own < 8, own, rest[:, None] - places)
        if int(far.max()) > 255:
            out = out.astype(np.int32)
        out.reshape(-1, 8)[rare] = far
    return out


def _rice(buffer: np.ndarray, frames: list[_Frame]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The residuals of all frames (longest first) and, of each place, how many frames reach it and where its residuals begin.

    Frames are followed side by side, a sample of each at a time. Only where codes begin is found in this way, by the number of bits 0 from there
    on; values are read from all codes at once. A frame's first samples, which have no residual, count as 0.
    """
    size, order = np.array([f.size for f in frames]), np.array([f.order for f in frames])
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    row = np.concatenate([[0], np.cumsum(live)])
    zeros = _zeros(buffer)
    # The 64 bits from each byte on.
    window = np.ndarray((len(buffer),), ">u8", np.concatenate([buffer, np.zeros(8, np.uint8)]), strides=(1,)).astype(np.uint64)

    def read(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (window.take(at >> 3, mode="clip") << (at & 7).astype(np.uint64) >> (64 - n).astype(np.uint64)).astype(np.int64)

    at = np.array([f.bits for f in frames], np.int64)
    head = read(at, np.full(len(at), 6))
    if (head >> 5).any():
        raise ValueError("residuals of a kind that isn't supported")
    width = 4 + (head >> 4)  # bits of a partition's parameter
    part = size >> (head & 15)
    if (part < np.maximum(order, 1)).any():
        raise ValueError("a partition is shorter than its predictor's order")
    at += 6
    skip, rice8, raw = np.ones(len(at), np.int64), np.zeros(len(at), np.uint8), np.full(len(at), -1)
    due_at, begun, upcoming, any_raw, most = order.copy(), np.zeros(len(at), np.int64), int(order.min()), False, int(order.max())
    starts, tops, rices = np.empty(row[-1], np.int64), np.empty(row[-1], zeros.dtype), np.empty(row[-1], np.uint8)
    exact: list[tuple[np.ndarray, np.ndarray]] = []
    bounds, counts = row.tolist(), live.tolist()
    for i, n in enumerate(counts):
        while i == upcoming:  # partitions that begin here
            due = np.flatnonzero(due_at[:n] == i)
            if len(due):
                rice = read(at[due], width[due])
                at[due] += width[due]
                escape = rice == (1 << width[due]) - 1
                raw[due] = -1
                if escape.any():
                    plain = due[escape]
                    raw[plain] = read(at[plain], np.full(len(plain), 5))
                    at[plain] += 5
                    rice[escape] = 0
                rice8[due] = rice
                skip[due] = rice + 1
                begun[due] += 1
                due_at[due] = begun[due] * part[due]
                any_raw = bool((raw[:n] >= 0).any())
            upcoming = int(due_at[:n].min())
        lo, hi = bounds[i], bounds[i + 1]
        a, top = starts[lo:hi], tops[lo:hi]
        a[:] = at[:n]
        zeros.take(a, out=top, mode="clip")
        rices[lo:hi] = rice8[:n]
        new = at[:n]
        if i < most or any_raw:
            step = top + skip[:n]
            if any_raw:
                plain = np.flatnonzero((raw[:n] >= 0) & (order[:n] <= i))
                w = raw[plain]
                v = np.where(w > 0, read(a[plain], np.maximum(w, 1)), 0)
                exact.append((lo + plain, v - ((v >> np.maximum(w - 1, 0) & 1) << w)))
                step[plain] = w
            step[order[:n] > i] = 0
            new += step
        else:
            new += top
            new += skip[:n]
    if (-(-at // 8) + 2 != np.array([f.end for f in frames])).any():
        raise ValueError("a frame doesn't end where its residuals do")
    values = np.empty(len(starts), np.int32)
    for lo in range(0, len(starts), 1 << 16):
        a, top, k = starts[lo : lo + (1 << 16)], tops[lo : lo + (1 << 16)].astype(np.int64), rices[lo : lo + (1 << 16)]
        a += top  # the bit 1 that ends the top, and the low bits behind it
        low = window.take(a >> 3, mode="clip") << (a & 7).astype(np.uint64) >> (np.uint8(63) - k).astype(np.uint64)
        u = ((top - 1) << k) + low.astype(np.int64)
        values[lo : lo + (1 << 16)] = (u >> 1) ^ -(u & 1)
    for where, v in exact:
        values[where] = v
    return values, row, counts


def _samples(buffer: np.ndarray, frames: list[_Frame]) -> None:
    """The samples of all frames, side by side: what the predictor says of those before, plus the residual."""
    if not frames:
        return
    frames = sorted(frames, key=lambda f: -f.size)
    residuals, row, live = _rice(buffer, frames)
    order, shift = np.array([f.order for f in frames]), np.array([f.shift for f in frames], np.int32)
    most = max(1, int(order.max()))
    x = np.zeros((most + len(live), len(frames)), np.int32)  # each frame's first sample stands at row ``most``; untouched rows take no memory
    taps, warm = np.zeros((most, len(frames)), np.int32), np.zeros((most, len(frames)), np.int32)
    for j, f in enumerate(frames):
        if f.order:
            warm[: f.order, j] = np.frombuffer(f.warm, np.int8)
            taps[most - f.order :, j] = f.taps[::-1]
    product, total, bounds, n = np.empty_like(taps), np.empty(len(frames), np.int32), row.tolist(), -1
    for i, k in enumerate(live):
        if k != n:
            n, own, by, products, totals = k, taps[:, :k], shift[:k], product[:, :k], total[:k]
        np.multiply(x[i : i + most, :k], own, out=products)
        np.add.reduce(products, 0, out=totals)
        np.right_shift(totals, by, out=totals)
        np.add(totals, residuals[bounds[i] : bounds[i + 1]], out=x[most + i, :k])
        if i < most:
            x[most + i, :k] = np.where(order[:k] > i, warm[i, :k], x[most + i, :k])
    for lo in range(0, len(frames), 64):
        some = frames[lo : lo + 64]
        turned = np.ascontiguousarray(x[most : most + some[0].size, lo : lo + 64].astype(np.int8).T)
        for f, samples in zip(some, turned, strict=True):
            f.pcm = samples[: f.size].tobytes()


def payload_of(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of ``PAD``."""
    return data + bytes(-len(data) % PAD or (0 if data else PAD))


def feature(pcm: np.ndarray) -> str:
    """Energy, sign changes and peak of the samples, as integers."""
    x, below = pcm.astype(np.float64), pcm < 0
    energy, crossings = np.einsum("i,i->", x, x), np.count_nonzero(below[1:] != below[:-1])  # whole numbers, which double precision holds up to 2 ** 39 samples
    return f"energy={int(energy)};crossings={crossings};peak={max(int(pcm.max(initial=0)), -int(pcm.min(initial=0)))}"


def to_media(rows: DataFrame, data: str = "data", out: str = "media") -> DataFrame:
    """``rows`` with a column of streams in place of a column of bytes (padded as said)."""
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name not in (data, out)]

    def run(batches):
        for b in _common.slices(batches, data):
            got = encode([payload_of(x or b"") for x in b.column(data).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in kinds), pa.array(got, pa.binary())], names=[*(n for n, _ in kinds), out])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*kinds, (out, "binary")]))


def pcm_blocks(rows: DataFrame, media: str = "media") -> DataFrame:
    """A row for each block of each stream: block, first_sample, stream_offset (where its frame begins) and pcm (signed bytes)."""
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name != media]

    def run(batches):
        for b in _common.slices(batches, media):
            got = decode([x for x in b.column(media).to_pylist() if x is not None])
            known = np.flatnonzero(b.column(media).is_valid().to_numpy(zero_copy_only=False))
            at = pa.array(np.repeat(known, [len(x) for x in got]), pa.int64())
            flat = [(i, *y) for x in got for i, y in enumerate(x)]
            columns = [pa.array([y[c] for y in flat], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n, _ in kinds), *columns], names=[*(n for n, _ in kinds), "block", "first_sample", "stream_offset", "pcm"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*kinds, ("block", "int"), ("first_sample", "bigint"), ("stream_offset", "bigint"), ("pcm", "binary")]))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: sizes and digests of the payload, as read back from its stream, and of the stream, the samples' feature, and where each block can be sought.

    ``to_media`` writes a column of streams; what reads it back is what ``pcm_blocks`` uses. Both follow one another in a task, without a shuffle.
    """
    names = [c.split()[0] for c in FEATURES.split(", ")]
    block = pa.list_(pa.struct([("first_sample", pa.int64()), ("stream_offset", pa.int64()), ("samples", pa.int32())]))

    @_common.task
    def run(batches):
        for b in _common.slices(batches, "media"):
            streams, rows = b.column("media").to_pylist(), []
            for stream, blocks in zip(streams, decode(streams), strict=True):
                pcm = np.frombuffer(b"".join(y[2] for y in blocks), np.int8)
                payload = (pcm.view(np.uint8) ^ 0x80).tobytes()
                places = [{"first_sample": f, "stream_offset": at, "samples": len(x)} for f, at, x in blocks]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(pcm), places))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), block)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), data.alias("data"))
    return to_media(slim).select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
