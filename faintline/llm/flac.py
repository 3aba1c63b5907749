"""FLAC media column: mono 8-bit streams with fixed or LPC predictors, Rice residuals and a seek table.

``encode`` turns texts into streams; ``decode`` reads streams back, checks every frame (CRC-8, CRC-16) and the
whole (MD5), and gives PCM blocks with the sample they start at; ``samples`` reads any range of samples through the
seek table, decoding only the frames it lies in. Inside a task the frames of many rows are
coded side by side: step i handles sample i of every frame at once, so numpy does the work.

Defined results: null text is empty; a payload is the text's UTF-8 bytes, filled with spaces to a positive
multiple of 192, each byte a sample (less 128); equal texts give equal streams; texts of any length are handled
frame by frame; an empty table gives no rows; a damaged stream raises ``FlacError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintline.llm.common import slices

# Fixed values of the format: sync word and header of a mono 16 kHz 8-bit frame with a 16-bit block size; fixed predictors.
_SYNC = b"\xff\xf8\x75\x02"
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_RATE = 16_000
BLOCK, UNIT = 4096, 192
_ORDER, _PRECISION = 4, 12  # of the encoder's own predictors
_CHUNK = 256  # frames coded side by side by the encoder
_WIDE = 2048  # and by the decoder


class FlacError(ValueError):
    """A stream that breaks the format or fails a checksum."""


def _table(poly: int, bits: int, width: int) -> np.ndarray:
    """Remainders of all values of ``width`` bits."""
    crc = np.arange(1 << width, dtype=np.uint32) << (bits - width if bits > width else 0)
    for _ in range(width):
        crc = np.where(crc >> (bits - 1) & 1, crc << 1 ^ poly, crc << 1) & ((1 << bits) - 1)
    return crc.astype(np.uint16)


_CRC8 = _table(0x07, 8, 8).tolist()
_CRC16 = _table(0x8005, 16, 16)  # two bytes at a time


def _crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def _crc16(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of each buf[start : start + size], all side by side."""
    order = np.argsort(-size, kind="stable")
    at, pairs, odd = start[order], size[order] // 2, size[order] % 2
    crc = np.zeros(len(size), np.uint16)
    alive = np.searchsorted(-pairs, -np.arange(1, int(pairs.max(initial=0)) + 1), side="right")
    pos = at.copy()
    for m in alive.tolist():
        p = pos[:m]
        crc[:m] = _CRC16[crc[:m] ^ (buf[p].astype(np.uint16) << 8 | buf[p + 1])]
        pos[:m] += 2
    if odd.any():
        k = np.flatnonzero(odd)
        one = crc[k] >> 8 ^ buf[pos[k]]
        crc[k] = (crc[k] << 8) ^ _CRC16[one]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    lead = (0xFF << (8 - size)) & 0xFF
    return bytes([lead | n >> 6 * (size - 1)] + [0x80 | n >> 6 * k & 0x3F for k in range(size - 2, -1, -1)])


# ---------------------------------------------------------------- encoding


def _predictors(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of each frame, from its autocorrelation by Levinson's recursion."""
    r = np.empty((_ORDER + 1, len(size)))
    wide = x.astype(np.float64)
    for lag in range(_ORDER + 1):
        product = wide * np.concatenate([np.zeros(lag), wide[: len(wide) - lag]])
        for k in range(lag):
            product[np.minimum(start + k, len(x) - 1)] = 0
        r[lag] = np.add.reduceat(product, start)
    error, a = r[0] * (1 + 1e-9) + 1e-9, np.zeros((_ORDER, len(size)))
    for i in range(_ORDER):
        k = (r[i + 1] - sum((a[j] * r[i - j] for j in range(i)), np.zeros(len(size)))) / error
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.abs(a).max(axis=0)
    shift = np.clip(_PRECISION - 2 - np.floor(np.log2(np.maximum(top, 1e-6))).astype(np.int64) - 0, 0, 15)
    coef = np.clip(np.rint(a * (1 << shift)), -(1 << (_PRECISION - 1)), (1 << (_PRECISION - 1)) - 1).astype(np.int64)
    return coef, shift


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = value >> (width - 1 - b) & 1


def _zigzag(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 31)


def encode_frames(frames: list[tuple[int, np.ndarray]]) -> list[bytes]:
    """The bytes of each frame (number, samples as int8), the cheapest predictor of five each."""
    size = np.array([len(s) for _, s in frames], np.int64)
    start = np.cumsum(size) - size
    x = np.concatenate([s for _, s in frames]).astype(np.int32)
    inside = np.arange(len(x)) - np.repeat(start, size)
    coef, shift = _predictors(x, start, size)

    lag = lambda j: np.concatenate([np.zeros(j, np.int32), x[: len(x) - j]])
    kinds: list[tuple[int, np.ndarray]] = []
    for taps in _FIXED[:3]:
        kinds.append((len(taps), _zigzag(x - sum((c * lag(j + 1) for j, c in enumerate(taps)), np.int32(0)))))
    guess = sum(np.repeat(coef[j].astype(np.int32), size) * lag(j + 1) for j in range(_ORDER)) >> np.repeat(shift.astype(np.int32), size)
    kinds.append((_ORDER, _zigzag(x - guess)))

    cost, rice = [], []
    for order, u in kinds:
        u[inside < order] = 0
        total, n = np.add.reduceat(u, start, dtype=np.int64), np.maximum(size - order, 1)
        best = np.full(len(size), np.iinfo(np.int64).max)
        which = np.zeros(len(size), np.int64)
        k0 = np.clip(np.floor(np.log2(np.maximum(total / n, 1))).astype(np.int64), 0, 14)
        for k in (k0, np.maximum(k0 - 1, 0)):
            now = n * (1 + k) + np.add.reduceat(u >> np.repeat(k.astype(np.int32), size), start, dtype=np.int64)
            which, best = np.where(now < best, k, which), np.minimum(now, best)
        extra = 8 * order + 18 + (9 + _ORDER * _PRECISION) * (len(cost) == 3)
        cost.append(np.where(size > order, best + extra, np.iinfo(np.int64).max))
        rice.append(which)
    cost.append(8 * size + 8)
    low, high = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
    cost.append(np.where(low == high, 0, np.iinfo(np.int64).max))
    pick = np.argmin(cost, axis=0)

    order = np.array([0, 1, 2, _ORDER, 0, 0])[pick]
    k = np.where(pick < 4, np.array(rice)[np.minimum(pick, 3), np.arange(len(size))], 0)
    u = np.choose(np.repeat(np.minimum(pick, 3), size), [u for _, u in kinds])
    heads = []
    for (number, _), n in zip(frames, size.tolist(), strict=True):
        head = _SYNC + _number(number) + struct.pack(">H", n - 1)
        heads.append(head + bytes([_crc8(head)]))
    head_bits = np.array([8 * len(h) for h in heads], np.int64)
    lpc, coded, plain = pick == 3, pick < 4, pick == 4
    before = 8 + 8 * order + np.where(lpc, 9 + _ORDER * _PRECISION, 0) + np.where(coded, 10, 0)  # bits of a subframe up to its codes
    code = np.where((inside >= np.repeat(order, size)) & np.repeat(coded, size), (u >> np.repeat(k, size)) + 1 + np.repeat(k, size), 0)
    body = before + np.where(coded, np.add.reduceat(code, start), np.where(plain, 8 * size, 8))
    total = (head_bits + body + 7) // 8 * 8 + 16
    base = np.cumsum(total) - total
    bits = np.zeros(int(total.sum()), np.uint8)

    sub = base + head_bits
    _put(bits, sub, np.select([pick < 3, lpc, plain], [(8 + order) << 1, np.full(len(size), (32 + _ORDER - 1) << 1), np.full(len(size), 2)], 0), 8)
    for j in range(_ORDER):  # warm-up samples
        f = np.flatnonzero(order > j)
        _put(bits, sub[f] + 8 + 8 * j, x[start[f] + j] & 255, 8)
    f = np.flatnonzero(lpc)
    at = sub[f] + 8 + 8 * _ORDER
    _put(bits, at, np.full(len(f), _PRECISION - 1), 4)
    _put(bits, at + 4, shift[f], 5)
    for j in range(_ORDER):
        _put(bits, at + 9 + _PRECISION * j, coef[j][f] & ((1 << _PRECISION) - 1), _PRECISION)
    f = np.flatnonzero(coded)
    _put(bits, (sub + before)[f] - 4, k[f], 4)  # method and partition order are zero bits
    f = np.flatnonzero(pick == 5)
    _put(bits, sub[f] + 8, x[start[f]] & 255, 8)
    s = np.flatnonzero(np.repeat(plain, size))
    _put(bits, np.repeat(sub + 8, size)[s] + 8 * inside[s], x[s] & 255, 8)
    s = np.flatnonzero(code)
    c, us, ks = code[s], u[s], np.repeat(k, size)[s]
    run = np.cumsum(code) - code
    end = np.repeat(sub + before - run[start], size)[s] + run[s] + c  # where each code ends
    bits[end - 1 - ks] = 1
    for j in range(int(ks.max(initial=0))):
        bits[(end - 1 - j)[ks > j]] = (us[ks > j] >> j) & 1

    out = np.packbits(bits)
    first, length = base // 8, total // 8
    for b, h in zip(first.tolist(), heads, strict=True):
        out[b : b + len(h)] = np.frombuffer(h, np.uint8)
    crc = _crc16(out, first, length - 2)
    out[first + length - 2], out[first + length - 1] = crc >> 8, crc & 255
    data = out.tobytes()
    return [data[b : b + n] for b, n in zip(first.tolist(), length.tolist(), strict=True)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    signed = (np.frombuffer(payload, np.uint8) - np.uint8(128)).tobytes()
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (_RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    points, at = [], 0
    for i, f in enumerate(frames):
        points.append(struct.pack(">QQH", i * BLOCK, at, min(BLOCK, len(payload) - i * BLOCK)))
        at += len(f)
    seek = b"".join(points)
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


def encode_payloads(payloads: Iterable[bytes]) -> list[bytes]:
    payloads = list(payloads)
    frames = [(i, k) for i, p in enumerate(payloads) for k in range(0, len(p), BLOCK)]
    done: list[list[bytes]] = [[] for _ in payloads]
    for at in range(0, len(frames), _CHUNK):
        part = frames[at : at + _CHUNK]
        raw = [(k // BLOCK, (np.frombuffer(payloads[i], np.uint8, min(BLOCK, len(payloads[i]) - k), k) - np.uint8(128)).view(np.int8)) for i, k in part]
        for (i, _), data in zip(part, encode_frames(raw), strict=True):
            done[i].append(data)
    return [_stream(p, d) for p, d in zip(payloads, done, strict=True)]


# ---------------------------------------------------------------- decoding


class _Bits:
    """Bit by bit reading, for what the side-by-side decoder leaves."""

    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise FlacError("a frame ends too early")
        return self.value >> self.left & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def decode_frame(data: bytes, start: int, n: int) -> tuple[list[int], int]:
    """Samples of one mono 8-bit frame whose subframe starts at byte ``start``, and the byte after it; any subframe kind."""
    bits = _Bits(data[start:])
    if bits.take(1):
        raise FlacError("a subframe starts wrongly")
    kind, wasted = bits.take(6), bits.take(1)
    wasted = wasted and bits.unary() + 1
    depth = 8 - wasted
    if kind == 0:
        out = [bits.signed(depth)] * n
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        taps, shift = _FIXED[order] if kind <= 12 else (), 0
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            taps = [bits.signed(precision) for _ in range(order)]
        wide, parts = 4 + bits.take(2), bits.take(4)
        if wide > 5 or (parts and n % (1 << parts)):
            raise FlacError("a residual is coded in an unknown way")
        for p in range(1 << parts):
            k = bits.take(wide)
            raw = bits.take(5) if k == (1 << wide) - 1 else None
            for _ in range((n >> parts) - order * (p == 0)):
                if raw is None:
                    u = bits.unary() << k
                    u |= bits.take(k) if k else 0
                    e = u >> 1 ^ -(u & 1)
                else:
                    e = bits.signed(raw)
                out.append(e + (sum(c * out[-1 - j] for j, c in enumerate(taps)) >> shift))
    else:
        raise FlacError("a subframe is of an unknown kind")
    return [v << wasted for v in out], len(data) - bits.left // 8


def _headers(buf: bytes, at: int) -> tuple[int, int, int]:
    """(number, samples, start of the subframe) of the frame at ``at``."""
    if buf[at : at + 4] != _SYNC:
        raise FlacError("no mono 8-bit frame with a 16-bit block size here")
    lead = buf[at + 4]
    more = 0 if lead < 0x80 else next(k for k in range(1, 8) if not lead >> (6 - k) & 1)
    number = lead & (0x7F if not more else (1 << (6 - more)) - 1)
    for b in buf[at + 5 : at + 5 + more]:
        number = number << 6 | b & 0x3F
    end = at + 7 + more
    n = struct.unpack_from(">H", buf, end - 2)[0] + 1
    if _crc8(buf[at:end]) != buf[end]:
        raise FlacError("a frame header fails its CRC-8")
    return number, n, end + 1


def _side_by_side(buf: np.ndarray, raw: bytes, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples by step and frame, byte after each subframe); n in descending order. Frames left over: end -1."""
    width, steps = len(n), int(n[0])
    kind = buf[begin] >> 1
    usable = (buf[begin] & 1 == 0) & (((kind >= 8) & (kind <= 12)) | (kind >= 32))
    order = np.where(kind >= 32, kind.astype(np.int64) - 31, kind.astype(np.int64) - 8) * usable
    usable &= order <= 12
    order *= usable
    out = np.zeros((steps + 13, width), np.int32)  # thirteen rows of zeros before the samples
    # big-endian windows of eight bytes at every byte
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    window = np.zeros(len(buf) + 1, np.uint64)
    for b in range(8):
        window |= pad[b : b + len(buf) + 1].astype(np.uint64) << np.uint64(56 - 8 * b)
    last = len(buf)

    def take(pos: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = window[np.minimum(pos >> 3, last)] << (pos & 7).astype(np.uint64)
        return (w >> np.uint64(1) >> (63 - count).astype(np.uint64)).astype(np.int64)

    pos = 8 * (begin.astype(np.int64) + 1)
    coef, shift = np.zeros((12, width), np.int32), np.zeros(width, np.int32)
    precision = np.zeros(width, np.int64)
    for j in range(12):
        f = np.flatnonzero(order > j)
        v = take(pos[f], np.full(len(f), 8))
        out[13 + j, f] = v - ((v & 128) << 1)
        pos[f] += 8
    f = np.flatnonzero(usable & (kind >= 32))
    precision[f] = take(pos[f], np.full(len(f), 4)) + 1
    shift[f] = take(pos[f] + 4, np.full(len(f), 5))
    usable[f] &= shift[f] < 16  # a negative shift is left to the other decoder
    shift = np.where(usable, shift, 0)
    pos[f] += 9
    for j in range(12):
        g = f[order[f] > j]
        v = take(pos[g], precision[g])
        coef[j, g] = v - ((v >> (precision[g] - 1)) << precision[g])
        pos[g] += precision[g]
    for o, taps in enumerate(_FIXED):
        for j, c in enumerate(taps):
            coef[j, (kind == 8 + o) & usable] = c
    method, parts = take(pos, np.full(width, 2)), take(pos + 2, np.full(width, 4))
    usable &= (method < 2) & (n % (1 << parts) == 0)
    wide = 4 + method
    pos += 6
    span = n >> parts
    k, next_part = np.zeros(width, np.int64), np.where(usable, 0, steps + 1)
    most = int(order.max(initial=0))
    rows = np.ascontiguousarray(coef[:most])
    alive = np.searchsorted(-n, -np.arange(steps), side="left")
    one = np.uint64(1)
    due = 0
    for i in range(steps):
        m = int(alive[i])
        if i >= due:  # parameters of the partitions that begin here
            f = np.flatnonzero(next_part[:m] == i)
            k[f] = take(pos[f], wide[f])
            pos[f] += wide[f]
            usable[f] &= k[f] < (1 << wide[f]) - 1
            next_part[f] += span[f]
            due = int(next_part[:m].min(initial=steps))
        p = pos[:m]
        w = window[np.minimum(p >> 3, last)] << (p & 7).astype(np.uint64)
        zeros = 1075 - ((w >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52)  # leading zeros of the top 53 bits
        q = np.minimum(zeros, 53)
        kk = k[:m]
        low = (w << (q + 1).astype(np.uint64) >> one >> (63 - kk).astype(np.uint64)).astype(np.int64)
        u = q << kk | low
        wrong = (q > 52) | (q + 1 + kk > 56)
        e = (u >> 1 ^ -(u & 1)).astype(np.int32)
        coded = (i >= order[:m]) & usable[:m]
        if wrong.any():
            usable[:m] &= ~(wrong & coded)
        pos[:m] = p + np.where(coded, q + 1 + kk, 0)
        if most:
            e = e + ((rows[:, :m] * out[12 + i : 12 + i - most : -1, :m]).sum(axis=0, dtype=np.int32) >> shift[:m])
        out[13 + i, :m] = np.where(coded, e, out[13 + i, :m])
    return out[13:], np.where(usable, (pos + 7) // 8, -1)


def _layout(data: bytes) -> tuple[int, bytes, list[tuple[int, int, int, int]]]:
    """(samples, MD5, (first sample, first byte, end, samples) of every frame) of a stream, from its metadata."""
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, seek = 4, False, b""
    info = b""
    while not last:
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        info, seek = (body if kind == 0 else info), (body if kind == 3 else seek)
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 36 & 31 != 7 or packed >> 41 & 7:
        raise FlacError("not mono with 8 bits")
    total = packed & ((1 << 36) - 1)
    points = [p for p in struct.iter_unpack(">QQH", seek) if p[0] != (1 << 64) - 1]
    if sum(p[2] for p in points) != total:
        raise FlacError("the seek table doesn't list every frame")
    ends = [at + p[1] for p in points[1:]] + [len(data)]
    return total, info[18:34], [(first, at + off, end, count) for (first, off, count), end in zip(points, ends, strict=True)]


def decode_streams(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its blocks: first sample and the samples as bytes (plus 128, as they were stored)."""
    jobs, infos = [], []
    for s, data in enumerate(streams):
        total, digest, frames = _layout(data)
        infos.append((total, digest))
        jobs += [(s, *frame) for frame in frames]
    blocks = _decoded(streams, jobs)
    for own, (total, digest) in zip(blocks, infos, strict=True):
        pcm = b"".join(b for _, b in own)
        if len(pcm) != total or hashlib.md5((np.frombuffer(pcm, np.uint8) - np.uint8(128)).tobytes()).digest() != digest:
            raise FlacError("the samples differ from the stream's MD5")
    return blocks


def decode_ranges(wanted: list[tuple[bytes, int, int]]) -> list[bytes]:
    """Samples first to first + count of each (stream, first, count): the seek table names the only frames decoded."""
    jobs = [(s, *f) for s, (data, first, count) in enumerate(wanted) for f in _layout(data)[2] if f[0] < first + count and f[0] + f[3] > first]
    out = []
    for own, (_, first, count) in zip(_decoded([w[0] for w in wanted], jobs), wanted, strict=True):
        skip = first - own[0][0] if own else 0
        out.append(b"".join(b for _, b in own)[max(skip, 0) :][: max(count, 0)])
    return out


def _decoded(streams: list[bytes], jobs: list[tuple[int, int, int, int, int]]) -> list[list[tuple[int, bytes]]]:
    blocks: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    jobs.sort(key=lambda j: -j[4])
    for c in range(0, len(jobs), _WIDE):
        _decode_jobs(streams, jobs[c : c + _WIDE], blocks)
    for own in blocks:
        own.sort()
    return blocks


def _decode_jobs(streams: list[bytes], jobs: list[tuple[int, int, int, int, int]], blocks: list[list[tuple[int, bytes]]]) -> None:
    raw = b"".join(streams[s][a:b] for s, _, a, b, _ in jobs)
    size = np.array([b - a for _, _, a, b, _ in jobs], np.int64)
    start = np.cumsum(size) - size
    buf = np.frombuffer(raw, np.uint8)
    if _crc16(buf, start, size).any():  # a frame and its CRC-16 leave no remainder
        raise FlacError("a frame fails its CRC-16")
    heads = [_headers(raw, a) for a in start.tolist()]
    n = np.array([h[1] for h in heads], np.int64)
    if (n != [j[4] for j in jobs]).any():
        raise FlacError("a frame and the seek table differ")
    samples, end = _side_by_side(buf, raw, np.array([h[2] for h in heads], np.int64), n)
    columns = np.ascontiguousarray((samples + 128).astype(np.uint8).T)
    for i, (s, first, *_) in enumerate(jobs):
        stop = int(start[i] + size[i])
        if end[i] < 0:
            out, after = decode_frame(raw[start[i] : stop], heads[i][2] - int(start[i]), int(n[i]))
            after += int(start[i])
            pcm = bytes(v + 128 & 255 for v in out)
        else:
            after, pcm = int(end[i]), columns[i, : n[i]].tobytes()
        if after != stop - 2:
            raise FlacError("a frame is longer or shorter than its codes")
        blocks[s].append((first, pcm))


# ---------------------------------------------------------------- columns

_MEDIA = "doc_id bigint, n_bytes bigint, media binary"
_PCM = "doc_id bigint, n_bytes bigint, media_bytes bigint, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string"
_BLOCKS = ", blocks array<struct<first_sample:bigint,n_samples:int,pcm:binary>>"


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT))


def feature(pcm: bytes) -> str:
    """Mean, energy and zero crossings of the samples, as whole numbers."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(x < 0)))
    return f"sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"


def encode(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the FLAC stream of each text's payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            data = [payload(t) for t in texts]
            lengths = pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lengths, pa.array(encode_payloads(data), pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _MEDIA)


def decode(media: DataFrame, blocks: bool = True) -> DataFrame:
    """Each stream's digests and features of the payload read back and checked; with ``blocks`` its PCM blocks too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            streams = batch.column("media").to_pylist()
            found = decode_streams(streams)
            rows = []
            for doc, n, stream, own in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), streams, found, strict=True):
                pcm = b"".join(b for _, b in own)
                row = {"doc_id": doc, "n_bytes": n, "media_bytes": len(stream), "media_sha256": hashlib.sha256(stream).hexdigest(), "payload_bytes": len(pcm), "payload_sha256": hashlib.sha256(pcm).hexdigest(), "tail_crc32": zlib.crc32(pcm[-16:]), "feature": feature(pcm)}
                rows.append(row | {"blocks": [{"first_sample": a, "n_samples": len(b), "pcm": b} for a, b in own]} if blocks else row)
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA if blocks else _DIGESTS)

    return media.mapInArrow(run, _PCM + _BLOCKS if blocks else _PCM)


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())])
_SCHEMA = _DIGESTS.append(pa.field("blocks", pa.list_(pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))))


def blocks(decoded: DataFrame) -> DataFrame:
    """One row per PCM block, ready to be written: doc_id, first_sample, n_samples, pcm."""
    return decoded.select("doc_id", F.inline("blocks"))


def samples(media: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, first_sample, n_samples, pcm) of each row (doc_id, first_sample, n_samples) of ``wanted``, decoding only the frames it needs."""
    both = media.select("doc_id", "media").join(wanted.select("doc_id", F.col("first_sample").cast("bigint"), F.col("n_samples").cast("bigint")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            columns = [batch.column(c) for c in ("doc_id", "first_sample", "n_samples")]
            pcm = decode_ranges(list(zip(batch.column("media").to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pcm, pa.binary())], ["doc_id", "first_sample", "n_samples", "pcm"])

    return both.mapInArrow(run, "doc_id bigint, first_sample bigint, n_samples bigint, pcm binary")
