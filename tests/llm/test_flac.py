"""Streams against the plain bit-by-bit decoder, and damage of every kind."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from faintline.llm import flac


def payloads():
    rnd = random.Random(1)
    out = [flac.payload(t) for t in (None, "", "a", "the cat sat on the mat " * 900, "é😀" * 700, "x" * 4096, "y" * 4097, "\x00\x7f" * 300)]
    out += [bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 9000))) for _ in range(12)]
    t = np.arange(9000)
    out.append((128 + 100 * np.sin(t / 30)).astype(np.uint8).tobytes())
    out.append(bytes([0, 255] * 3000) + bytes(5000))
    return out


def test_round_trip_and_plain_decoder():
    data = payloads()
    streams = flac.encode_payloads(data)
    kinds = set()
    for p, own, s in zip(data, flac.decode_streams(streams), streams, strict=True):
        assert b"".join(b for _, b in own) == p
        assert [a for a, _ in own] == list(range(0, len(p), flac.BLOCK))
        n = -(-len(p) // flac.BLOCK)
        at = 4 + 4 + 34 + 4 + 18 * n
        for k in range(n):
            number, count, begin = flac._headers(s, at)
            kinds.add(s[begin] >> 1)
            out, at = flac.decode_frame(s, begin, count)
            at += 2
            assert number == k and bytes(v + 128 for v in out) == p[k * flac.BLOCK :][:count]
        assert at == len(s)
    assert {0, 1}.issubset(kinds) and any(k >= 32 for k in kinds) and any(8 <= k <= 12 for k in kinds)


def read_stream(data):
    """A whole stream by a reader of its own: bits of one long number, no code shared with the operator."""
    at = 4
    while True:
        last, size = data[at] >> 7, int.from_bytes(data[at + 1 : at + 4], "big")
        at += 4 + size
        if last:
            break
    bits = bin(int.from_bytes(b"\1" + data[at:], "big"))[3:]
    pos, out = 0, []

    def take(n, signed=False):
        nonlocal pos
        v = int(bits[pos : pos + n] or "0", 2)
        pos += n
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    def unary():
        nonlocal pos
        one = bits.index("1", pos)
        n, pos = one - pos, one + 1
        return n

    def residuals(count, order):
        width = (4, 5)[take(2)]
        parts = 1 << take(4)
        for j in range(parts):
            k = take(width)
            raw = take(5) if k == (1 << width) - 1 else None
            for _ in range(count // parts - (order if j == 0 else 0)):
                if raw is not None:
                    yield take(raw, True)
                else:
                    u = unary() << k | take(k)
                    yield -(u >> 1) - 1 if u & 1 else u >> 1

    while pos < len(bits):
        assert take(14) == 0b11111111111110
        take(2)
        size_code, rate = take(4), take(4)
        assert take(4) == 0 and take(3) == 1 and take(1) == 0
        lead = take(8)
        for _ in range(max(0, f"{lead:08b}".index("0") - 1)):
            take(8)
        count = take(16) + 1 if size_code == 7 else take(8) + 1
        assert rate in (0, 5)
        take(8)
        assert take(1) == 0
        kind, wasted = take(6), take(1)
        assert not wasted
        if kind == 0:
            frame = [take(8, True)] * count
        elif kind == 1:
            frame = [take(8, True) for _ in range(count)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            frame = [take(8, True) for _ in range(order)]
            shift = 0
            coefs = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order] if kind < 32 else None
            if coefs is None:
                precision, shift = take(4) + 1, take(5, True)
                coefs = [take(precision, True) for _ in range(order)]
            for e in residuals(count, order):
                frame.append(e + (sum(c * frame[-1 - i] for i, c in enumerate(coefs)) >> shift))
        pos = -(-pos // 8) * 8 + 16
        out += frame
    return bytes(v + 128 for v in out)


def test_against_an_independent_reader():
    data = payloads()
    for p, s in zip(data, flac.encode_payloads(data), strict=True):
        assert read_stream(s) == p


def test_ranges(spark):
    rnd = random.Random(5)
    p = flac.payload("some text of many frames, " * 3000)
    stream = flac.encode_payloads([p])[0]
    wanted = [(rnd.randrange(len(p)), rnd.randrange(9000)) for _ in range(40)] + [(0, 1), (4095, 2), (len(p) - 1, 50), (len(p), 3), (5, 0)]
    assert flac.decode_ranges([(stream, a, n) for a, n in wanted]) == [p[a : a + n] for a, n in wanted]
    # only the frames of the range are read: damage elsewhere goes unnoticed
    _, begin, end, _ = flac._layout(stream)[2][1]
    bad = stream[: begin + 30] + bytes([stream[begin + 30] ^ 1]) + stream[begin + 31 :]
    assert flac.decode_ranges([(bad, 2 * flac.BLOCK, 100)]) == [p[2 * flac.BLOCK :][:100]]
    with pytest.raises(flac.FlacError):
        flac.decode_ranges([(bad, flac.BLOCK, 1)])
    media = flac.encode(spark.createDataFrame([(1, p.decode()), (2, None)], "doc_id long, text string"))
    got = flac.samples(media, spark.createDataFrame([(1, a, n) for a, n in wanted] + [(9, 0, 1)], "doc_id long, first_sample long, n_samples long")).collect()
    assert sorted((r.first_sample, r.n_samples, bytes(r.pcm)) for r in got) == sorted((a, n, p[a : a + n]) for a, n in wanted)


def test_checksums_by_bits():
    def crc(data, poly, bits):
        c = 0
        for b in data:
            c ^= b << (bits - 8)
            for _ in range(8):
                c = (c << 1 ^ poly if c >> (bits - 1) & 1 else c << 1) & ((1 << bits) - 1)
        return c

    rnd = random.Random(2)
    rows = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 2, 7, 40, 41)]
    buf = np.frombuffer(b"".join(rows) + b"\0\0", np.uint8)
    size = np.array([len(r) for r in rows])
    assert flac._crc16(buf, np.cumsum(size) - size, size).tolist() == [crc(r, 0x8005, 16) for r in rows]
    assert [flac._crc8(r) for r in rows] == [crc(r, 0x07, 8) for r in rows]
    assert [flac._number(n) for n in (0, 127)] == [b"\0", b"\x7f"] and flac._number(0x20AC) == "€".encode() and flac._number(0x1F600) == "😀".encode()


@pytest.mark.parametrize("where", [10, 60, 200, -1, -3])
def test_damage(where):
    stream = bytearray(flac.encode_payloads([b"some text that repeats, some text " * 40])[0])
    stream[where] ^= 16
    with pytest.raises((flac.FlacError, Exception)):
        if b"".join(b for _, b in flac.decode_streams([bytes(stream)])[0]):
            raise AssertionError("not noticed") from None


def test_partitions_and_escapes():
    """A frame with four partitions, one of them unencoded, decoded by both ways."""
    rnd = random.Random(7)
    samples = [rnd.randint(-20, 20) for _ in range(64)]
    bits = "0" + "001000" + "0" + "00" + "0010"
    for p in range(4):
        part = samples[16 * p : 16 * p + 16]
        if p == 2:
            bits += "1111" + "00110" + "".join(f"{v & 63:06b}" for v in part)
        else:
            bits += f"{p + 1:04b}"
            for v in part:
                u = v << 1 ^ v >> 31
                bits += "0" * (u >> (p + 1)) + "1" + f"{u & ((1 << (p + 1)) - 1):0{p + 1}b}"
    bits += "0" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big")
    assert flac.decode_frame(body, 0, 64)[0] == samples
    bits4 = bits[:8] + "00" + "0010"
    for p in range(4):
        bits4 += "0011" + "".join("0" * ((u := v << 1 ^ v >> 31) >> 3) + "1" + f"{u & 7:03b}" for v in samples[16 * p : 16 * p + 16])
    bits4 += "0" * (-len(bits4) % 8)
    body = int(bits4, 2).to_bytes(len(bits4) // 8, "big")
    got, end = flac._side_by_side(np.frombuffer(body, np.uint8), body, np.array([0]), np.array([64]))
    assert got[:, 0].tolist() == samples and end[0] == len(body)


def test_table(spark):
    texts = [None, "", "a", "a", "é" * 5000, "word " * 30000]
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in flac.decode(flac.encode(df)).collect()}
    for i, t in enumerate(texts):
        p = flac.payload(t)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert len(p) % 192 == 0 and len(p) > 0
    assert got[2].media_sha256 == got[3].media_sha256 and got[0].feature == got[1].feature
    first = flac.blocks(flac.decode(flac.encode(df))).filter("doc_id = 5").orderBy("first_sample").collect()
    assert b"".join(bytes(r.pcm) for r in first) == flac.payload(texts[5])
    assert flac.decode(flac.encode(df.limit(0))).collect() == []
