"""The FLAC codec against a plain writer of streams, bit by bit, and a published stream."""

import hashlib
import random

import numpy as np
import pytest

from planegrid.llm import flac

#: Fixed value: the third example stream of RFC 9639 (one channel, 8 bits, 32 kHz, a linear predictor, no seek table).
RFC = "664c614380000022100010000000 1f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32 fff868020017e944004f6f313d1047d227cb6d09 0831452bdc2822228057a3"
RFC_SAMPLES = [0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0]


def crc(data, poly, bits):
    c = 0
    for byte in data:
        c ^= byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
    return c


def signed(v, n):
    return format(v & ((1 << n) - 1), f"0{n}b")


def rice(r, order, n, partitions, escape, wide):
    """Coded residuals; partitions for which ``escape`` says so hold plain numbers."""
    bits = ("01" if wide else "00") + format(partitions, "04b")
    size, at = n >> partitions, 0
    for p in range(1 << partitions):
        own = r[at : at + size - (order if p == 0 else 0)]
        at += len(own)
        if escape(p):
            width = max([0, *((v if v >= 0 else -v - 1).bit_length() + 1 for v in own if v)])
            bits += "1" * (5 if wide else 4) + format(width, "05b") + "".join(signed(v, width) for v in own if width)
            continue
        k = max(0, int(np.mean([abs(v) for v in own] or [0])).bit_length())
        bits += format(k, "05b" if wide else "04b")
        for v in own:
            u = v << 1 if v >= 0 else (-v << 1) - 1
            bits += "0" * (u >> k) + "1" + (format(u & ((1 << k) - 1), f"0{k}b") if k else "")
    return bits


def subframe(x, kind, partitions=0, escape=lambda p: False, wide=False, coefficients=(), shift=0):
    n = len(x)
    if kind == "constant":
        return "00000000" + signed(x[0], 8)
    if kind == "verbatim":
        return "00000010" + "".join(signed(v, 8) for v in x)
    w = flac.FIXED[kind] if isinstance(kind, int) else coefficients
    o = len(w)
    r = [x[t] - (sum(c * x[t - d] for d, c in enumerate(w, 1)) >> (0 if isinstance(kind, int) else shift)) for t in range(o, n)]
    bits = "0" + (format(8 | o, "06b") if isinstance(kind, int) else format(32 | (o - 1), "06b")) + "0" + "".join(signed(v, 8) for v in x[:o])
    if not isinstance(kind, int):
        bits += format(14, "04b") + signed(shift, 5) + "".join(signed(c, 15) for c in coefficients)
    return bits + rice(r, o, n, partitions, escape, wide)


def stream(x, frames, per_frame, told=True):
    """A stream without seek table: frames are (samples, keywords of subframe)."""
    md5 = hashlib.md5(np.array(x, np.int8).tobytes()).digest() if told else bytes(16)
    info = per_frame.to_bytes(2, "big") * 2 + bytes(6) + (32000 << 44 | 7 << 36 | (len(x) if told else 0)).to_bytes(8, "big") + md5
    out, at = b"fLaC" + b"\x04" + (5).to_bytes(3, "big") + b"extra" + b"\x80" + len(info).to_bytes(3, "big") + info, 0
    for number, (n, how) in enumerate(frames):
        code = {192: "0001", 576: "0010", 256: "1000", 512: "1001"}.get(n)
        head = bytes([0xFF, 0xF8]) + int((code or "0111") + "1000" + "00000010", 2).to_bytes(2, "big")
        head += chr(number).encode() + (b"" if code else (n - 1).to_bytes(2, "big"))
        head += bytes([crc(head, 0x07, 8)])
        bits = subframe(x[at : at + n], **how)
        bits += "0" * (-len(bits) % 8)
        frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
        out += frame + crc(frame, 0x8005, 16).to_bytes(2, "big")
        at += n
    return out


def samples(media):
    return [b - 128 for _, block in flac.decode([media])[0] for b in block]


def test_published_stream():
    media = bytes.fromhex(RFC)
    assert samples(media) == RFC_SAMPLES
    assert flac.seek(media, 23) == 42


@pytest.mark.parametrize("seed", range(6))
def test_foreign_streams(seed):
    """All kinds of subframes, orders, partitions and escapes, block sizes by code and by number, no seek table."""
    rng = random.Random(seed)
    hows = [{"kind": "verbatim"}, {"kind": 0, "partitions": 2}, {"kind": 1, "escape": lambda p: True}, {"kind": 2, "partitions": 3, "escape": lambda p: p % 3 == 1}, {"kind": 3, "wide": True}]
    hows += [{"kind": 4, "partitions": 4}, {"kind": "linear", "coefficients": (13, -7, 2), "shift": 3, "partitions": 1}, {"kind": "linear", "coefficients": tuple(rng.randint(-9, 9) for _ in range(12)), "shift": 5, "escape": lambda p: True}]
    rng.shuffle(hows)
    x, v = [], 0
    for _ in range(256 * (len(hows) + 1)):
        v = max(-128, min(127, v + rng.randint(-9, 9) if rng.random() < 0.98 else rng.randint(-128, 127)))
        x.append(v)
    x[:256] = [7] * 256
    frames = [(256, {"kind": "constant"}), *((256, h) for h in hows)]
    media = stream(x, frames, 256, told=bool(seed % 2))
    assert samples(media) == x
    for at in (0, 255, 256, 1000, len(x) - 1):
        header = flac._read_header(media[flac.seek(media, at) :][:24], 256)
        assert header.first <= at < header.first + header.n
    with pytest.raises(flac.FlacError):
        flac.seek(media, len(x))
    bad = bytearray(media)
    bad[len(media) // 2] ^= 4
    with pytest.raises(flac.FlacError):
        flac.decode([bytes(bad)])


@pytest.mark.parametrize("n", [192, 576, 1000])
def test_foreign_block_sizes(n):
    rng = random.Random(n)
    x = [rng.randint(-40, 40) for _ in range(n)]
    for told in (True, False):
        assert samples(stream(x, [(n, {"kind": 1})], n, told)) == x


PAYLOADS = [b"", b"\0" * 64, random.Random(2).randbytes(5000), b"abc" * 3000, "Hello wörld, ".encode() * 900, b"\xff\x00" * 4096, b"a", b"\0" * 4095 + b"\xff" * 200]
PAYLOADS += [bytes(int(128 + 90 * np.sin(i / 9) + 20 * np.sin(i / 2.3)) for i in range(9000)), bytes(np.cumsum(np.random.default_rng(1).integers(-3, 4, 9000)) % 97 + 60), b"\0\0\0z" * 900 + bytes(5000)]


def test_round_trip():
    media = flac.encode(PAYLOADS)
    for data, blocks in zip(PAYLOADS, flac.decode(media)):
        assert b"".join(b for _, b in blocks) == data
        assert [o for o, _ in blocks] == list(range(0, len(data), flac.BLOCK))
    assert media == flac.encode(PAYLOADS[:3]) + flac.encode(PAYLOADS[3:])


def without_table(media):
    """The stream with its last metadata block, the seek table, taken away."""
    assert media[42] == 0x83
    return media[:4] + b"\x80" + media[5:42] + media[46 + int.from_bytes(media[43:46], "big") :]


def test_the_seek_table_is_optional():
    media = flac.encode(PAYLOADS)
    assert flac.decode([without_table(m) for m in media]) == flac.decode(media)
    own = media[8]
    for at in (0, 4095, 4096, 8999):
        begin = flac.seek(own, at)
        assert begin - flac.seek(without_table(own), at) == len(own) - len(without_table(own))


def test_the_encoder_uses_what_is_shortest():
    """Linear predictors and several partitions are written where they help, verbatim and constant frames too."""
    kinds, partitions = set(), set()
    for m in flac.encode(PAYLOADS):
        _, per_frame, _, _, at = flac._metadata(m)
        for begin, header, _ in flac._walk(m, at, per_frame):
            kind = m[begin + header.size] >> 1
            kinds.add("linear" if kind >= 32 else {0: "constant", 1: "verbatim"}.get(kind, "fixed"))
            if 8 <= kind < 32:
                bit = 8 * (begin + header.size + 1 + kind - 8) + 2
                partitions.add(int.from_bytes(m[bit // 8 : bit // 8 + 2], "big") >> (12 - bit % 8) & 15)
    assert kinds == {"constant", "verbatim", "fixed", "linear"} and partitions == {0, flac.PARTITIONS}
    noise, wave = flac.encode([PAYLOADS[2], PAYLOADS[8]])
    assert len(noise) < 1.03 * 5000 + 120 and len(wave) < 0.5 * 9000
