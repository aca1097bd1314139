"""Media columns: lossless FLAC of 8-bit samples, decoded to PCM blocks with seekable sample offsets.

The encoder writes one mono stream per row: STREAMINFO, a SEEKTABLE with a point for every frame, and
frames of at most 4096 samples. Each frame takes what is shortest: a constant, its samples verbatim, a fixed
predictor of order 0 to 2 or a linear predictor fitted to it, with one or eight Rice partitions. The
decoder walks the frames by their headers and checksums, with or without a seek table, and reads fixed
orders 0 to 4, quantized coefficients, several Rice partitions and escaped ones. It checks both
checksums of every frame, and decodes all frames of a batch in step: at step t each frame's sample t,
so that NumPy works across frames although a Rice code's place depends on the code before it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

BLOCK = 4096
RATE = 8000
#: Payload bytes that a task decodes in step.
GROUP = 6 << 20

#: Fixed predictors of the format: weights of the samples before, nearest first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Order, bits of a coefficient, and right shift of the predictors that are fitted.
ORDER, PRECISION, SHIFT = 4, 12, 9
#: Rice partitions of a frame that does better with several than with one, as a power of two.
PARTITIONS = 3


class FlacError(ValueError):
    """A stream that is not valid FLAC of the kind read here, or a checksum that does not hold."""


def _crc_table(poly: int, bits: int) -> list[int]:
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8 = _crc_table(0x07, 8)
_CRC16 = np.array(_crc_table(0x8005, 16), np.uint16)


def _far_table(n: int) -> np.ndarray:
    """[d, b]: the 16-bit checksum of byte b with d bytes 0 after it."""
    out = np.empty((n, 256), np.uint16)
    out[0] = _CRC16
    for d in range(1, n):
        out[d] = (out[d - 1] << np.uint16(8)) ^ _CRC16[out[d - 1] >> np.uint16(8)]
    return out


_FAR = _far_table(8192)
#: Bytes b to the two's complement bytes of the samples b - 128, and back.
_SIGNED = bytes(b ^ 128 for b in range(256))
#: Zeros before the first one of 16 bits.
_ZEROS = np.array([16 - i.bit_length() for i in range(1 << 16)], np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: np.ndarray) -> int:
    """The checksum is linear, so it is the XOR of what each byte gives at its distance from the end."""
    out = 0
    for i in range(0, len(data), len(_FAR)):
        part = data[i : i + len(_FAR)]
        for _ in range(len(part) if out else 0):  # carry what came before over this part
            out = ((out << 8) & 0xFFFF) ^ int(_CRC16[out >> 8])
        out ^= int(np.bitwise_xor.reduce(_FAR[np.arange(len(part) - 1, -1, -1), part]))
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < limit:
            return bytes([(0xFF & ~(limit * 2 - 1)) | n, *reversed(tail)])
        limit >>= 1


def _header(number: int, n: int) -> bytes:
    h = bytes([0xFF, 0xF8, 0x74, 0x02]) + _coded_number(number) + struct.pack(">H", n - 1)
    return h + bytes([crc8(h)])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload, a byte b being the sample b - 128."""
    out: list[bytes] = []
    i = 0
    while i < len(payloads):  # about a megabyte together
        j, size = i, 0
        while j < len(payloads) and (j == i or size + len(payloads[j]) <= 1 << 20):
            size += len(payloads[j])
            j += 1
        out += _encode(payloads[i:j])
        i = j
    return out


def _encode(payloads: list[bytes]) -> list[bytes]:
    frames = [(i, f, data[f * BLOCK : (f + 1) * BLOCK]) for i, data in enumerate(payloads) for f in range(-(-len(data) // BLOCK))]
    parts: list[list[bytes]] = [[] for _ in payloads]
    for (i, number, raw), body in zip(frames, _subframes([x[2] for x in frames])):
        frame = _header(number, len(raw)) + body
        parts[i].append(frame + struct.pack(">H", crc16(np.frombuffer(frame, np.uint8))))
    return [_stream(data, own) for data, own in zip(payloads, parts)]


def _stream(data: bytes, frames: list[bytes]) -> bytes:
    """The metadata blocks of a payload before its frames."""
    sizes = [len(f) for f in frames]
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
    info += (RATE << 44 | 7 << 36 | len(data)).to_bytes(8, "big") + hashlib.md5(data.translate(_SIGNED)).digest()
    points, at = [], 0
    for j, s in enumerate(sizes):
        points.append(struct.pack(">QQH", j * BLOCK, at, min(BLOCK, len(data) - j * BLOCK)))
        at += s
    table = b"".join(points)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


def _fitted(x: np.ndarray, bounds: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Each frame's linear predictor: [frame, ORDER] whole coefficients, by Levinson's recursion over all frames at once."""
    place = np.arange(len(x)) - np.repeat(bounds[:-1], lens)
    own = x.astype(np.float64)
    r = [np.add.reduceat(own * own, bounds[:-1])]
    for d in range(1, ORDER + 1):
        product = np.zeros(len(x))
        product[d:] = own[d:] * own[:-d]
        product[place < d] = 0
        r.append(np.add.reduceat(product, bounds[:-1]))
    error = r[0] * (1 + 1e-9) + 1e-9
    a = np.zeros((ORDER + 1, len(lens)))
    for i in range(1, ORDER + 1):
        k = (r[i] - sum((a[j] * r[i - j] for j in range(1, i)), np.zeros(len(lens)))) / error
        new = a.copy()
        new[i] = k
        for j in range(1, i):
            new[j] = a[j] - k * a[i - j]
        a, error = new, np.maximum(error * (1 - k * k), 1e-9)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a[1:].T * (1 << SHIFT)), -most, most).astype(np.int32)


def _rice(u: np.ndarray, bounds: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, bits) of the best Rice parameter of each stretch of residuals, 15 (which means escaped) excluded."""
    mean = np.add.reduceat(u, bounds[:-1]) / lens
    low = np.clip(np.floor(np.log2(mean + 1e-9)), 0, 7).astype(np.int32)
    tried = [(k, np.add.reduceat(u >> np.repeat(k, lens), bounds[:-1]) + lens * (k + 1)) for k in (np.maximum(low - 1, 0), low)]
    first = tried[0][1] <= tried[1][1]
    return np.where(first, tried[0][0], tried[1][0]), np.where(first, tried[0][1], tried[1][1])


def _subframes(raws: list[bytes]) -> Iterator[bytes]:
    """The subframe of each block of bytes, all blocks' residuals and codes made together."""
    if not raws:
        return
    lens = np.array([len(x) for x in raws])
    bounds = np.r_[0, np.cumsum(lens)]
    x = np.frombuffer(b"".join(raws), np.uint8).astype(np.int32) - 128
    place = np.arange(len(x), dtype=np.int32) - np.repeat(bounds[:-1], lens).astype(np.int32)
    fitted = _fitted(x, bounds, lens)
    residuals, costs = [], []
    for w in (*FIXED[:3], None):
        predicted = np.zeros(len(x), np.int32)
        for d in range(1, (ORDER if w is None else len(w)) + 1):
            predicted[d:] += (np.repeat(fitted[:, d - 1], lens)[d:] if w is None else w[d - 1]) * x[:-d]
        r = x - (predicted >> SHIFT if w is None else predicted)
        r[place < (ORDER if w is None else len(w))] = 0
        residuals.append(r)
        # a code has some log2 of the mean and two bits a sample; coefficients come on top
        cost = np.add.reduceat(np.abs(r), bounds[:-1])
        costs.append(lens * np.log2(1 + cost / lens) + (9 + PRECISION * ORDER if w is None else 0))
    chosen = np.argmin(costs, 0)
    linear = chosen == 3
    order = np.where(linear, ORDER, chosen)
    r = residuals[0]
    for w in range(1, len(residuals)):
        r = np.where(np.repeat(chosen == w, lens), residuals[w], r)
    u = (r << 1) ^ (r >> 31)
    # one partition, or 2 ** PARTITIONS of them where they divide the frame and save bits
    k_one, bits_one = _rice(u, bounds, lens)
    can = (lens % (1 << PARTITIONS) == 0) & (lens >> PARTITIONS > ORDER)
    pieces = np.where(can, 1 << PARTITIONS, 1)
    piece_lens = np.repeat(lens // pieces, pieces)
    piece_bounds = np.r_[0, np.cumsum(piece_lens)]
    k_many, bits_many = _rice(u, piece_bounds, piece_lens)
    begins_of = np.r_[0, np.cumsum(pieces)]
    split = can & (np.add.reduceat(bits_many, begins_of[:-1]) + 4 * ((1 << PARTITIONS) - 1) < bits_one)
    kk = np.where(np.repeat(split, lens), np.repeat(k_many, piece_lens), np.repeat(k_one, lens)).astype(np.int32)
    width = (u >> kk) + 1 + kk
    width[place < np.repeat(order, lens)] = 0
    # a partition's parameter stands before its first code; the first partition's in the head
    before = np.zeros(len(x), np.int32)
    later = np.flatnonzero(np.repeat(split, pieces) & (np.arange(len(piece_lens)) > np.repeat(begins_of[:-1], pieces)))
    before[piece_bounds[later]] = 4
    coded_bits = np.add.reduceat(width + before, bounds[:-1])
    head_bits = 8 + 8 * order + np.where(linear, 9 + PRECISION * ORDER, 0) + 10
    sizes = -(-(head_bits + coded_bits) // 8)
    begins = np.r_[0, np.cumsum(sizes)]
    ends = np.cumsum(width + before, dtype=np.int64) + np.repeat(8 * begins[:-1] + head_bits - np.r_[0, np.cumsum(coded_bits)[:-1]], lens)
    # a code ends in a one and k bits, at most 8 of them, so these lie in two bytes; so does a parameter
    some = width > 0
    values = [((1 << kk) | (u & ((1 << kk) - 1)))[some], k_many[later]]
    firsts = [(ends - 1 - kk)[some], (ends - width - 4)[piece_bounds[later]]]
    spans = [kk[some] + 1, np.full(len(later), 4)]
    value, first, span = (np.concatenate(v) for v in (values, firsts, spans))
    value = value << (16 - (first & 7) - span)
    made = np.bincount(first >> 3, value >> 8, begins[-1] + 1) + np.bincount((first >> 3) + 1, value & 255, begins[-1] + 1)[: begins[-1] + 1]
    body = made.astype(np.uint8)
    for f, raw in enumerate(raws):
        n, o = len(raw), int(order[f])
        if raw.count(raw[:1]) == n:
            yield bytes([0x00, raw[0] ^ 128])
        elif n <= o or sizes[f] > n:
            yield b"\x02" + raw.translate(_SIGNED)
        else:
            kind = bytes([(0x20 | (o - 1)) << 1 if linear[f] else (0x08 | o) << 1])
            bits = [np.unpackbits(np.frombuffer(kind + raw[:o].translate(_SIGNED), np.uint8))]
            if linear[f]:
                bits += [_bits(PRECISION - 1, 4), _bits(SHIFT, 5), *(_bits(int(c) & ((1 << PRECISION) - 1), PRECISION) for c in fitted[f])]
            # Rice coding, the order of its partitions, and the first one's parameter
            bits += [_bits(0, 2), _bits(PARTITIONS if split[f] else 0, 4), _bits(int(k_many[begins_of[f]] if split[f] else k_one[f]), 4)]
            head = np.packbits(np.concatenate(bits))
            own = body[begins[f] : begins[f + 1]]
            own[: len(head)] |= head
            yield own.tobytes()


def _bits(value: int, n: int) -> np.ndarray:
    return np.array([value >> (n - 1 - i) & 1 for i in range(n)], np.uint8)


def _metadata(media: bytes) -> tuple[int, int, bytes, list[tuple[int, int]], int]:
    """(samples, or 0 if not told; samples of a frame; MD5; seek points; first byte of the frames).

    A seek point is (sample, byte of its frame, counted in the whole stream).
    """
    if media[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, info, seek = 4, False, b"", b""
    while not last:
        if at + 4 > len(media):
            raise FlacError("the metadata blocks do not end")
        last, kind, n = bool(media[at] & 128), media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        block = media[at + 4 : at + 4 + n]
        info, seek = (block if kind == 0 else info), (block if kind == 3 else seek)
        at += 4 + n
    packed = int.from_bytes(info[10:18], "big")
    if len(info) != 34 or (packed >> 41 & 7, packed >> 36 & 31) != (0, 7):
        raise FlacError("only one channel of 8-bit samples is read")
    points = [struct.unpack_from(">QQH", seek, i) for i in range(0, len(seek) - 17, 18)]
    return packed & (1 << 36) - 1, int.from_bytes(info[2:4], "big"), info[18:34], [(p[0], at + p[1]) for p in points if p[0] != (1 << 64) - 1], at


class Header(NamedTuple):
    first: int  # sample
    n: int  # samples
    size: int  # bytes of the header


def _read_header(raw: bytes, per_frame: int) -> Header | None:
    """The frame header that ``raw`` begins with, or None if there is none whose checksum holds."""
    if len(raw) < 6 or raw[0] != 0xFF or raw[1] & 0xFE != 0xF8 or raw[3] >> 4 or raw[3] & 1:
        return None
    lead = raw[4]
    length = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    block, rate, bits = raw[2] >> 4, raw[2] & 15, raw[3] >> 1 & 7
    if length == 0 or (lead >= 0x80 and length == 1) or length > 7 or block == 0 or rate == 15 or bits not in (0, 1):
        return None
    number = lead if lead < 0x80 else lead & ((1 << (7 - length)) - 1) if length < 7 else 0
    for b in raw[5 : 4 + length]:
        number = number << 6 | b & 0x3F
    at = 4 + length
    more = {6: 1, 7: 2}.get(block, 0)
    told = int.from_bytes(raw[at : at + more], "big") + 1
    n = told if more else 192 if block == 1 else 576 << (block - 2) if block < 6 else 256 << (block - 8)
    at += more + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if len(raw) <= at or crc8(raw[:at]) != raw[at]:
        return None
    return Header(number if raw[1] & 1 else number * per_frame, n, at + 1)


def _walk(media: bytes, at: int, per_frame: int) -> Iterator[tuple[int, Header, int]]:
    """(first byte, header, byte past it) of each frame from byte ``at`` on.

    A frame ends where the next header stands that goes on with its samples, or the stream ends, and the checksum
    of all before it holds.
    """
    data = np.frombuffer(media, np.uint8)
    marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] & 0xFE == 0xF8))
    ends = [*marks[marks > at].tolist(), len(media)]
    own = _read_header(media[at : at + 24], per_frame)
    i = 0
    while at < len(media):
        if own is None:
            raise FlacError(f"byte {at}: no frame header that holds")
        while i < len(ends):
            end = ends[i]
            i += 1
            after = None if end == len(media) else _read_header(media[end : end + 24], per_frame)
            if end - at > own.size + 2 and (end == len(media) or after and after.first == own.first + own.n) and crc16(data[at : end - 2]) == int.from_bytes(media[end - 2 : end], "big"):
                break
        else:
            raise FlacError(f"frame at sample {own.first}: its checksum does not hold")
        yield at, own, end
        at, own = end, after


def seek(media: bytes, sample: int) -> int:
    """The first byte of the frame that has ``sample``: from the last seek point before it, or the first frame, on."""
    _, per_frame, _, points, at = _metadata(media)
    start = max((p for p in points if p[0] <= sample), default=(0, at))[1]
    for begin, header, _ in _walk(media, start, per_frame):
        if header.first <= sample < header.first + header.n:
            return begin
    raise FlacError(f"no sample {sample}")


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """Each stream's PCM blocks: (sample offset, bytes), a sample s being the byte s + 128."""
    frames = []  # stream, first sample, samples, first byte, byte past it
    heads = []
    totals = []
    for i, media in enumerate(streams):
        total, per_frame, md5, _, at = _metadata(media)
        totals.append((total, md5))
        for begin, header, end in _walk(media, at, per_frame):
            frames.append((i, header.first, header.n, begin, end))
            heads.append(header.size)
    out = [np.zeros(0, np.int32)] * len(frames)
    rice: list[tuple[int, int, tuple[int, ...], int, int]] = []  # frame, first bit, weights, shift, order
    for f, ((i, first, n, begin, end), h) in enumerate(zip(frames, heads)):
        media, at = streams[i], begin + h
        kind = media[at] >> 1 & 63
        if media[at] & 129:
            raise FlacError("wasted bits are not read")
        signed = np.frombuffer(media, np.int8)
        if kind == 0:
            out[f] = np.full(n, signed[at + 1], np.int32)
        elif kind == 1:
            out[f] = signed[at + 1 : at + 1 + n].astype(np.int32)
        elif 8 <= kind <= 12:
            rice.append((f, 8 * (at + 1 + kind - 8), FIXED[kind - 8], 0, kind - 8))
        elif kind >= 32:
            o = kind - 31
            bit = 8 * (at + 1 + o)

            def number(bit: int, n: int, media: bytes = media) -> int:
                word = int.from_bytes(media[bit // 8 : (bit + n + 7) // 8], "big")
                return word >> (-(bit + n) % 8) & ((1 << n) - 1)

            precision, shift = number(bit, 4) + 1, number(bit + 4, 5)
            w = [number(bit + 9 + j * precision, precision) for j in range(o)]
            w = [c - (1 << precision) if c >> (precision - 1) else c for c in w]
            rice.append((f, bit + 9 + o * precision, tuple(w), shift, o))
        else:
            raise FlacError(f"subframe type {kind}")
    if rice:
        _decode_rice(streams, frames, heads, rice, out)
    blocks: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    for (i, first, *_), samples in zip(frames, out):
        blocks[i].append((first, (samples + 128).astype(np.uint8).tobytes()))
    for (total, md5), own in zip(totals, blocks):
        whole = b"".join(b for _, b in own)
        if (total and len(whole) != total) or any(md5) and hashlib.md5(whole.translate(_SIGNED)).digest() != md5:
            raise FlacError("the samples are not those that the stream info names")
    return blocks


def _decode_rice(streams: list[bytes], frames: list, heads: list[int], rice: list, out: list[np.ndarray]) -> None:
    """Residuals of all frames in step, then their predictions."""
    begins = np.cumsum([0, *(frames[f][4] - frames[f][3] + 8 for f, *_ in rice)])
    data = np.zeros(begins[-1] + 16, np.uint8)
    for (f, *_), b in zip(rice, begins):
        i, _, _, begin, end = frames[f]
        data[b : b + end - begin] = np.frombuffer(streams[i], np.uint8)[begin:end]
    # 32 bits from every byte on, in network order: any code part of up to 24 bits is one look
    wide = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    bit = np.array([first - 8 * frames[f][3] + 8 * b for (f, first, *_), b in zip(rice, begins)], np.int64)

    def look(bit: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        word = wide[bit >> 3].astype(np.int64)
        return (word >> (32 - (bit & 7) - n)) & ((np.int64(1) << n) - 1)

    n = np.array([frames[f][2] for f, *_ in rice])
    order = np.array([x[4] for x in rice])
    method = look(bit, 2)
    wide_k = np.where(method == 1, 5, 4)
    partitions = look(bit + 2, 4)
    bit = bit + 6
    per = n >> partitions
    result = np.zeros((int(n.max()), len(rice)), np.int32)
    k = np.zeros(len(rice), np.int64)
    raw = np.full(len(rice), -1, np.int64)
    by_length = np.argsort(-n, kind="stable")  # frames that still run stay in front
    bit, per, order_, n_, wide_k = bit[by_length], per[by_length], order[by_length], n[by_length], wide_k[by_length]
    lowest = int(order_.min())
    for t in range(lowest, int(n_[0])):
        m = int(np.searchsorted(-n_, -t, "left"))
        opens = np.flatnonzero((order_[:m] == t) | ((t % per[:m] == 0) & (order_[:m] < t)))
        if len(opens):
            k[opens] = look(bit[opens], wide_k[opens])
            bit[opens] += wide_k[opens]
            escaped = opens[k[opens] == (1 << wide_k[opens]) - 1]
            raw[opens] = -1
            raw[escaped] = look(bit[escaped], 5)
            bit[escaped] += 5
        on = order_[:m] <= t
        b, kk = bit[:m], k[:m]
        word = (wide[b >> 3] << (b & 7).astype(np.uint32)).astype(np.uint32)
        # the unary part, within 16 bits; longer runs of zeros are counted one by one
        q = _ZEROS[word >> np.uint32(16)]
        for j in np.flatnonzero((q == 16) & on & (raw[:m] < 0)):
            z = int(b[j])
            while not data[z >> 3] >> (7 - (z & 7)) & 1:
                z += 1
            q[j] = z - b[j]
        after = b + q + 1
        u = (q << kk) | look(np.minimum(after, 8 * len(wide) - 8), kk)
        r = (u >> 1) ^ -(u & 1)
        step = after + kk
        if (raw[:m] >= 0).any():
            plain = raw[:m] >= 0
            v = look(b, np.maximum(raw[:m], 0))
            v = np.where((raw[:m] > 0) & (v >> np.maximum(raw[:m] - 1, 0) & 1 == 1), v - (np.int64(1) << np.maximum(raw[:m], 0)), v)
            r, step = np.where(plain, v, r), np.where(plain, b + raw[:m], step)
        result[t, :m] = np.where(on, r, 0)
        bit[:m] = np.where(on, step, b)
    linear = []
    for column, j in enumerate(by_length):
        f, _, w, shift, o = rice[j]
        i, _, n_f, begin, _ = frames[f]
        subframe = begin + heads[f]
        result[:o, column] = np.frombuffer(streams[i], np.int8)[subframe + 1 : subframe + 1 + o]
        if not (o < len(FIXED) and w == FIXED[o] and not shift):
            linear.append((column, f, w, shift, o, n_f))
            continue
        x = result[:n_f, column].astype(np.int64)
        y = x[o:]  # the residual is the o-th difference
        for d in range(o, 0, -1):
            y = np.cumsum(y) + np.diff(x[:o], d - 1)[-1]
        x[o:] = y
        out[f] = x.astype(np.int32)
    if linear:
        _predict(result, linear, out)


def _predict(result: np.ndarray, linear: list, out: list[np.ndarray]) -> None:
    """Samples of the frames with quantized coefficients, a sample of each frame at a time."""
    most = max(o for *_, o, _ in linear)
    weights = np.zeros((most, len(linear)), np.int64)
    for j, (_, _, w, _, o, _) in enumerate(linear):
        weights[most - o :, j] = w[::-1]  # oldest first
    shift, order = (np.array([x[k] for x in linear]) for k in (3, 4))
    x = np.zeros((most + len(result), len(linear)), np.int64)
    x[most:] = result[:, [c for c, *_ in linear]]
    for t in range(int(order.min()), len(result)):
        predicted = np.einsum("dl,dl->l", weights, x[t : t + most]) >> shift
        x[most + t] += np.where(order <= t, predicted, 0)
    for j, (_, f, *_, n_f) in enumerate(linear):
        out[f] = x[most : most + n_f, j].astype(np.int32)


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about GROUP bytes in a column."""
    for batch in batches:
        sizes = np.cumsum([0, *(len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column))])
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + GROUP, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def store(df: DataFrame, column: str = "payload", out: str = "media") -> DataFrame:
    """``df`` with its binary ``column`` stored as a FLAC stream in ``out`` (null: null, empty: no frames).

    Equal payloads give equal streams. A column named ``out`` is replaced, other columns stay.
    """
    rest = [c for c in df.columns if c not in (column, out)]
    source = df.select(*rest, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, len(rest)):
            values = b.column(len(rest)).to_pylist()
            made = iter(encode([v for v in values if v is not None]))
            media = pa.array([None if v is None else next(made) for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], media], [*rest, out])

    schema = T.StructType([*(source.schema[c] for c in rest), T.StructField(out, T.BinaryType())])
    return source.mapInArrow(run, schema)


BLOCKS = T.ArrayType(T.StructType([T.StructField("first_sample", T.LongType()), T.StructField("pcm", T.BinaryType())]))


def read_back(df: DataFrame, column: str = "media", out: str = "blocks", joined: str | None = None) -> DataFrame:
    """``df`` with the stream in ``column`` decoded into ``out``: PCM blocks, each with the offset of its first sample.

    With ``joined``, a column of that name has all samples in one. A null stays null; a stream whose
    checksums do not hold raises. Columns of these names are replaced.
    """
    source = df.select(*[c for c in df.columns if c not in (out, joined)])
    at = source.columns.index(column)
    kind = pa.list_(pa.struct([("first_sample", pa.int64()), ("pcm", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, at):
            values = b.column(at).to_pylist()
            made = iter(decode([v for v in values if v is not None]))
            found = [None if v is None else next(made) for v in values]
            rows = [None if v is None else [{"first_sample": o, "pcm": p} for o, p in v] for v in found]
            whole = [pa.array([None if v is None else b"".join(p for _, p in v) for v in found], pa.binary())] if joined else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind), *whole], [*b.schema.names, out, *([joined] if joined else [])])

    fields = [*source.schema, T.StructField(out, BLOCKS), *([T.StructField(joined, T.BinaryType())] if joined else [])]
    return source.mapInArrow(run, T.StructType(fields))


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as FLAC and read back; the feature names its blocks, the last one's offset and the ratio."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(text)
    whole = F.greatest(F.lit(64), F.ceil(size / 64) * 64)
    padded = F.concat(text, F.unhex(F.repeat(F.lit("00"), (whole - size).cast("int"))))
    docs = documents(spark, sf_dir).select("doc_id", size.cast("long").alias("n_bytes"), padded.alias("payload"))
    back = read_back(store(docs), joined="payload")
    read = back.select("doc_id", "n_bytes", "media", "payload", F.size("blocks").alias("n_blocks"), F.element_at("blocks", -1)["first_sample"].alias("last_block"))
    length = F.octet_length("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        length.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(" ", F.concat(F.lit("blocks="), F.col("n_blocks")), F.concat(F.lit("last="), F.col("last_block")), F.concat(F.lit("ratio="), F.format_number(F.octet_length("media") / length, 3))).alias("feature"),
    )
