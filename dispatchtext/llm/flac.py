"""FLAC streams of 8-bit mono samples: a vectorised encoder and decoder over many frames at once.

Bytes are unsigned 8-bit samples, as in a WAV file, so any FLAC reader gives the payload back. Every frame holds
BLOCK samples and has its own seek point, so any frame can be decoded alone. The encoder picks constant, verbatim
or a fixed linear predictor with Rice-coded residuals; the decoder also reads quantised linear predictors (LPC),
partitioned Rice parameters, escaped partitions and wasted bits. Both work on lanes: step t handles sample t of all
frames of a chunk; frames with escapes or wasted bits, which are rare, are read one by one.
"""

from __future__ import annotations

import hashlib
import struct
from functools import cache, lru_cache

import numpy as np

BLOCK = 576
RATE = 8000
#: Frames per vectorised step of the encoder and of the decoder: bounds memory whatever the size of a text.
CHUNK, LANES = 1024, 4096

#: Fixed values of the format: the coefficients of the fixed predictors by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


#: What a byte is above its signed sample.
MIDDLE = 128


@cache
def _crc_table(poly: int, bits: int) -> np.ndarray:
    out, top, full = [], 1 << (bits - 1), (1 << bits) - 1
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & full
        out.append(c)
    return np.array(out, np.uint16)


def crc8(data: bytes) -> int:
    table, c = _crc_table(0x07, 8), 0
    for b in data:
        c = int(table[c ^ b])
    return c


def crc16_rows(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of flat[starts:ends] for each row; leading zeros do not change it, so rows are aligned at their ends."""
    width = int((ends - starts).max(initial=0))
    at = ends[:, None] - width + np.arange(width)
    rows = np.where(at >= starts[:, None], flat[np.maximum(at, 0)], 0).astype(np.uint8).T.copy()
    table, c = _crc_table(0x8005, 16), np.zeros(len(starts), np.uint16)
    for column in rows:
        c = (c << 8) ^ table[(c >> 8) ^ column]
    return c


@lru_cache(1 << 16)
def _header(number: int) -> bytes:
    """Frame header: sync, 576 samples, 8 kHz, mono, 8 bits, the frame's number, CRC-8."""
    if number < 0x80:
        coded = bytes([number])
    else:
        tail = []
        rest, room = number, 6
        while rest >= 1 << room:
            tail.append(0x80 | rest & 0x3F)
            rest, room = rest >> 6, room - 1
        coded = bytes([(0xFF << (room + 1)) & 0xFF | rest, *tail[::-1]])
    head = bytes([0xFF, 0xF8, 0x24, 0x02]) + coded
    return head + bytes([crc8(head)])


def _residual(x: np.ndarray, order: int) -> np.ndarray:
    r = x
    for _ in range(order):
        r = np.diff(r, axis=1)
    return r


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of samples x (n, BLOCK) in -128..127 with the given frame numbers."""
    n = len(x)
    x = x.astype(np.int16)
    zig = [((r << 1) ^ (r >> 15)).astype(np.uint16) for r in (_residual(x, o) for o in range(3))]
    sums = np.stack([z.sum(1, dtype=np.int64) for z in zig])
    order = np.argmin(sums, axis=0)
    count = BLOCK - order
    guess = np.clip(np.log2(np.maximum(sums[order, np.arange(n)] / count * 0.7, 1)).astype(np.int64), 0, 13)
    codes = np.zeros((n, BLOCK), np.uint16)
    for o in range(3):
        codes[order == o, o:] = zig[o][order == o]
    cost = np.stack([(codes >> k[:, None]).sum(1, dtype=np.int64) + count * (k + 1) for k in (guess, guess + 1)])
    k = guess + np.argmin(cost, axis=0)
    bits = cost.min(0) + 10 + 8 * order
    kind = np.where((x == x[:, :1]).all(1), 0, np.where(bits < 8 * BLOCK, 2, 1))  # constant, verbatim, fixed
    heads = [_header(int(i)) for i in numbers]
    head_len = np.fromiter(map(len, heads), np.int64, n)
    body = np.select([kind == 0, kind == 1], [8, 8 * BLOCK], bits)
    size = head_len + 1 + (body + 7) // 8 + 2
    ends = np.cumsum(size)
    starts = ends - size
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    flat_heads = np.frombuffer(b"".join(heads), np.uint8)
    at = np.repeat(starts - (np.cumsum(head_len) - head_len), head_len) + np.arange(len(flat_heads))
    out[at] = flat_heads
    sub = starts + head_len
    out[sub] = np.select([kind == 0, kind == 1], [0x00, 0x02], (8 + order) << 1)
    raw = x.astype(np.int8).view(np.uint8)
    out[sub[kind == 0] + 1] = raw[kind == 0, 0]
    verbatim = np.flatnonzero(kind == 1)
    if len(verbatim):
        out[(sub[verbatim] + 1)[:, None] + np.arange(BLOCK)] = raw[verbatim]
    rice = np.flatnonzero(kind == 2)
    if len(rice):
        o, kk = order[rice], k[rice]
        pos = 8 * (sub[rice] + 1)
        for j in range(2):  # warm-up samples
            some = o > j
            out[sub[rice[some]] + 1 + j] = raw[rice[some], j]
        pos = pos + 8 * o  # then method 0, partition order 0 and the parameter: 10 bits
        u = codes[rice].astype(np.int32)
        k32 = kk.astype(np.int32)[:, None]
        q = u >> k32
        length = q + 1 + k32
        skipped = np.arange(BLOCK) < o[:, None]
        length[skipped] = 0
        one = np.cumsum(length, axis=1, dtype=np.int64) - length + q + (pos + 10)[:, None]
        code = (1 << k32) | (u & ((1 << k32) - 1))  # the stop bit and the low bits
        code[skipped] = 0
        at, size_k = np.concatenate((one.ravel(), pos)), np.concatenate((np.repeat(kk, BLOCK) + 1, np.full(len(kk), 10)))
        value = np.concatenate((code.ravel(), kk)).astype(np.int64) << (24 - (at & 7) - size_k)
        first = at >> 3
        base = int(first.min())
        total = np.zeros(len(out) + 3 - base)  # codes share bytes but no bits, so sums are unions
        for j in range(3):
            part = np.bincount(first - base, weights=(value >> (16 - 8 * j)) & 0xFF, minlength=len(out) - base)
            total[j : j + len(part)] += part
        out[base:] |= total[: len(out) - base].astype(np.uint8)
    crc = crc16_rows(out, starts, ends - 2)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 0xFF
    data = out.tobytes()
    return [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload; sizes are positive multiples of BLOCK."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    owners = np.repeat(np.arange(len(payloads)), [len(p) // BLOCK for p in payloads])
    numbers = np.concatenate([np.arange(len(p) // BLOCK) for p in payloads]) if payloads else np.empty(0, np.int64)
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    for i in range(0, len(flat), CHUNK):
        made = encode_frames(flat[i : i + CHUNK].astype(np.int16) - MIDDLE, numbers[i : i + CHUNK])
        for owner, frame in zip(owners[i : i + CHUNK].tolist(), made):
            frames[owner].append(frame)
    return [_stream(p, f) for p, f in zip(payloads, frames)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    signed = (np.frombuffer(payload, np.uint8) ^ np.uint8(MIDDLE)).tobytes()
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    points = np.zeros(len(frames), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
    points["sample"], points["offset"], points["n"] = np.arange(len(frames)) * BLOCK, np.cumsum(sizes) - sizes, BLOCK
    table = points.tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


def parse(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """(samples, MD5, byte offsets of the frames, end) of a stream whose seek table names every frame."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, digest, offsets = 4, False, 0, b"", np.empty(0, np.int64)
    while not last:
        last, kind, size = bool(stream[at] >> 7), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            bits = int.from_bytes(block[10:18], "big")
            if bits >> 41 & 7 or (bits >> 36 & 31) != 7:
                raise ValueError("only mono streams of 8-bit samples are read")
            total, digest = bits & (1 << 36) - 1, block[18:34]
        elif kind == 3:
            offsets = np.frombuffer(block, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))["o"].astype(np.int64)
    return total, digest, offsets + at, len(stream)


def _predict(warm: np.ndarray, residual: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Undo a linear predictor on lanes: coefs (lanes, order), newest sample first."""
    order = coefs.shape[1]
    x = residual.copy()
    x[:, :order] = warm
    for t in range(order, x.shape[1]):
        x[:, t] += (coefs * x[:, t - order : t][:, ::-1]).sum(1) >> shift
    return x


class _Bits:
    """Lane-wise reading from one array of bits."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate((data, np.zeros(80, np.uint8)))  # lanes that end early read on a little
        wide = padded.astype(np.uint64)
        self.word = (wide[:-4] << 32) | (wide[1:-3] << 24) | (wide[2:-2] << 16) | (wide[3:-1] << 8) | wide[4:]

    def take(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned values of up to 32 bits at bit offsets."""
        shift = 40 - (at & 7) - width
        return (self.word[at >> 3].astype(np.int64) >> shift) & ((1 << np.asarray(width, np.int64)) - 1)


def _rice(bits: _Bits, at: np.ndarray, order: np.ndarray, partition: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of lanes with the same partition order (same predictor order too, if partitioned), and which lanes hold an escape."""
    steps = BLOCK - int(order.min(initial=0))
    out = np.zeros((steps, len(at)), np.int64)
    span, first, size = BLOCK >> partition, int(order[0]), 5 if wide else 4
    limit = 8 * (len(bits.word) - 1)
    escaped = np.zeros(len(at), bool)
    for t in range(steps):
        if t == 0 or partition and (t + first) % span == 0:
            k = bits.take(at, size)
            at = at + size
            escaped |= k == (1 << size) - 1
            mask = (np.int64(1) << k) - 1
        word = bits.word[at >> 3] << (24 + (at & 7)).astype(np.uint64)  # at least 33 bits, from the top
        q = 64 - np.frexp(word.astype(np.float64))[1].astype(np.int64)
        if int((q + k).max()) <= 32 and word.all():
            low = (word >> (63 - q - k).astype(np.uint64)).astype(np.int64) & mask
        else:
            q = np.where(word == 0, 33, q)
            far = np.flatnonzero(word == 0)
            while len(far):  # long runs of zeros
                more = bits.word[np.minimum(at[far] + q[far], limit) >> 3] << (24 + ((at[far] + q[far]) & 7)).astype(np.uint64)
                q[far] += np.where(more == 0, 33, 64 - np.frexp(more.astype(np.float64))[1])
                far = far[(more == 0) & (at[far] + q[far] < limit)]
            low = bits.take(np.minimum(at + q + 1, limit), k)
        out[t] = q << k | low
        at = np.minimum(at + q + 1 + k, limit)
    out = (out >> 1) ^ -(out & 1)
    x = np.zeros((len(at), BLOCK), np.int64)
    for o in np.unique(order):
        x[order == o, o:] = out[: BLOCK - o, order == o].T
    return x, escaped


def decode_alone(subframe: bytes) -> list[int]:
    """Samples of one subframe of BLOCK samples, bit by bit: every kind that the format knows."""
    bits, at = int.from_bytes(subframe, "big"), 8 * len(subframe)

    def take(n: int) -> int:
        nonlocal at
        at -= n
        if at < 0:
            raise ValueError("a subframe ends early")
        return bits >> at & ((1 << n) - 1)

    def signed(n: int) -> int:
        v = take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary() -> int:
        n = 0
        while not take(1):
            n += 1
        return n

    take(1)
    kind = take(6)
    wasted = unary() + 1 if take(1) else 0
    width = 8 - wasted
    if kind == 0:
        x = [signed(width)] * BLOCK
    elif kind == 1:
        x = [signed(width) for _ in range(BLOCK)]
    else:
        order = kind - 31 if kind >= 32 else kind - 8
        if not 0 <= order <= (32 if kind >= 32 else 4):
            raise ValueError("a reserved kind of subframe")
        x = [signed(width) for _ in range(order)]
        coefs, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision, shift = take(4) + 1, signed(5)
            coefs = [signed(precision) for _ in range(order)]
        size = 5 if take(2) else 4
        parts = 1 << take(4)
        for part in range(parts):
            k = take(size)
            raw = take(5) if k == (1 << size) - 1 else None
            for _ in range(BLOCK // parts - (0 if part else order)):
                if raw is None:
                    u = unary() << k
                    u |= take(k)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = signed(raw)
                x.append(r + (sum(c * v for c, v in zip(coefs, x[: -order - 1 : -1])) >> shift if order else 0))
    return [v << wasted for v in x]


def decode_frames(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Samples (n, BLOCK) of frames flat[starts:ends]; checks sync, both checksums and the block size."""
    n = len(starts)
    x = np.zeros((n, BLOCK), np.int64)
    if not n:
        return x
    if crc16_rows(flat, starts, ends).any():
        raise ValueError("a frame's CRC-16 is wrong")
    if not ((flat[starts] == 0xFF) & (flat[starts + 1] == 0xF8) & (flat[starts + 2] >> 4 == 2)).all():
        raise ValueError("not a frame of 576 samples")
    lead = flat[starts + 4]
    head = 5 + np.where(lead < 0x80, 1, np.select([lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [2, 3, 4, 5, 6], 7))
    for size in np.unique(head):
        rows = np.flatnonzero(head == size)
        c = np.zeros(len(rows), np.uint16)
        for j in range(size):
            c = _crc_table(0x07, 8)[c ^ flat[starts[rows] + j]]
        if c.any():
            raise ValueError("a frame header's CRC-8 is wrong")
    sub = starts + head
    kind = flat[sub].astype(np.int64) >> 1
    alone = (flat[sub] & 1) == 1  # wasted bits
    constant, verbatim = (kind == 0) & ~alone, (kind == 1) & ~alone
    x[constant] = flat[sub[constant] + 1].view(np.int8)[:, None]
    if verbatim.any():
        x[verbatim] = flat[(sub[verbatim] + 1)[:, None] + np.arange(BLOCK)].view(np.int8)
    order = np.where(kind >= 32, kind - 31, kind - 8)
    coded = ~constant & ~verbatim & ~alone
    if coded.any():
        bits = _Bits(flat)
        at = 8 * (sub + 1) + 8 * np.where(coded, order, 0)
        coefs, shift = np.zeros((n, 32), np.int64), np.zeros(n, np.int64)
        for o in range(1, 5):
            coefs[kind == 8 + o, :o] = FIXED[o]
        for value in np.unique(kind[kind >= 32]):
            lanes, o = np.flatnonzero(kind == value), int(value) - 31
            pos = at[lanes]
            precision, shift[lanes] = bits.take(pos, 4) + 1, bits.take(pos + 4, 5)
            got = np.stack([bits.take(pos + 9 + j * precision, precision) for j in range(o)], axis=1)
            coefs[lanes, :o] = got - ((got >> (precision[:, None] - 1)) << precision[:, None])
            at[lanes] = pos + 9 + o * precision
        lanes = np.flatnonzero(coded)
        method, partition = bits.take(at[lanes], 2), bits.take(at[lanes] + 2, 4)
        joint = method * 16 + partition + np.where(partition > 0, 64 * order[lanes], 0)
        for value in np.unique(joint):
            some = lanes[joint == value]
            residual, escaped = _rice(bits, at[some] + 6, order[some], int(value) % 16, bool(value // 16 % 4))
            alone[some[escaped]] = True
            for o in np.unique(order[some]):
                own = order[some] == o
                rows, r = some[own], residual[own]
                warm = flat[(sub[rows] + 1)[:, None] + np.arange(o)].view(np.int8).astype(np.int64)
                simple = o <= 2 and (kind[rows] < 32).all()
                if simple:  # the first differences run backwards: sums
                    if o == 2:
                        r[:, 1] = warm[:, 1] - warm[:, 0]
                        r[:, 1:] = np.cumsum(r[:, 1:], axis=1)
                    if o:
                        r[:, 0] = warm[:, 0]
                        r = np.cumsum(r, axis=1)
                    x[rows] = r
                else:
                    x[rows] = _predict(warm, r, coefs[rows, :o], shift[rows])
    for i in np.flatnonzero(alone).tolist():
        x[i] = decode_alone(flat[sub[i] : ends[i] - 2].tobytes())
    return x


def _bytes(samples: np.ndarray) -> np.ndarray:
    return samples.astype(np.int8).view(np.uint8) ^ np.uint8(MIDDLE)


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams, checked against frame checksums and the stream's MD5."""
    heads = [parse(s) for s in streams]
    bases = np.cumsum([0, *map(len, streams)])
    flat = np.frombuffer(b"".join(streams), np.uint8)
    starts = np.concatenate([h[2] + b for h, b in zip(heads, bases)]) if heads else np.empty(0, np.int64)
    ends = np.concatenate([np.append(h[2][1:], h[3]) + b for h, b in zip(heads, bases)]) if heads else np.empty(0, np.int64)
    out = np.empty((len(starts), BLOCK), np.int8)
    for i in range(0, len(starts), LANES):
        s, e = starts[i : i + LANES], ends[i : i + LANES]
        low = int(s[0])
        out[i : i + LANES] = decode_frames(flat[low : int(e[-1])], s - low, e - low)
    result, at = [], 0
    for total, digest, offsets, _ in heads:
        block = out[at : at + len(offsets)]
        at += len(offsets)
        if len(block) * BLOCK != total or hashlib.md5(block.tobytes()).digest() != digest:
            raise ValueError("the stream's MD5 is wrong")
        result.append(_bytes(block).tobytes())
    return result


def seek(stream: bytes, sample: int, count: int) -> bytes:
    """Payload bytes [sample, sample + count): only the frames that hold them are decoded."""
    _, _, offsets, end = parse(stream)
    first, last = sample // BLOCK, -(-(sample + count) // BLOCK)
    starts, ends = offsets[first:last], np.append(offsets, end)[first + 1 : last + 1]
    block = _bytes(decode_frames(np.frombuffer(stream, np.uint8), starts, ends)).tobytes()
    return block[sample - first * BLOCK :][:count]
