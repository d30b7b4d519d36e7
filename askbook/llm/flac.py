"""FLAC media columns: texts stored as losslessly coded samples, and FLAC bytes decoded to PCM blocks.

`store` writes payloads as mono 8-bit FLAC files of 576-sample frames (constant, verbatim, or fixed
linear predictors of order 0 to 4 with Rice-coded residuals in four partitions) with a seek point for
every frame. `decode_media` reads any FLAC bytes: it verifies each frame's CRC-8 and CRC-16 and the
stream's MD5, and gives whole PCM with the sample offset of every block; `pcm_blocks` makes these
blocks rows. Frames of the common shape (one channel, Rice residuals, fixed or general linear
predictors) are decoded side by side, one sample of every frame at a step; all others (stereo
decorrelation, wasted bits, escaped partitions, very long codes) one by one.

Null text counts as empty; an empty payload becomes one frame of padding. Null or damaged media give
null PCM and a reason in `error`. Equal payloads give equal bytes. Input columns of the names that an
operator adds are replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askbook.llm._util import map_rows, replaced, slices, with_fields

BLOCK = 576
RATE = 8000
PARTITIONS = 4
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for i in range(256):
        c = i << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.int64)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc(buf: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """The checksum of each range of the bytes, all ranges a byte at a step."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    value = np.zeros(len(start), np.int64)
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    mask = (1 << width) - 1
    for i, n in enumerate(live):
        v = value[:n]
        value[:n] = table[(v >> (width - 8)) ^ buf[start[:n] + i]] ^ ((v << 8) & mask)
    out = np.empty_like(value)
    out[order] = value
    return out


def coded_number(n: int) -> bytes:
    """A frame number in the UTF-8-like form of frame headers."""
    if n < 0x80:
        return bytes([n])
    extra = 1
    while n >= 1 << (6 - extra + 6 * extra):
        extra += 1
    lead = (0xFF << (7 - extra)) & 0xFF
    return bytes([lead | n >> (6 * extra)] + [0x80 | n >> (6 * i) & 0x3F for i in range(extra - 1, -1, -1)])


# ---- writing


def _subframes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subframes' bytes one after the other, and their sizes, for rows of 8-bit samples."""
    frames = len(x)
    diffs = [x.astype(np.int32)]
    for _ in range(4):
        diffs.append(np.diff(diffs[-1], axis=1))
    order = np.argmin(np.stack([np.abs(d[:, 4 - o :]).sum(1) for o, d in enumerate(diffs)]), axis=0)
    size = np.zeros(frames, np.int64)
    chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    constant = (x == x[:, :1]).all(1)
    plain = np.zeros(frames, bool)
    part = x.shape[1] // PARTITIONS
    for o in range(5):
        rows = np.flatnonzero((order == o) & ~constant)
        if not len(rows):
            continue
        r = diffs[o][rows]
        u = np.zeros((len(rows), x.shape[1]), np.int32)  # the warm-up stays zero
        u[:, o:] = (r << 1) ^ (r >> 31)
        per = u.reshape(len(rows), PARTITIONS, part)
        mean = per.sum(2, dtype=np.int64) / part
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
        ks = np.repeat(k.astype(np.int32), part, axis=1)
        q = u >> ks
        length = q + 1 + ks
        length[:, ::part] += 4
        length[:, :o] = 0
        length[:, 0] += 4 * (o > 0)
        end = np.cumsum(length, axis=1, dtype=np.int32) + np.int32(8 + 8 * o + 6)
        bits = end[:, -1].astype(np.int64)
        big = bits >= 8 * x.shape[1]
        plain[rows[big]] = True
        keep = ~big
        rows, u, ks, k, q, end, bits = rows[keep], u[keep], ks[keep], k[keep], q[keep], end[keep], bits[keep]
        if not len(rows):
            continue
        bytes_ = (bits + 7) // 8
        base = (np.cumsum(bytes_) - bytes_) * 8
        out = np.zeros(int(bytes_.sum()) * 8, np.uint8)

        def put(at: np.ndarray, value: np.ndarray, width: int, out=out) -> None:
            for j in range(width):
                out[at + j] = (value >> (width - 1 - j)) & 1

        put(base, np.full(len(rows), (8 | o) << 1), 8)
        for i in range(o):
            put(base + 8 + 8 * i, x[rows, i].astype(np.int64) & 255, 8)
        put(base + 8 + 8 * o, np.full(len(rows), PARTITIONS.bit_length() - 1), 6)
        for p in range(PARTITIONS):
            first = o if p == 0 else p * part
            put(base + end[:, first] - (q[:, first] + 1 + k[:, p]) - 4, k[:, p], 4)
        stop = (base[:, None] + (end - ks - 1))[:, o:].ravel()
        out[stop] = 1
        flat_u, flat_k = u[:, o:].ravel(), ks[:, o:].ravel()
        for width in np.unique(k).tolist():
            own = np.flatnonzero(flat_k == width)
            at, value = stop[own], flat_u[own]
            for j in range(width):
                out[at + (1 + j)] = (value >> (width - 1 - j)) & 1
        size[rows] = bytes_
        chunks.append((rows, bytes_, np.packbits(out)))
    rows = np.flatnonzero(constant)
    if len(rows):
        chunks.append((rows, np.full(len(rows), 2), np.stack([np.zeros(len(rows), np.uint8), x[rows, 0].view(np.uint8)], 1).ravel()))
        size[rows] = 2
    rows = np.flatnonzero(plain)
    if len(rows):
        chunks.append((rows, np.full(len(rows), 1 + x.shape[1]), np.concatenate([np.full((len(rows), 1), 2, np.uint8), x[rows].view(np.uint8)], 1).ravel()))
        size[rows] = 1 + x.shape[1]
    whole = np.empty(int(size.sum()), np.uint8)
    first = np.cumsum(size) - size
    for rows, sizes, data in chunks:
        whole[_ranges(first[rows], sizes)] = data
    return whole, size


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+size[0]-1, start[1] .. and so on."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC files of payloads whose sizes are positive multiples of 576; a byte b is the sample b - 128."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    if not len(counts):
        return []
    x = (np.frombuffer(b"".join(payloads), np.uint8) ^ 128).view(np.int8).reshape(-1, BLOCK)
    body, size = _subframes(x)
    number = _ranges(np.zeros(len(counts), np.int64), counts)
    numbers = [coded_number(n) for n in range(int(counts.max()))]
    head = np.zeros((len(number), 12), np.uint8)
    head[:, :4] = (0xFF, 0xF8, 0x24, 0x02)
    digits, width = np.zeros((len(numbers), 7), np.uint8), np.array([len(n) for n in numbers], np.int64)
    for i, n in enumerate(numbers):
        digits[i, : len(n)] = list(n)
    head[:, 4:11] = digits[number]
    head_size = 4 + width[number]
    at = np.arange(len(number)) * 12
    head[np.arange(len(number)), head_size] = crc(head.ravel(), at, head_size, CRC8, 8)
    head_size = head_size + 1
    frame_size = head_size + size + 2
    first = np.cumsum(frame_size) - frame_size
    out = np.zeros(int(frame_size.sum()), np.uint8)
    out[_ranges(first, head_size)] = head.ravel()[_ranges(at, head_size)]
    out[_ranges(first + head_size, size)] = body
    check = crc(out, first, frame_size - 2, CRC16, 16)
    out[first + frame_size - 2], out[first + frame_size - 1] = check >> 8, check & 255
    files, frame = [], 0
    for payload, n in zip(payloads, counts.tolist()):
        own = slice(frame, frame + n)
        points = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
        points["sample"], points["offset"], points["samples"] = np.arange(n) * BLOCK, first[own] - first[frame], BLOCK
        most = (1 << 24) // 18 - 1  # a metadata block's size has 24 bits; frames past these have no seek point
        points = points[:most]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(frame_size[own].min()).to_bytes(3, "big") + int(frame_size[own].max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK).to_bytes(8, "big")
        info += hashlib.md5(x[own].tobytes()).digest()
        files.append(b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + (18 * len(points)).to_bytes(3, "big") + points.tobytes() + out[first[frame] : first[frame] + int(frame_size[own].sum())].tobytes())
        frame += n
    return files


# ---- reading


class Bits:
    """Reads bits of a bytes object, from a bit position on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise ValueError("the data ends within a frame")
        v = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n)
        self.at += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _one_residual(b: Bits, n: int, order: int) -> list[int]:
    method = b.take(2)
    if method > 1:
        raise ValueError("reserved residual coding")
    wide, parts = 4 + method, 1 << b.take(4)
    if n % parts:
        raise ValueError("partitions don't divide the block")
    out: list[int] = []
    for p in range(parts):
        k, count = b.take(wide), n // parts - (order if p == 0 else 0)
        if k == (1 << wide) - 1:
            raw = b.take(5)
            out += [b.signed(raw) for _ in range(count)]
        else:
            for _ in range(count):
                u = b.zeros() << k | b.take(k)
                out.append(u >> 1 ^ -(u & 1))
    return out


def _one_subframe(b: Bits, n: int, bits: int) -> list[int]:
    if b.take(1):
        raise ValueError("a subframe begins with a one bit")
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.zeros() + 1
        bits -= wasted
    if kind == 0:
        x = [b.signed(bits)] * n
    elif kind == 1:
        x = [b.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind & 7 if kind < 32 else (kind & 31) + 1
        x, shift = [b.signed(bits) for _ in range(order)], 0
        if kind < 32:
            weights = FIXED[order]
        else:
            precision, shift = b.take(4) + 1, b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        for r in _one_residual(b, n, order):
            x.append(r + (sum(w * x[-1 - i] for i, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("reserved subframe type")
    return [v << wasted for v in x]


def parse_head(data: bytes, at: int, stream: dict) -> dict:
    """A frame's header; ValueError where no valid one begins."""
    b = Bits(data, at * 8)
    if b.take(14) != 0x3FFE or b.take(1):
        raise ValueError("no frame begins here")
    b.take(1)
    size, rate, channels, sample = b.take(4), b.take(4), b.take(4), b.take(3)
    if b.take(1) or not size or rate == 15 or channels > 10 or sample == 3:
        raise ValueError("reserved value in a frame header")
    lead = b.take(8)
    extra = next((i for i in range(8) if not lead >> (7 - i) & 1), 8)
    for _ in range(max(0, extra - 1)):
        if b.take(2) != 2:
            raise ValueError("bad frame number")
        b.take(6)
    n = 192 if size == 1 else 576 << (size - 2) if size < 6 else b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else 256 << (size - 8)
    if rate in (12, 13, 14):
        b.take(8 if rate == 12 else 16)
    end = b.at >> 3
    if int(crc(np.frombuffer(data, np.uint8), np.array([at]), np.array([end - at]), CRC8, 8)[0]) != b.take(8):
        raise ValueError("CRC-8")
    return {"n": n, "channels": channels, "bits": {0: stream["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[sample], "body": end + 1}


def decode_frame(data: bytes, at: int, stream: dict) -> tuple[np.ndarray, int]:
    """One frame's samples (channels by samples) and the place after it: any frame, a value at a time."""
    h = parse_head(data, at, stream)
    b, c = Bits(data, h["body"] * 8), h["channels"]
    count = c + 1 if c < 8 else 2
    x = [_one_subframe(b, h["n"], h["bits"] + ((c, i) in ((8, 1), (9, 0), (10, 1)))) for i in range(count)]
    end = (b.at + 7) >> 3
    told = int.from_bytes(data[end : end + 2], "big")
    if len(data) < end + 2 or told != int(crc(np.frombuffer(data, np.uint8), np.array([at]), np.array([end - at]), CRC16, 16)[0]):
        raise ValueError("CRC-16")
    v = np.array(x, np.int64)
    if c == 8:
        v[1] = v[0] - v[1]
    elif c == 9:
        v[0] = v[0] + v[1]
    elif c == 10:
        mid = (v[0] << 1) | (v[1] & 1)
        v = np.stack([(mid + v[1]) >> 1, (mid - v[1]) >> 1])
    return v, end + 2


def parse_stream(data: bytes) -> dict:
    """STREAMINFO, where the frames begin, and the seek points (sample, byte from the first frame, samples)."""
    if data[:4] != b"fLaC":
        raise ValueError("not FLAC")
    at, stream, points = 4, None, np.zeros((0, 3), np.int64)
    while True:
        if at + 4 > len(data):
            raise ValueError("the data ends within its metadata")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("the data ends within its metadata")
        if kind & 127 == 0:
            if size < 34:
                raise ValueError("short STREAMINFO")
            v = int.from_bytes(body[10:18], "big")
            stream = {"rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & (1 << 36) - 1, "md5": body[18:34]}
        elif kind & 127 == 3:
            p = np.frombuffer(body[: size // 18 * 18], np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
            p = p[p["sample"] < 1 << 62]
            points = np.stack([p["sample"].astype(np.int64), p["offset"].astype(np.int64), p["samples"].astype(np.int64)], 1)
        at += 4 + size
        if kind & 128:
            break
    if stream is None:
        raise ValueError("no STREAMINFO")
    return stream | {"frames": at, "points": points}


def _starts(data: bytes, s: dict) -> np.ndarray | None:
    """Where each frame begins, if the seek points tell of every frame without gap."""
    p = s["points"]
    if not len(p) or p[0, 0] or p[0, 1] or (p[1:, 0] != p[:-1, 0] + p[:-1, 2]).any() or p[-1, 0] + p[-1, 2] != s["samples"] or (np.diff(p[:, 1]) < 8).any() or s["frames"] + p[-1, 1] + 8 > len(data):
        return None
    return s["frames"] + p[:, 1]


def _side_by_side(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames by 576) of one-channel 8-bit frames, and which frames were read; the rest are for decode_frame."""
    F_, lanes = len(start), np.arange(len(start))
    head = buf[start[:, None] + np.arange(16)].astype(np.int64)
    lead = head[:, 4]
    extra = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, -1, 1, 2, 3, 4, 5], -1)
    ok = (head[:, 0] == 0xFF) & (head[:, 1] & 0xFE == 0xF8) & (head[:, 2] >> 4 == 2) & (head[:, 2] & 15 < 12) & (head[:, 3] == 2) & (extra >= 0)
    size = 5 + np.maximum(extra, 0)
    ok &= crc(buf, start, size, CRC8, 8) == head[lanes, size]
    ok &= crc(buf, start, end - start - 2, CRC16, 16) == (buf[end - 2].astype(np.int64) << 8 | buf[end - 1])
    body = start + size + 1
    kind = np.where(ok, buf[body].astype(np.int64), 255)
    out = np.zeros((F_, BLOCK), np.int64)
    rows = np.flatnonzero(kind == 0)
    out[rows] = (buf[body[rows] + 1] ^ 0).view(np.int8)[:, None]
    rows = np.flatnonzero(kind == 2)
    if len(rows):
        out[rows] = buf[(body[rows] + 1)[:, None] + np.arange(BLOCK)].view(np.int8)
    done = (kind == 0) | (kind == 2)
    fixed, general = (kind >= 16) & (kind <= 24) & (kind & 1 == 0), (kind >= 64) & (kind < 128) & (kind & 1 == 0)
    rows = np.flatnonzero(fixed | general)
    if not len(rows):
        return out, done
    order = np.where(general[rows], (kind[rows] >> 1 & 31) + 1, kind[rows] >> 1 & 7)
    words = np.ndarray((len(buf) - 8,), ">u8", buf, 0, (1,))
    limit = len(words) - 1

    def window(p: np.ndarray) -> np.ndarray:
        return words[np.minimum(p >> 3, limit)].astype(np.uint64) << (p & 7).astype(np.uint64)

    def take(p: np.ndarray, n) -> np.ndarray:
        return (window(p) >> (np.uint64(64) - np.asarray(n).astype(np.uint64))).astype(np.int64)

    def signed(v: np.ndarray, n) -> np.ndarray:
        return v - ((v >> (n - 1) & 1) << n)

    p = (body[rows] + 1) * 8
    most = int(order.max())
    warm = np.zeros((len(rows), most), np.int64)
    for i in range(most):
        on = order > i
        warm[on, i] = signed(take(p[on] + 8 * i, 8), 8)
    p = p + 8 * order
    weights, shift = np.zeros((len(rows), most), np.int64), np.zeros(len(rows), np.int64)
    for o in range(1, min(most, 4) + 1):
        weights[(order == o) & fixed[rows], :o] = FIXED[o]
    g = np.flatnonzero(general[rows])
    if len(g):
        precision, shift[g] = take(p[g], 4) + 1, signed(take(p[g] + 4, 5), 5)
        p[g] += 9
        for i in range(most):
            on = g[order[g] > i]
            n = precision[order[g] > i]
            weights[on, i] = signed(take(p[on], n), n)
            p[on] += n
    method, split = take(p, 2), take(p + 2, 4)
    p = p + 6
    part = BLOCK >> split
    good = (method == 0) & ((part << split) == BLOCK) & (order <= part) & (shift >= 0)
    part = np.maximum(part, 1)
    residual = np.zeros((BLOCK, len(rows)), np.int64)
    k = np.zeros(len(rows), np.int64)
    one, top = np.uint64(1), np.uint64(64)
    bounds = set(np.unique(np.concatenate([np.arange(0, BLOCK, int(x)) for x in np.unique(part)])).tolist()) | set(np.unique(order).tolist())
    uneven = bool((order != order[0]).any())
    for i in range(int(order.min()), BLOCK):
        if i in bounds:  # a partition begins for some; the first begins after the warm-up
            begins = ((i % part == 0) & (i > order)) | (i == order)
            k = np.where(begins, take(p, 4), k)
            p = p + 4 * begins
            good &= k < 15
            ku = k.astype(np.uint64)
        w = window(p)
        q = 1075 - ((w >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52)
        step = q + 1 + k
        rest = ((w << (q.astype(np.uint64) + one)) >> (top - ku)).astype(np.int64)
        u = (q << k) | rest
        if uneven and i < most:
            live = order <= i
            u, step = np.where(live, u, 0), np.where(live, step, 0)
        if int(step.max()) > 57:
            good &= step <= 57
            step = np.minimum(step, 57)
        residual[i] = (u >> 1) ^ -(u & 1)
        p = p + step
    good &= p <= (end[rows] - 2) * 8
    x = np.ascontiguousarray(residual.T)
    for o in np.unique(order[~general[rows]]) if (~general[rows]).any() else []:
        own = np.flatnonzero((order == o) & ~general[rows])
        v = x[own, o:]
        seeds = [warm[own, :o]]
        for _ in range(o):
            seeds.append(np.diff(seeds[-1], axis=1))
        for d in range(o - 1, -1, -1):
            v = np.cumsum(v, axis=1) + seeds[d][:, -1:]
        x[own, o:] = v
        x[own, :o] = warm[own, :o]
    for o in np.unique(order[g]) if len(g) else []:
        own = g[order[g] == o]
        v, back, s = x[own].T.copy(), weights[own, :o].T[::-1], shift[own]
        v[:o] = warm[own, :o].T
        for i in range(o, BLOCK):
            v[i] += (back * v[i - o : i]).sum(0) >> s
        x[own] = v.T
    good &= ((x >= -128) & (x <= 127)).all(1)
    out[rows[good]] = x[good]
    done[rows[good]] = True
    return out, done


def decode(files: list[bytes | None]) -> list[tuple[np.ndarray | None, list[int], dict, str | None]]:
    """For each file its samples (samples by channels), the blocks' first samples, STREAMINFO and what is wrong with it."""
    out: list = [None] * len(files)
    quick, first, last, owner = [], [], [], []
    base, pieces = 0, []
    for i, data in enumerate(files):
        if data is None:
            out[i] = (None, [], {}, "null")
            continue
        try:
            s = parse_stream(data)
            starts = _starts(data, s) if s["channels"] == 1 and s["bits"] == 8 else None
            if starts is None or (s["points"][:, 2] != BLOCK).any():
                out[i] = _one_by_one(data, s)
                continue
            quick.append((i, s, starts))
            first.append(starts + base)
            last.append(np.append(starts[1:], len(data)) + base)
            owner.append(len(starts))
            pieces.append(data)
            base += len(data)
        except ValueError as e:
            out[i] = (None, [], {}, str(e))
    if quick:
        buf = np.frombuffer(b"".join(pieces) + bytes(BLOCK + 16), np.uint8)
        x, done = _side_by_side(buf, np.concatenate(first), np.concatenate(last))
        at = 0
        for (i, s, starts), n in zip(quick, owner):
            own, fine = x[at : at + n], done[at : at + n]
            at += n
            error = None
            for j in np.flatnonzero(~fine):
                try:
                    v, _ = decode_frame(files[i], int(starts[j]), s)
                    if v.shape != (1, BLOCK):
                        raise ValueError("its size is not as the seek table tells")
                    own[j] = v[0]
                except ValueError as e:
                    error = f"frame {j}: {e}"
                    break
            pcm = own.reshape(-1, 1)
            out[i] = (None, [], s, error) if error else _verified(pcm, (np.arange(n) * BLOCK).tolist(), s)
    return out


def _verified(pcm: np.ndarray, blocks: list[int], s: dict) -> tuple:
    wide = -(-s["bits"] // 8)
    if s["samples"] and len(pcm) != s["samples"]:
        return None, [], s, "number of samples"
    if any(s["md5"]):
        raw = pcm.astype(np.int8).tobytes() if wide == 1 else np.ascontiguousarray(pcm, "<i8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
        if hashlib.md5(raw).digest() != s["md5"]:
            return None, [], s, "MD5"
    return pcm, blocks, s, None


def _one_by_one(data: bytes, s: dict) -> tuple:
    at, parts, blocks, n = s["frames"], [], [], 0
    try:
        while at < len(data):
            v, at = decode_frame(data, at, s)
            blocks.append(n)
            n += v.shape[1]
            parts.append(v.T)
    except ValueError as e:
        return None, [], s, f"frame {len(blocks)}: {e}"
    return _verified(np.concatenate(parts) if parts else np.zeros((0, s["channels"]), np.int64), blocks, s)


# ---- operators


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_bytes (of the text in UTF-8), payload_bytes (padded with 255) and media (FLAC)."""
    schema = with_fields(docs.schema, ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("media", "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(b.schema.names.index(text)).to_pylist()]
            padded = [r + b"\xff" * (-len(r) % BLOCK if r else BLOCK) for r in raw]
            yield replaced(b, schema, {"n_bytes": pa.array([len(r) for r in raw], pa.int64()), "payload_bytes": pa.array([len(p) for p in padded], pa.int64()), "media": pa.array(encode(padded), pa.binary())})

    return map_rows(docs, run, schema)


def feature(x: np.ndarray) -> str:
    """Whole-number features of a signal: mean and mean square in thousandths, zero crossings, peak."""
    v = x.ravel()
    n = max(1, len(v))
    up = v >= 0
    return f"mean={int(v.sum()) * 1000 // n};power={int((v * v).sum()) * 1000 // n};crossings={int((up[1:] != up[:-1]).sum())};peak={int(np.abs(v).max()) if len(v) else 0}"


def decode_media(rows: DataFrame, media: str = "media") -> DataFrame:
    """The rows with pcm (little-endian, interleaved; 8-bit samples unsigned), block_starts, sample_bytes, feature and error."""
    schema = with_fields(rows.schema, ("pcm", "binary"), ("block_starts", "array<bigint>"), ("sample_bytes", "int"), ("feature", "string"), ("error", "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            pcm, starts, wide, told, errors = [], [], [], [], []
            for x, blocks, s, error in decode(b.column(b.schema.names.index(media)).to_pylist()):
                errors.append(error)
                starts.append(None if x is None else blocks)
                told.append(None if x is None else feature(x))
                n = None if x is None else -(-s["bits"] // 8)
                wide.append(None if n is None else n * s["channels"])
                pcm.append(None if x is None else (x + 128).astype(np.uint8).tobytes() if n == 1 else np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes())
            yield replaced(b, schema, {"pcm": pa.array(pcm, pa.binary()), "block_starts": pa.array(starts, pa.list_(pa.int64())), "sample_bytes": pa.array(wide, pa.int32()), "feature": pa.array(told, pa.string()), "error": pa.array(errors, pa.string())})

    return map_rows(rows, run, schema)


def pcm_blocks(decoded: DataFrame, key: str) -> DataFrame:
    """A row for each block: key, block, first_sample, n_samples and its pcm."""
    total = F.length("pcm").cast("bigint") / F.col("sample_bytes")
    dealt = decoded.where("pcm IS NOT NULL").select(key, "pcm", "sample_bytes", total.cast("bigint").alias("total"), "block_starts", F.posexplode("block_starts").alias("block", "first_sample"))
    ended = dealt.withColumn("n_samples", F.coalesce(F.try_element_at("block_starts", F.col("block") + F.lit(2)), F.col("total")) - F.col("first_sample"))
    return ended.select(key, "block", "first_sample", "n_samples", F.expr("substring(pcm, cast(first_sample * sample_bytes + 1 as int), cast(n_samples * sample_bytes as int))").alias("pcm"))


def text_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts stored as FLAC and read back: the rows with everything that store and decode_media add."""
    return decode_media(store(docs, text))
