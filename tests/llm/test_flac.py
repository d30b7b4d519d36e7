import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from askbook.llm import flac as M


def payloads():
    r = random.Random(5)
    out = [b"\xff" * 576, bytes(576), bytes(r.randrange(256) for _ in range(576 * 3)), b"the quick brown fox " * 1000 + b"\xff" * ((-20000) % 576)]
    out.append(bytes([0, 255] * 288 * 2))
    out.append(bytes(int(128 + 100 * np.sin(i / 9)) for i in range(576 * 130)))
    out.append(("é ñ ü word\n" * 500).encode()[: 576 * 9])
    out.append(bytes(200 if i % 97 == 0 else 128 for i in range(576 * 2)))
    return out


def test_round_trip_and_slow_decoder_agree():
    files = M.encode(payloads())
    assert files == M.encode(payloads())
    for p, f, (x, blocks, s, error) in zip(payloads(), files, M.decode(files)):
        assert error is None
        assert (x[:, 0] + 128).astype(np.uint8).tobytes() == p
        assert blocks == list(range(0, len(p), 576))
        slow = M._one_by_one(f, M.parse_stream(f))
        assert slow[3] is None and (slow[0] == x).all()
        for sample, offset, n in s["points"]:
            v, _ = M.decode_frame(f, s["frames"] + int(offset), s)
            assert (v[0] == x[sample : sample + n, 0]).all()
    assert sum(map(len, files)) < 1.1 * sum(map(len, payloads()))


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, v, n):
        self.bits += format(v & (1 << n) - 1, f"0{n}b") if n else ""

    def rice(self, r, k):
        u = r << 1 if r >= 0 else -2 * r - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)

    def done(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8))


def crc_plain(data, poly, width):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (width - 1) & 1 else c << 1) & (1 << width) - 1
    return c


def plain_file(x, subframes, channels=0, bits_code=1, bits=8, seek=True):
    """One-frame files of 576 samples; subframes(writer) writes what comes after the header."""
    head = bytes([0xFF, 0xF8, 0x24, channels << 4 | bits_code << 1, 0])
    head += bytes([crc_plain(head, 7, 8)])
    w = Writer()
    subframes(w)
    frame = head + w.done()
    frame += crc_plain(frame, 0x8005, 16).to_bytes(2, "big")
    x = np.array(x).reshape(-1, 576).T
    wide = -(-bits // 8)
    md5 = hashlib.md5(b"".join(int(v).to_bytes(wide, "little", signed=True) for v in x.ravel())).digest()
    info = struct.pack(">HH", 576, 576) + bytes(6) + (8000 << 44 | (x.shape[1] - 1) << 41 | (bits - 1) << 36 | 576).to_bytes(8, "big") + md5
    table = b"\x83\x00\x00\x12" + struct.pack(">QQH", 0, 0, 576) if seek else b"\x84\x00\x00\x00"
    return b"fLaC\x00\x00\x00\x22" + info + table + frame


@pytest.mark.parametrize("seek", [True, False])
@pytest.mark.parametrize("order,partition", [(1, 0), (3, 1), (8, 2), (12, 3)])
def test_general_linear_predictor(order, partition, seek):
    r = random.Random(order)
    weights, shift, precision = [r.randint(-9, 9) for _ in range(order)], 5, 6
    x, res = [r.randint(-20, 20) for _ in range(order)], []
    while len(x) < 576:
        guess = sum(w * x[-1 - i] for i, w in enumerate(weights)) >> shift
        v = max(-128, min(127, guess + r.randint(-6, 6)))
        res.append(v - guess)
        x.append(v)

    def sub(w):
        w.put(32 | order - 1, 7)
        w.put(0, 1)
        for v in x[:order]:
            w.put(v, 8)
        w.put(precision - 1, 4)
        w.put(shift, 5)
        for c in weights:
            w.put(c, precision)
        w.put(0, 2)
        w.put(partition, 4)
        at = 0
        for p in range(1 << partition):
            n = (576 >> partition) - (order if p == 0 else 0)
            w.put(2 + p % 2, 4)
            for v in res[at : at + n]:
                w.rice(v, 2 + p % 2)
            at += n

    f = plain_file(x, sub, seek=seek)
    (got, _, s, error), (slow, _, _, slow_error) = M.decode([f])[0], M._one_by_one(f, M.parse_stream(f))
    assert error is None and slow_error is None
    assert got[:, 0].tolist() == x == slow[:, 0].tolist()
    if seek:
        buf = np.frombuffer(f + bytes(600), np.uint8)
        assert M._side_by_side(buf, np.array([s["frames"]]), np.array([len(f)]))[1].all()


def test_escape_wasted_bits_and_long_codes():
    r = random.Random(3)
    x = [4 * r.randint(-30, 30) for _ in range(576)]

    def escaped(w):
        w.put(8, 7)
        w.put(1, 1)
        w.put(1, 2)  # two wasted bits
        w.put(0, 2)
        w.put(0, 4)
        w.put(15, 4)
        w.put(7, 5)
        for v in x:
            w.put(v >> 2, 7)

    def long_codes(w):
        w.put(8, 7)
        w.put(0, 1)
        w.put(0, 2)
        w.put(0, 4)
        w.put(0, 4)
        for v in x:
            w.rice(v, 0)

    for sub in (escaped, long_codes):
        got, _, _, error = M.decode([plain_file(x, sub)])[0]
        assert error is None and got[:, 0].tolist() == x


@pytest.mark.parametrize("mode", [8, 9, 10])
def test_stereo_decorrelation_16_bit(mode):
    r = random.Random(mode)
    left, right = ([r.randint(-3000, 3000) for _ in range(576)] for _ in range(2))
    side = [a - b for a, b in zip(left, right)]
    first, second = {8: (left, side), 9: (side, right), 10: ([(a + b) >> 1 for a, b in zip(left, right)], side)}[mode]

    def sub(w):
        for x, bits in ((first, 16 + (mode == 9)), (second, 16 + (mode != 9))):
            w.put(1, 7)
            w.put(0, 1)
            for v in x:
                w.put(v, bits)

    got, _, _, error = M.decode([plain_file(left + right, sub, mode, 4, 16)])[0]
    assert error is None and got[:, 0].tolist() == left and got[:, 1].tolist() == right


def test_damage_is_told():
    good = M.encode([b"some words here " * 36])[0]
    told = []
    for at in (0, len(good) - 300, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        told.append(M.decode([bytes(bad)])[0][3])
    told += [M.decode([x])[0][3] for x in (None, b"", b"fLaC", good[:-1], good[:60])]
    assert all(told), told
    start = M.parse_stream(good)["frames"]
    bad = bytearray(good)
    bad[start + 4] ^= 1
    assert "CRC-8" in M.decode([bytes(bad)])[0][3]


def test_text_media(spark):
    texts = [None, "", "a", "é" * 288, "x" * 576, "y" * 577, "long text " * 30000, "a"]
    rows = [(i, t, i) for i, t in enumerate(texts)]
    done = M.text_media(spark.createDataFrame(rows, "doc_id bigint, text string, pcm int"))
    for r in done.collect():
        raw = (texts[r.doc_id] or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, bytes(r.pcm), r.error) == (len(raw), len(want), want, None)
        assert zlib.crc32(bytes(r.pcm)[-32:]) == zlib.crc32(want[-32:])
    blocks = M.pcm_blocks(done, "doc_id").where("doc_id = 6").orderBy("block").collect()
    assert [b.first_sample for b in blocks] == list(range(0, 576 * len(blocks), 576))
    assert b"".join(bytes(b.pcm) for b in blocks)[: len(texts[6])] == texts[6].encode()
    assert M.text_media(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
