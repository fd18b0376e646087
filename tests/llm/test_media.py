"""Progressive JPEG: exact round trips, and a general file made by a plain encoder."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from leafwright.llm import jpegcol as j


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 384, 385, 5000, 70_000])
def test_payload_round_trip(n):
    data = random.Random(n).randbytes(n)
    picture = j.Picture(j.encode(j.padded(data), n))
    assert picture.payload() == j.padded(data) and len(j.padded(data)) % 64 == 0
    assert picture.rgb().shape == (picture.height, picture.width, 3)


@pytest.mark.parametrize("data", [b"\xff" * 1000, b"\0" * 777, bytes(range(256)) * 9])
def test_extreme_payloads(data):
    assert j.Picture(j.encode(j.padded(data), len(data))).payload() == j.padded(data)


class Plain:
    """Scans of a grey picture, symbol by symbol, with codes of eight bits for every symbol."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def number(self, v):
        size = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def closed(self):
        return j._closed(np.array(self.bits, np.uint8))


def scan(first, last, high, low, data):
    return j._segment(0xDA, bytes([1, 1, 0, first, last, high << 4 | low])) + data


def halved(v, low):
    return v >> low if v >= 0 else -(-v >> low)


def plain_file(blocks, columns, rows):
    code = {s: k for k, s in enumerate(range(255))}
    table = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))
    out = [b"\xff\xd8", j._segment(0xDB, b"\0" + bytes(range(1, 65))), j._segment(0xC2, bytes([8, 0, rows * 8 - 3, 0, columns * 8 - 5, 1, 1, 0x11, 0])), j._segment(0xC4, b"\0" + table + b"\x10" + table)]
    p, before = Plain(), 0
    for b in blocks:
        v = int(b[0]) >> 1
        d, before = v - before, v
        p.put(code[abs(d).bit_length()], 8)
        if d:
            p.number(d)
    out.append(scan(0, 0, 0, 1, p.closed()))
    for first, last in ((1, 5), (6, 63)):
        p = Plain()
        run = 0
        for n, b in enumerate(blocks):
            zeros, some = 0, [halved(int(v), 2) for v in b[first : last + 1]]
            end = max([k for k, v in enumerate(some) if v], default=-1) + 1
            if end:
                if run:
                    k = run.bit_length() - 1
                    p.put(code[k << 4], 8)
                    p.put(run - (1 << k), k)
                    run = 0
                for v in some[:end]:
                    if not v:
                        zeros += 1
                        continue
                    while zeros > 15:
                        p.put(code[0xF0], 8)
                        zeros -= 16
                    p.put(code[zeros << 4 | abs(v).bit_length()], 8)
                    p.number(v)
                    zeros = 0
            if end < len(some):
                run += 1
        if run:
            k = run.bit_length() - 1
            p.put(code[k << 4], 8)
            p.put(run - (1 << k), k)
        out.append(scan(first, last, 0, 2, p.closed()))
    for low in (1, 0):
        p = Plain()
        for b in blocks:
            now, old = [halved(int(v), low) for v in b[1:]], [halved(int(v), low + 1) for v in b[1:]]
            fresh = max([k for k in range(63) if now[k] and not old[k]], default=-1)
            zeros, waiting = 0, []
            for k in range(63):
                if k > fresh:
                    break
                if old[k]:
                    waiting.append(abs(now[k]) & 1)
                elif not now[k]:
                    zeros += 1
                    if zeros == 16:
                        p.put(code[0xF0], 8)
                        for x in waiting:
                            p.put(x, 1)
                        zeros, waiting = 0, []
                else:
                    p.put(code[zeros << 4 | 1], 8)
                    p.put(int(now[k] > 0), 1)
                    for x in waiting:
                        p.put(x, 1)
                    zeros, waiting = 0, []
            if fresh < 62:
                p.put(code[0], 8)
                for x in waiting:
                    p.put(x, 1)
                for k in range(fresh + 1, 63):
                    if old[k]:
                        p.put(abs(now[k]) & 1, 1)
        out.append(scan(1, 63, low + 1, low, p.closed()))
        if low:
            p = Plain()
            for b in blocks:
                p.put(int(b[0]) & 1, 1)
            out.append(scan(0, 0, 1, 0, p.closed()))
    return b"".join([*out, b"\xff\xd9"])


def test_general_progressive_file():
    rng = np.random.default_rng(3)
    blocks = (rng.normal(0, 40, (12, 64)) * (rng.random((12, 64)) < 0.3)).astype(int)
    blocks[:, 0] = rng.integers(-200, 200, 12)
    blocks[5, 1:] = 0
    blocks[7, 1:] = rng.integers(4, 200, 63)
    picture = j.Picture(plain_file(blocks, 4, 3))
    assert (picture.height, picture.width) == (21, 27)
    assert (picture.coefficients[0] == blocks).all()
    assert picture.rgb().shape == (21, 27, 3)


def test_cosines_are_orthonormal():
    assert np.abs(j._COSINES @ j._COSINES.T - np.eye(64)).max() < 1e-5


def test_upsampled_chroma():
    picture = j.Picture(j.encode(b"\0" * 384, 384))
    for c, value in zip(picture.coefficients, (0, 80, -80)):
        c[:] = 0
        c[:, 0] = value
    assert len(np.unique(picture.rgb().reshape(-1, 3), axis=0)) == 1


def test_digests(odd):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    rows = j.media_digests(odd).collect()
    assert len(rows) == 9
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        whole = j.padded(data)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["tail_crc32"] == zlib.crc32(whole[-64:])
    assert len({tuple(r)[1:] for r in rows if r["doc_id"] == 1}) == 1 and len({r["feature"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert j.media_digests(odd.limit(0)).count() == 0


def test_store_and_load(odd):
    back = {r["doc_id"]: r for r in j.load(j.store(odd)).collect()}
    digests = {r["doc_id"]: r["rgb_sha256"] for r in j.media_digests(odd).collect()}
    assert all(hashlib.sha256(r["rgb"]).hexdigest() == digests[d] for d, r in back.items())
    assert bytes(back[8]["payload"]).rstrip(b"\0").decode().startswith("ß") and len(back[8]["rgb"]) == 3 * back[8]["width"] * back[8]["height"]


def test_rgb_is_a_plain_inverse_transform():
    """Samples by the definition of the inverse cosine transform, colour by the usual matrix, one pixel at a time."""
    import math

    picture = j.Picture(j.encode(j.padded(bytes(range(7, 190)) * 2), 366))
    rgb = picture.rgb()
    order = j._zigzag()
    scale = lambda k: math.sqrt(0.5) if k == 0 else 1.0

    def sample(c, y, x):
        h, v = picture.sampling[c]
        y, x = y * v // picture.most[1], x * h // picture.most[0]
        across = picture.columns * h
        block = picture.coefficients[c][(y // 8) * across + x // 8]
        total = 0.0
        for k in range(64):
            u, w = int(order[k]) % 8, int(order[k]) // 8
            total += scale(u) * scale(w) / 4 * float(block[k]) * float(picture.quant[c][k]) * math.cos((2 * (x % 8) + 1) * u * math.pi / 16) * math.cos((2 * (y % 8) + 1) * w * math.pi / 16)
        return min(255.0, max(0.0, total + 128))

    for y, x in ((0, 0), (picture.height - 1, picture.width - 1), (picture.height // 2, 3), (5, picture.width // 2)):
        a, b, c = (sample(k, y, x) for k in range(3)) if len(picture.coefficients) == 3 else (sample(0, y, x), 128, 128)
        want = [a + 1.402 * (c - 128), a - 0.344136 * (b - 128) - 0.714136 * (c - 128), a + 1.772 * (b - 128)]
        assert all(abs(min(255, max(0, w)) - int(g)) <= 1 for w, g in zip(want, rgb[y, x]))


def test_load_of_files_that_are_none(spark):
    whole = j.encode(j.padded(b"abc"), 3)
    rows = [(1, bytearray(whole)), (2, None), (3, bytearray(whole[: len(whole) // 3])), (4, bytearray(b"GIF89a")), (5, bytearray())]
    got = {r["doc_id"]: r for r in j.load(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert len(got) == 5 and bytes(got[1]["payload"]).startswith(b"abc") and got[1]["error"] is None
    assert got[2]["payload"] is None and got[2]["error"] is None
    assert all(got[k]["payload"] is None and got[k]["error"] for k in (3, 4, 5))
