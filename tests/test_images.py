"""PNG to small JPEG, checked by a decoder of its own."""

import random
import struct
import zlib

import numpy as np
import pytest

from quillgraph.sources import images
from quillgraph.sources.images import ZIGZAG, code_sizes, codes, decode_png, encode_jpeg, tables, thumbnail


def png(samples, depth=8, kind=2, palette=None, seed=0, interlace=0):
    """A PNG of samples (rows of bytes), every row with a filter of its own."""
    rng = random.Random(seed)
    h, line = samples.shape
    pixel = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind] * depth // 8)
    above, out = [0] * line, b""
    for row in samples.tolist():
        f = rng.randrange(5)
        made = []
        for i, v in enumerate(row):
            a, b, c = row[i - pixel] if i >= pixel else 0, above[i], above[i - pixel] if i >= pixel else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            made.append((v - (0, a, b, (a + b) // 2, near)[f]) % 256)
        out += bytes([f, *made])
        above = row
    width = line * 8 // (depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind])
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    extra = part(b"PLTE", bytes(palette)) if palette else b""
    return images.PNG + part(b"IHDR", struct.pack(">IIBBBBB", width, h, depth, kind, 0, 0, interlace)) + extra + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


def picture(h, w, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    smooth = np.stack([128 + 100 * np.sin(x / 9 + k) * np.cos(y / 7) for k in range(3)], axis=2)
    return np.clip(smooth + rng.normal(0, 6, (h, w, 3)), 0, 255).astype(np.uint8)


def decode_jpeg(data):
    """A plain reader of what the encoder writes: height x width x 3, and its quantisation tables."""
    at, quant, huff, scan = 2, {}, {}, None
    while scan is None:
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if mark == 0xDB:
            quant[body[0]] = np.frombuffer(body[1:], np.uint8).astype(int)
        elif mark == 0xC0:
            h, w = struct.unpack(">HH", body[1:5])
            assert body[6:] == bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
        elif mark == 0xC4:
            table, code, k = {}, 0, 17
            for n in range(1, 17):
                for _ in range(body[n]):
                    table[n, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            huff[body[0]] = table
        elif mark == 0xDA:
            scan = at + 2 + size
        at += 2 + size
    assert data[-2:] == b"\xff\xd9"
    bits = "".join(f"{b:08b}" for b in data[scan:-2].replace(b"\xff\x00", b"\xff"))
    place = 0

    def symbol(table):
        nonlocal place
        for n in range(1, 17):
            if (found := table.get((n, int(bits[place : place + n], 2)))) is not None:
                place += n
                return found
        raise AssertionError

    def number(n):
        nonlocal place
        if not n:
            return 0
        v = int(bits[place : place + n], 2)
        place += n
        return v if v >> (n - 1) else v - (1 << n) + 1

    last = [0, 0, 0]

    def block(c):
        z = [0] * 64
        last[c] += number(symbol(huff[int(c > 0)]))
        z[0], k = last[c], 1
        while k < 64:
            s = symbol(huff[0x10 | int(c > 0)])
            if s == 0:
                break
            k += s >> 4
            if s != 0xF0:
                z[k] = number(s & 15)
            k += 1
        out = np.zeros(64)
        out[ZIGZAG] = np.array(z) * quant[int(c > 0)]
        return images.DCT.T @ out.reshape(8, 8) @ images.DCT + 128

    rows, columns = -(-h // 16), -(-w // 16)
    y, blue, red = np.zeros((rows * 16, columns * 16)), np.zeros((rows * 8, columns * 8)), np.zeros((rows * 8, columns * 8))
    for i in range(rows):
        for j in range(columns):
            for k in range(4):
                y[16 * i + 8 * (k // 2) :][:8, 16 * j + 8 * (k % 2) :][:, :8] = block(0)
            blue[8 * i :][:8, 8 * j :][:, :8] = block(1)
            red[8 * i :][:8, 8 * j :][:, :8] = block(2)
    assert set(bits[place:]) <= {"1"} and len(bits) - place < 8
    b, r = (np.repeat(np.repeat(c, 2, 0), 2, 1) - 128 for c in (blue, red))
    rgb = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2)
    return np.clip(rgb[:h, :w], 0, 255), quant


@pytest.mark.parametrize(("h", "w"), [(16, 16), (37, 50), (1, 1), (8, 65)])
def test_jpeg_is_near_to_the_picture(h, w):
    image = picture(h, w)
    got, quant = decode_jpeg(encode_jpeg(image))
    error = abs(got - image.astype(float))
    assert got.shape == image.shape and error.mean() < 8 and error.max() < 90
    assert [quant[k].tolist() for k in (0, 1)] == [t[ZIGZAG].tolist() for t in tables()]
    assert tables()[0][0] == 5 and tables(50)[0][0] == 16 and tables(100)[1].max() == 1
    flat = np.full((h, w, 3), 77, np.uint8)
    assert abs(decode_jpeg(encode_jpeg(flat))[0] - 77).max() <= 2


def test_higher_quality_is_nearer():
    image = picture(48, 48)
    errors = [np.abs(decode_jpeg(encode_jpeg(image, q))[0] - image).mean() for q in (20, 85, 98)]
    assert errors[0] > errors[1] > errors[2] and len(encode_jpeg(image, 20)) < len(encode_jpeg(image, 98))


def test_png_kinds():
    rgb = picture(9, 14)
    assert (decode_png(png(rgb.reshape(9, -1))) == rgb).all()
    rgba = np.concatenate([rgb, np.full((9, 14, 1), 9, np.uint8)], axis=2)
    assert (decode_png(png(rgba.reshape(9, -1), kind=6)) == rgb).all()
    gray = rgb[:, :, 0]
    assert (decode_png(png(gray, kind=0)) == gray[:, :, None]).all()
    assert (decode_png(png(np.stack([gray, gray], axis=2).reshape(9, -1), kind=4)) == gray[:, :, None]).all()
    wide = np.stack([rgb, rgb // 2], axis=3).reshape(9, -1)
    assert (decode_png(png(wide, depth=16)) == rgb).all()
    palette = list(range(48))
    index = (gray % 16)[:, :14]
    packed = (index[:, ::2] << 4) | index[:, 1::2]
    assert (decode_png(png(packed, depth=4, kind=3, palette=palette)) == np.array(palette).reshape(16, 3)[index]).all()
    assert (decode_png(png(packed, depth=4, kind=0)) == (index * 17)[:, :, None]).all()
    with pytest.raises(ValueError):
        decode_png(png(gray, kind=0, interlace=1))


def test_thumbnails():
    assert thumbnail(picture(30, 20)).shape == (30, 20, 3)
    small = thumbnail(picture(300, 150), 100)
    assert small.shape == (100, 50, 3)
    want = picture(300, 150, 1).astype(float).reshape(100, 3, 50, 3, 3).mean(axis=(1, 3))
    assert abs(small - want).mean() < 6
    assert (thumbnail(np.full((257, 90, 3), 200, np.uint8), 64) == 200).all()
    assert thumbnail(np.zeros((2000, 1, 3), np.uint8), 64).shape == (64, 1, 3)


def test_codes():
    rng = np.random.default_rng(2)
    for counts in (np.array([5]), np.array([1, 1]), rng.integers(0, 50, 256), 2 ** np.arange(40)):
        full = np.zeros(256, np.int64)
        full[: len(counts)] = counts
        code, sizes, table = codes(full)
        used = np.flatnonzero(full)
        words = {format(int(code[s]), f"0{sizes[s]}b") for s in used}
        assert len(words) == len(used) and sizes.max() <= 16 and sum(table[:16]) == len(used)
        assert not any(a != b and b.startswith(a) for a in words for b in words) and not any(set(x) == {"1"} for x in words)
    assert code_sizes(np.array([1, 1, 2, 4, 8])).tolist() == [4, 4, 3, 2, 1]
    assert code_sizes(2 ** np.arange(20), 8).max() == 8 and (2.0 ** -code_sizes(2 ** np.arange(20), 8)).sum() <= 1


def test_images_of_a_table(spark):
    big = picture(60, 90)
    rows = [("a.png", png(big.reshape(60, -1)), "image/png"), ("b.jpg", b"\xff\xd8 whatever", "image/jpeg"), ("c.png", images.PNG + b"broken", "image/png"), ("d.png", None, "image/png")]
    got = {r["image_id"]: (r["image"], r["mime"]) for r in images.encoded(spark.createDataFrame(rows, "image_id string, image binary, mime string"), longest=45).collect()}
    made, _ = decode_jpeg(bytes(got["a.png"][0]))
    assert got["a.png"][1] == "image/jpeg" and made.shape == (30, 45, 3) and abs(made - thumbnail(big, 45)).mean() < 10
    assert (bytes(got["b.jpg"][0]), got["b.jpg"][1]) == (rows[1][1], "image/jpeg") and bytes(got["c.png"][0]) == rows[2][1] and got["d.png"] == (None, "image/png")
