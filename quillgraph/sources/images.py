"""Images as questions need them: at most so many pixels wide and high, as baseline JPEG, each encoded once.

PNG files (8 or 16 bits, or palettes; not interlaced) are decoded, made smaller by a Lanczos filter and encoded; files
of other kinds go as they are. All of it is array work on one image, in Arrow batches that Spark deals.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LONGEST, QUALITY = 1024, 85
LOBES = 3
PNG = b"\x89PNG\r\n\x1a\n"
# The quantisation tables of the JPEG standard, for quality 50, in reading order.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Places of a block in the order of the file: along the diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (s := p // 8 + p % 8, p // 8 if s % 2 else p % 8)))
DCT = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


def _unfiltered(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Samples (row, pixel, byte of the pixel) from what a PNG stores: differences to the left, upper or upper left
    pixel, by a rule for each row. A pixel needs those on the diagonal before, so whole diagonals are done at once."""
    h, w, size = rows.shape
    out = np.zeros((h + 1, w + 1, size), np.int16)
    kind = kinds[:, None]
    for t in range(h + w - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        p = a + b - c
        da, db, dc = abs(p - a), abs(p - b), abs(p - c)
        nearest = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        out[y + 1, x + 1] = (rows[y, x] + np.select([kind[y] == k for k in range(1, 5)], [a, b, (a + b) >> 1, nearest], 0)) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """height x width x 3 bytes of red, green and blue; transparency is left out."""
    if not data or not data.startswith(PNG):
        raise ValueError("no PNG")
    at, parts, palette, head = len(PNG), [], None, None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            parts.append(body)
        at += 12 + size
    if not head or head[6]:
        raise ValueError("no header, or interlaced")
    w, h, depth, kind = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    line = -(-w * channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)[: h * (line + 1)].reshape(h, line + 1)
    pixel = max(1, channels * depth // 8)
    bytes_ = _unfiltered(raw[:, 1:].reshape(h, line // pixel, pixel).astype(np.int16), raw[:, 0]).reshape(h, line)
    if depth == 16:
        samples = bytes_[:, ::2]
    elif depth == 8:
        samples = bytes_
    else:
        bits = np.unpackbits(bytes_, axis=1)[:, : w * depth].reshape(h, w, depth)
        samples = bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
        samples = samples if kind == 3 else samples * np.uint8(255 // ((1 << depth) - 1))
    samples = samples.reshape(h, w, channels)
    if kind == 3:
        return palette[samples[:, :, 0]]
    return np.repeat(samples[:, :, :1], 3, axis=2) if kind in (0, 4) else samples[:, :, :3]


def _shorter(image: np.ndarray, size: int) -> np.ndarray:
    """image with `size` rows: each is a mean of the rows around it, weighted by a windowed sinc as wide as its share."""
    old = len(image)
    step = old / size
    reach = LOBES * max(step, 1.0)
    middle = (np.arange(size) + 0.5) * step
    first = np.floor(middle - reach).astype(int)
    taps = int(np.ceil(2 * reach)) + 1
    at = first[:, None] + np.arange(taps)
    x = (at + 0.5 - middle[:, None]) / max(step, 1.0)
    weight = np.where(abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0) * ((at >= 0) & (at < old))
    weight /= weight.sum(axis=1, keepdims=True)
    out = np.zeros((size, *image.shape[1:]), np.float32)
    for k in range(taps):
        out += weight[:, k, None, None].astype(np.float32) * image[np.clip(at[:, k], 0, old - 1)]
    return out


def thumbnail(image: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """image, not larger than `longest` either way, in its proportions; smaller ones stay as they are."""
    h, w = image.shape[:2]
    if max(h, w) <= longest:
        return image
    scale = longest / max(h, w)
    small = _shorter(image.astype(np.float32), max(1, round(h * scale)))
    small = _shorter(small.transpose(1, 0, 2), max(1, round(w * scale))).transpose(1, 0, 2)
    return np.clip(np.rint(small), 0, 255).astype(np.uint8)


def tables(quality: int = QUALITY) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients of the 8 x 8 blocks of a plane: rows of blocks, blocks, 64 in the order of the file."""
    h, w = plane.shape
    cut = plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3) - 128
    made = np.rint((DCT @ cut @ DCT.T).reshape(h // 8, w // 8, 64) / table).astype(np.int32)
    return made[:, :, ZIGZAG]


def code_sizes(counts: np.ndarray, most: int = 16) -> np.ndarray:
    """Bits of the best code of at most `most` bits for symbols that occur so often (0: no code). Packages of coins:
    on every level two neighbours in order of weight become one of the next, and what the cheapest of the last level
    hold tells how often each symbol was paid for."""
    used = np.flatnonzero(counts)
    coins = sorted((int(counts[s]), (int(s),)) for s in used)
    row = list(coins)
    for _ in range(most - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2], strict=False)]
        row = list(heapq.merge(coins, pairs))
    sizes = np.zeros(len(counts), np.int64)
    for _, held in row[: 2 * (len(used) - 1)]:
        np.add.at(sizes, list(held), 1)
    return sizes


def codes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and its size for each of 256 symbols, and the table as a file has it. No code is all ones, as a symbol more,
    the rarest, takes that one."""
    sizes = code_sizes(np.append(counts * 2, 1) if counts.any() else np.append(np.ones(1), np.zeros(256)))
    order = sorted(np.flatnonzero(sizes).tolist(), key=lambda s: (sizes[s], s))
    code, value, last = np.zeros(257, np.int64), 0, 0
    for s in order:
        value <<= int(sizes[s]) - last
        last = int(sizes[s])
        code[s] = value
        value += 1
    kept = [s for s in order if s < 256]
    return code[:256], sizes[:256], bytes(np.bincount(sizes[kept], minlength=17)[1:17].tolist()) + bytes(kept)


def _sizes_of(values: np.ndarray) -> np.ndarray:
    return np.where(values == 0, 0, np.floor(np.log2(np.maximum(abs(values), 1))).astype(np.int64) + 1)


def _events(blocks: np.ndarray, plane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table (0-1: first coefficients of brightness and colour, 2-3: others), symbol and value of all that a scan says
    of its blocks, in order; plane tells of which of the three planes a block is."""
    n, colour = len(blocks), (plane > 0).astype(np.int64)
    first = blocks[:, 0].astype(np.int64)
    for k in range(3):
        own = np.flatnonzero(plane == k)
        first[own] = np.diff(blocks[own, 0], prepend=0)
    block, at = np.nonzero(blocks[:, 1:])
    at = at + 1
    value = blocks[block, at].astype(np.int64)
    before = np.where(np.append(True, block[1:] != block[:-1])[: len(block)], 0, np.append(0, at[:-1])[: len(block)])
    run = at - before - 1
    far = np.repeat(np.arange(len(at)), run >> 4)  # sixteen zeros each
    last = np.zeros(n, np.int64)
    np.maximum.at(last, block, at)
    short = np.flatnonzero(last < 63)
    parts = [  # place, table, symbol, value
        (np.arange(n) * 256, colour, _sizes_of(first), first),
        (block * 256 + 2 * at + 1, 2 + colour[block], (run & 15) * 16 + _sizes_of(value), value),
        (block[far] * 256 + 2 * at[far], 2 + colour[block[far]], np.full(len(far), 0xF0), np.zeros(len(far), np.int64)),
        (short * 256 + 255, 2 + colour[short], np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)),
    ]
    place, table, symbol, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(place, kind="stable")
    return table[order], symbol[order], value[order]


def encode_jpeg(image: np.ndarray, quality: int = QUALITY) -> bytes:
    """Baseline JPEG with colour at half the resolution, and code tables made for the image."""
    h, w = image.shape[:2]
    pad = np.pad(image, ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge").astype(np.float64)
    r, g, b = pad[:, :, 0], pad[:, :, 1], pad[:, :, 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    half = lambda c: (c[::2, ::2] + c[1::2, ::2] + c[::2, 1::2] + c[1::2, 1::2]) / 4
    light, tint = tables(quality)
    bright = _blocks(y, light)
    blue, red = _blocks(half(128 + (b - y) / 1.772), tint), _blocks(half(128 + (r - y) / 1.402), tint)
    rows, columns = blue.shape[:2]
    four = bright.reshape(rows, 2, columns, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, columns, 4, 64)
    scan = np.concatenate([four, blue[:, :, None], red[:, :, None]], axis=2).reshape(-1, 64)
    table, symbol, value = _events(scan, np.tile([0, 0, 0, 0, 1, 2], rows * columns))
    made = [codes(np.bincount(symbol[table == k], minlength=256)) for k in range(4)]
    code, size = (np.stack([m[i] for m in made])[table, symbol] for i in (0, 1))
    more = symbol & 15
    bits = (code << more) | np.where(value < 0, value + (1 << more) - 1, value)
    total = size + more
    ends = np.cumsum(total)
    shift = np.repeat(ends, total) - np.arange(ends[-1]) - 1
    stream = ((np.repeat(bits, total) >> shift) & 1).astype(np.uint8)
    body = np.packbits(np.append(stream, np.ones(-len(stream) % 8, np.uint8))).tobytes().replace(b"\xff", b"\xff\x00")
    part = lambda mark, data: struct.pack(">BBH", 0xFF, mark, len(data) + 2) + data
    out = b"\xff\xd8" + part(0xE0, b"JFIF\x00" + struct.pack(">HBHHBB", 0x0101, 0, 1, 1, 0, 0))
    out += b"".join(part(0xDB, bytes([k]) + bytes(t[ZIGZAG].tolist())) for k, t in enumerate((light, tint)))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    out += b"".join(part(0xC4, bytes([(k >> 1) << 4 | k & 1]) + m[2]) for k, m in enumerate(made))
    return out + part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + body + b"\xff\xd9"


def encoded(images: DataFrame, longest: int = LONGEST, quality: int = QUALITY) -> DataFrame:
    """images (image_id, image, mime) with the image as JPEG, not larger than `longest`; what cannot be decoded here
    (other formats, interlaced or broken files) stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, mime = batch.column("image")[row].as_py(), batch.column("mime")[row].as_py()
                try:
                    data, mime = encode_jpeg(thumbnail(decode_png(data), longest), quality), "image/jpeg"
                except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
                    pass  # it goes as it is
                yield pa.RecordBatch.from_arrays([batch.column("image_id").slice(row, 1), pa.array([data], pa.binary()), pa.array([mime], pa.string())], ["image_id", "image", "mime"])

    return images.select("image_id", "image", "mime").mapInArrow(run, "image_id string, image binary, mime string")
