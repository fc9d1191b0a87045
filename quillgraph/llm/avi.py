"""Media columns: grey motion-JPEG in AVI, written and read without loss.

Writing: a payload of 8-bit samples becomes frames of 64 x 16. Each frame is a lossless JPEG (process 14,
SOF3, predictor 1) whose restart interval is one line, so that lines can be decoded side by side. The AVI has
the usual headers, a 'movi' list of '00dc' chunks, an 'idx1' index, and the payload's size in an INFO comment.

Reading: the RIFF chunks and the index are parsed, every frame is decoded, and shots are cut where the
histogram difference of neighbouring frames exceeds an adaptive threshold (mean + 2 deviations of the
differences before it in the same clip), which yields timed clip rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, give_back, utf8

WIDTH, HEIGHT = 64, 16
FRAME = WIDTH * HEIGHT
FPS = 25
#: Category k (0 to 8) of a difference has the four-bit code k.
CODE_BITS = 4
_HEAD = (
    b"\xff\xd8"
    + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, HEIGHT, WIDTH, 1) + bytes([1, 0x11, 0])
    + b"\xff\xc4" + struct.pack(">HB", 19 + 9, 0) + bytes([0, 0, 0, 9, *[0] * 12]) + bytes(range(9))
    + b"\xff\xdd" + struct.pack(">HH", 4, WIDTH)
    + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0])
)
_SIZE = np.array([int(x).bit_length() for x in range(256)], np.uint8)


def encode_lines(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of WIDTH samples, with stuffing and a restart marker after each line, and the
    bounds of the lines. The marker after the last line of a frame is for the caller to leave out."""
    diff = np.empty(lines.shape, np.int16)
    diff[:, 0] = lines[:, 0].astype(np.int16) - 128
    np.subtract(lines[:, 1:], lines[:, :-1], out=diff[:, 1:], dtype=np.int16)
    size = _SIZE[np.abs(diff)]
    bits = np.where(diff < 0, diff + (1 << size.astype(np.int16)) - 1, diff).astype(np.int32)
    width = size.astype(np.int32) + CODE_BITS
    value = (size.astype(np.int32) << size) | bits
    ends = np.cumsum(width, axis=1)
    line_bytes = (ends[:, -1] + 7) >> 3
    starts = np.concatenate([[0], np.cumsum(line_bytes)])
    first = (starts[:-1, None] * 8 + ends - width).ravel()
    shifted = value.ravel().astype(np.int64) << (24 - (first & 7) - width.ravel())
    at = first >> 3
    total = int(starts[-1])
    out = np.zeros(total + 2)
    for k in range(3):
        out += np.bincount(at + k, weights=(shifted >> (16 - 8 * k)) & 255, minlength=total + 2)[: total + 2]
    out = out[:total].astype(np.uint8)
    pad = line_bytes * 8 - ends[:, -1]
    out[starts[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    stuffed = np.repeat(out, 1 + (out == 255)) if (out == 255).any() else out
    if len(stuffed) != total:
        where = np.flatnonzero(out == 255)
        stuffed[where + np.arange(1, len(where) + 1)] = 0
    bounds = starts + np.concatenate([[0], np.cumsum(out == 255)])[starts]
    return stuffed, bounds


def write_avi(payload_size: int, frames: list[bytes]) -> bytes:
    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    n, most = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, most, 0, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"%d" % payload_size))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        body.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    return chunk(b"RIFF", b"AVI " + hdrl + info + chunk(b"LIST", b"".join(body)) + chunk(b"idx1", b"".join(index)))


def encode(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """An AVI for each payload (the length of each is a positive multiple of WIDTH)."""
    n_frames = -(-np.diff(bounds) // FRAME)
    lines = np.zeros((int(n_frames.sum()) * HEIGHT, WIDTH), np.uint8)
    firsts = np.concatenate([[0], np.cumsum(n_frames)])
    flat = lines.reshape(-1)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        flat[firsts[i] * FRAME : firsts[i] * FRAME + b - a] = data[a:b]
    coded, ends = encode_lines(lines)
    coded = coded.tobytes()
    marks = [bytes([255, 0xD0 + k % 8]) for k in range(HEIGHT - 1)] + [b"\xff\xd9"]
    ends = ends.tolist()
    out = []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        frames = []
        for f in range(firsts[i], firsts[i + 1]):
            row = f * HEIGHT
            frames.append(_HEAD + b"".join([x for k in range(HEIGHT) for x in (coded[ends[row + k] : ends[row + k + 1]], marks[k])]))
        out.append(write_avi(int(b - a), frames))
    return out


def parse_avi(media: bytes) -> tuple[int, int, list[tuple[int, int]]]:
    """Payload size, microseconds a frame, and (start, size) of each frame by the index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    size, micros, movi, index, at = None, None, None, [], 12
    todo = [(at, 8 + struct.unpack_from("<I", media, 4)[0])]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, n = struct.unpack_from("<4sI", media, at)
            if name == b"LIST":
                kind = media[at + 8 : at + 12]
                if kind == b"movi":
                    movi = at + 8
                else:
                    todo.append((at + 12, at + 8 + n))
            elif name == b"avih":
                micros = struct.unpack_from("<I", media, at + 8)[0]
            elif name == b"ICMT":
                size = int(media[at + 8 : at + 8 + n])
            elif name == b"idx1":
                index = np.frombuffer(media, "<u4", n // 4, at + 8).reshape(-1, 4)[:, 2:].tolist()
            at += 8 + n + (n & 1)
    return size, micros, [(movi + a + 8, n) for a, n in index]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (frames, HEIGHT, WIDTH) of lossless JPEG frames as encode() makes them."""
    scans = []
    for f in frames:
        if f[: len(_HEAD)] != _HEAD or f[-2:] != b"\xff\xd9":
            raise ValueError("not a frame of this writer")
        scans.append(f[len(_HEAD) :])
    data = np.frombuffer(b"".join(scans), np.uint8)
    escape = np.flatnonzero(data[:-1] == 255)
    after = data[escape + 1]
    kept = np.ones(len(data), bool)
    kept[escape + 1] = False  # stuffed zeros and the second bytes of markers
    kept[escape[after != 0]] = False
    moved = np.cumsum(kept)
    data, ends = data[kept], moved[escape[after != 0]]
    starts = np.concatenate([[0], ends[:-1]])
    wide = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int32)
    wide = (wide[:-3] << 16) | (wide[1:-2] << 8) | wide[2:-1]
    bit = starts.astype(np.int64) * 8
    diff = np.empty((WIDTH, len(starts)), np.int32)
    for k in range(WIDTH):
        window = (wide[bit >> 3] << (bit & 7)) & 0xFFFFFF
        size = window >> (24 - CODE_BITS)
        extra = (window >> (24 - CODE_BITS - size)) & ((1 << size) - 1)
        diff[k] = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
        bit += CODE_BITS + size
    return (np.cumsum(diff, axis=0) + 128).astype(np.uint8).T.reshape(len(frames), HEIGHT, WIDTH)


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, end) of each shot: a cut where the histogram difference, of 16 bins, is above mean + 2
    deviations of the differences since the last cut (of two at least)."""
    if not len(frames):
        return []
    bins = (frames.reshape(len(frames), -1) >> 4).astype(np.int64) + 16 * np.arange(len(frames))[:, None]
    hist = np.bincount(bins.ravel(), minlength=16 * len(frames)).reshape(-1, 16)
    change = np.abs(np.diff(hist, axis=0)).sum(1)
    cuts, n, s, q = [0], 0, 0, 0
    for k, x in enumerate(change.tolist(), 1):
        if n >= 2 and x * n > s and (x * n - s) ** 2 > 4 * (n * q - s * s):
            cuts.append(k)
            n, s, q = 0, 0, 0
        else:
            n, s, q = n + 1, s + x, q + x * x
    return list(zip(cuts, [*cuts[1:], len(frames)]))


def media_rows(docs: DataFrame) -> DataFrame:
    """Every text stored as an AVI and read back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (shots as
    start-end in milliseconds, then the crc32 of all histogram bins' sums), media (the file) and clips. A null
    text is empty: 64 zero bytes. Equal texts give equal values; repeated rows repeat.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for row, end in chunks(bounds, 1 << 20):
                sizes = np.diff(bounds[row : end + 1])
                padded = np.maximum(64, -(-sizes // 64) * 64)
                at = np.concatenate([[0], np.cumsum(padded)])
                flat = np.zeros(int(at[-1]), np.uint8)
                for i in range(end - row):
                    flat[at[i] : at[i] + sizes[i]] = data[bounds[row + i] : bounds[row + i + 1]]
                media = encode(flat, at)
                parsed = [parse_avi(m) for m in media]
                back = decode_frames([m[a : a + n] for m, (_, _, index) in zip(media, parsed, strict=True) for a, n in index])
                out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "clips")}
                frame = 0
                for i, (m, (size, micros, index)) in enumerate(zip(media, parsed, strict=True)):
                    own = back[frame : frame + len(index)]
                    frame += len(index)
                    payload = own.tobytes()[:size]
                    clips = [{"start_ms": a * micros // 1000, "end_ms": b * micros // 1000} for a, b in shots(own)]
                    hist = np.bincount(own.ravel(), minlength=256).astype("<u4").tobytes()
                    for k, v in (
                        ("n_bytes", int(sizes[i])), ("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-64:])),
                        ("media_bytes", len(m)), ("media_sha256", hashlib.sha256(m).hexdigest()), ("feature", ",".join(f"{c['start_ms']}-{c['end_ms']}" for c in clips) + f":{zlib.crc32(hist):08x}"), ("media", m), ("clips", clips),
                    ):
                        out[k].append(v)
                kinds = {"media": pa.binary(), "clips": pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))}
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), *[pa.array(v, kinds.get(k)) for k, v in out.items()]], ["doc_id", *out]
                )
            give_back()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(
        store,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, clips array<struct<start_ms:long,end_ms:long>>",
    )


def clip_rows(media: DataFrame) -> DataFrame:
    """One row per clip: doc_id, clip, start_ms, end_ms."""
    return media.selectExpr("doc_id", "posexplode(clips) as (clip, c)").selectExpr("doc_id", "clip", "c.start_ms", "c.end_ms")
