"""Best-two-fit packing of tokenized documents into sequences of a fixed number of tokens.

A bin is filled greedily, always with the longest unpacked piece that fits. Then its smallest piece is taken
out if two unpacked pieces fill the gap that this opens more tightly; that is repeated while it helps. Pieces
are dealt by a hash to packers of about PACKER pieces each, which leave one loose bin each; only lengths
matter to a packer, so it works on a histogram of them.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

CAPACITY = 1024
END = 2
PACKER = 50_000
#: Chunks of text whose ids a worker has met since it last set the older ones aside; it keeps two such lots.
CACHE = 500_000
#: Marks that are tokens by themselves after a letter or between lines. What has no space before it goes by a
#: key that starts with FIRST, marks and line breaks too, so it is not taken for the same with a space.
CUTS = ("\n", ",", ".", ";", ":", "!", "?")
FIRST = "\x00"
#: Line breaks that are no tokens by themselves: other white space, or an end of the text, is beside them.
BESIDE = re.compile(r"\n(?:\s|\Z|(?<=\s\n)|(?<=\A\n))")

_encoders: dict[str, list] = {}


def _encoder(path: str):
    """The tokenizer with which of its ids start with a space, and ids (as little-endian bytes) of the chunks that it
    has met, late and early ones; kept while the worker lives."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        spaced[[i for token, i in vocabulary.items() if token[:1] == "\u0120"]] = True  # how byte-level tokens spell a space
        _encoders[path] = [(tokenizer, spaced), {}, {}]
    return _encoders[path]


def _ids(tokenizer, texts: list[str]) -> list[bytes]:
    return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _word_ids(tokenizer, spaced: np.ndarray, words: list[str]) -> list[bytes]:
    """Ids of words of letters only, each with a space before it: as one text, of which each is a part that starts with
    its space."""
    out = []
    for at in range(0, len(words), 2000):
        some = words[at : at + 2000]
        raw = _ids(tokenizer, [" " + " ".join(some)])[0]
        starts = np.flatnonzero(spaced[np.frombuffer(raw, "<u4")]).tolist()
        if len(starts) == len(some):
            out += [raw[4 * x : 4 * y] for x, y in zip(starts, [*starts[1:], len(raw) // 4])]
        else:
            out += _ids(tokenizer, [" " + w for w in some])
    return out


def _units(chunk: str) -> list[str] | None:
    """A chunk as lines and the marks that end or part them, each of which is tokenized by itself; None for a
    chunk that is not cut off rightly, as white space meets white space at its ends."""
    body = chunk[1:] if chunk[:1] == FIRST else chunk
    if not body:
        return [] if chunk else None
    if body[-1].isspace() or (body is chunk and body[0].isspace()):
        return None
    units = []
    for k, line in enumerate(body.split("\n")):
        if not line or line[0].isspace() or line[-1].isspace():
            return [chunk]
        key = FIRST + line if k or body is not chunk else line
        if k:
            units.append(FIRST + "\n")
        units += [key[:-1], FIRST + line[-1]] if line[-1] in CUTS and line[-2:-1].isalpha() else [key]
    return units


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of every text as little-endian unsigned 32-bit numbers.

    The byte-level pre-tokenizer starts a new token at every space between two characters that are not white
    space, so texts are cut there and each distinct chunk is encoded once; likewise at single line breaks
    (where all of a text are such, before chunks are looked up) and before a closing mark after a letter. Texts with other white space beside a space are encoded whole, and so
    are those that hold the character FIRST themselves.
    """
    own = _encoder(path)
    if len(own[1]) > CACHE:
        own[1:] = {}, own[1]
    (tokenizer, spaced), known, early = own
    if not known:
        known.update(zip([FIRST + c for c in CUTS], _ids(tokenizer, list(CUTS)), strict=True))
    split, found, new = [], [], set()
    for t in texts:
        whole = FIRST in t
        if not whole and "\n" in t and not BESIDE.search(t):
            t = t.replace("\n", f" {FIRST}\n {FIRST}")
        p = [] if whole else t.split(" ")
        if p:
            p[0] = FIRST + p[0]  # it has no space before it
        got = list(map(known.get, p))
        open_ = [k for k, ids in enumerate(got) if ids is None] if None in got else []
        new.update([p[k] for k in open_])
        split.append((p, open_))
        found.append(got)
    words, plain, ended, made = set(), set(), [], {}
    for x in new:  # most are a word, or a word and a mark
        if x in early:
            known[x] = early[x]
        elif x.isalpha():
            words.add(x)
        elif x[:1] == FIRST and x[1:].isalpha():
            plain.add(x)
        elif x[:1] == FIRST and x[-1:] in CUTS and x[1:-1].isalpha():
            ended.append(x)
            if x[:-1] not in known:
                plain.add(x[:-1])
        elif x[-1:] in CUTS and x[:-1].isalpha():
            ended.append(x)
            if x[:-1] not in known:
                words.add(x[:-1])
        elif x not in known:  # None marks a chunk that makes its text odd
            made[x] = _units(x)
    for u in {u for units in made.values() for u in units or () if u not in known}:
        (words if u.isalpha() else plain).add(u)
    base = list(words)
    known.update(zip(base, _word_ids(tokenizer, spaced, base), strict=True))
    base = list(plain)
    for i in range(0, len(base), 20_000):
        some = base[i : i + 20_000]
        known.update(zip(some, _ids(tokenizer, [x[1:] if x[0] == FIRST else " " + x for x in some]), strict=True))
    for x in ended:
        known[x] = known[x[:-1]] + known[FIRST + x[-1]]
    for x, units in made.items():
        known[x] = None if units is None else b"".join([known[u] for u in units])
    out, odd = [], []
    for k, ((p, open_), got) in enumerate(zip(split, found, strict=True)):
        for i in open_:
            got[i] = known[p[i]]
        if p and None not in got:
            out.append(b"".join(got))
        else:  # a chunk without ids, or a text without chunks
            odd.append(k)
            out.append(b"")
    for k, ids in zip(odd, _ids(tokenizer, [texts[k] for k in odd]), strict=True):
        out[k] = ids
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece: ids then `end`, cut into pieces of `capacity` of
    which the first may be shorter. A null text is empty and has the one token `end`."""
    tail = np.array([end], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                out = []
                for doc_id, ids in zip(part["doc_id"], encode(part["text"].tolist(), path), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    out += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
                made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                made["doc_id"] = made["doc_id"].astype("Int64")
                yield made

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (each from 1 to capacity)."""
    order = np.argsort(lengths, kind="stable")
    at = np.searchsorted(lengths[order], np.arange(capacity + 2))
    stacks = [order[at[n] : at[n + 1]].tolist()[::-1] if at[n + 1] > at[n] else [] for n in range(capacity + 1)]
    there = sum(1 << n for n in range(1, capacity + 1) if stacks[n])
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal there
        item = stacks[n].pop()
        if not stacks[n]:
            there &= ~(1 << n)
        return item

    def put(n: int, item: int) -> None:
        nonlocal there
        stacks[n].append(item)
        there |= 1 << n

    def two(room: int, least: int) -> tuple[int, int] | None:
        """Lengths of two unpacked pieces with the largest sum over `least` and up to `room`."""
        best, sum_, a = None, least, room - 1
        while (a := (there & ((1 << (a + 1)) - 1)).bit_length() - 1) > 0 and 2 * a > sum_ - 1:
            b = (there & ((1 << (min(a, room - a) + 1)) - 1)).bit_length() - 1
            if b == a and len(stacks[a]) < 2:
                b = (there & ((1 << a) - 1)).bit_length() - 1
            if b > 0 and a + b > sum_:
                best, sum_ = (a, b), a + b
                if sum_ == room:
                    break
            a -= 1
        return best

    number = 0
    while there:
        room, held = capacity, []
        while there and (n := (there & ((1 << (room + 1)) - 1)).bit_length() - 1) > 0:
            held.append((n, take(n)))
            room -= n
        while room and there:
            n, item = held[-1]  # greedy filling goes downwards, so the last is the smallest
            if not (pair := two(room + n, n)):
                break
            held.pop()
            put(n, item)
            held += [(m, take(m)) for m in pair]
            held.sort(key=lambda x: -x[0])
            room = capacity - sum(m for m, _ in held)
        offset = 0
        for n, item in held:
            bins[item], offsets[item] = number, offset
            offset += n
        number += 1
    return bins, offsets


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all docs with sequence_id and offset.

    Every row of docs is packed, repeated rows again; an empty table gives none. A document without a doc_id
    keeps null. sequence_id is packer * 2**32 + bin.
    """
    made = saved(pieces(docs, path, capacity, end))
    packers = max(1, -(-made.count() // PACKER))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offsets = best_two_fit(frame["length"].to_numpy(np.int64), capacity)
        frame["sequence_id"] = (frame["packer"].to_numpy(np.int64) << 32) + bins
        frame["offset"] = offsets
        return frame.drop(columns="packer")

    dealt = made.withColumn("packer", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(packers)).cast("int"))
    return dealt.groupBy("packer").applyInPandas(fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
