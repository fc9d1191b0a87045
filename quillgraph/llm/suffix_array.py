"""Removal of repeated byte strings with suffix arrays, built by induced sorting.

What counts is whether a string of LENGTH bytes also starts earlier, so suffixes matter to that depth only,
and they can be dealt to shards by content:

1. Anchors. Of the GRAM-byte hashes in each LENGTH-byte string the least one is its anchor (the leftmost on a
   tie), so equal strings have equal anchors at equal places. The strings that share one occurrence of an
   anchor are consecutive and make a piece of at most 2 * LENGTH - GRAM bytes. Pieces are combined by content
   within a batch and then within a bucket of anchors: all but the first of equal pieces are covered as
   wholes, and a piece whose anchor occurs once is done.
2. Shards. The pieces whose anchor has several different pieces are cut from the texts and go to shards by
   anchor. A shard concatenates its pieces and sorts the suffixes by induced sorting: suffix types, order of
   the leftmost-smaller substrings, found recursively, and two linear induction passes (bucket by bucket on
   arrays, or position by position where names are many). Permuted common prefixes with the preceding suffix
   then show the classes of equal strings; all but the earliest of a class are covered.
   The pieces of an anchor with more than CROWD different ones would crowd a shard: their strings go to shards
   one by one, each by its own content, after equal ones were combined within a batch.
3. Covered positions of a document are merged and cut out.

Anchors in very many documents (found in a bounded sample of documents: of a share over HOT_SHARE, or over
HOT_DOCS documents if that is less) would gather in one shard. Each of their strings is an item of its own,
keyed by its hash, from the start, which combines by content like whole pieces do and needs no shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import numbered
from .common import chunks, give_back, mix64, saved, utf8

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
SAMPLE = 10_000
HOT_SHARE, HOT_DOCS = 0.05, 200_000
#: Bytes of text for each bucket of anchors, and of pieces for each shard.
BUCKET_BYTES, SHARD_BYTES = 6 << 20, 1 << 20
#: Different pieces of an anchor from which on its strings go to shards by themselves, each by its own content.
CROWD = 4096
#: Bytes of text that are combined before items leave a task.
PART_BYTES = 4 << 20
COVERED = 0x80
CROWDED = -1


PRIME = (1 << 31) - 1
#: Two bases of polynomial hashes modulo PRIME, and pieces that a worker remembers from batch to batch.
BASES = (1_116_352_408, 1_899_447_441)
REMEMBERED = 200_000
_powers: dict[int, np.ndarray] = {}


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any x below 2**63."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n of base modulo PRIME."""
    if base not in _powers or len(_powers[base]) <= n:
        out = np.ones(1, np.uint32)
        while len(out) <= n:
            out = np.concatenate([out, folded(out.astype(np.uint64) * np.uint64(pow(base, len(out), PRIME))).astype(np.uint32)])
        _powers[base] = out
    return _powers[base][: n + 1]


class Texts:
    """Concatenated texts with prefix sums that give the hash of any stretch: two polynomials modulo 2**31 - 1."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        self.sums, self.down = [], []
        for base in BASES:
            sums, up = np.zeros(len(data) + 1, np.uint32), powers(base, len(data))
            for at in range(0, len(data), 1 << 20):  # a sum of so many terms below 2**39 stays below 2**63
                part = data[at : at + (1 << 20)].astype(np.uint64) + np.uint64(1)
                sums[at + 1 : at + 1 + len(part)] = folded(np.cumsum(part * up[at : at + len(part)]) + np.uint64(sums[at]))
            self.sums.append(sums)
            self.down.append(powers(pow(base, -1, PRIME), len(data)))

    def _poly(self, k: int, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
        return folded(folded(self.sums[k][b] + np.uint64(PRIME) - self.sums[k][a]) * self.down[k][a].astype(np.uint64))

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self._poly(0, a, b) << np.uint64(31)) | self._poly(1, a, b))

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor hash, text number, start in the data, and length of every piece."""
        n = len(self.data)
        none = np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
        if n < LENGTH:
            return none
        m = mix64(self._poly(0, slice(0, n + 1 - GRAM), slice(GRAM, n + 1)))
        m >>= np.uint64(32)
        m <<= np.uint64(32)
        m |= np.arange(len(m), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < SPAN:
            m = np.minimum(m[: len(m) - (SPAN - width)], m[SPAN - width :])
        # strings that would run over the end of their text count for nothing
        step = np.zeros(n + 1, np.int32)
        last = np.maximum(self.bounds[1:] - LENGTH + 1, self.bounds[:-1])
        np.add.at(step, last, 1)
        np.add.at(step, self.bounds[1:], -1)
        inside = np.cumsum(step[: len(m)]) == 0
        edge = np.ones(len(m), bool)
        edge[1:] = (m[1:] != m[:-1]) | (inside[1:] != inside[:-1])
        edge[self.bounds[:-1][self.bounds[:-1] < len(m)]] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(m))
        ok = inside[start]
        start, end = start[ok], end[ok]
        at = (m[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return self.hash(at, at + GRAM), np.searchsorted(self.bounds, start, side="right") - 1, start, end - 1 + LENGTH - start


def _hot_grams(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the anchors that are in a large share of a sample of documents; at most the sample's
    anchors over the least count that qualifies."""
    n = docs.count()
    least = max(8, int(SAMPLE * min(HOT_SHARE, HOT_DOCS / max(n, 1))))
    if n < least:
        return np.zeros(0, np.uint64)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for row, end in chunks(bounds):
                b = bounds[row : end + 1]
                h, doc, _, _ = Texts(data[b[0] : b[-1]], b - b[0]).pieces()
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                found, count = np.unique(h[fresh], return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": pa.array(found.view(np.int64)), "n": pa.array(count)})

    share = min(1.0, SAMPLE / n)
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).select("text")
    rows = picked.mapInArrow(grams, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64).view(np.uint64))


def _in_sorted(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(found, values), len(found) - 1)
    return found[at] == values


def _firsts(key: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, content, doc and start, once each; in it, which rows are the first of key and content."""
    order = np.lexsort((start, doc, content, key))
    k, c, d, s = key[order], content[order], doc[order], start[order]
    once = np.ones(len(k), bool)
    once[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    order, k, c = order[once], k[once], c[once]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, first


class Remembered:
    """Pieces that repeated in the parts that a task has dealt already, with their earliest occurrence. It holds
    REMEMBERED of them at most; what it forgets goes to the buckets, which decide all the same."""

    def __init__(self):
        self.key, self.doc, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def later(self, key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which pieces are after an occurrence that was met."""
        if not len(self.key):
            return np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.key[at] == key) & ((doc > self.doc[at]) | ((doc == self.doc[at]) & (start > self.start[at])))

    def add(self, key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        key, doc, start = np.concatenate([self.key, key]), np.concatenate([self.doc, doc]), np.concatenate([self.start, start])
        order = np.lexsort((start, doc, key))
        order = order[np.append(True, key[order[1:]] != key[order[:-1]])] if len(order) else order
        if len(order) > REMEMBERED:
            order = order[:: -(-len(order) // REMEMBERED)]
        self.key, self.doc, self.start = key[order], doc[order], start[order]


def _bodies(ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, buckets: int, hot: np.ndarray, met: Remembered) -> Iterator[pa.RecordBatch]:
    parts = []
    for row, end in chunks(bounds):
        b = bounds[row : end + 1]
        texts = Texts(data[b[0] : b[-1]], b - b[0])
        h, text, start, size = texts.pieces()
        content = texts.hash(start, start + size)
        common = _in_sorted(h, hot)
        if common.any():
            count = size[common] - LENGTH + 1
            own = np.repeat(start[common], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            each, rest = texts.hash(own, own + LENGTH), ~common
            h, content = np.concatenate([h[rest], each]), np.concatenate([content[rest], each])
            text, size = np.concatenate([text[rest], np.repeat(text[common], count)]), np.concatenate([size[rest], np.full(len(own), LENGTH)])
            start = np.concatenate([start[rest], own])
        parts.append((h, content, ids[row + text], start - texts.bounds[text], size))
    if not any(len(x[0]) for x in parts):
        return
    h, content, doc, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, first = _firsts(h, content, doc, start)
    h, content, doc, start, size = (x[order] for x in (h, content, doc, start, size))
    own = mix64(h) ^ content
    again = np.unique(own[~first])
    shown = first & _in_sorted(own, again)
    first &= ~met.later(own, doc, start)
    met.add(own[shown], doc[shown], start[shown])
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    short = (h // np.uint64(buckets)).astype(np.uint32)
    size = size - LENGTH + np.where(first, 0, COVERED)
    bucket[~first] = doc[~first] % buckets
    content[~first], short[~first] = 0, 0
    order = np.argsort(bucket, kind="stable")
    bucket, short, content, doc, start, size = (x[order] for x in (bucket, short, content, doc, start, size))
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    bodies = [
        short[a:b].tobytes() + content[a:b].tobytes() + doc[a:b].astype("<i8").tobytes() + start[a:b].astype("<u4").tobytes() + size[a:b].astype(np.uint8).tobytes()
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)])
    ]
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[edge]), "body": pa.array(bodies, pa.binary())})


def _dealt(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """bucket, body: packed items of a batch. Later equals within a batch are only passed on as covered."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Remembered()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, bounds = utf8(batch.column("text"))
            for row, end in chunks(bounds, PART_BYTES):
                b = bounds[row : end + 1]
                yield from _bodies(ids[row:end], data[b[0] : b[-1]], b - b[0], buckets, shared.value, met)
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal, "bucket long, body binary")


def _unpacked(bodies: list[bytes]) -> list[np.ndarray]:
    kinds = ("<u4", "<u8", "<i8", "<u4", "u1")
    out: list[list] = [[] for _ in kinds]
    for body in bodies:
        n, at = len(body) // 25, 0
        for k, kind in enumerate(kinds):
            out[k].append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in out]


def _resolve(frame: pd.DataFrame, crowd: int) -> pd.DataFrame:
    """doc, start, size, gram (null: covered, CROWDED: one of very many) of a bucket's items that are covered or need
    a shard."""
    short, content, doc, start, size = _unpacked(frame["body"].tolist())
    done = size >= COVERED
    gone = [(doc[done], start[done], size[done] - COVERED)]
    short, content, doc, start, size = (x[~done] for x in (short, content, doc, start, size))
    order, first = _firsts(short, content, doc, start)
    short, doc, start, size = (x[order] for x in (short, doc, start, size))
    gone.append((doc[~first], start[~first], size[~first]))
    short, doc, start, size = (x[first] for x in (short, doc, start, size))
    _, group, count = np.unique(short, return_inverse=True, return_counts=True)
    several = count[group] > 1
    gone.append((doc[several], start[several], size[several]))
    doc, start, size = (np.concatenate(x) for x in zip(*gone, strict=True))
    own = np.where(count[group] > crowd, CROWDED, short.astype(np.int64) * 0x100003 + int(frame["bucket"].iloc[0]))
    gram = pd.array(np.concatenate([np.zeros(len(doc) - several.sum(), np.int64), own[several]]), dtype="Int64")
    gram[: len(doc) - int(several.sum())] = pd.NA
    give_back()
    return pd.DataFrame({"doc": doc, "start": start.astype(np.int64), "size": size.astype(np.int64) + LENGTH, "gram": gram})


def _append(sa: np.ndarray, fill: np.ndarray, chars: np.ndarray, items: np.ndarray, down: bool) -> None:
    """Put items, in their order, at the free ends of the buckets of their characters."""
    if len(items) > 1:
        order = np.argsort(chars, kind="stable")
        chars, items = chars[order], items[order]
        edge = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
        count = np.diff(np.append(edge, len(chars)))
        rank = np.arange(len(chars)) - np.repeat(edge, count)
        own = chars[edge]
    else:
        rank, own, count = 0, chars, 1
    if down:
        sa[fill[chars] - 1 - rank] = items
        fill[own] -= count
    else:
        sa[fill[chars] + rank] = items
        fill[own] += count


def _induce(t: np.ndarray, smaller: np.ndarray, heads: np.ndarray, tails: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from the order of the leftmost-smaller ones, in two passes."""
    n, k = len(t), len(heads)
    sa = np.full(n, -1, np.int32)
    own = t[seeds]
    order = np.argsort(own, kind="stable")
    seeds, own = seeds[order], own[order]
    seed_at = np.searchsorted(own, np.arange(k + 1)).tolist()
    fill = heads.copy()
    _append(sa, fill, t[n - 1 : n], np.array([n - 1], np.int32), False)
    head = heads.tolist()
    for c in range(k):
        done = head[c]
        while done < (end := int(fill[c])):
            before = sa[done:end] - 1
            done = end
            before = before[before >= 0]
            before = before[~smaller[before]]
            if len(before):
                _append(sa, fill, t[before], before, False)
        if seed_at[c] < seed_at[c + 1]:
            before = seeds[seed_at[c] : seed_at[c + 1]] - 1
            _append(sa, fill, t[before], before, False)
    larger_end = fill.tolist()
    fill = tails.copy()
    tail = tails.tolist()
    for c in range(k - 1, -1, -1):
        done = tail[c]
        while (end := int(fill[c])) < done:
            before = sa[end:done][::-1] - 1
            done = end
            before = before[before >= 0]
            before = before[smaller[before]]
            if len(before):
                _append(sa, fill, t[before], before, True)
        if head[c] < larger_end[c]:
            before = sa[head[c] : larger_end[c]][::-1] - 1
            before = before[before >= 0]
            before = before[smaller[before]]
            if len(before):
                _append(sa, fill, t[before], before, True)
    return sa


def _induce_one_by_one(t: np.ndarray, smaller: np.ndarray, heads: np.ndarray, tails: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The same, position by position: for alphabets with few suffixes a bucket."""
    n = len(t)
    # the character before a suffix if the one-longer suffix is larger (smaller) than it, else -1; free places are -1
    larger_before, smaller_before = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    larger_before[1:n] = np.where(smaller[:-1], -1, t[:-1])
    smaller_before[1:n] = np.where(smaller[:-1], t[:-1], -1)
    larger_before, smaller_before = larger_before.tolist(), smaller_before.tolist()
    sa, fill = [-1] * n, tails.tolist()
    for s, c in zip(seeds[::-1].tolist(), t[seeds[::-1]].tolist()):
        at = fill[c] = fill[c] - 1
        sa[at] = s
    fill, c = heads.tolist(), int(t[n - 1])
    sa[fill[c]] = n - 1
    fill[c] += 1
    for x in sa:  # what is placed ahead comes up later in the same loop
        c = larger_before[x]
        if c >= 0:
            at = fill[c]
            sa[at] = x - 1
            fill[c] = at + 1
    fill = tails.tolist()
    for x in reversed(sa):
        c = smaller_before[x]
        if c >= 0:
            at = fill[c] = fill[c] - 1
            sa[at] = x - 1
    return np.array(sa, np.int32)


def _same_strings(t: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether t[a:a+size] equals t[b:b+size], for each of several places and sizes (0: no)."""
    same, open_, k = sizes > 0, np.flatnonzero(sizes > 0), 0
    while len(open_):
        alike = t[a[open_] + k] == t[b[open_] + k]
        same[open_[~alike]] = False
        k += 1
        open_ = open_[alike & (sizes[open_] > k)]
    return same


def suffix_order(t: np.ndarray, k: int) -> np.ndarray:
    """Start positions of the suffixes of t (characters below k) in order, by induced sorting.

    Suffixes are classified as smaller or larger than the next one. The substrings between leftmost-smaller
    positions are sorted by an induction, named by rank, and the string of names is sorted in the same way, level
    by level, until all names differ; a second induction takes their order to all suffixes.
    """
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int32)
    induce = _induce if k <= max(512, n // 64) else _induce_one_by_one
    edge = np.flatnonzero(t[1:] != t[:-1])
    smaller = np.repeat(np.append(t[edge] < t[edge + 1], False), np.diff(np.concatenate([[-1], edge, [n - 1]])))
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    count = np.bincount(t, minlength=k)
    tails = np.cumsum(count)
    heads = tails - count
    if len(leftmost) > 1:
        rough = induce(t, smaller, heads, tails, leftmost)
        flag = np.zeros(n, bool)
        flag[leftmost] = True
        rough = rough[flag[rough]]
        place = np.zeros(n, np.int32)
        place[leftmost] = np.arange(len(leftmost))
        own = place[rough]
        sizes = np.append(np.diff(leftmost) + 1, 0)  # the last one holds the end of the text: no other is like it
        alike = np.where(sizes[own[1:]] == sizes[own[:-1]], sizes[own[1:]], 0)
        fresh = np.append(True, ~_same_strings(t, leftmost[own[:-1]], leftmost[own[1:]], alike))
        names = np.empty(len(leftmost), np.int32)
        names[own] = np.cumsum(fresh) - 1
        order = own if fresh.all() else suffix_order(names, int(fresh.sum()))
        leftmost = leftmost[order]
    return induce(t, smaller, heads, tails, leftmost)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By position in the text: how many characters a suffix shares with the one before it in order (the first: 0).

    A suffix whose left neighbour character is also that of its predecessor shares one less than the suffix to
    its left; only the others are compared, four characters at a time.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    plain = phi >= 0
    taken = np.zeros(n, bool)
    taken[1:] = plain[1:] & (phi[1:] > 0) & (t[:-1] == t[np.maximum(phi[1:] - 1, 0)])
    wide = np.ndarray((n + 1,), "<u8", np.concatenate([t.astype("<i2"), np.full(8, -1, "<i2")]), strides=(2,))
    out = np.zeros(n, np.int64)
    open_, k = np.flatnonzero(plain & ~taken), 0
    while len(open_):
        x = wide[open_ + k] ^ wide[phi[open_] + k]
        differ = x != 0
        low = x[differ]
        out[open_[differ]] = k + (np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 4)
        open_ = open_[~differ]
        k += 4
    last = np.maximum.accumulate(np.where(taken, 0, np.arange(n)))
    return out[last] - (np.arange(n) - last)


def covered_strings(data: np.ndarray, bounds: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, offset and size of the stretches of pieces that are covered by strings which start earlier."""
    sizes = np.diff(bounds)
    n = len(data) + len(sizes)
    t = np.zeros(n, np.int16)
    piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    where = np.arange(n) != np.repeat(bounds[1:] + np.arange(len(sizes)), sizes + 1)
    t[where] = data.astype(np.int16) + 1
    first = bounds[:-1] + np.arange(len(sizes))  # of each piece in t; a zero follows each
    sa = suffix_order(t, 257)
    shared = permuted_common_prefixes(t, sa)
    offset = np.arange(n, dtype=np.int32) - first[piece].astype(np.int32)
    sa = sa[offset[sa] <= sizes[piece[sa]] - LENGTH]  # suffixes that hold a whole string
    same = shared[sa] >= LENGTH  # with the suffix before it, which then holds a whole string as well
    klass = np.cumsum(~same)
    d, s = docs[piece[sa]], starts[piece[sa]] + offset[sa]
    in_class = same.copy()
    in_class[:-1] |= same[1:]
    sa, klass, d, s = sa[in_class], klass[in_class], d[in_class], s[in_class]
    order = np.lexsort((s, d, klass))
    sa, klass, d, s = sa[order], klass[order], d[order], s[order]
    later = np.zeros(len(sa), bool)
    later[1:] = klass[1:] == klass[:-1]
    begin = np.maximum.accumulate(np.where(later, 0, np.arange(len(sa))))
    later &= (d != d[begin]) | (s != s[begin])  # rows that repeat a doc_id show the first occurrence again
    at = np.sort(sa[later])
    if not len(at):
        return at, at, at
    edge = np.append(True, (np.diff(at) > 1) | (piece[at[1:]] != piece[at[:-1]]))
    begin = at[edge]
    end = at[np.append(edge[1:], True)] + LENGTH
    return piece[begin], offset[begin], end - begin


def _shard_rows(shard: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, begin: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """One row for each shard with the items that come, in order of shard, and their bytes (from begin on in data);
    none for shards below 0, which hold what is covered."""
    edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    bodies = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(shard)]):
        n = size[a:b]
        at = np.repeat(begin[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
        bodies.append(data[at].tobytes() if shard[a] >= 0 else b"")
    list_of = lambda x: pa.ListArray.from_arrays(pa.array(np.append(edge, len(shard)).astype(np.int32)), pa.array(x))
    return pa.RecordBatch.from_arrays([pa.array(shard[edge]), list_of(doc), list_of(start), list_of(size), pa.array(bodies, pa.binary())], ["shard", "docs", "starts", "sizes", "body"])


def _strings(doc: np.ndarray, start: np.ndarray, size: np.ndarray, begin: np.ndarray, data: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """The strings of crowded pieces: the first of equal ones goes to a shard, by content, the later are covered."""
    count = size - LENGTH + 1
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc, start, begin = np.repeat(doc, count), np.repeat(start, count) + step, np.repeat(begin, count) + step
    wide = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    places = [*range(0, LENGTH - 8, 8), LENGTH - 8]
    h = np.zeros(len(begin), np.uint64)
    for k in places:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + wide[begin + k])
    order = np.lexsort((start, doc, h))
    h, doc, start, begin = h[order], doc[order], start[order], begin[order]
    same = np.append(False, h[1:] == h[:-1])
    for k in places:  # neighbours in order are compared, so unlike strings with one hash stay apart
        same[1:] &= wide[begin[1:] + k] == wide[begin[:-1] + k]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    gone = same & ((doc != doc[first]) | (start != start[first]))
    shard = (h % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard[~same], kind="stable")
    yield _shard_rows(*(x[~same][order] for x in (shard, doc, start, np.full(len(h), LENGTH), begin)), data)
    if gone.any():
        doc, start = doc[gone], start[gone]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        edge = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))
        end = start[np.append(edge[1:], True)] + LENGTH
        doc, start = doc[edge], start[edge]
        shard = -1 - doc % shards
        order = np.argsort(shard, kind="stable")
        shard, doc, start, size = shard[order], doc[order], start[order], (end - start)[order]
        yield _shard_rows(shard, doc, start, size, start, data)


def _cut(shards: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, all_bounds = utf8(batch.column("text"))
            lists = batch.column("items")
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            flat, ends = lists.flatten(), np.asarray(lists.value_lengths())
            row = np.repeat(np.arange(batch.num_rows), ends)
            start, size, gram = (np.asarray(flat.field(k)) for k in ("start", "size", "gram"))
            if not len(row):
                continue
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[row]
            begin = all_bounds[row] + start
            crowded = np.flatnonzero(gram == CROWDED)
            for at in range(0, len(crowded), 2000):
                some = crowded[at : at + 2000]
                yield from _strings(doc[some], start[some], size[some], begin[some], data, shards)
            plain = np.flatnonzero(gram != CROWDED)
            if len(plain):
                shard = (mix64(gram[plain].view(np.uint64)) % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((gram[plain], shard))
                yield _shard_rows(shard[order], *(x[plain][order] for x in (doc, start, size, begin)), data)
            give_back()

    return cut


def _sorted_shard(frame: pd.DataFrame) -> pd.DataFrame:
    sizes = np.concatenate(frame["sizes"].to_list()).astype(np.int64)
    docs, starts = np.concatenate(frame["docs"].to_list()), np.concatenate(frame["starts"].to_list())
    if frame["shard"].iloc[0] < 0:  # known to be covered
        return pd.DataFrame({"doc": docs, "start": starts, "size": sizes})
    data = np.frombuffer(b"".join(frame["body"]), np.uint8)
    piece, offset, size = covered_strings(data, np.concatenate([[0], np.cumsum(sizes)]), docs, starts)
    give_back()
    return pd.DataFrame({"doc": docs[piece], "start": starts[piece] + offset, "size": size.astype(np.int64)})


def _removed(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """What stays of each text, as bytes or as their SHA-256."""
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        items = batch.column("items")
        lists = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
        n = batch.num_rows
        counts = np.asarray(lists.value_lengths().fill_null(0))
        flat = lists.flatten()
        start, size = np.asarray(flat.field("start")), np.asarray(flat.field("size"))
        ends = np.concatenate([[0], np.cumsum(counts)])
        removed, spans, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        for i in range(n):
            own = np.ascontiguousarray(data[bounds[i] : bounds[i + 1]])
            if counts[i]:
                step = np.zeros(len(own) + 1, np.int32)
                s = start[ends[i] : ends[i + 1]]
                np.add.at(step, s, 1)
                np.add.at(step, s + size[ends[i] : ends[i + 1]], -1)
                gone = np.cumsum(step)[:-1] > 0
                removed[i] = gone.sum()
                spans[i] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                own = own[~gone]
            kept.append(hashlib.sha256(own).hexdigest() if digest else own.tobytes())
        columns = [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(removed), pa.array(spans), pa.array(kept, pa.string() if digest else pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])
        give_back()


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for every row of docs; with
    digest, kept_sha256 in its place.

    Texts are UTF-8 bytes, null is empty; a text under LENGTH bytes keeps all. Equal rows (same doc_id, same text) are one
    document, so they lose nothing to each other and the same to others. Unlike texts under one doc_id are documents of
    their own that follow each other in the order of their hashes. A row without doc_id is taken out of all comparisons
    and keeps its bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    hashes = [f(F.xxhash64("text")).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    per = some.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("n"), *hashes)
    total, unlike = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bool_or(F.col("low") != F.col("high")), F.lit(False))).first()
    if unlike:
        each = numbered(some.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")).distinct(), [F.col("doc_id"), F.col("h")], "doc")
        rows = saved(rows.withColumn("h", F.md5(F.col("text").cast("binary"))).join(each, ["doc_id", "h"], "left").select(F.col("doc_id").alias("own"), F.col("doc").alias("doc_id"), "text"))
        some = rows.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    else:
        rows = rows.withColumn("own", F.col("doc_id"))
    buckets, crowd = max(16, -(-total // BUCKET_BYTES)), CROWD
    found = saved(_dealt(some, buckets, _hot_grams(some)).groupBy("bucket").applyInPandas(lambda frame: _resolve(frame, crowd), "doc long, start long, size long, gram long"))
    open_ = found.filter("gram is not null")
    shards = max(8, -(-int(open_.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES))
    by_doc = open_.groupBy("doc").agg(F.collect_list(F.struct("start", "size", "gram")).alias("items"))
    cut = some.join(by_doc, some["doc_id"] == by_doc["doc"]).select("doc_id", "text", "items")
    cut = cut.mapInArrow(_cut(shards), "shard long, docs array<long>, starts array<long>, sizes array<long>, body binary")
    more = saved(cut.groupBy("shard").applyInPandas(_sorted_shard, "doc long, start long, size long"))
    gone = found.filter("gram is null").select("doc", "start", "size").unionByName(more)
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("items"))
    held = rows.join(gone, rows["doc_id"] == gone["doc"], "left").select(F.col("own").alias("doc_id"), "text", "items")
    kind = "kept_sha256 string" if digest else "kept binary"
    return held.mapInArrow(lambda batches: _removed(batches, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {kind}")


def dedup(docs: DataFrame) -> DataFrame:
    """remove_repeats() with the SHA-256 of what stays in place of the bytes."""
    return remove_repeats(docs, digest=True)
