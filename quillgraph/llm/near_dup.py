"""Near-duplicate documents by min-max hashing over five-word shingles.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so half as
many permutations are evaluated; both agree between two sets with probability equal to their Jaccard
similarity. BANDS bands of two permutations (four values) are looked up. A pair at similarity 0.75 misses
all bands with probability (1 - 0.75**4) ** 40 = 2.5e-7. In sets of a few shingles minimum and maximum depend
on one another, so sets of SMALL shingles at most have EXTRA bands more.

Hashes only find candidates. Documents with equal word sequences (by a cryptographic digest) are one class from
the start; every link is confirmed on the words of both texts. In a bucket of classes, all are first checked
against the bucket's smallest one, which joins most of a group in a linear number of checks. Buckets whose
members are then still in different components are compared in blocks of bounded size, buckets of the same
members once, but not within a component, and only links of a spanning forest leave a block. Components are
joined by alternating large and small stars.
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
from .common import chunks, give_back, mix64, renamed, restored, saved, utf8

SHINGLE = 5
BANDS = 40
#: More bands for sets of so many shingles at most.
EXTRA, SMALL = 80, 24
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
BLOCK = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = mix64(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)
_A = mix64(np.arange(1000, 1000 + 2 * (BANDS + EXTRA), dtype=np.uint64)) | np.uint64(1)
_B = mix64(np.arange(3000, 3000 + 2 * (BANDS + EXTRA), dtype=np.uint64))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words up to this many bytes are hashed side by side, eight bytes a step, longer ones one by one.
LONG = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end], which lie in lower case."""
    size = ends - starts
    wide = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix64(size.astype(np.uint64) * _ODD[50])
    for k in range(0, LONG, 8):
        own = np.flatnonzero((size > k) & (size <= LONG))
        if not len(own):
            break
        block = wide[starts[own] + k] & _MASK[np.minimum(size[own] - k, 8)]
        out[own] = mix64(out[own] * _ODD[51] + block)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, sorted within a text, and the bounds of the texts."""
    n_docs, n = len(bounds) - 1, len(data)
    empty = np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    if not n:
        return empty
    inside = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return empty
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    word = word_hashes(_LOWER[data], starts, ends)
    first = np.searchsorted(starts, bounds)  # of the words of each text
    count = np.diff(first)
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    out_bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first[:-1] - out_bounds[:-1], size) + np.arange(out_bounds[-1])
    wide = np.concatenate([word, np.zeros(SHINGLE, np.uint64)])
    held = np.repeat(count, size)
    total = mix64(np.minimum(held, SHINGLE).astype(np.uint64))
    for k in range(SHINGLE):
        total = total + np.where(k < held, wide[at + k] * _ODD[k], np.uint64(0))
    hashes = mix64(total)
    for a, b in zip(out_bounds[:-1].tolist(), out_bounds[1:].tolist()):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[out_bounds[:-1][size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return hashes[fresh], kept[out_bounds]


def shingles(text: bytes) -> set[tuple[bytes, ...]]:
    """The shingles of a text as tuples of words."""
    w = text.lower().split()  # of bytes: just A-Z, and just the six ASCII white-space characters
    return set(zip(*[w[k:] for k in range(SHINGLE)], strict=False)) if len(w) >= SHINGLE else {tuple(w)} if w else set()


def band_hashes(sets: np.ndarray, starts: np.ndarray, bands: range) -> np.ndarray:
    """A hash for each band of each (non-empty) set: of the minima and maxima under two permutations each."""
    out = np.empty((len(starts), len(bands)), np.uint64)
    for column, band in enumerate(bands):
        h = np.full(len(starts), _ODD[band % len(_ODD)] + np.uint64(band), np.uint64)
        for p in (2 * band, 2 * band + 1):
            x = sets * _A[p] + _B[p]
            h = mix64(h * _ODD[60] + np.minimum.reduceat(x, starts))
            h = mix64(h * _ODD[61] + np.maximum.reduceat(x, starts))
        out[:, column] = h
    return out


def _digest(text: bytes) -> bytes:
    """A cryptographic digest of a text's words."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array([_digest(t) for t in batch.column("text").to_pylist()], pa.binary())], ["text", "digest"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, all_bounds = utf8(batch.column("text"))
        for row, end in chunks(all_bounds):
            b = all_bounds[row : end + 1]
            own, cut = data[b[0] : b[-1]], (b - b[0]).tolist()
            sets, bounds = shingle_sets(own, b - b[0])
            size = np.diff(bounds)
            digests = [_digest(own[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:])]
            width = np.where(size > SMALL, BANDS, np.where(size > 0, BANDS + EXTRA, 0))
            ends = np.concatenate([[0], np.cumsum(width)])
            flat = np.zeros(ends[-1], np.uint64)
            for rows, bands in ((size > 0, range(BANDS)), ((size > 0) & (size <= SMALL), range(BANDS, BANDS + EXTRA))):
                rows = np.flatnonzero(rows)
                if len(rows):
                    some = np.concatenate([sets[bounds[i] : bounds[i + 1]] for i in rows.tolist()]) if bands.start else sets
                    starts = np.concatenate([[0], np.cumsum(size[rows])[:-1]])
                    flat[(ends[rows] + bands.start)[:, None] + np.arange(len(bands))] = band_hashes(some, starts, bands)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(size.astype(np.int64)), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"])
        give_back()


def linked(x: set, y: set) -> bool:
    """Whether the texts of two sets of shingles are linked."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    common = len(x & y)
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that are linked; the shingles of a text that several rows in turn begin with are made once."""
    last, x = None, set()
    for batch in batches:
        ids, others = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        ok = []
        for i, a in enumerate(ids):
            if a != last:
                last, x = a, shingles(batch.column("ta")[i].as_py())
            ok.append(linked(x, shingles(batch.column("tb")[i].as_py())))
        kept = [(a, b) for a, b, fit in zip(ids, others, ok, strict=True) if fit]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([k for _, k in kept], pa.int64())], ["a", "b"])
    give_back()


def block_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between the rows `left` and `right` that are in different components."""
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1  # a shingle of one row is in no intersection
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    # a row that shares too few of its shingles with any other row here has no link
    enough = 100 * np.bincount(rows[use], minlength=len(sets)) >= PERCENT * sizes
    left, right = left[enough[left]], right[enough[right]]
    if not len(left) or not len(right):
        return []
    rows, cols, width = rows[use], column[inverse[use]], int(shared.sum())
    common = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for at in range(0, width, 4096):
        a, b = np.searchsorted(cols, [at, at + 4096])
        r, c = rows[a:b], cols[a:b] - at
        one, two = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        m = place_l[r] >= 0
        one[place_l[r[m]], c[m]] = 1
        m = place_r[r] >= 0
        two[place_r[r[m]], c[m]] = 1
        common += one @ two.T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    linked = (100 * common >= PERCENT * union) & (comps[left][:, None] != comps[right][None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(v.tolist() for v in np.nonzero(linked)), strict=True):
        x, y = find(int(comps[left[i]])), find(int(comps[right[j]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(ids[left[i]]), int(ids[right[j]])))
    return out


def _blocks(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks: found on hashes of shingles, each confirmed on the words of both texts. Should hashes
    have misled, words decide alone."""
    ids, comps, texts = frame["id"].to_numpy(np.int64), frame["comp"].to_numpy(np.int64), frame["text"].tolist()
    left, right = np.flatnonzero(frame["block"] == frame["i"]), np.flatnonzero(frame["block"] == frame["j"])
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sets = []
    for row, end in chunks(bounds):
        hashes, cut = shingle_sets(np.frombuffer(b"".join(texts[row:end]), np.uint8), bounds[row : end + 1] - bounds[row])
        sets += [hashes[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    links = block_links(ids, comps, sets, left, right)
    of = dict(zip(ids.tolist(), texts, strict=True))
    if not all(linked(shingles(of[a]), shingles(of[b])) for a, b in links):
        number: dict[tuple[bytes, ...], int] = {}
        sets = [np.array([number.setdefault(s, len(number)) for s in shingles(t)], np.int64) for t in texts]
        links = block_links(ids, comps, sets, left, right)
    give_back()
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _dealt(labelled: DataFrame, size: int) -> DataFrame:
    """h, id, comp, block, i, j: the rows of each pair of blocks (i, j) to compare, of buckets in several components.

    A component with `size` rows or more in a bucket has blocks of its own there, which are not compared with
    one another; the rows of the others share blocks. Rows are dealt by a hash of their id, so a bucket of
    any size needs no order. Buckets of two were compared already. Of buckets with the same members (by two
    64-bit sums over their ids) one is compared.
    """
    member = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"f{k}") for k in (1, 2)]
    groups = labelled.groupBy("h", "comp").agg(F.count("*").alias("c"), *member)
    small = F.sum(F.when(F.col("c") < size, F.col("c")).otherwise(0))
    mixed = groups.groupBy("h").agg(F.count("*").alias("k"), F.sum("c").alias("m"), small.alias("small"), F.bit_xor("f1").alias("f1"), F.bit_xor("f2").alias("f2")).filter("k > 1 and m > 2")
    mixed = mixed.groupBy("k", "m", "f1", "f2").agg(F.min(F.struct("h", "small")).alias("one")).select("one.h", "one.small")
    owner = F.when(F.col("c") >= size, F.col("comp"))
    parts = F.ceil(F.when(F.col("c") >= size, F.col("c")).otherwise(F.col("small")) / size).cast("int")
    groups = saved(groups.join(mixed, "h").select("h", "comp", owner.alias("owner"), parts.alias("parts")))
    name = lambda part: F.concat_ws(":", F.col("owner").cast("string"), part.cast("string"))
    blocks = groups.select("h", "owner", "parts").distinct().select("h", "owner", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks = blocks.select("h", "owner", name(F.col("part")).alias("i"))
    pairs = blocks.join(blocks.withColumnsRenamed({"i": "j", "owner": "other"}), "h").filter("i <= j and not coalesce(owner = other, false)")
    sides = pairs.select("h", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = labelled.join(groups, ["h", "comp"]).select("h", "id", "comp", name(F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    return rows.join(sides, ["h", "block"])


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of the undirected links a - b, by alternating stars."""
    x = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    before = None
    while True:
        both = x.unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        x = both.filter("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = x.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        y = x.join(low, F.col("a") == F.col("n"))
        x = saved(y.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(y.select("a", F.col("m").alias("b"))).filter("a != b").distinct())
        now = x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return x.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    A null text, or one without words, has no shingles and is linked with nothing. Rows that share a doc_id
    are one document and get the same decision (but for rows without words), also where their texts differ: what is linked with one of the texts
    is linked with the document. A row without doc_id takes no part: component_id is null and
    it is kept. Ties need no rule, as a component's name is its smallest doc_id.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    signed = saved(rows.mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, bands array<long>"))
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    several = saved(some.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.max("digest").alias("other")).filter("digest <> other").drop("other"))
    unlike = not several.isEmpty()  # a doc_id has texts of several classes, so it names none
    classes = saved(numbered(classes, [F.col("rep"), F.col("digest")], "id") if unlike else classes.withColumn("id", F.col("rep")))
    held = saved(some.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"]).dropDuplicates(["digest"]).selectExpr("id", "n_shingles n", "bands"))
    keys = held.select("id", "n", F.explode("bands").alias("h"))
    buckets = keys.groupBy("h").agg(F.min(F.struct("id", "n")).alias("pivot"), F.count("*").alias("m")).filter("m > 1")
    members = saved(keys.join(buckets, "h").select("h", "id", "n", "pivot"))
    fits = F.expr(f"100 * least(n, pivot.n) >= {PERCENT} * greatest(n, pivot.n)")
    pairs = members.filter(fits & (F.col("id") != F.col("pivot.id"))).select(F.col("pivot.id").alias("a"), F.col("id").alias("b")).distinct()
    wanted = members.select("id").distinct()
    if unlike:
        wanted = wanted.join(classes, "id")
        texts = rows.join(wanted, rows["doc_id"] == wanted["rep"], "left_semi").select(F.col("text").cast("binary").alias("text")).filter("text is not null")
        texts = texts.mapInArrow(_digested, "text binary, digest binary").join(wanted.select("id", "digest"), "digest")
    else:
        texts = rows.join(wanted, rows["doc_id"] == wanted["id"], "left_semi").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    texts = saved(texts.groupBy("id").agg(F.min("text").alias("text")))
    one, two = texts.selectExpr("id a", "text ta"), texts.selectExpr("id b", "text tb")
    links = saved(pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long"))
    if unlike:
        own = some.join(several.withColumnRenamed("digest", "least"), "doc_id").select("least", "digest").distinct()
        a, b = classes.select(F.col("digest").alias("least"), F.col("id").alias("a")), classes.select("digest", F.col("id").alias("b"))
        links = saved(links.unionByName(own.join(a, "least").join(b, "digest").select("a", "b")))
    first = components(links).withColumnRenamed("node", "id")
    labelled = members.join(first, "id", "left").select("h", "id", F.coalesce("component", "id").alias("comp"))
    dealt = _dealt(labelled, BLOCK).join(texts, "id")
    more = dealt.groupBy("h", "i", "j").applyInPandas(_blocks, "a long, b long")
    found = components(saved(links.unionByName(more)))
    named = classes.join(found, classes["id"] == found["node"], "left").select("digest", "rep", F.coalesce("component", "id").alias("class_component"))
    if unlike:
        named = named.join(named.groupBy("class_component").agg(F.min("rep").alias("least")), "class_component").select("digest", F.col("least").alias("class_component"))
    named = named.select("digest", "class_component")
    out = signed.drop("bands").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("class_component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that a smaller doc_id of their component represents; columns stay."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("d")).distinct()
    x = docs.select(F.col("doc_id").cast("long").alias("d"), *renamed(docs.columns)).join(gone, "d", "left_anti")
    return x.select(*restored(docs.columns))
