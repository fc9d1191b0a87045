"""Alignment of two tokenizers over the same bytes.

The texts of an Arrow batch are laid end to end, each with a space before it, and so are their tokens. The ends of
the tokens of A and of B are counted by byte, once for the whole batch; a byte where both have one is a cut.
Positions within a document follow from running sums over the batch, taken at the documents' bounds.

The tokens that end at a cut are linked, and as they cover the same bytes up to there, one of them is a suffix of
the other. That gives every possible link a small number of its own: a token of A and the length of the suffix
that is the token of B, or the other way round. There are at most as many as the tokens have bytes in all (about
540,000 for the two vocabularies here, whatever the corpus), so the counts of all links are one array, which every
task can hold.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, give_back, saved, utf8

#: Chunks of text whose ids a worker keeps at most; beyond that it starts anew.
KNOWN = 600_000
#: Longer chunks, and odd texts, go through the tokenizer file's own library.
LONG = 300
#: Tokens or bytes that are looked at together.
STRETCH = 1 << 20
SPACE = "▁"
# Fixed value: where a byte-level tokenizer parts a text.
PARTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_workers: dict[tuple[str, str], Encoder] = {}


@dataclass
class Vocabulary:
    """The bytes of all tokens of one tokenizer, laid end to end; `plain` tokens are no byte fallbacks."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    plain: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes], plain: list[bool]) -> Vocabulary:
        sizes = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array(plain))

    def tokens(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a : a + n] for a, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True)]

    def spell(self, data: np.ndarray, ids: np.ndarray) -> bool:
        """Whether the tokens' bytes, end to end, are just these."""
        ends = np.cumsum(self.sizes[ids])
        if (int(ends[-1]) if len(ids) else 0) != len(data):
            return False
        for low in range(0, len(ids), STRETCH):
            some = ids[low : low + STRETCH]
            first = int(ends[low - 1]) if low else 0
            sizes = self.sizes[some]
            at = np.repeat(self.starts[some] - (ends[low : low + STRETCH] - sizes - first), sizes) + np.arange(sizes.sum())
            if not np.array_equal(self.data[at], data[first : first + len(at)]):
                return False
        return True


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: bytes that show keep their code point,
    the others follow from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@cache
def vocabularies(path_a: str, path_b: str) -> tuple[Vocabulary, Vocabulary]:
    import sentencepiece
    from tokenizers import Tokenizer

    a, of = Tokenizer.from_file(path_a), byte_level()
    spelled = [""] * a.get_vocab_size()
    for token, i in a.get_vocab(with_added_tokens=False).items():
        spelled[i] = token
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    fallback = [b.is_byte(i) for i in range(b.get_piece_size())]
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if f else b"" if b.is_control(i) or b.is_unknown(i) else p.replace(SPACE, " ").encode() for i, (p, f) in enumerate(zip(pieces, fallback, strict=True))]
    return Vocabulary.of([bytes(of[c] for c in t) for t in spelled], [True] * len(spelled)), Vocabulary.of(bytes_b, [not f for f in fallback])


class Links:
    """Numbers of all possible links: below `split` a token of A and the size of B's (0 for a byte fallback), from
    there a token of B and the size of A's, which is smaller."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b = a, b
        self.base_a = np.cumsum(a.sizes + 1) - a.sizes - 1
        self.split = int((a.sizes + 1).sum())
        self.base_b = self.split + np.cumsum(b.sizes) - b.sizes
        self.size = self.split + int(b.sizes.sum())

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size_a, size_b = self.a.sizes[a], self.b.sizes[b]
        within = self.base_a[a] + np.where(self.b.plain[b], size_b, 0)
        return np.where(size_b <= size_a, within, self.base_b[b] + size_a - 1)

    def token_of_b(self, number: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.base_b, number, side="right") - 1  # for those from `split` on; empty tokens have no number
        ids = {(t, bool(p)): i for i, (t, p) in enumerate(zip(self.b.tokens(), self.b.plain, strict=True)) if t}
        tokens = self.a.tokens()
        low = np.flatnonzero(number < self.split)
        own = np.searchsorted(self.base_a, number[low], side="right") - 1
        size = number[low] - self.base_a[own]
        out[low] = [ids[tokens[i][-max(n, 1) :], n > 0] for i, n in zip(own.tolist(), size.tolist(), strict=True)]
        return out


def _ranked(path: str):
    """A faster encoder with the same vocabulary, where its merges are in the order of their ids, and which tokens
    start with a space."""
    import tiktoken

    held, of = json.loads(Path(path).read_text()), byte_level()
    model, special = held["model"], {t["id"] for t in held["added_tokens"]}
    merges = [m if isinstance(m, str) else "".join(m) for m in model["merges"]]
    ids = [model["vocab"][m.replace(" ", "")] for m in merges]
    if ids != sorted(ids):
        raise ValueError("merges are not in the order of their ids")
    ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if i not in special}
    spaced = np.zeros(len(model["vocab"]), bool)
    spaced[[i for t, i in ranks.items() if t[:1] == b" "]] = True
    return tiktoken.Encoding("ranked", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={}), spaced


class Encoder:
    """Both tokenizers, and the ids of the chunks of text met so far, in two arrays by a chunk's number.

    Both tokenizers start a new token at a single space between two characters that are no white space, so texts
    are cut there and each distinct chunk is encoded once. A text with other white space beside a space, or with
    B's own mark for spaces, is encoded whole.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.fast, self.spaced = _ranked(path_a)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": -1}
        none = np.zeros(0, np.int32)
        self.ids, self.ends = [none, none], [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def whole(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    def learn(self, new: list[str]) -> None:
        """Ids of chunks that were not met yet; -1 marks those that make their text odd."""
        fit = []
        for c in new:
            if c[0].isspace() or c[-1].isspace() or SPACE in c or len(c) > LONG:
                self.known[c] = -1
            else:
                self.known[c] = len(self.ends[0]) - 1 + len(fit)
                fit.append(c)
        made: list[list[np.ndarray]] = [[], []]
        sizes: list[list[np.ndarray]] = [[], []]
        for at in range(0, len(fit), 2000):
            some = fit[at : at + 2000]
            a = np.array(self.fast.encode_ordinary(" " + " ".join(some)), np.int32)  # spaces start chunks and nothing else
            b = self.b.encode(some, num_threads=1)
            made[0].append(a)
            sizes[0].append(np.diff(np.append(np.flatnonzero(self.spaced[a]), len(a))))
            sizes[1].append(np.array([len(x) for x in b], np.int64))
            made[1].append(np.fromiter(chain.from_iterable(b), np.int32, int(sizes[1][-1].sum())))
        for k in range(2):
            self.ids[k] = np.concatenate([self.ids[k], *made[k]])
            self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes[k]]))])

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B for all texts, each with the bounds of the texts; empty texts have none."""
        if len(self.known) > KNOWN:
            self.forget()
        parts = [t.split(" ") if t else [] for t in texts]
        if new := set(chain.from_iterable(parts)).difference(self.known):
            self.learn(list(new))
        counts = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        row = np.repeat(np.arange(len(texts)), counts)
        odd = np.unique(row[at < 0])
        fine = np.ones(len(texts), bool)
        fine[odd] = False
        at, row = at[fine[row]], row[fine[row]]
        whole = self.whole([texts[i] for i in odd.tolist()]) if len(odd) else ([], [])
        out = []
        for ids, ends, others in zip(self.ids, self.ends, whole, strict=True):
            size = ends[at + 1] - ends[at]
            sizes = np.bincount(row, size, len(texts)).astype(np.int64)
            sizes[odd] = [len(x) for x in others]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            made = np.empty(bounds[-1], np.int32)
            from_chunks = np.ones(len(made), bool)
            for i, x in zip(odd.tolist(), others, strict=True):
                made[bounds[i] : bounds[i + 1]] = x
                from_chunks[bounds[i] : bounds[i + 1]] = False
            made[from_chunks] = ids[np.repeat(ends[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            out.append((made, bounds))
        return out[0], out[1]


def _encoder(path_a: str, path_b: str) -> Encoder:
    if (path_a, path_b) not in _workers:
        _workers[path_a, path_b] = Encoder(path_a, path_b)
    return _workers[path_a, path_b]


def both_ends(ends_a: np.ndarray, ends_b: np.ndarray, total: int) -> np.ndarray:
    """The bytes where a token of A and one of B end, in order: ends are counted by byte, in stretches."""
    out = []
    for low in range(0, total, 4 * STRETCH):
        size = min(4 * STRETCH, total - low)
        a, b = (np.bincount(e[slice(*np.searchsorted(e, [low + 1, low + size + 1]))] - low - 1, minlength=size) for e in (ends_a, ends_b))
        out.append(np.flatnonzero((a > 0) & (b > 0)) + low + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@cache
def _written(n: int) -> pa.Array:
    """Every id with a comma, a bar and a semicolon after it."""
    return pa.array([f"{i}{mark}" for mark in ",|;" for i in range(n)], pa.large_string())


def digests(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, bounds: np.ndarray, n: int) -> list[str]:
    """SHA-256 of the groups of each document, of which bounds are the first groups; '' for one without groups."""
    last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
    upto_a, upto_b = (np.concatenate([[0], np.flatnonzero(last) + 1]) for last in (last_a, last_b))
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    code[np.arange(len(ids_a)) + upto_b[group_a]] = ids_a + n * last_a
    code[np.arange(len(ids_b)) + upto_a[group_b + 1]] = ids_b + 2 * n * last_b
    ends = (upto_a + upto_b)[bounds]
    out = []
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if low == high:
            out.append("")
            continue
        h = hashlib.sha256()
        for at in range(low, high, STRETCH):
            some = pc.take(_written(n), pa.array(code[at : min(high, at + STRETCH)]))
            offsets, data = np.frombuffer(some.buffers()[1], np.int64), some.buffers()[2]
            h.update(memoryview(data)[: int(offsets[len(some)]) - (at + STRETCH >= high)])
        out.append(h.hexdigest())
    return out


def align(texts: list[str], encoder: Encoder, links: Links) -> dict[str, np.ndarray | list]:
    """n_a, n_b, n_groups, groups_sha256 of each text and `links`, the numbers of its links in order, as bytes."""
    (ids_a, of_a), (ids_b, of_b) = encoder.encode(texts)
    raw = [(" " + t).encode() if t else b"" for t in texts]
    data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
    start = np.cumsum(sizes) - sizes
    if not (links.a.spell(data, ids_a) and links.b.spell(data, ids_b)):  # some text's tokens do not spell it
        good = np.array([
            all(v.spell(data[s : s + n], ids[of[i] : of[i + 1]]) for v, ids, of in ((links.a, ids_a, of_a), (links.b, ids_b, of_b)))
            for i, (s, n) in enumerate(zip(start.tolist(), sizes.tolist(), strict=True))
        ], bool)
        ids_a, ids_b = ids_a[np.repeat(good, np.diff(of_a))], ids_b[np.repeat(good, np.diff(of_b))]
        of_a, of_b = (np.concatenate([[0], np.cumsum(np.where(good, np.diff(of), 0))]) for of in (of_a, of_b))
        sizes = np.where(good, sizes, 0)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ends_a, ends_b = np.cumsum(links.a.sizes[ids_a]), np.cumsum(links.b.sizes[ids_b])
    cut = both_ends(ends_a, ends_b, int(bounds[-1]))
    number = links.number(ids_a[np.searchsorted(ends_a, cut)], ids_b[np.searchsorted(ends_b, cut)]).astype(np.uint32)
    groups = np.searchsorted(cut, bounds, side="right")  # cuts up to the end of each document: running sums at its bounds
    sha = digests(ids_a, ids_b, np.searchsorted(cut, ends_a), np.searchsorted(cut, ends_b), groups, max(len(links.a.sizes), len(links.b.sizes)))
    return {
        "n_a": np.diff(of_a), "n_b": np.diff(of_b), "n_groups": np.diff(groups), "groups_sha256": sha,
        "links": [number[x:y].tobytes() for x, y in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True)],
    }


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, links (unsigned 32-bit numbers) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, encoder = Links(*vocabularies(path_a, path_b)), _encoder(path_a, path_b)
        for batch in batches:
            _, bounds = utf8(batch.column("text"))
            for row, end in chunks(bounds):
                part = batch.slice(row, end - row)
                made = align([t or "" for t in part.column("text").to_pylist()], encoder, links)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(made[c], pa.int64()) for c in ("n_a", "n_b", "n_groups")], pa.array(made["groups_sha256"], pa.string()), pa.array(made["links"], pa.binary())],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
                )
            give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of links, and the bounds of its rows."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view("<u4") if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint32)
    return flat, (bounds - bounds[0]) // 4


def link_counts(rows: DataFrame, size: int) -> DataFrame:
    """number, n: how often each link occurs in all rows; a task sends a number once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            flat, _ = _numbers(batch.column("links"))
            for low in range(0, len(flat), 4 * STRETCH):
                total += np.bincount(flat[low : low + 4 * STRETCH], minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"number": pa.array(found), "n": pa.array(total[found])})

    return rows.select("links").mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    A is a byte-level vocabulary and gets a space before each text, B is of pieces and adds it itself. Texts that
    are null or empty, or that either tokenizer's tokens do not spell, have zeros and ''. Every row counts, also
    repeated ones and those without a doc_id; other columns are not looked at, and an empty table gives none. Long
    texts are worked on in stretches. Counts are of all rows: n_best are a document's links that no other link of
    the same token of B outnumbers, count_sum is the sum of its links' counts.
    """
    made = saved(aligned(docs, path_a, path_b))
    links = Links(*vocabularies(path_a, path_b))
    counts = link_counts(made, links.size).toPandas()  # links.size rows at most
    number, n = counts["number"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    of = links.token_of_b(number)
    most = np.zeros(len(links.b.sizes), np.int64)
    np.maximum.at(most, of, n)
    count, best = np.zeros(links.size, np.int64), np.zeros(links.size, bool)
    count[number], best[number] = n, n == most[of]
    shared = docs.sparkSession.sparkContext.broadcast((count, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = shared.value
        for batch in batches:
            flat, bounds = _numbers(batch.column("links"))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[flat], dtype=np.int64)])[bounds]) for x in (best, count)]
            columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.diff(bounds)), *map(pa.array, sums), batch.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return made.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
