"""Language identification by prediction by partial matching (PPM, escape method C).

Every language has a tree of byte contexts of order 0 to 3. The probability of a byte in a context is
its count over (total + distinct bytes); an unseen byte escapes, with probability distinct / (total +
distinct), to the context that is one byte shorter, and at last to a uniform guess. The statistics are
frozen after fitting, so the code length of a byte depends on itself and the three bytes before it: each
tree is unrolled into a table of code lengths by context node and byte, and a whole text is scored by array
lookups. The language with the shortest exact code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, renamed, restored, utf8

ORDER = 3
#: Texts start as if after white space.
PAD = 0x20
UNDETERMINED = "und"


#: Bytes that are scored at once, of a part of one text or of several texts.
STRETCH = 1 << 20


@dataclass
class Tree:
    """The unrolled context tree of one language: class of each byte (0: not seen), context node by three classes,
    bits by node and class. Nodes below classes**2 are contexts of order 2, the others seen ones of order 3."""

    classes: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    def cost(self, data: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """Bits of every byte after the one, two and three bytes before it."""
        a = int(self.classes.max()) + 1
        one, two, three = (self.classes[x] for x in before)
        return self.bits[self.nodes[(three * a + two) * a + one] * a + self.classes[data]]


@dataclass
class Ppm:
    """langs (sorted) and their trees; the model grows with the number of languages, each with its own sample."""

    langs: list[str]
    trees: list[Tree]

    def code_lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of every text under every language; an empty text takes 0. A long text is scored in stretches."""
        out = np.zeros((len(bounds) - 1, len(self.langs)))
        for low in range(0, len(data), STRETCH):
            high = min(low + STRETCH, len(data))
            first = int(np.searchsorted(bounds, low, side="right")) - 1
            last = int(np.searchsorted(bounds, high, side="left"))
            starts = bounds[first:last]
            before = []
            for back in range(1, ORDER + 1):
                prev = np.full(high - low, PAD, np.uint8)
                skip = max(0, back - low)
                prev[skip:] = data[low + skip - back : max(0, high - back)]
                for k in range(back):
                    at = starts[starts + k >= low] + k - low
                    prev[at[at < high - low]] = PAD
                before.append(prev)
            full = np.flatnonzero(np.minimum(bounds[first + 1 : last + 1], high) > np.maximum(starts, low))
            at = np.maximum(starts[full], low) - low
            for k, tree in enumerate(self.trees):
                out[first + full, k] += np.add.reduceat(tree.cost(data[low:high], before), at, dtype=np.float64)
        return out


def held_out(doc_id: str | F.Column = "doc_id") -> F.Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text: str = "text") -> F.Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (three bytes of context, byte) by language in each batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        data, bounds = utf8(batch.column("text"))
        for lang in sorted(set(langs)):
            counts: dict[int, int] = {}
            for row in np.flatnonzero(langs == lang):
                t = np.concatenate([np.full(ORDER, PAD, np.uint8), data[bounds[row] : bounds[row + 1]]]).astype(np.uint32)
                code = (t[:-3] << 24) | (t[1:-2] << 16) | (t[2:-1] << 8) | t[3:]
                for g, n in zip(*(x.tolist() for x in np.unique(code, return_counts=True)), strict=True):
                    counts[g] = counts.get(g, 0) + n
            if counts:
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.string()), "gram": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})


def fit(docs: DataFrame, sample_docs: int = 600) -> Ppm:
    """Frozen statistics of the labelled rows that are not held out.

    sample_docs bounds the training documents of a language (about; a hash of doc_id picks them, so reruns
    agree), and with them what reaches the driver. Every context of the sample is kept.
    """
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & has_letter() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    picked = F.lit(False)
    for lang in langs:
        share = min(1.0, sample_docs / sizes[lang])
        picked = picked | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))))
    grams = (
        rows.filter(picked)
        .select("lang", "text")
        .mapInArrow(_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    model = build(langs, grams["lang"].to_numpy(), grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64))
    del grams
    give_back()
    return model


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Ppm:
    """The unrolled trees from counts of four-byte strings. The uniform guess is over the bytes of all languages."""
    seen = np.unique(np.concatenate([*[(gram >> s) & 255 for s in (24, 16, 8, 0)], [PAD]]))
    return Ppm(langs, [_tree(gram[lang == x], n[lang == x], 1.0 / (len(seen) + 1)) for x in langs])


def _tree(gram: np.ndarray, n: np.ndarray, guess: float) -> Tree:
    bytes_ = [(gram >> s) & 255 for s in (24, 16, 8, 0)]
    seen = np.unique(np.concatenate([*bytes_, [PAD]])).astype(np.int64)
    classes = np.zeros(256, np.int32)
    classes[seen] = np.arange(1, len(seen) + 1)
    a = len(seen) + 1
    c = [classes[x].astype(np.int64) for x in bytes_]
    p = np.full((1, a), guess)
    for order in range(3):
        ctx = sum((c[3 - k] * a ** (k - 1) for k in range(1, order + 1)), np.zeros(len(gram), np.int64))
        counts = np.bincount(ctx * a + c[3], weights=n, minlength=a**order * a).reshape(-1, a)
        p = _escape(counts, np.tile(p, (a**order // len(p), 1)))
    kept, at = np.unique((c[0] * a + c[1]) * a + c[2], return_inverse=True)
    nodes = np.tile(np.arange(a * a, dtype=np.int32), a)
    nodes[kept] = a * a + np.arange(len(kept), dtype=np.int32)
    counts = np.bincount(at * a + c[3], weights=n, minlength=len(kept) * a).reshape(-1, a)
    longest = _escape(counts, p[kept % (a * a)])
    return Tree(classes, nodes, -np.log2(np.concatenate([p.ravel(), longest.ravel()])).astype(np.float32))


def _escape(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of one order from its counts and those of the next shorter contexts."""
    total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    room = np.maximum(total + distinct, 1)
    return np.where(total == 0, shorter, np.where(counts > 0, counts / room, distinct / room * shorter))


def predict(docs: DataFrame, model: Ppm, extra: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte, and the columns named in extra; text names the texts.

    score is the posterior of the winner under equal priors. `und` and score 0 where the text is null or has
    no letter, or no language was learned. Ties go to the language first by code point. Every row gets one
    row, repeated rows equal ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, bounds = utf8(batch.column(text))
            ok = np.array(batch.column("_ok").to_pylist(), bool)
            n = batch.num_rows
            lang, best, rate = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
            if m.langs and n:
                bits = m.code_lengths(data, bounds)
                win = bits.argmin(1)
                least = bits[np.arange(n), win]
                post = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                for i in np.flatnonzero(ok):
                    lang[i], best[i], rate[i] = m.langs[win[i]], post[i], least[i] / max(1, bounds[i + 1] - bounds[i])
            out = batch.drop_columns(["_ok"] if text in extra else [text, "_ok"])
            for name, values in (("lang_pred", pa.array(lang, pa.string())), ("score", pa.array(best)), ("bits_per_byte", pa.array(rate))):
                out = out.append_column(name, values)
            yield out
            give_back()

    given = list(dict.fromkeys([*extra, text]))  # texts go to Python and back once
    rows = docs.select("doc_id", held_out().alias("held_out"), *given, has_letter(text).alias("_ok"))
    kept = [f for f in rows.schema.fields if f.name != "_ok" and (f.name != text or text in extra)]
    return rows.mapInArrow(score, T.StructType([*kept, *T.StructType.fromDDL("lang_pred string, score double, bits_per_byte double").fields]))


def language_id(docs: DataFrame, **parameters) -> DataFrame:
    """Fit on the rows of docs that may teach, and predict all of them."""
    return predict(docs, fit(docs, **parameters))


def keep_identified(docs: DataFrame, **parameters) -> DataFrame:
    """docs without the rows whose language is undetermined; all columns stay as they are."""
    names = docs.columns
    own = [f"own_{i}" for i in range(len(names))]
    got = predict(docs.select("doc_id", *renamed(names)), fit(docs, **parameters), tuple(own), own[names.index("text")])
    return got.filter(F.col("lang_pred") != UNDETERMINED).select(*restored(names))
