"""Collocations against counting every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm import collocations
from quillgraph.llm.collocations import radix_order, run_lengths, words


def direct(rows, least, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    most[p[i : i + m]] = max(most[p[i : i + m]], a)
        scored = []
        for p, a in candidates.items():
            if p in most and 100 * most[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(docs, **options):
    return sorted(map(tuple, collocations.collocations(docs, **options).collect()))


@pytest.mark.parametrize(("table", "least"), [("documents", 30), ("edge", 3), ("empty", 1)])
def test_phrases(request, table, least):
    docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    want = direct(rows, least)
    assert got(docs, least=least) == want and (table == "empty" or want)


def made_texts(seed=7, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "A", "b\x00c", "'s", "né"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", " ; "]
    one = lambda: "".join(rng.choice(vocabulary[: rng.choice((4, 45))]) + rng.choice(marks) for _ in range(rng.randrange(60)))
    return [(i, one() if i % 17 else None, rng.choice(["en", "fr", None, "und"])) for i in range(n)]


@pytest.mark.parametrize("head", [0, 3, 1 << 19])
def test_words_beyond_the_head_are_looked_up(spark, monkeypatch, head):
    """Also with a bitmap that takes most pairs and words for others, and few keys at a time."""
    rows = made_texts()
    for name, value in (("HEAD", head), ("BITS", 1 << 15), ("KEYS", 64), ("DISTINCT", 20), ("FIRST", 15), ("PARTS", 3)):
        monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert got(docs, least=4) == direct([(x, t) for _, t, x in rows], 4, first=15)


def test_scores_beyond_64_bits(spark):
    a = 9 * 10**17
    x = spark.createDataFrame([(a, a, a + 1)], "a long, l long, r long")
    made = x.selectExpr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as score").first()[0]
    assert made == 2000000 * a // (2 * a + 1)


def test_radix_order():
    ids = np.random.default_rng(1).integers(0, 1 << 20, (5000, 4)).astype(np.uint32) % np.array([5, 1 << 20, 70_000, 2], np.uint32)
    assert ids[radix_order(ids)].tolist() == sorted(ids.tolist())
    keys, n = run_lengths(ids % 3)
    assert {tuple(k): c for k, c in zip(keys.tolist(), n.tolist(), strict=True)} == Counter(map(tuple, (ids % 3).tolist()))


def test_stretches_end_between_words(monkeypatch):
    raw = ("x" * 30 + " ab cd,e\nf " + "y" * 25).encode()
    whole = [w for part in words(raw) for w in part if w]
    for size in (1, 5, 9, 33):
        monkeypatch.setattr(collocations, "STRETCH", size)
        assert [w for part in words(raw) for w in part if w] == whole
