"""Rows that share a doc_id though their texts differ, columns with awkward names, texts with very many matches."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import line_windows, mixing, near_dup, pii, suffix_array

SCHEMA = "doc_id long, text string"


def brute_repeats(rows):
    """Each row's result: documents are (doc_id, hash of the text), in this order."""
    order = sorted({(d, hashlib.md5(t.encode()).hexdigest(), t) for d, t in rows})
    seen, out = set(), {}
    for d, h, t in order:
        raw = t.encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d, t] = (d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out[r] for r in rows)


def made(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


def repeat_tables():
    rng = random.Random(2)
    x, y = made(rng, 300), made(rng, 300)
    yield [(0, x), (1, x), (1, "short")]
    yield [(0, x), (1, x), (1, y)]
    yield [(1, x), (1, x + y), (1, y), (0, y[:150] + x)]
    parts = [made(rng, rng.randrange(60, 250)) for _ in range(12)]
    for _ in range(3):
        yield [(rng.randrange(8), "".join(rng.choice(parts) for _ in range(rng.randrange(4)))) for _ in range(25)]


@pytest.mark.parametrize("rows", list(repeat_tables()))
def test_repeats_in_documents_of_one_id(spark, rows):
    got = suffix_array.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == brute_repeats(rows)


def brute_components(rows):
    sets = [(d, near_dup.shingles(t.encode())) for d, t in rows]
    label = {d: d for d, _ in rows}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t) and root(a) != root(b):
                label[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((d, len(s), root(d) if s else d) for d, s in sets)


def near_tables():
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    a, b = text(60), text(60)
    yield [(1, a), (1, b), (2, a + " x"), (3, b + " x")]
    yield [(5, a), (2, a), (2, b), (9, b), (7, b + " y"), (2, ""), (4, text(3))]
    bases = [text(50) for _ in range(6)]
    for _ in range(2):
        rows = []
        for _ in range(40):
            w = rng.choice(bases).split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(50)] = f"v{rng.randrange(90)}"
            rows.append((rng.randrange(1, 30), " ".join(w)))
        yield rows


@pytest.mark.parametrize("rows", list(near_tables()))
def test_links_of_every_text_of_a_document(spark, rows):
    got = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def odd_names(spark):
    rows = [(k, f"line {k}\nb c\nd e\nf g" if k % 2 else "some words of one two three four", "en", f"s{k % 2}", 7, "x", "y", "z", 1.5) for k in range(6)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", "a`b", "SIZE", "Copies", "N_lines"]).repartition(2)


def test_columns_with_awkward_names(spark):
    docs = odd_names(spark)
    mixed = mixing.mix(docs)
    assert [c.lower() for c in mixed.columns].count("size") == 1 and {"a`b", "N_lines"} <= set(mixed.columns)
    assert mixed.select("doc_id", "size", "source_size", "target", "taken", "copies").count() == 6
    lines = line_windows.dedup_lines(docs)
    assert lines.select("doc_id", "n_lines", "n_removed", "SIZE").count() == 6 and [c.lower() for c in lines.columns].count("n_lines") == 1
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert {r["a`b"] for r in out.collect()} == {"x"}, name


def test_columns_of_other_case_keep_their_names(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd", 9), (2, "a\nb\nc\nx", 9)], ["doc_id", "Text", "N_Chars"])
    out = line_windows.without_repeats(docs)
    assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == [(1, "a\nb\nc\nd", 7), (2, "x", 1)]


def test_texts_with_very_many_spans(spark):
    n = 100_000
    text = F.concat(F.lit("ünï "), F.repeat(F.lit("mail ab.c@example.com, "), n))
    r = pii.personal_data(spark.createDataFrame([(1,)], "doc_id long").select("doc_id", text.alias("text"))).first()
    spans = [f"email:{9 + 23 * k}:{25 + 23 * k}" for k in range(n)]
    assert r["n_email"] == n and r["spans"] == ",".join(spans) and r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
