"""Alignment of two tokenizers against token-by-token brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import alignment, queries

A, B = queries.tokenizer_path(), queries.pieces_path()
NONE = (0, 0, 0, "", [])


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    of = alignment.byte_level()

    def bytes_of(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled_b = [b.id_to_piece(i) for i in ids_b]
        return (
            [(i, bytes(of[c] for c in a.id_to_token(i))) for i in ids_a],
            [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(ids_b, spelled_b, strict=True)],
        )

    return bytes_of


def direct(text, tools):
    if not text:
        return NONE
    ends = []
    for tokens in tools(text):
        if b"".join(x for _, x in tokens) != (" " + text).encode():
            return NONE
        at, own = 0, {}
        for i, x in tokens:
            at += len(x)
            own[at] = i
        ends.append(own)
    a, b = ends
    groups, links, open_ = [], [], ([], [])
    for end in sorted(set(a) | set(b)):
        for own, part in zip(ends, open_, strict=True):
            if end in own:
                part.append(str(own[end]))
        if end in a and end in b:
            groups.append(",".join(open_[0]) + "|" + ",".join(open_[1]))
            links.append((a[end], b[end]))
            open_ = ([], [])
    return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def expected(texts, tools):
    rows = [direct(t, tools) for t in texts]
    count = Counter(link for r in rows for link in r[4])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(*r[:3], len(r[4]), sum(count[x] == most[x[1]] for x in r[4]), sum(count[x] for x in r[4]), r[3]) for r in rows]


@pytest.mark.parametrize("table", ["documents", "edge", "empty"])
def test_alignment(request, table, tools):
    docs = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = [(d, *w) for (d, _), w in zip(rows, expected([t for _, t in rows], tools), strict=True)]
    assert sorted(map(tuple, alignment.alignment(docs, A, B).collect())) == sorted(want)


def test_odd_texts(spark, tools, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN", 50)
    rng = random.Random(3)
    parts = [" ", " ", "  ", "\n", "\t", "a", "the", "é", "́", "▁", "<s>", "<|endoftext|>", "\x00", "　", "1", "23", ".", ",", "'s", "😀", "ß", "<0x41>", "\x1c", "\r\n", "日本", "q" * 400]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(2000)]
    encoder, links = alignment.Encoder(A, B), alignment.Links(*alignment.vocabularies(A, B))
    numbers, of_b = [], []
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        made = alignment.align(some, encoder, links)
        for k, t in enumerate(some):
            n_a, n_b, n, sha, own = direct(t, tools)
            assert (made["n_a"][k], made["n_b"][k], made["n_groups"][k], made["groups_sha256"][k]) == (n_a, n_b, n, sha)
            got = np.frombuffer(made["links"][k], "<u4")
            assert got.tolist() == (links.number(*np.array(own, np.int64).T).tolist() if own else [])
            numbers += got.tolist()
            of_b += [y for _, y in own]
    assert links.token_of_b(np.array(numbers, np.int64)).tolist() == of_b


def test_numbers_of_links_differ():
    """Over every token of A with every token of B that is its suffix or has it as one."""
    links = alignment.Links(*alignment.vocabularies(A, B))
    a, b = links.a.tokens(), links.b.tokens()
    by_bytes = {}
    for i, t in enumerate(b):
        by_bytes.setdefault(t, []).append(i)
    ids_a = {t: i for i, t in enumerate(a) if t}
    pairs = [(i, j) for t, i in ids_a.items() for k in range(len(t)) for j in by_bytes.get(t[k:], ())]
    pairs += [(ids_a[t[k:]], j) for j, t in enumerate(b) for k in range(1, len(t)) if t[k:] in ids_a]
    made = links.number(*np.array(pairs).T)
    assert len(np.unique(made)) == len(pairs) and made.max() < links.size


def test_stretches_change_nothing(monkeypatch, documents):
    texts = [r["text"] for r in documents.select("text").limit(40).collect()] + ["", "x" * 3000]
    links = alignment.Links(*alignment.vocabularies(A, B))
    whole = alignment.align(texts, alignment.Encoder(A, B), links)
    monkeypatch.setattr(alignment, "STRETCH", 37)
    cut = alignment.align(texts, alignment.Encoder(A, B), links)
    assert all(list(whole[c]) == list(cut[c]) for c in whole)
