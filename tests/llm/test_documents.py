"""The operators on documents against brute force, on a small table and on one of edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillgraph.llm import avi, language_id, line_windows, mixing, near_dup, packing, pii, queries, suffix_array


@pytest.fixture(scope="module", params=["documents", "edge", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def by_id(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_language_id(documents, edge, empty):
    rows = documents.join(language_id.language_id(documents), "doc_id").collect()
    judged = [r for r in rows if r["held_out"] and r["lang"] and re.search(r"[^\W\d_]", r["text"] or "")]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.95 * len(judged) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r for r in language_id.language_id(edge).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (1, 2, 3))
    assert got[4]["lang_pred"] != "und" and language_id.language_id(empty).count() == 0
    kept = language_id.keep_identified(edge)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 3


def test_ppm_code_lengths_equal_a_direct_model():
    """Unrolled table against the recursion over the trees."""
    texts = {"a": b"abracadabra abra", "b": b"cadacada dab"}
    grams = defaultdict(int)
    for lang, t in texts.items():
        t = b"   " + t
        for i in range(3, len(t)):
            grams[lang, int.from_bytes(t[i - 3 : i + 1], "big")] += 1
    langs, gram = [k[0] for k in grams], np.array([k[1] for k in grams])
    model = language_id.build(["a", "b"], np.array(langs, object), gram, np.array(list(grams.values()), float))
    symbols = len(set(b"".join(texts.values())) | {32}) + 1

    def p(lang, context, byte):
        counts = defaultdict(int)
        for (own, g), n in grams.items():
            g = g.to_bytes(4, "big")
            if own == lang and g[: 3][3 - len(context) :] == context:
                counts[g[3]] += n
        shorter = p(lang, context[1:], byte) if context else 1 / symbols
        total, distinct = sum(counts.values()), len(counts)
        if not total:
            return shorter
        return counts[byte] / (total + distinct) if byte in counts else distinct / (total + distinct) * shorter

    test = b"abrad zzcab"
    padded = b"   " + test
    want = [sum(-np.log2(p(lang, padded[i - 3 : i], padded[i])) for i in range(3, len(padded))) for lang in "ab"]
    data = np.frombuffer(test * 2, np.uint8)
    got = model.code_lengths(data, np.array([0, len(test), len(test), 2 * len(test)]))
    assert np.allclose(got, [want, [0, 0], want], rtol=1e-5)


def test_long_texts_are_scored_in_stretches(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 103, 5000).astype(np.uint8)
    codes = (data[:-3].astype(np.int64) << 24) | (data[1:-2].astype(np.int64) << 16) | (data[2:-1].astype(np.int64) << 8) | data[3:]
    model = language_id.build(["x"], np.array(["x"] * len(codes), object), codes, np.ones(len(codes)))
    bounds = np.array([0, 0, 1, 2, 7, 7, 300, 301, 4000, 5000, 5000])
    whole = model.code_lengths(data, bounds)
    for size in (1, 2, 3, 50, 4999):
        monkeypatch.setattr(language_id, "STRETCH", size)
        assert np.allclose(model.code_lengths(data, bounds), whole)


def test_packing(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    rows = packing.pack(docs, path).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // 1024) * 1.02 + 2


def test_encoding_of_odd_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\nb c\n\nd", "it's <|endoftext|> x <|endoftext|>y", "a  b", " x y", "don't I'll  've\t1 2 3", "\n a", "\nfoo bar", "é \U0001f600 z"]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode(texts, path)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoding_of_texts_with_nul():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = ["a \x00b c", "\x00", "\x00a", "a\x00b", "a \x00", " \x00b", "a\n\x00b c", "a \x00. b", "a b c"]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode(texts, path)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoding_equals_the_tokenizer_on_any_mix_of_marks_and_spaces():
    """50,000 texts of marks, line breaks, odd spaces, apostrophes, digits and letters of several scripts."""
    import random

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    bits = list(",.;:!?'\"-()«»…%") + ["\n", "\n\n", "\r\n", "\t", " ", "  ", "\u00a0", "\u2003", "\u200b", "\x1c", "\x0b", "a", "it", "word", "Bonjour", "é", "ünd", "ß", "日本", "e\u0301", "\U0001f600", "7", "2024", "¼", "'s", "'ll", "'T", "<|endoftext|>", "\x00"]
    rng = random.Random(11)
    texts = ["a ! b", "x : y", "Bonjour !", "a , b", "one ? two", "a .\nb", "! a", "!\n!", ".\n. .", " !", "! ", "\n !"]
    texts += ["".join(rng.choice(bits) + rng.choice(("", "", " ", " ", " ", "\n")) for _ in range(rng.randrange(1, 14))) for _ in range(50_000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 512):
        got = [np.frombuffer(x, "<u4").tolist() for x in packing.encode(texts[at : at + 512], path)]
        assert got == want[at : at + 512], [t for t, a, b in zip(texts[at : at + 512], got, want[at : at + 512]) if a != b][:5]


def test_best_two_fit_replaces_the_smallest():
    # greedy leaves 600 + 300 with a gap of 100; 250 + 150 fill the gap of 400 that taking out 300 opens
    lengths = np.array([600, 300, 250, 150])
    bins, offsets = packing.best_two_fit(lengths, 1000)
    assert bins[0] == bins[2] == bins[3] != bins[1]
    assert sorted(offsets[[0, 2, 3]].tolist()) == [0, 600, 850]


def test_media(docs):
    rows = avi.media_rows(docs).collect()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append((r["text"] or "").encode())
    assert len(rows) == docs.count()
    for r in rows:
        payload = texts[r["doc_id"]][0]
        size = len(payload)
        payload += bytes(max(64, -(-size // 64) * 64) - size)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        stored, micros, index = avi.parse_avi(bytes(r["media"]))
        assert (stored, micros, len(index)) == (len(payload), 40_000, -(-len(payload) // avi.FRAME))
        assert r["clips"][0]["start_ms"] == 0 and r["clips"][-1]["end_ms"] == 40 * len(index)


def test_media_round_trip_of_any_bytes():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8) for n in (1, 16, 17, 40)] + [np.tile(np.array([0, 255], np.uint8), 512), np.full(1024, 255, np.uint8)]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
    for p, media in zip(payloads, avi.encode(np.concatenate(payloads), bounds), strict=True):
        size, _, index = avi.parse_avi(media)
        assert avi.decode_frames([media[a : a + n] for a, n in index]).tobytes()[:size] == p.tobytes()


def test_shots():
    dark, light = np.zeros((16, 64), np.uint8), np.full((16, 64), 250, np.uint8)
    assert avi.shots(np.array([dark] * 5 + [light] * 4)) == [(0, 5), (5, 9)]
    assert avi.shots(np.array([dark])) == [(0, 1)] and avi.shots(np.zeros((0, 16, 64), np.uint8)) == []


def shingles(text):
    w = [re.sub(r"[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(rows):
    sets = defaultdict(set)
    for d, t in rows:
        sets[shingles(t)].add(d)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    keys = [s for s in sets if s]
    for s in keys:
        for d in sets[s]:
            join(d, min(sets[s]))
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if 100 * len(a & b) >= 75 * len(a | b):
                join(min(sets[a]), min(sets[b]))
    return find


def test_near_duplicates(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    find = components_of(rows)
    got = near_dup.near_duplicates(docs).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, len(shingles(t)), find(d), find(d) == d) for d, t in rows)


@pytest.mark.parametrize("block", [16, 256])
def test_near_duplicate_chains_in_crowded_buckets(spark, monkeypatch, block):
    """A chain of edits whose ends are far apart, more than a block of members, all in shared buckets."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    w = [f"t{i}" for i in range(100)]
    rows = []
    for k in range(400):
        if k % 3 == 0:
            w[(7 * k) % 100] = f"u{k}"
        rows.append((k, " ".join(w) + f" end{k}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    find = components_of(rows)
    got = near_dup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: find(d) for d, _ in rows}


def test_blocks_of_a_bucket_skip_pairs_within_a_component(spark):
    """1000 rows of one component, 40 of a second and 3 single ones: all that differ meet, at a linear cost."""
    comp = [0] * 1000 + [1000] * 40 + [1040, 1041, 1042]
    rows = [(7, i, c) for i, c in enumerate(comp)] + [(8, i, 0) for i in range(50)] + [(9, 1, 1), (9, 2, 2)]
    dealt = near_dup._dealt(spark.createDataFrame(rows, "h long, id long, comp long"), 20).collect()
    groups = {}
    for r in dealt:
        assert r["h"] == 7
        groups.setdefault((r["i"], r["j"]), {}).setdefault(r["block"], set()).add(r["id"])
    met = set()
    for (i, j), held in groups.items():
        met |= {(min(a, b), max(a, b)) for a in held[i] for b in held[j] if comp[a] != comp[b]}
    assert met == {(b, a) for a in range(1043) for b in range(a) if comp[a] != comp[b]}
    assert max(len(x) for held in groups.values() for x in held.values()) < 60 and len(dealt) < 20_000


def test_blocks_link_what_pivots_miss():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    sets = [np.sort(np.unique(np.concatenate([base[k * 5 :], rng.integers(0, 1 << 60, k * 5).astype(np.uint64)]))) for k in range(8)]
    ids = comps = np.arange(8)
    links = near_dup.block_links(ids, comps, sets, np.arange(8), np.arange(8))
    want = {(i, j) for i in range(8) for j in range(8) if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert len(links) < len(want) and {tuple(sorted(x)) for x in links} <= want

    def root(edges):
        r = list(range(8))
        for _ in range(8):
            for a, b in edges:
                r[a] = r[b] = min(r[a], r[b])
        return r

    assert root(links) == root(want)


def test_line_windows(docs):
    seen, marked, rows = {}, defaultdict(set), sorted({(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}, key=lambda r: r[0])
    for d, t in rows:
        lines = (t or "").split("\n") if t is not None else []
        for i in range(len(lines) - 2):
            if seen.setdefault(tuple(lines[i : i + 3]), (d, i)) != (d, i):
                marked[d].update((i, i + 1, i + 2))
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in marked[d]) for d, t in rows}
    got = line_windows.dedup_lines(docs)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want and got.count() == docs.count()
    assert all(r["n_removed"] == len(marked[r["doc_id"]]) for r in got.collect())
    kept = line_windows.without_repeats(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, t in rows if not (marked[d] and len(marked[d]) == len(t.split("\n")))}


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["target"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == docs.count()
    texts = {r["doc_id"]: r for r in docs.collect()}
    sources = defaultdict(list)
    for r in rows:
        assert r["size"] == len(words(texts[r["doc_id"]]["text"])) and 0 <= r["taken"] <= 3 * r["size"]
        sources[texts[r["doc_id"]]["source"]].append(r)
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r["size"] for r in sources[s]) for s in order}
    left, open_, target = float(sum(sizes.values())), dict(zip(order, [1, 2, 3] * len(order))), {}
    while open_:
        full = [s for s in open_ if left * open_[s] / sum(open_.values()) >= 3 * sizes[s]]
        if not full:
            target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        for s in full:
            del open_[s]
    for s in order:
        longest = max(r["size"] for r in sources[s])
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) for r in sources[s])
        assert abs(sum(r["taken"] for r in sources[s]) - target[s]) <= 2 * longest
    emitted = mixing.mixed_documents(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r["copies"] for r in rows)


def brute_repeats(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = True
            seen.add(s)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(b) > 0 and gone[0])
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", ["no", "hot", "crowded"])
def test_repeats(docs, hot, monkeypatch):
    if hot == "crowded":  # every anchor with two different pieces sends its strings to shards by themselves
        monkeypatch.setattr(suffix_array, "CROWD", 1)
    if hot == "hot":  # every anchor that two sampled documents share goes by its strings
        monkeypatch.setattr(suffix_array, "_hot_grams", lambda d: np.sort(np.concatenate([suffix_array.Texts(np.frombuffer(x, np.uint8), np.array([0, len(x)])).pieces()[0] for x in [(r["text"] or "").encode() for r in d.limit(60).collect()]] or [np.zeros(0, np.uint64)])))
    rows = {(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_array.dedup(docs).collect()}
    assert got == brute_repeats(rows)


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(0)
    for n in range(300):
        t = rng.integers(0, int(rng.integers(1, 6)) + 1, int(rng.integers(1, 200))).astype(np.int16)
        t = np.tile(t, 3) if n % 3 == 0 else t
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for k in (257, 100_000):  # by buckets and one by one
            sa = suffix_array.suffix_order(t, k)
            assert sa.tolist() == want
        shared = suffix_array.permuted_common_prefixes(t, sa)
        for a, b in zip(want[:-1], want[1:]):
            same = 0
            while max(a, b) + same < len(t) and t[a + same] == t[b + same]:
                same += 1
            assert shared[b] == same
        assert shared[want[0]] == 0


def test_structured_strings_have_their_own_hashes():
    """Thue-Morse words and their complements, which polynomials modulo a power of two cannot tell apart."""
    w = "a"
    for _ in range(11):
        w += w.translate(str.maketrans("ab", "ba"))
    pair = (w.encode(), w.translate(str.maketrans("ab", "ba")).encode())
    data, n = np.frombuffer(pair[0] + pair[1], np.uint8), len(w)
    x = suffix_array.Texts(data, np.array([0, n, 2 * n])).hash(np.array([0, n]), np.array([n, 2 * n]))
    assert x[0] != x[1]
    for size in (8, 60, 64, 65, 1024, n):
        words_ = [data[:size], data[n : n + size]]
        h = near_dup.word_hashes(np.concatenate(words_), np.array([0, size]), np.array([size, 2 * size]))
        assert h[0] != h[1]


def test_texts_that_share_no_shingle_are_not_linked(spark):
    w = "a"
    for _ in range(10):
        w += w.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"p q r s {w}"), (2, f"p q r s {w.translate(str.maketrans('ab', 'ba'))}"), (3, "b a c d e f g"), (4, "B a  c d e\nf G"), (5, "b a c d e f")]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}


def test_small_sets_are_found(spark):
    """All pairs of 3 shingles against 4 of them, which forty bands alone would miss at times."""
    rows = []
    for k in range(400):
        w = [f"v{k}x{i}" for i in range(8)]
        rows += [(2 * k, " ".join(w[:7])), (2 * k + 1, " ".join(w))]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_remembered_pieces_keep_the_earliest(monkeypatch):
    monkeypatch.setattr(suffix_array, "REMEMBERED", 3)
    met = suffix_array.Remembered()
    key = np.array([5, 9, 7], np.uint64)
    met.add(key, np.array([4, 4, 4]), np.array([0, 1, 2]))
    met.add(key[:1], np.array([2]), np.array([9]))
    assert met.later(np.array([5, 5, 9, 8], np.uint64), np.array([2, 3, 4, 9]), np.array([9, 0, 1, 9])).tolist() == [False, True, False, False]
    met.add(np.arange(20, 30, dtype=np.uint64), np.arange(10), np.arange(10))
    assert len(met.key) <= 3


def brute_spans(text):
    found = []

    def add(kind, pattern, ok):
        found.extend((kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m[0]))

    def luhn(s):
        d = [int(c) for c in reversed(re.sub("[^0-9]", "", s))]
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0

    add("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)
    add("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split(".")))
    add("card", r"[0-9]([\x20-]?[0-9])+", luhn)
    add("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15)
    return found


PERSONAL = [
    "mail a.b@c.de..x@y.org,a@b@c.d, _q@-a.b.c. e@f", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 9.9.9", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 5500  0000 0000 0004",
    "call +49 (30) 123-456.78 or +1 or +12345678901234567 \U0001f600 +33 1 23 45 67 89", "phone (555) 123-4567 or 555-123-4567, tel 555.123.4567", "9" * 5000, "1 " * 9000, "a." * 9000 + "@" + "b." * 9000 + "c", "a@b.cd", None, "",
]


def test_personal_data(spark, documents):
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(PERSONAL, 10_000_000)), "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (r, joined)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        spans = [x for x in r["spans"].split(",") if x]
        assert set(joined.split(",")) - {""} <= set(spans) and len(spans) == len(base) + r["n_added"]


def test_reliabilities_are_recovered(spark):
    """Expectation-maximisation on votes drawn with known reliabilities."""
    rng = np.random.default_rng(4)
    prior, yes, no = 0.4, np.array([0.9, 0.75, 0.6, 0.7]), np.array([0.15, 0.3, 0.1, 0.2])
    truth = rng.random(60_000) < prior
    votes = (rng.random((60_000, 4)) < np.where(truth[:, None], yes, no)) @ (1 << np.arange(4))
    rows = [(3, int(v), int(n)) for v, n in zip(*np.unique(votes, return_counts=True))]
    p = pii.reliabilities(spark.createDataFrame(rows, "kind int, votes int, n long")).first()["p"]
    assert abs(p["prior"] - prior) < 0.05 and np.abs(np.array(p["yes"]) - yes).max() < 0.05 and np.abs(np.array(p["no"]) - no).max() < 0.05


def test_added_spans_follow_their_context(spark):
    """Spelled-out addresses and national numbers where the words around speak of them, not the same forms elsewhere."""
    rng, rows, want = np.random.default_rng(6), [], {}
    for i in range(900):
        mail, digits = f"user{i}", f"{200 + i % 700}-{100 + i % 800}-{1000 + i}"
        said = [
            (f"please write to {mail}@shop{i}.com or call +1 {digits} any day", []),
            (f"please write to {mail} [at] shop{i}.com today", [("email", f"{mail} [at] shop{i}.com")]),
            (f"lot {mail}@rack{i}.zz with +99999 {digits}1 in stock", []),
            (f"call us by phone at {digits} today", [("phone", digits)]),
            (f"serial {digits} on the shelf", []),
        ][i % 5]
        rows.append((i, f"{'x' * int(rng.integers(0, 9))} {said[0]}"))
        want[i] = {f"{k}:{rows[-1][1].index(s)}:{rows[-1][1].index(s) + len(s)}" for k, s in said[1]}
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    base = {i: {f"{k}:{a}:{b}" for k, a, b in brute_spans(t)} for i, t in rows}
    added = {r["doc_id"]: {x for x in r["spans"].split(",") if x} - base[r["doc_id"]] for r in got}
    right = sum(len(added[i] & want[i]) for i in added)
    assert right >= 0.9 * sum(map(len, want.values())) and right >= 0.9 * sum(map(len, added.values())), (right, sum(map(len, added.values())), sum(map(len, want.values())))


def test_personal_data_of_edge_cases(edge, empty):
    assert pii.personal_data(edge).count() == edge.count() and pii.personal_data(empty).count() == 0
