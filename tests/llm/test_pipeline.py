"""The pipeline's stages against the brute-force rules of each, and with deleted folders."""

from collections import Counter, defaultdict

import corpus_pipeline
from test_documents import components_of, words

from quillgraph.llm import line_windows, mixing


def test_stages(spark, edge, documents, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        after = corpus_pipeline.saved(stage(spark, docs, sf))
        rows = [r.asDict() for r in after.collect()]
        if name != "pack":
            assert after.columns == documents.columns
        if name == "language_id":
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or ""))
        if name == "line_dedup":
            seen, gone = {}, defaultdict(set)
            for r in sorted(before, key=lambda r: r["doc_id"]):
                lines = r["text"].split("\n")
                for i in range(len(lines) - 2):
                    if seen.setdefault(tuple(lines[i : i + 3]), (r["doc_id"], i)) != (r["doc_id"], i):
                        gone[r["doc_id"]].update((i, i + 1, i + 2))
            want = {r["doc_id"]: "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in gone[r["doc_id"]]) for r in before if len(gone[r["doc_id"]]) < len(r["text"].split("\n"))}
            assert {r["doc_id"]: r["text"] for r in rows} == want and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "near_dedup":
            find = components_of([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in before if find(r["doc_id"]) == r["doc_id"])
        if name == "mix":
            copies = Counter(r["doc_id"] for r in rows)
            assert all(copies[r["doc_id"]] == r["copies"] for r in mixing.mix(docs).collect())
        if name == "pack":
            assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
            firsts = Counter(r["doc_id"] for r in rows if r["start"] == 0)
            assert firsts == Counter(r["doc_id"] for r in before) and all(len(words(r["text"])) for r in before)
        docs = after
    ran = corpus_pipeline.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, ran)) == sorted(tuple(r)[:5] for r in docs.collect())


CLASHING = (
    "d h t row lines starts ends e g at pos key first n kept marked owner b i m z s r ahead before smaller earlier size source_size target copies taken weight _s _z _r _b _i _before _gone _doc _text_key "
    "component_id n_shingles l _ok _text held_out lang_pred score bits_per_byte n_lines n_removed c0 c1 piece start length ids_crc32 packer sequence_id offset x full left_ level"
).split()


def test_columns_that_clash_with_internal_names_keep_their_values(spark):
    rows = [(1, "a b\nc d\ne f\ng h", "s", "en"), (2, "q\na b\nc d\ne f\ng h\nz", "s", "en"), (3, "x y z one two three four", None, "fr"), (4, "x y z one two three four", "t", "fr"), (5, "solo", "t", None)]
    names = ["doc_id", "text", "source", "lang", "n_chars", *CLASHING]
    docs = spark.createDataFrame([(*r, len(r[1]), *[f"{c} of {r[0]}" for c in CLASHING]) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "").collect()
        assert got and list(got[0].asDict()) == names, name
        for r in got:
            assert all(r[c] == f"{c} of {r['doc_id']}" for c in CLASHING), name
    mixed = mixing.mix(docs)
    own = [c for c in CLASHING if c not in ("size", "source_size", "target", "copies", "taken")]
    assert mixed.count() == 5 and all(r[c] == f"{c} of {r['doc_id']}" for r in mixed.collect() for c in own)
    cut = line_windows.dedup_lines(docs)
    own = [c for c in CLASHING if c not in ("n_lines", "n_removed")]
    assert {r["doc_id"]: r["n_removed"] for r in cut.collect()} == {1: 0, 2: 4, 3: 0, 4: 0, 5: 0}
    assert all(r[c] == f"{c} of {r['doc_id']}" for r in cut.collect() for c in own)


def test_equal_rows_take_their_own_copies(spark):
    rows = [(1, "a b c", "s")] * 5 + [(2, "d e f", "s")] * 3 + [(None, "g h", "t")] * 4 + [(None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r)
    assert len(got) == len(rows)
    for own in by_source.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in got)


def test_edge_cases(spark, edge, empty, sf):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.saved(stage(spark, docs, sf))
