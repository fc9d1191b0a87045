"""Readers, graph operators, display, ranking, questions and parsing on hand-written graphs."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import display, graph, paths, rank, replies
from quillgraph.operators.providers import TableReplies, family
from quillgraph.sources import annotations, tables
from quillgraph.streaming import replies as stream

NAMES = ["Seed Store", "Mill", "Dough Mixer", "Proof Room", "Oven", "Shop Counter", "Bakery Hall", "Delivery Van"]
FLOWS = [(0, 1, "grain sacks"), (1, 2, "flour"), (2, 3, " N/A "), (3, 4, ""), (4, 5, "loaves"), (4, 7, "none"), (1, 5, "bagged flour")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("annotations")
    relations = [{"subject_id": f"e{a}", "predicate": "flows_to", "object_id": f"e{b}", "edge_text": t, "is_conflict": False} for a, b, t in FLOWS]
    relations += [{"subject_id": "e6", "predicate": "contains", "object_id": f"e{k}"} for k in (2, 3, 4)] + [{"subject_id": "e5", "predicate": "connects_to", "object_id": "e7"}]
    relations += [{"subject_id": "e0", "predicate": "sees", "object_id": "e1"}, {"subject_id": "e0", "object_id": "e0"}, {"subject_id": "e0", "object_id": "e99"}]
    doc = {"image_id": "a", "paper_id": "p", "summary": {"text": " Bakes bread. "}, "entities": [{"id": f"e{i}", "text": n, "type": "Odd" if i else "Node"} for i, n in enumerate(NAMES)], "relations": relations}
    (path / "a.json").write_text(json.dumps(doc, indent=1))
    twin = {"image_id": "b", "summary": "plain", "entities": [{"text": " Gate "}, {"text": "gate"}, {"text": "Alpha"}, {"text": "Omega"}], "relations": [{"subject_id": "e2", "object_id": "e0"}, {"subject_id": "e1", "object_id": "e3"}]}
    (path / "b.json").write_text(json.dumps(twin))
    (path / "broken.json").write_text("{nothing")
    (path / "note.txt").write_text("{}")
    return str(path)


@pytest.fixture(scope="module")
def g(spark, folder):
    return annotations.read_annotations(spark, folder)


def rows(df, where="image_id = 'a'"):
    return sorted(tuple(r) for r in df.filter(where).drop("image_id").collect())


def test_loader(g):
    assert rows(g.graphs) == [("p", "Bakes bread.")] and rows(g.graphs, "image_id = 'b'") == [(None, "plain")]
    assert g.relations.filter("image_id = 'a'").count() == 11 and g.entities.filter("image_id = 'a' and type = 'Node'").count() == 8
    assert sorted(r["edge_text"] for r in graph.edges_with_text(g).collect()) == ["bagged flour", "flour", "grain sacks", "loaves"]


def test_graph(g):
    assert [r[1] for r in rows(graph.neighbours(g).drop("ord")) if r[0] in ("e1", "e4")] == ["e2", "e5", "e5", "e7"]
    assert rows(graph.unique_neighbour(g)) == [("e0", "e1"), ("e2", "e3"), ("e3", "e4")]
    assert rows(graph.neighbours(g, ("connects_to", "contains")).select("image_id", "id", "neighbour")) == [("e5", "e7"), ("e6", "e2"), ("e6", "e3"), ("e6", "e4")]
    assert [r[0] for r in rows(graph.top_level(g).select("image_id", "id"))] == ["e0", "e1", "e5", "e6", "e7"]
    assert [r[0] for r in rows(graph.root_flow(g).select("image_id", "id"))] == ["e0", "e6", "e7"]
    assert rows(paths.main_flow(g)) == [(["e0", "e1", "e5"],)]
    found = rows(paths.shortest(g))
    assert ("e0", "e5", ["e0", "e1", "e5"], 2) in found and ("e0", "e4", ["e0", "e1", "e2", "e3", "e4"], 4) in found
    pairs = {r[:2] for r in rows(paths.unique_multihop(g).select("image_id", "src", "tgt"))}
    assert len(pairs) == 12 and ("e1", "e7") in pairs and ("e1", "e5") not in pairs
    within = paths.shared_container(g, paths.shortest(g).filter("hops = 2").select("image_id", "path"))
    assert rows(within) == [(["e2", "e3", "e4"], "e6")]
    ids = g.entities.sparkSession.createDataFrame([("a", "e1"), ("a", "zz"), ("b", "e3")], "image_id string, id string")
    assert sorted(map(tuple, graph.has_entity(g, ids).collect())) == [("a", "e1"), ("b", "e3")]


def test_display(g):
    d = {r["id"]: r["display_text"] for r in display.display_map(g).filter("image_id = 'b'").collect()}
    assert d == {"e0": "Gate immediately after Alpha", "e1": "gate immediately before Omega", "e2": "Alpha", "e3": "Omega"}


def test_editor_reading(spark, folder):
    e = annotations.normalize_annotation_ui(annotations.scan(spark, folder))
    assert rows(e.relations.select("image_id", "predicate").distinct()) == [("connects_to",), ("contains",), ("flows_to",)] and e.relations.filter("image_id = 'b'").count() == 0


def test_ranking(spark):
    df = spark.createDataFrame([("Fast Encoder", ["Tiny-Block", "Slow Encoder", "", "X" * 100])], "t string, c array<string>")
    hint = F.array(F.lit("unknown"))
    got = df.select(rank.texts(rank.ranked(F.col("t"), rank.prepared(F.col("c")), hint, F.array().cast("array<string>"))).alias("r")).first()["r"]
    assert got == ["Slow Encoder", "Tiny-Block"]


def test_reduced_rankings_give_the_same_pick(spark):
    """Against the rule itself, over many random rankings."""
    rng = random.Random(3)
    rows = [(i, [(float(k), f"t{k}", rng.choice("abc"), rng.choice("xyz")) for k in range(rng.randrange(0, 80))]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, o array<struct<s:double,text:string,first:string,last:string>>")
    for k in (1, 2, 3, 4):
        got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", rank.diverse(F.col("o"), k).alias("a"), rank.diverse(rank.reduced(F.col("o")), k).alias("b")).collect()}
        for i, order in rows:
            out, firsts, lasts = [], set(), set()
            for _, text, first, last in order:
                if len(out) < k and (len(out) < max(1, k // 2) or first not in firsts or last not in lasts):
                    out.append(text)
                    firsts.add(first)
                    lasts.add(last)
            assert got[i] == (out, out)


def test_ranking_in_a_large_pool(spark):
    pool = spark.range(50_000).select(F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("red", "blue", "old"))), (F.col("id") % 3 + 1).cast("int")), F.concat(F.lit("part"), "id")).alias("text"))
    ready = pool.agg(F.collect_list("text").alias("texts")).select(rank.prepared(F.col("texts")).alias("pool")).cache()
    ready.count()
    began = time.time()
    picked = ready.select(rank.diverse(rank.reduced(rank.ranked(F.lit("red part17"), F.col("pool"), F.array(F.lit("unknown")), F.array(F.lit("red part17")), True)), 3)).first()[0]
    assert len(picked) == 3 and time.time() - began < 5


def test_parsing_quirks(spark):
    raws = ["The answer is B.", "I choose option b: yes, answer: (C)", "**D**", "A. or B.", "node amber gate", "It is amber gate", "no module is enclosed", None]
    options = [("A", "amber gate"), ("B", "silver loop")]
    df = spark.createDataFrame([(i, r, "single_choice", options, None) for i, r in enumerate(raws)], "i int, raw_output string, answer_type string, options array<struct<label:string,text:string>>, judge_reply string")
    got = [(r["parse_stage"], r["parse_action"], (r["parse_letters"] or [None])[0]) for r in replies.parse(df).orderBy("i").collect()]
    assert got == [("regex", "selected", "B"), ("regex", "selected", "C"), ("regex", "selected", "D"), ("judge", "invalid", None), ("judge", "invalid", None), ("substring", "selected", "A"), ("abstain_rule", "abstained", None), ("judge", "invalid", None)]
    fixed = [r["parse_stage"] for r in replies.parse(df, compat=False).orderBy("i").collect()]
    assert fixed[4] == "substring"


def test_stream_of_replies(spark, tmp_path):
    line = {"key": "k", "model": "m", "answer_type": "single_choice", "is_unanswerable": False, "gold": ["A"], "options": [{"label": "A", "text": "amber gate"}], "raw_output": "The answer is B."}
    source = tmp_path / "in"
    source.mkdir()
    for n, raw in enumerate(("The answer is B.", "The answer is A.")):
        (source / f"{n}.json").write_text(json.dumps(line | {"raw_output": raw}))
        q = stream.follow(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"))
        assert q.awaitTermination(90)
    got = stream.metrics(spark, str(tmp_path / "out")).first()
    assert (got["n"], got["answerable_correct_rate"]) == (1, 1.0)


def test_providers(spark):
    work = spark.createDataFrame([("a",), ("b",)], "key string")
    known = spark.createDataFrame([("a", "x")], "key string, raw_output string")
    assert {r["key"]: r["error"] for r in TableReplies(known).replies(work).collect()} == {"a": None, "b": "no reply"}
    assert family("o3-mini") == "openai" and family("vendor/qwen-max") == "dashscope"


def test_question_and_manifest_files(spark, tmp_path):
    made = [{"image_id": str(i), "question": f"q{i}", "answer": ["A", "B"] if i % 2 else "A", "options": [{"label": "A", "text": "x"}], "level": "L1"} for i in range(7)]
    (tmp_path / "in.json").write_text(json.dumps(made))
    q = annotations.read_questions(spark, str(tmp_path / "in.json"))
    assert q.count() == 7 and [r["question"] for r in annotations.read_questions(spark, str(tmp_path / "in.json"), 3).orderBy("idx").collect()] == ["q0", "q1", "q2"]
    assert {r["answer"] for r in q.collect()} == {"A", '["A", "B"]'}
    split = q.withColumn("split", F.when(F.col("image_id") < "4", "train").otherwise("test"))
    for jsonl in (True, False):
        out = tmp_path / f"out{jsonl}"
        annotations.write_questions(split, str(out), jsonl)
        lines = [json.loads(x) for f in (out / "split=train").glob("part*") for x in f.read_text().splitlines()]
        held = lines if jsonl else [r for part in lines for r in part]
        assert sorted(r["question"] for r in held) == ["q0", "q1", "q2", "q3"]
    annotations.write_manifest(spark.createDataFrame([("train", 4), ("test", 3)], "split string, n long"), {"seed": 42}, str(tmp_path / "manifest"))
    (text,) = [f.read_text() for f in (tmp_path / "manifest").glob("part*")]
    assert json.loads(text) == {"config": {"seed": "42"}, "statistics": [{"split": "train", "n": 4}, {"split": "test", "n": 3}]}


def test_limit_takes_the_first_by_file_and_place(spark, tmp_path):
    for f, n in (("b", 300), ("a", 200), ("c", 5)):
        (tmp_path / f"{f}.jsonl").write_text("".join(json.dumps({"image_id": f, "question": f"{f}{k}", "answer": "A"}) + "\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = annotations.read_questions(spark, str(tmp_path), 350, lines=True).orderBy("idx").select("question", "idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in got] == [(q, k) for k, q in enumerate([f"a{k}" for k in range(200)] + [f"b{k}" for k in range(150)])]


def test_faults_of_a_scan(spark, folder, tmp_path):
    good, bad = annotations.scanned(spark, folder)
    assert sorted(r["image_id"] for r in good.collect()) == ["a", "b"]
    (r,) = bad.collect()
    assert (r["file"].rsplit("/", 1)[1], r["position"], r["reason"], r["start"]) == ("broken.json", 2, "no JSON, or fields of other types", "{nothing")
    for name, text in (("1", "[1, 2]"), ("2", '{"image_id": "x", "entities": {"a": 1}}'), ("3", "{}"), ("4", '{"image_id": "y", "entities": []}'), ("5", "")):
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = annotations.scanned(spark, str(tmp_path))
    assert [r["image_id"] for r in good.collect()] == ["y"]
    assert {r["file"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()}.keys() >= {"2.json", "3.json"}


def test_cache_files(spark, tmp_path):
    lines = [{"key": "a", "v": 1}, {"key": "b", "error": "x"}, {"key": "a", "v": 2}, {"v": 0}]
    (tmp_path / "cache.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nno json")
    known = annotations.read_cache(spark, str(tmp_path / "cache.jsonl"))
    assert {r["key"]: json.loads(r["value"]) for r in known.collect()} == {"a": lines[2], "b": lines[1]}
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert sorted(r["key"] for r in annotations.pending(work, known).collect()) == ["b", "c"]


def test_editor_round_trip(spark, g, folder, tmp_path):
    """What the editor saves it reads again."""
    editor = annotations.normalize_annotation_ui(annotations.scan(spark, folder))
    annotations.write_annotations(editor, str(tmp_path / "saved"))
    again = annotations.normalize_annotation_ui(annotations.scan(spark, str(tmp_path / "saved"), lines=True))
    for part in ("graphs", "entities", "relations"):
        a, b = (sorted(map(str, getattr(x, part).collect())) for x in (editor, again))
        assert a == b and a


def test_images(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"\x89PNG")
    (tmp_path / "y.txt").write_bytes(b"no")
    (r,) = annotations.read_images(spark, str(tmp_path)).collect()
    assert (r["image"], r["mime"]) == ("iVBORw==", "image/png")


def test_keys_of_questions(spark):
    options = [("A", 'x "y"'), ("B", "é")]
    df = spark.createDataFrame([("i", 3, "t", 'say "hi" é', options, ["A", "B"], "multi_select"), ("i", 4, "t", "q", [], ["A"], "open")], "image string, idx int, kind string, q string, o array<struct<label:string,text:string>>, a array<string>, k string")
    got = [r[0] for r in df.select(replies.sample_id(*[F.col(c) for c in df.columns])).collect()]
    want = []
    for _, idx, kind, q, o, a, k in df.collect():
        text = json.dumps({"ans": a if k == "multi_select" else a[0], "opts": [list(x) for x in o], "q": q}, ensure_ascii=False, sort_keys=True)
        want.append(f"i::{idx}::{kind}::{hashlib.md5(text.encode()).hexdigest()[:8]}")
    assert got == want


def test_metrics_document(spark, sf):
    scored = replies.score(replies.parse(tables.replies(spark, sf).unionByName(tables.multi_replies(spark, sf))))
    rates = {r["model"]: r for r in replies.metrics_by_model(scored).collect()}
    for r in replies.metrics_document(scored).collect():
        own = rates[r["model"]]
        assert abs(r["multihop_f1"] - own["multihop_f1"]) <= 5e-5 and 0 < r["multihop_f1"] < 1
        assert sum(r["parse_stage_counts"].values()) > 0 and set(r["by_level"]) == {"L1", "L2", "L3"}
        assert abs(own["unanswerable_correct_abstain_rate"] + own["unanswerable_hallucination_rate"] - 1) < 1e-12
