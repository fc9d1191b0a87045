import pytest

from quillgraph.operators import graph, questions, validate
from quillgraph.sources import annotations, tables


@pytest.fixture(scope="module")
def few(spark, sf):
    """Some graphs, two with a multihop question among them."""
    g = tables.order_graphs(spark, sf)
    return annotations.Graphs(*(x.filter("image_id in (73, 1192) or image_id % 30 = 0") for x in (g.graphs, g.entities, g.relations)))


def test_every_question_is_valid_and_reruns_agree(spark, sf):
    made = questions.Generator(tables.order_graphs(spark, sf))
    q = made.generate(["relation_successor_multiselect", "relation_containment_mcq", "element_presence_mcq", "no such type"])
    v = validate.verdicts(q, made.context).collect()
    assert v and all(r["ok"] for r in v), [r for r in v if not r["ok"]][:3]
    for r in v:
        labels = [o["label"] for o in r["options"]]
        assert labels == list("ABCDEF"[: len(labels)]) and len(labels) >= 4
        assert (r["answer"] == ["cannot_be_determined"]) == (r["correct_option_indices"] == [])
    again = questions.Generator(tables.order_graphs(spark, sf)).generate(["relation_successor_multiselect"])
    first = made.generate(["relation_successor_multiselect"])
    key = lambda df: sorted(map(str, df.select("image_id", "question", "options").collect()))
    assert key(first) == key(again)


def test_forced_types_have_the_reference_names(few):
    for limit, most in ((1, 1), (9, 9)):
        made = questions.Generator(few, limit=limit)
        q = made.generate([f"relation_unanswerable_{k}_mcq" for k in ("successor", "containment")]).collect()
        assert {r["question_type"] for r in q} == {"relation_successor_hidden_abstain_mcq", "relation_containment_hidden_abstain_mcq"}
        assert all(r["answer"] == ["cannot_be_determined"] for r in q)
        n = {}
        for r in q:
            n[r["image_id"], r["question_type"]] = n.get((r["image_id"], r["question_type"]), 0) + 1
        assert max(n.values()) == most
    assert len(made.registry()) == 16 and "relation_unanswerable_edge_label_mcq" in made.registry()


def test_candidates_take_turns(spark):
    rows = spark.range(3).selectExpr("1 image_id", "id").unionByName(spark.range(60).selectExpr("2 image_id", "id"))
    drawn = questions.drawn(rows, 42, "q", "id")
    turns = lambda *a: sorted((r["image_id"], r["attempt"]) for r in questions.at_tries(drawn, *a).collect())
    assert turns(0, 8) == [(1, a) for a in range(8)] + [(2, a) for a in range(8)]
    assert turns(0, 8, False) == [(1, a) for a in range(3)] + [(2, a) for a in range(8)]
    assert turns(1, 54)[-1] == (2, 53) and [questions.attempts(n) for n in (1, 2, 9)] == [8, 12, 54]


def test_wordings_of_a_graph_differ(few):
    made = questions.Generator(few, limit=3)
    for q in (made.presence(), made.summary()):
        said = {}
        for r in q.collect():
            said.setdefault(r["image_id"], []).append(r["question"])
        assert all(len(x) == len(set(x)) <= 3 for x in said.values()) and max(map(len, said.values())) == 3


def test_unanswerable_edge_labels_differ(few):
    """The label to rank by is drawn for each question, not once for all."""
    q = questions.Generator(few, unanswerable=1.0).edge_label().collect()
    assert len({tuple(sorted(o["text"] for o in r["options"])) for r in q}) > 1


def test_a_split_takes_no_option_from_another(spark, sf):
    g = tables.order_graphs(spark, sf)
    g = annotations.Graphs(*(x.filter("image_id % 25 = 0") for x in (g.graphs, g.entities, g.relations)))
    made = questions.dataset(g, ["element_presence_mcq", "element_absence_mcq"]).cache()
    texts = {}
    for r in graph.splits(g).join(g.entities, "image_id").select("split", "text").distinct().collect():
        texts.setdefault(r["split"], set()).add(r["text"].lower())
    assert {r["split"] for r in made.collect()} == set(texts) == {"train", "val", "test"}
    for r in made.filter("question_type = 'element_presence_mcq'").collect():
        wrong = {o["text"].lower() for o in r["options"] if o["text"] not in r["answer_text"]}
        assert wrong <= texts[r["split"]]
    assert questions.dataset(g, ["function_summary_open"], split=None).select("split").distinct().collect()[0][0] == "all"


def test_faults_of_multihop_questions_are_named(spark):
    shown = [(0, "s", "Start", False, []), (1, "m", "Middle", False, []), (2, "t", "Tail", False, []), (3, "x", "Other", False, []), (4, "y", "Else", False, [])]
    context = spark.createDataFrame([(1, shown, [s[2] for s in shown])], "image_id int, shown array<struct<ord:int,id:string,text:string,told:boolean,refs:array<string>>>, texts array<string>")
    options = [("A", "Middle"), ("B", "Other"), ("C", "Else"), ("D", "Far")]
    right = {"question": 'from "Start" to "Tail"', "options": options, "answer": ["A"], "answer_text": ["Middle"], "correct_option_indices": [0], "metadata": {"intermediate_node_ids": '["m"]'}}
    cases = [
        ({}, None),
        ({"metadata": {"intermediate_node_ids": '["nowhere"]'}}, "node on the path without display text"),
        ({"metadata": {"intermediate_node_ids": '["x"]'}}, "answer is not the path"),
        ({"question": 'from "Middle" to "Tail"'}, "end on the path"),
        ({"metadata": {}}, None),
        ({"metadata": {}, "question": 'from "Start" to "Middle"'}, "end in the answer"),
        ({"answer": ["B"]}, "answer labels mismatch"),
        ({"correct_option_indices": [9]}, "index out of range"),
        ({"options": [*options[:3], ("D", "middle ")]}, "duplicate option texts"),
    ]
    kind = "i int, image_id int, question_type string, answer_type string, question string, options array<struct<label:string,text:string>>, answer array<string>, answer_text array<string>, correct_option_indices array<int>, metadata map<string,string>"
    rows = [(i, 1, "relation_multihop_multiselect", "single_choice", *[(right | change)[k] for k in ("question", "options", "answer", "answer_text", "correct_option_indices", "metadata")]) for i, (change, _) in enumerate(cases)]
    q = spark.createDataFrame(rows, kind)
    assert {r["i"]: r["reason"] for r in validate.verdicts(q, context).collect()} == {i: reason for i, (_, reason) in enumerate(cases)}
    assert {r["i"] for r in validate.keep_valid(q, context).collect()} == {0, 4}
