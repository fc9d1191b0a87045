"""From a folder of annotations to metrics, by the command line's functions."""

import json

from pyspark.sql import functions as F

from quillgraph import cli
from quillgraph.operators import evaluate
from quillgraph.sources import annotations


def test_from_annotations_to_metrics(spark, tmp_path):
    source = tmp_path / "annotations"
    source.mkdir()
    for k in range(6):
        entities = [{"id": f"e{i}", "text": f"{word} {k}", "type": "Node"} for i, word in enumerate(("Pump", "Valve", "Tank", "Gauge", "Sieve", "Drain"))]
        relations = [{"subject_id": f"e{i}", "predicate": "flows_to", "object_id": f"e{i + 1}", "edge_text": f"pipe {k}{i}"} for i in range(5)] + [{"subject_id": "e0", "predicate": "flows_to", "object_id": "e3"}]
        (source / f"g{k}.json").write_text(json.dumps({"image_id": f"g{k}", "paper_id": "p", "summary": "Moves water.", "entities": entities, "relations": relations}))
    out = str(tmp_path / "out")
    types = ["element_presence_mcq", "relation_successor_multiselect", "relation_edge_label_hidden_abstain_mcq", "function_summary_open"]
    counts = cli.generate(spark, cli.parser().parse_args(["generate", "--input", str(source), "--output", out, "--types", *types])).collect()
    assert {r["question_type"] for r in counts} == set(types) and {r["split"] for r in counts} == {"all"}
    lines = [json.loads(x) for f in (tmp_path / "out" / "questions" / "split=all").glob("part*") for x in f.read_text().splitlines()]
    assert len(lines) == sum(r["n"] for r in counts)
    for r in lines:
        several = r["answer_type"] == "multi_select"
        assert isinstance(r["answer"], list) == isinstance(r["answer_text"], list) == several
        assert ("correct_option_indices" in r) == (r["answer_type"] != "open") == bool(r["options"])
        if several:
            assert r["metadata"]["successor_count"] == len(r["answer"]) == 2 and r["metadata"]["used_disambiguation"] is False
    q = annotations.read_questions(spark, f"{out}/questions/split=all", lines=True)
    asked = evaluate.asked(q, ["m1", "m2"])
    said = F.when(F.col("model") == "m2", "no idea").when(F.col("answer_type") == "multi_select", F.concat(F.lit("The correct options are "), F.array_join("gold", ", "), F.lit("."))).when(F.col("is_unanswerable"), "It cannot be determined.")
    said = said.otherwise(F.concat(F.lit("The answer is "), F.get("gold", F.lit(0)), F.lit(".")))
    asked.select(evaluate.key().alias("key"), said.alias("raw_output")).write.json(str(tmp_path / "replies"))
    args = cli.parser().parse_args(["evaluate", "--questions", f"{out}/questions/split=all", "--replies", str(tmp_path / "replies"), "--models", "m1", "m2", "--output", out])
    rates = {r["model"]: r for r in cli.evaluate(spark, args).collect()}
    assert rates["m1"]["answerable_correct_rate"] == rates["m1"]["multihop_f1"] == 1.0 and rates["m1"]["invalid_response_rate"] == 0.0
    assert rates["m2"]["invalid_response_rate"] == 1.0
    assert spark.read.json(f"{out}/results").count() == 2 * len(lines)
