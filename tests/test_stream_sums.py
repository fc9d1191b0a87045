"""Sums of a stream of results against a full recount, with lines out of order, repeated and replaced."""

import json
import random

from pyspark.sql import functions as F

from quillgraph.operators import replies
from quillgraph.sources import tables
from quillgraph.sources.shared import materialized
from quillgraph.streaming import sums
from quillgraph.streaming.replies import LINE


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(round(r[c], 12) if isinstance(r[c], float) else r[c] for c in names) for r in df.collect()), key=repr)


def same(scored, table):
    def near(a, b):
        assert len(a) == len(b) > 0
        assert a == b

    near(rows(sums.metrics_of(table)), rows(replies.metrics_by_model(scored)))
    for column in ("level", "question_type"):
        near(rows(sums.metrics_of_by(table, column)), rows(replies.metrics_by(scored, column)))
    near(rows(sums.stages_of(table)), rows(replies.stage_counts(scored)))


def test_metrics_of_sums(spark, sf):
    scored = materialized(replies.score(replies.parse(tables.replies(spark, sf).unionByName(tables.multi_replies(spark, sf), allowMissingColumns=True))))
    x = materialized(sums.contributions(scored.withColumns({"key": F.lit("k"), "at": F.lit(0.0)})))
    halves = [sums.summed(x.filter(F.pmod(F.xxhash64("v", "model", "level"), F.lit(2)) == k)) for k in (0, 1)]
    same(scored, materialized(sums.merged(halves)))


def line(rng, key, at):
    kind = rng.choice(["single_choice", "multi_select", "open"])
    said = rng.choice(["The answer is A.", "The correct options are A, B.", "It cannot be determined.", "hm", "The answer is C."])
    error = rng.random() < 0.1
    return {
        "key": f"k{key}", "model": f"m{key % 2}", "level": f"L{key % 3}", "question_type": f"t{key % 4}", "answer_type": kind, "is_unanswerable": rng.random() < 0.4, "gold": ["A"], "at": at,
        "options": [{"label": c, "text": f"{c} thing"} for c in "ABCD"], "raw_output": None if error else said, "error": "x" if error else None, "prompt_tokens": rng.randrange(9), "completion_tokens": 1,
        "open_judge": {"coverage": rng.randrange(3), "correctness": 1, "hallucination": 2} if rng.random() < 0.7 else None,
    }


def test_stream_equals_a_recount(spark, tmp_path):
    rng, source, every = random.Random(5), tmp_path / "in", []
    source.mkdir()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        for batch in range(3):
            made = [line(rng, rng.randrange(25), rng.choice([1.0, 2.0, 3.0])) for _ in range(30)]
            made += [rng.choice(every) for _ in range(10) if every] + [made[0]]  # repeated, of earlier batches and of this one
            every += made
            (source / f"{batch}.json").write_text("\n".join(map(json.dumps, made)))
            q = sums.follow_sums(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"))
            assert q.awaitTermination(240) and q.exception() is None
            lines = spark.read.schema(f"{LINE}, at double").json(str(source))
            last = lines.groupBy("key").agg(F.max_by(F.struct(*[c for c in lines.columns if c != "key"]), sums.age(lines)).alias("r")).select("key", "r.*")
            got = sums.sums(spark, str(tmp_path / "out"))
            assert rows(got.groupBy("model").agg(F.sum("n").alias("n"))) == rows(last.groupBy("model").agg(F.count("*").alias("n")))
            if batch == 2:
                same(materialized(replies.score(replies.parse(last))), got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
