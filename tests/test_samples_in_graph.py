"""Draws of a graph meet only rows of the graph: nothing goes whole to every task, pairs are no rows of a table."""

import hashlib

from pyspark.sql import functions as F

from quillgraph.operators import graph, paths, questions, samples
from quillgraph.sources import annotations, tables


def _few(spark, sf):
    g = tables.order_graphs(spark, sf)
    return questions.Kept(annotations.Graphs(*(x.filter("image_id % 20 = 0") for x in (g.graphs, g.entities, g.relations))))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_named_ends_are_not_broadcast(spark, sf):
    g = tables.order_graphs(spark, sf)
    for df in (samples.successor_target(g), samples.containment_target(g)):
        joins = [line for line in _plan(df).splitlines() if "LeftSemi" in line and "HashJoin" in line]
        assert len(joins) == 2 and not any("Broadcast" in line for line in joins)


def test_pairs_without_an_edge_stay_in_their_row(spark, sf):
    g = _few(spark, sf)
    made = samples.negative_relation(g, "flows_to")
    assert "explode(array_except" not in _plan(made)
    ids, linked = {}, {(r["image_id"], r["subject_id"], r["object_id"]) for r in graph.select_relations(g, "flows_to").collect()}
    for r in g.entities.filter("norm_text <> ''").collect():
        ids.setdefault(r["image_id"], set()).add(r["id"])
    want = {}
    for i, all_ in ids.items():
        open_ = [(hashlib.md5(f"42|negative flows_to|{i}|{a}|{b}".encode()).hexdigest(), a, b) for a in all_ for b in all_ if a != b and (i, a, b) not in linked]
        if open_:
            want[i] = min(open_)[1:]
    got = {r["image_id"]: (r["subject_id"], r["object_id"]) for r in made.collect()}
    assert got == want and len(got) > 50


def test_a_pair_is_drawn_from_each_length_first(spark, sf):
    g = _few(spark, sf)
    made = samples.multihop_pair(g)
    want = samples.drawn(paths.shortest(g, None).filter(F.col("hops") >= 2), "multihop", samples.SEED, "src", "tgt")
    key = lambda df: sorted(map(str, df.select("image_id", "src", "tgt", "path", "hops").collect()))
    assert key(made) == key(want) and len(key(made)) > 40
    assert _plan(made).count("min_by") > _plan(want).count("min_by")


def test_candidates_of_a_row_take_turns_as_rows_do(spark):
    rows = spark.range(3).selectExpr("1 image_id", "id").unionByName(spark.range(40).selectExpr("2 image_id", "id"))
    drawn = questions.drawn(rows, 42, "q", "id")
    one = F.struct(questions.key(42, "q", F.col("image_id"), F.col("id")).alias("k"), "id")
    held = rows.groupBy("image_id").agg(F.collect_list(one).alias("all"))
    for args in ((0, 1), (0, 8), (0, 8, False), (1, 8), (1, 54, False)):
        want = sorted((r["image_id"], r["attempt"], r["id"]) for r in questions.at_tries(drawn, *args).collect())
        got = held.select("image_id", F.explode(questions.tries(F.col("all"), *args)).alias("t")).select("image_id", "t.attempt", "t.c.id").collect()
        assert sorted(map(tuple, got)) == want
