"""Graphs of orders: parts that are missing or repeated, and tasks that grow in number, not in size."""

import re

import pytest

from quillgraph.operators import display, graph, paths, questions
from quillgraph.plans import catalogue
from quillgraph.sources import tables
from quillgraph.sources.shared import ALL_KEYS, materialized


@pytest.fixture
def odd(spark, tmp_path):
    line = "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double"
    rows = [(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4), (2, 11, 1), (2, None, 2), (None, 10, 1), (None, 12, 2)]
    spark.createDataFrame([(*r, "A", "F", 0.1) for r in rows], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(10, "ten", "Brand#1"), (12, "twelve", None), (13, "thirteen", "Brand#1"), (13, "again", "Brand#2"), (None, "none", "Brand#3")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("whole", [400_000, 0])
def test_parts_missing_or_repeated(spark, odd, monkeypatch, whole):
    monkeypatch.setattr(tables, "PARTS", whole)
    g = tables.order_graphs(spark, odd)
    known = {(r.image_id, r.id, r.text, r.ord) for r in g.entities.collect()}
    assert {x for x in known if x[0] == 1} == {
        (1, "e10", "ten", 0), (1, "e12", "twelve", 2), (1, "e13", "thirteen", 3), (1, "e13", "again", 3),
        (1, None, None, 1000), (1, "cBrand1", "Brand#1", 1001), (1, "cBrand2", "Brand#2", 1002),
    }
    assert not [x for x in known if x[0] == 2]  # no part of it is known
    flows = sorted((r.subject_id, r.object_id) for r in g.relations.filter("predicate = 'flows_to'").collect())
    assert flows == [("e12", "e13")]  # not to e11, which is no entity
    assert g.relations.filter("image_id is null").count() == 0 and g.graphs.filter("image_id = 1").first().summary_text == "Order with 4 parts"


def test_tasks_grow_in_number(spark, sf, monkeypatch):
    """Each task has its share of the lines, however many there are."""
    monkeypatch.setattr(tables, "LINES", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        g = tables.order_graphs(spark, sf)
        lines = tables.table(spark, sf, "lineitem").count()
        for rows in (g.entities, g.relations, g.entities.groupBy("image_id", "norm_text").count()):
            sizes = [len(p) for p in rows.select("image_id").rdd.glom().collect()]
            assert len(sizes) >= lines / 100 and max(sizes) < 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pairs_do_not_read_texts(spark, sf):
    """What a text says is found for entities; the pairs only compare it."""
    pairs = catalogue.queries()["candidate_scores"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "score" in pairs and "split(" not in pairs and "regexp" not in pairs


def test_types_make_only_what_they_need(spark, sf):
    made = questions.Generator(tables.order_graphs(spark, sf))
    assert made.summary().count() and not {"context", "display", "nodes", "labels"} & set(vars(made)) and set(vars(made.g)) == {"_g", "graphs"}
    assert made.conflict().count() and not {"context", "nodes", "labels"} & set(vars(made))


def test_rows_of_graphs_stay_together(spark, sf):
    """What joins or counts kept rows by graph has nothing to shuffle."""
    kept = materialized(tables.order_graphs(spark, sf).entities)
    plan = kept.groupBy("image_id", "norm_text").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and kept.count() == tables.order_graphs(spark, sf).entities.count()


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_are_shuffled_once(spark, sf):
    """All three tables come from kept rows that lie by graph, and the phrases of a graph meet in one shuffle."""
    g = tables.order_graphs(spark, sf, kept=True)
    for rows in vars(g).values():
        assert not _shuffles(rows.repartition(8, "image_id"))
    plain = tables.order_graphs(spark, sf)
    for name in vars(g):
        assert not getattr(g, name).exceptAll(getattr(plain, name)).count() and getattr(g, name).count() == getattr(plain, name).count()
    spark.conf.set(ALL_KEYS, "false")
    try:
        assert _shuffles(display.display_map(g)) <= 1
    finally:
        spark.conf.unset(ALL_KEYS)


def test_keeps_no_candidates(spark, sf, monkeypatch):
    """Candidates and texts of a graph are made where they are ranked, and never written."""
    kept = []
    monkeypatch.setattr(questions, "materialized", lambda df: kept.append(df.columns) or materialized(df))
    made = questions.Generator(tables.order_graphs(spark, sf, kept=True))
    made.successor_abstain(), made.multihop()
    assert not [c for c in kept if {"ready"} & set(c)]
    assert not [c for c in kept if "options" in c and {"texts", "shown", "found", "mid"} & set(c)]


def test_words_are_not_shuffled(spark, sf):
    """Texts meet by graph once; their words, which are many more, stay where they are."""
    g = tables.order_graphs(spark, sf, kept=True)
    assert _shuffles(graph.keyword_counts(g)) <= 1


def test_a_task_keeps_one_bucket(spark, sf):
    """Also where nothing but the writing asks for buckets, so that a task does not grow with the table."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        files = materialized(tables.order_graphs(spark, sf, kept=True).relations).inputFiles()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({re.search(r"part-(\d+)", f)[1] for f in files}) == len(files) > 32


@pytest.mark.parametrize("query", ["shortest_path_le4", "shared_container"])
def test_joins_of_paths_stay_in_buckets(spark, sf, query):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalogue.queries()[query](spark, sf)
        assert not _shuffles(found) and found.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_containers_of_paths_stay_in_buckets(spark, sf):
    """Paths of two hops come from one kept table, so their containers need no shuffle."""
    g = questions.Kept(tables.order_graphs(spark, sf, kept=True))
    two = paths.shortest(g, hops=2, low=2)
    assert two.count() and not two.exceptAll(paths.shortest(g, hops=2).filter("hops = 2")).count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(ALL_KEYS, "false")
    try:
        assert not _shuffles(paths.shared_container(g, two.select("image_id", "path")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset(ALL_KEYS)
