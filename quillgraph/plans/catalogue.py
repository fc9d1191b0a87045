"""All queries over graphs, questions and replies on whole tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_of, clean, domains, in_common, keywords, norm_key, score_fitting, signature
from ..operators import display, graph, paths, questions, rank, replies, samples, validate
from ..sources import annotations, tables
from ..sources.shared import materialized
from . import question_sql, sql

__all__ = ["oracle_sql", "queries"]


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | question_sql.oracle_sql()


ALL_TYPES = {
    "q_presence": "presence", "q_absence": "absence", "q_successor_abstain": "successor_abstain", "q_successor_multi": "successor_multi", "q_containment_abstain": "containment_abstain",
    "q_containment_multi": "containment_multi", "q_edge_label": "edge_label", "q_multihop": "multihop", "q_conflict": "conflict", "q_summary": "summary",
}


def _orders(build: Callable[[annotations.Graphs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(tables.order_graphs(spark, sf_dir))


def _replies(build: Callable[[DataFrame], DataFrame], source=tables.replies) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(source(spark, sf_dir))


def _path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join("path", ">"))


def _signatures(g: annotations.Graphs) -> DataFrame:
    x = graph.node_pool(g).withColumn("s", signature(F.col("text")))
    return x.select(
        "text", "s.token_count", "s.char_length", "s.has_hyphen", "s.suffix_type",
        F.array_join(F.array_sort("s.keywords"), " ").alias("keywords"),
        F.array_join(F.array_sort(domains(keywords(F.col("text")))), " ").alias("domains"),
    )


def _scores(g: annotations.Graphs) -> DataFrame:
    """All ordered pairs of a graph's entities; what a text says is found once for each entity, not for each pair."""
    e = g.entities.select("image_id", "id", signature(clean(F.col("text"))).alias("sig")).join(graph.domain_hints(g), "image_id")
    one = F.struct("id", "sig", any_of(domains(F.col("sig.keywords")), F.col("domains")).alias("fits"))
    all_ = e.groupBy("image_id").agg(F.collect_list(one).alias("all"))
    two = all_.select("image_id", "all", F.explode("all").alias("t")).select("image_id", "t", F.explode("all").alias("c")).filter("t.id <> c.id")
    shared = in_common(F.col("t.sig.keywords"), F.col("c.sig.keywords"))
    own = score_fitting(F.col("t.sig"), F.col("c.sig"), F.col("c.fits"), shared)
    return two.select("image_id", F.col("t.id").alias("id"), F.col("c.id").alias("candidate_id"), own.alias("score"))


def _targets(g: annotations.Graphs, near: bool) -> DataFrame:
    """Every entity with the ranking of the other texts of its graph.

    Where all texts are few, they are ranked once for each text and hint, and a graph puts its own in that order; else
    each entity ranks the texts of its graph.
    """
    texts = g.entities.groupBy("image_id", "norm_text").agg(F.min(clean(F.col("text"))).alias("text"))
    rows = g.entities.select("image_id", "id", clean(F.col("text")).alias("text"))
    hints = materialized(graph.domain_hints(g))
    known = materialized(rows.select("text").distinct())
    if known.count() > rank.WHOLE:
        ready = texts.groupBy("image_id").agg(F.collect_list("text").alias("texts")).select("image_id", rank.prepared(F.col("texts")).alias("ready"))
        rows = rows.join(ready, "image_id").join(hints, "image_id")
        return rows.withColumn("order", rank.ranked(F.col("text"), F.col("ready"), F.col("domains"), F.array(norm_key(F.col("text"))), near))
    all_ = materialized(known.agg(F.array_sort(F.collect_list("text")).alias("t")).select(rank.prepared(F.col("t")).alias("all")))
    code = all_.select(F.posexplode("all").alias("code", "c")).select("code", F.col("c.text").alias("text"))
    once = known.crossJoin(F.broadcast(hints.select("domains").distinct())).crossJoin(F.broadcast(all_))
    once = materialized(once.select("text", "domains", "all", rank.placed(F.col("text"), F.col("all"), F.col("domains"), near).alias("places")))
    place = F.transform("all", lambda c, i: F.when(c["key"] != norm_key(F.col("text")), F.nullif(F.array_position("places", i), F.lit(0))))
    shown = F.transform("all", lambda c: F.struct(*[c[k].alias(k) for k in ("text", "first", "last")]))
    once = F.broadcast(once.select("text", "domains", place.alias("place"), shown.alias("all")))
    codes = texts.join(F.broadcast(code), "text").groupBy("image_id").agg(F.collect_list("code").alias("codes"))
    own = hints.join(codes, "image_id", "left").hint("shuffle_hash")
    rows = rows.join(own, "image_id").join(once, ["text", "domains"])
    at = F.transform(F.coalesce("codes", F.array().cast("array<int>")), lambda c: F.struct(F.get("place", c).alias("p"), c.alias("c")))
    return rows.withColumn("order", F.transform(F.sort_array(F.filter(at, lambda x: x["p"].isNotNull())), lambda x: F.get("all", x["c"])))


def _ranked(g: annotations.Graphs) -> DataFrame:
    return _targets(g, False).select("image_id", "id", F.array_join(rank.texts(F.col("order")), "|").alias("ranking"))


def _diverse(g: annotations.Graphs) -> DataFrame:
    return _targets(g, True).select("image_id", "id", F.array_join(rank.diverse(F.col("order"), 3), "|").alias("picked"))


def _display(g: annotations.Graphs) -> DataFrame:
    return display.display_map(g).select(
        "image_id", "id", "display_text", "usable", "used_disambiguation",
        F.array_join(F.array_sort("referenced_ids"), ",").alias("referenced_ids"),
    )


def _flat(q: DataFrame, *more: str) -> DataFrame:
    """Questions with every list as text."""
    options = F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit(". "), o["text"])), "|")
    meta = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    return q.select(
        "image_id", "paper_id", "level", "question_type", "question", options.alias("options"), F.array_join("answer", ",").alias("answer"), F.array_join("answer_text", "|").alias("answer_text"),
        F.array_join(
            F.transform("correct_option_indices", lambda i: i.cast("string")), ",",
        ).alias("correct_option_indices"), "answer_type", meta.alias("metadata"), *more,
    )


def _questions(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _flat(getattr(questions.Generator(tables.order_graphs(spark, sf_dir, kept=True)), method)())


def _every_question(g: annotations.Graphs) -> tuple[DataFrame, DataFrame]:
    made = questions.Generator(g)
    return made.generate(questions.TYPES), made.context


def _judged(q: DataFrame, context: DataFrame) -> DataFrame:
    """Verdicts over questions as they are made, and over the same with faults put in by turns."""
    turn = F.when(F.col("answer_type") == "open", 0).otherwise(F.pmod("image_id", F.lit(6)))
    texts = F.transform(
        "options", lambda o,
        i: F.struct(o["label"].alias("label"), F.when((turn == 1) & (i == 0), F.get("options", F.lit(1))["text"]).otherwise(o["text"]).alias("text")),
    )
    labels = F.transform("options", lambda o, i: F.struct(F.when((turn == 2) & (i == 0), "B").otherwise(o["label"]).alias("label"), o["text"].alias("text")))
    spoiled = q.withColumn(
        "correct_option_indices", F.when(turn == 3, F.array(F.lit(7))).otherwise(F.col("correct_option_indices")),
    ).withColumn("answer", F.when(turn == 4, F.array(F.lit("F"))).otherwise(F.col("answer")))
    spoiled = spoiled.withColumn(
        "options",
        F.when(turn == 1, texts).when(turn == 2, labels).when(turn == 5, F.slice("options", 1, 1)).otherwise(F.col("options")),
    )
    both = q.withColumn("spoiled", F.lit(False)).unionByName(spoiled.withColumn("spoiled", F.lit(True)))
    return validate.verdicts(both, context).groupBy("question_type", "spoiled", "ok", "reason").agg(F.count("*").alias("n"))


def _negative(g: annotations.Graphs) -> DataFrame:
    """Ordered pairs of a graph's nodes without any edge, conflicts included."""
    e = g.entities.filter("type = 'Node'").select("image_id", F.col("id").alias("subject_id")).distinct()
    two = e.join(e.withColumnRenamed("subject_id", "object_id"), "image_id").filter("subject_id <> object_id")
    return two.join(g.relations, ["image_id", "subject_id", "object_id"], "left_anti")


def _parsed(rows: DataFrame) -> DataFrame:
    return replies.parse(rows).select("sample_id", "parse_action", F.array_join("parse_letters", ",").alias("letters"), "parse_stage")


def _scored(rows: DataFrame) -> DataFrame:
    return replies.score(replies.parse(rows))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache lines of users: the last one of a key counts."""
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("value"))
    return annotations.last_wins(e)


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as work; orders are their cached replies, four of five with an error."""
    work = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    cached = tables.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 5 != 0, '{"error": "x"}').otherwise("{}").alias("value"),
    )
    return annotations.pending(work, cached)


def _prompts(rows: DataFrame) -> DataFrame:
    return replies.prompts(rows.withColumn("question", F.concat(F.lit("Which one is "), "sample_id", F.lit("?")))).select("sample_id", "prompt")


def _kept(build: Callable[[annotations.Graphs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Over graph tables that are made once, if they are asked for: for queries that use them several times."""
    return lambda spark, sf_dir: build(questions.Kept(tables.order_graphs(spark, sf_dir, kept=True)))


def _both_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to single questions and, of the same models, to those with several right options."""
    return tables.replies(spark, sf_dir).unionByName(tables.multi_replies(spark, sf_dir))


def _shared(g: annotations.Graphs) -> DataFrame:
    """The least container of each shortest path of two hops over all predicates within one."""
    p = materialized(paths.shortest(g, hops=2, low=2).select("image_id", "path"))
    return materialized(paths.shared_container(g, p)).withColumn("path", F.array_join("path", ">"))


def _probes(g: annotations.Graphs) -> DataFrame:
    """Ends of relations and ids that are none."""
    return g.relations.select("image_id", F.explode(F.array("subject_id", F.concat("object_id", F.lit("x")), "object_id")).alias("id")).distinct()


def _sample_ids(rows: DataFrame) -> DataFrame:
    x = rows.withColumn("question", F.concat(F.lit("Which \"one\" is "), "sample_id", F.lit("?")))
    return x.select(
        "sample_id",
        replies.sample_id(
            F.col("model"), F.col("sample_id"), F.col("question_type"), F.col("question"), F.col("options"), F.col("gold"),
            F.col("answer_type"),
        ).alias("key"),
    )


def _dataset(g: annotations.Graphs) -> DataFrame:
    """Questions that take options from pools, of three splits."""
    made = questions.dataset(g, ["element_presence_mcq", "relation_edge_label_hidden_abstain_mcq", "function_summary_open"])
    return _flat(made, "split")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    g = graph
    relations = ["image_id", "ord", "subject_id", "predicate", "object_id", "edge_text", "is_conflict"]
    found = {
        "entities_normalized": _orders(lambda x: x.entities.select("image_id", "ord", "id", "text", "type", "norm_text")),
        "relations_clean": _orders(lambda x: x.relations.select(*relations)),
        "event_relations": lambda spark, d: tables.event_graphs(spark, d).relations.select("image_id", "ord", "subject_id", "object_id"),
        "hierarchy_children": lambda spark, d: g.neighbours(tables.hierarchy_graphs(spark, d), "contains").select("image_id", "id", "neighbour"),
        "relation_filters": _orders(lambda x: g.select_relations(x, "flows_to", False).select("image_id", "subject_id", "object_id")),
        "edges_with_text": _orders(lambda x: g.edges_with_text(x).select("image_id", "subject_id", "object_id", "edge_text")),
        "conflict_relations": _orders(lambda x: g.conflict_relations(x).select("image_id", "subject_id", "object_id")),
        "entity_lookup_last_wins": _orders(g.entity_lookup),
        "find_ids_exact": _orders(lambda x: g.find_ids(x, " Brand#11 ").select("image_id", "id")),
        "find_ids_substring": _orders(lambda x: g.find_ids(x, "and#2", exact=False).select("image_id", "id")),
        "edge_exists": lambda spark, d: (
            lambda x: g.edge_exists(
                x,
                x.relations.select("image_id", F.col("object_id").alias("subject_id"), F.col("subject_id").alias("object_id")).distinct(),
            )
        )(tables.event_graphs(spark, d)),
        "edge_text_first": _orders(g.first_edge_text),
        "successors": _orders(lambda x: g.neighbours(x).select("image_id", "id", "neighbour")),
        "predecessors": _orders(lambda x: g.neighbours(x, forward=False).select("image_id", "id", "neighbour")),
        "children": _orders(lambda x: g.neighbours(x, "contains").select("image_id", "id", "neighbour")),
        "parents": _orders(lambda x: g.neighbours(x, "contains", forward=False).select("image_id", "id", "neighbour")),
        "connected_neighbors": lambda spark, d: g.neighbours(tables.event_graphs(spark, d), "connects_to").select("image_id", "id", "neighbour"),
        "neighbours_of_two_predicates": lambda spark, d: g.neighbours(
            tables.event_graphs(spark, d), {"connects_to", "contains"}, forward=False,
        ).select("image_id", "id", "neighbour"),
        "has_entity": _orders(lambda x: g.has_entity(x, _probes(x))),
        "pairs_by_predicate": _orders(lambda x: g.pairs(x, "flows_to", include_conflict=True)),
        "unique_successor": _orders(g.unique_neighbour),
        "unique_predecessor": _orders(lambda x: g.unique_neighbour(x, forward=False)),
        "unique_parent": _orders(lambda x: g.unique_neighbour(x, "contains", forward=False)),
        "text_counts": _orders(g.text_counts),
        "duplicate_texts": _orders(lambda x: g.duplicate_texts(x).withColumn("ids", F.array_join("ids", ","))),
        "graph_keywords_top12": _orders(lambda x: g.keyword_counts(x).withColumn("rank", F.col("rank").cast("long"))),
        "domain_hint": _kept(lambda x: g.domain_hints(x).withColumn("domains", F.array_join("domains", ","))),
        "node_pool": _orders(g.node_pool),
        "edge_label_pool": _orders(g.edge_label_pool),
        "top_level": _orders(lambda x: g.top_level(x).select("image_id", "id")),
        "root_flow": _kept(lambda x: g.root_flow(x).select("image_id", "id")),
        "shortest_path_le4": _kept(lambda x: _path(materialized(paths.shortest(x))).withColumn("hops", F.col("hops").cast("long"))),
        "has_path": _kept(lambda x: paths.shortest(x).groupBy("image_id").agg(F.count("*").alias("pairs"))),
        "unique_multihop_pairs": _kept(lambda x: _path(paths.unique_multihop(x)).select("image_id", "src", "tgt", "path")),
        "main_flow": _kept(lambda x: paths.main_flow(x).withColumn("flow", F.array_join("flow", ">"))),
        "text_signature": _orders(_signatures),
        "candidate_scores": _orders(_scores),
        "ranked_candidates": _kept(_ranked),
        "diverse_top_k": _kept(_diverse),
        "display_map": _kept(_display),
        "validation_verdicts": lambda spark, d: _judged(*_every_question(tables.order_graphs(spark, d, kept=True))),
        "summary_grouping_sets": lambda spark, d: questions.summarize(_every_question(tables.order_graphs(spark, d, kept=True))[0]),
        "negative_relation_pairs": _orders(_negative),
        "split_assignment": _orders(g.splits),
        "dataset_by_split": _kept(_dataset),
        "shared_container": _kept(_shared),
        "presence_sample": _orders(samples.presence_entity),
        "absence_sample": _orders(lambda x: samples.absence_text(x, g.node_pool(x))),
        "successor_sample": _orders(lambda x: materialized(samples.successor_target(x))),
        "containment_sample": _orders(lambda x: materialized(samples.containment_target(x))),
        "edge_label_sample": _orders(samples.edge_label_target),
        "conflict_sample": _orders(samples.conflict_target),
        "negative_relation_sample": _orders(lambda x: samples.negative_relation(x, "flows_to")),
        "multihop_pair_sample": _kept(lambda x: _path(materialized(samples.multihop_pair(x))).withColumn("hops", F.col("hops").cast("long"))),
        "sample_keys": _replies(_sample_ids),
        "prompts": _replies(_prompts),
        "parse_abstain": _replies(lambda r: r.select("sample_id", replies.abstains(F.col("raw_output")).alias("abstains"))),
        "parse_stage1_single": _replies(lambda r: r.select("sample_id", replies.stated_letter(F.col("raw_output")).alias("letter"))),
        "parse_stage2_substring": _replies(lambda r: r.select("sample_id", replies.option_hit(F.col("raw_output"), F.col("options")).alias("letter"))),
        "parse_cascade": _replies(_parsed),
        "parse_multi": _replies(_parsed, tables.multi_replies),
        "parse_multi_fixed": _replies(
            lambda r: replies.parse(r, compat=False).select("sample_id", "parse_action", F.array_join("parse_letters", ",").alias("letters"), "parse_stage"),
            tables.multi_replies,
        ),
        "score_single": _replies(lambda r: _scored(r).select("sample_id", "correct")),
        "score_multi_f1": _replies(lambda r: _scored(r).select("sample_id", "correct", "f1_units"), tables.multi_replies),
        "metrics_by_model": _replies(lambda r: replies.metrics_by_model(_scored(r))),
        "metrics_with_multi_select": _replies(lambda r: replies.metrics_by_model(_scored(r)), _both_replies),
        "token_usage": _replies(replies.token_usage),
        "metrics_by_level": _replies(lambda r: replies.metrics_by(_scored(r), "level")),
        "metrics_by_qtype": _replies(lambda r: replies.metrics_by(_scored(r), "question_type")),
        "stage_counts": _replies(lambda r: replies.stage_counts(_scored(r))),
        "cache_last_wins": _cache,
        "pending_work": _pending,
    }
    return found | {name: _questions(method) for name, method in ALL_TYPES.items()}
