"""Lookups, filters, joins and counts over all graphs at once. Joins go by image_id first, always."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, clean, domain_word, domains, tokens
from ..sources.annotations import Graphs
from ..sources.shared import dealt



#: One predicate, several of them, or none for all.
Predicates = str | Collection[str] | None


def select_relations(g: Graphs, predicate: Predicates = None, include_conflict: bool = True) -> DataFrame:
    r = g.relations if include_conflict else g.relations.filter(~F.col("is_conflict"))
    if predicate is None:
        return r
    return r.filter(F.col("predicate").isin(*([predicate] if isinstance(predicate, str) else predicate)))


def conflict_relations(g: Graphs) -> DataFrame:
    return g.relations.filter("is_conflict")


def edges_with_text(g: Graphs, predicate: Predicates = None, include_conflict: bool = False) -> DataFrame:
    return select_relations(g, predicate, include_conflict).filter(F.trim("edge_text") != "")


def entity_lookup(g: Graphs) -> DataFrame:
    """image_id, id, text, type: of a repeated id the last entity counts."""
    return g.entities.groupBy("image_id", "id").agg(F.max_by("text", "ord").alias("text"), F.max_by("type", "ord").alias("type"))


def has_entity(g: Graphs, ids: DataFrame) -> DataFrame:
    """The rows of ids (image_id, id) that are entities."""
    return ids.join(g.entities.select("image_id", "id"), ["image_id", "id"], "left_semi")


def find_ids(g: Graphs, text: str, exact: bool = True) -> DataFrame:
    probe = " ".join(text.split()).lower()
    hit = F.col("norm_text") == probe if exact else F.contains("norm_text", F.lit(probe))
    return g.entities.filter(hit).select("image_id", "ord", "id")


def edge_exists(g: Graphs, pairs: DataFrame, predicate: Predicates = None, include_conflict: bool = True) -> DataFrame:
    """pairs (image_id, subject_id, object_id) that have an edge."""
    return pairs.join(select_relations(g, predicate, include_conflict), ["image_id", "subject_id", "object_id"], "left_semi")


def first_edge_text(g: Graphs) -> DataFrame:
    """Label of the first edge of each pair, null if blank."""
    r = g.relations.groupBy("image_id", "subject_id", "object_id").agg(F.min_by("edge_text", "ord").alias("edge_text"))
    return r.withColumn("edge_text", F.nullif("edge_text", F.lit("")))


def neighbours(g: Graphs, predicate: Predicates = "flows_to", forward: bool = True, include_conflict: bool = False) -> DataFrame:
    """image_id, id, neighbour, ord, one row an edge: successors, predecessors, children, parents, connected."""
    a, b = ("subject_id", "object_id") if forward else ("object_id", "subject_id")
    return select_relations(g, predicate, include_conflict).select("image_id", F.col(a).alias("id"), F.col(b).alias("neighbour"), "ord")


def pairs(g: Graphs, predicate: Predicates, include_conflict: bool = False) -> DataFrame:
    return select_relations(g, predicate, include_conflict).select("image_id", "subject_id", "object_id")


def unique_neighbour(g: Graphs, predicate: str = "flows_to", forward: bool = True) -> DataFrame:
    """The neighbour of those that have one edge; parallel edges count."""
    n = neighbours(g, predicate, forward).groupBy("image_id", "id").agg(F.count("*").alias("n"), F.first("neighbour").alias("neighbour"))
    return n.filter("n = 1").drop("n")


def text_counts(g: Graphs) -> DataFrame:
    return g.entities.groupBy("image_id", "norm_text").agg(F.count("*").alias("n"))


def duplicate_texts(g: Graphs) -> DataFrame:
    """Groups of entities that share a text that is not empty."""
    d = g.entities.filter("norm_text <> ''").groupBy("image_id", "norm_text").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "id")))["id"].alias("ids"),
    )
    return d.filter("n > 1")


def top_level(g: Graphs) -> DataFrame:
    inside = pairs(g, "contains").select("image_id", F.col("object_id").alias("id"))
    return g.entities.join(inside, ["image_id", "id"], "left_anti")


def root_flow(g: Graphs) -> DataFrame:
    """Top-level entities without a top-level predecessor."""
    top = top_level(g)
    fed = neighbours(g, forward=False).join(top.select("image_id", F.col("id").alias("neighbour")), ["image_id", "neighbour"], "left_semi")
    return top.join(fed, ["image_id", "id"], "left_anti")


def _texts(g: Graphs) -> DataFrame:
    """image_id, ord, text of summaries and entities, dealt by graph."""
    texts = g.graphs.select(
        "image_id", F.lit(-1).cast("long").alias("ord"), F.col("summary_text").alias("text"),
    ).unionByName(g.entities.select("image_id", F.col("ord").cast("long").alias("ord"), "text"))
    return dealt(texts)


def keyword_counts(g: Graphs, k: int = 12, some: DataFrame | None = None) -> DataFrame:
    """The k most frequent words of the summary and entity texts, of some graphs or of all; ties by first occurrence.
    Texts are dealt by graph, not their words."""
    texts = _texts(g) if some is None else _texts(g).join(some, "image_id", "left_semi")
    words = texts.select(
        "image_id", "ord", F.posexplode(tokens(F.col("text"))).alias("pos", "word"),
    ).filter((F.length("word") >= 3) & ~F.col("word").isin(*STOPWORDS))
    n = words.groupBy("image_id", "word").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "first"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= k).select("image_id", "word", "n", "rank")


def domain_hints(g: Graphs) -> DataFrame:
    """image_id, domains (sorted) by the most frequent words; graphs without words are `unknown`. So are those without
    any word of a domain, whose words need not be counted."""
    some = _texts(g).filter(domain_word(F.col("text"))).select("image_id").distinct().hint("shuffle_hash")
    words = keyword_counts(g, some=some).groupBy("image_id").agg(F.collect_list("word").alias("words")).hint("shuffle_hash")
    hint = domains(F.coalesce("words", F.array().cast("array<string>")))
    return g.graphs.select("image_id").join(words, "image_id", "left").select("image_id", F.array_sort(hint).alias("domains"))


def pool(texts: DataFrame, *by: str) -> DataFrame:
    """key, text of the distinct texts in (text, image_id, ord); the first spelling counts. With `by`, a pool for each
    value of these columns."""
    rows = texts.select(*by, clean(F.col("text")).alias("text"), "image_id", "ord").withColumn("key", F.lower("text")).filter("key <> ''")
    return rows.groupBy(*by, "key").agg(F.min_by("text", F.struct("image_id", "ord")).alias("text"))


def node_texts(g: Graphs) -> DataFrame:
    return g.entities.select("text", "image_id", "ord")


def edge_label_texts(g: Graphs) -> DataFrame:
    return g.relations.select(F.col("edge_text").alias("text"), "image_id", "ord")


def node_pool(g: Graphs) -> DataFrame:
    return pool(node_texts(g))


def edge_label_pool(g: Graphs) -> DataFrame:
    return pool(edge_label_texts(g))


def splits(g: Graphs, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """image_id, split: sizes are whole parts, the test split takes the rest. The graphs below the cut are told
    by quantiles of a hash, counted within 4096 ranges, so no task sorts all graphs."""
    if abs(train + val + test - 1) > 1e-8:
        raise ValueError("ratios must sum to 1")
    h = F.md5(F.concat_ws("|", F.lit(seed), "image_id").cast("binary"))
    x = g.graphs.select("image_id", h.alias("h")).withColumn("range", F.substring("h", 1, 3))
    counts = x.groupBy("range").agg(F.count("*").alias("n"))
    ordered = Window.orderBy("range")
    counts = counts.select("range", F.sum("n").over(ordered).alias("upto"), "n", F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("upto") - F.col("n") + F.row_number().over(Window.partitionBy("range").orderBy("h", "image_id"))
    x = x.join(counts, "range").withColumn("rank", rank)
    a = F.floor(F.col("all") * train)
    b = a + F.floor(F.col("all") * val)
    return x.select("image_id", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "val").otherwise("test").alias("split"))

