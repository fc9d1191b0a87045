"""One draw per graph from each kind of candidates. A draw takes the candidate whose key (md5 of seed, kind, graph
and candidate) is least, so it does not depend on partitions and needs no pass over the graphs in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_key
from ..sources.annotations import Graphs
from ..sources.shared import numbered
from .graph import conflict_relations, edges_with_text, entity_lookup, select_relations, unique_neighbour
from .paths import levels

SEED = 42


def _key(seed: int, kind: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(kind), "image_id", *[p.cast("string") for p in parts]).cast("binary"))


def drawn(candidates: DataFrame, kind: str, seed: int, *parts: str) -> DataFrame:
    """One row of candidates for each image_id; parts tell them apart."""
    key = _key(seed, kind, *map(F.col, parts))
    rest = [c for c in candidates.columns if c != "image_id"]
    best = candidates.groupBy("image_id").agg(F.min_by(F.struct(*rest), F.struct(key, *parts)).alias("one"))
    return best.select("image_id", "one.*")


def _named(g: Graphs) -> DataFrame:
    """Entities with a text."""
    return g.entities.filter("norm_text <> ''")


def presence_entity(g: Graphs, seed: int = SEED) -> DataFrame:
    return drawn(_named(g).select("image_id", "ord", "id", "text"), "presence", seed, "ord")


def absence_text(g: Graphs, pool: DataFrame, seed: int = SEED) -> DataFrame:
    """image_id, text: a text of the pool (key, text) that the graph has not.

    Pool and graphs are not crossed: a graph walks the pool in the order of its keys, from a start of its own, and
    as many places as it has texts, and one more, hold one that is absent.
    """
    present = g.entities.select("image_id", "norm_text").distinct()
    n = pool.count()
    if not n:
        return present.select("image_id", F.lit("").alias("text")).limit(0)
    rank = numbered(pool.select("key", "text"), [F.col("key")], "place").withColumn("place", F.col("place") - 1)
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("absence"), "image_id").cast("binary")), 1, 8), 16, 10).cast("long") % n
    sizes = present.groupBy("image_id").agg(F.count("*").alias("n"))
    walk = sizes.select(
        "image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(n - 1)))).alias("step"),
    ).withColumn("place", (start + F.col("step")) % n)
    absent = walk.join(rank, "place").join(present.withColumnRenamed("norm_text", "key"), ["image_id", "key"], "left_anti")
    return absent.groupBy("image_id").agg(F.min_by("text", "step").alias("text"))


def _both_named(g: Graphs, pairs: DataFrame, a: str, b: str) -> DataFrame:
    # the entities of all graphs never go whole to every task, however small their table is thought to be
    named = entity_lookup(g).filter(norm_key(F.col("text")) != "").select("image_id", "id").hint("shuffle_hash")
    return pairs.join(named.withColumnRenamed("id", a), ["image_id", a], "left_semi").join(named.withColumnRenamed("id", b), ["image_id", b], "left_semi")


def successor_target(g: Graphs, seed: int = SEED) -> DataFrame:
    """image_id, id, neighbour: an entity and its only successor."""
    return drawn(_both_named(g, unique_neighbour(g), "id", "neighbour"), "successor", seed, "id")


def containment_target(g: Graphs, seed: int = SEED) -> DataFrame:
    """image_id, container, child: a child and its only container."""
    pairs = unique_neighbour(g, "contains", forward=False).withColumnsRenamed({"id": "child", "neighbour": "container"})
    return drawn(_both_named(g, pairs, "child", "container"), "containment", seed, "child")


def edge_label_target(g: Graphs, seed: int = SEED) -> DataFrame:
    return drawn(edges_with_text(g).select("image_id", "ord", "subject_id", "object_id", "edge_text"), "edge_label", seed, "ord")


def conflict_target(g: Graphs, seed: int = SEED) -> DataFrame:
    return drawn(conflict_relations(g).select("image_id", "ord", "subject_id", "object_id"), "conflict", seed, "ord")


def negative_relation(g: Graphs, predicate: str, seed: int = SEED) -> DataFrame:
    """image_id, subject_id, object_id: an ordered pair of named entities without such an edge, conflicts counted."""
    kind = f"negative {predicate}"
    ids = _named(g).groupBy("image_id").agg(F.collect_set("id").alias("ids"))
    linked = select_relations(g, predicate).groupBy("image_id").agg(F.collect_set(F.struct("subject_id", "object_id")).alias("linked"))
    none = F.array().cast(linked.schema["linked"].dataType)
    rows = ids.join(linked.hint("shuffle_hash"), "image_id", "left").withColumn("linked", F.coalesce("linked", none))
    # pairs are made and compared in the row of their graph, those of one subject at a time: none is sorted or written
    one = lambda a, b: F.struct(_key(seed, kind, a, b).alias("k"), a.alias("subject_id"), b.alias("object_id"))
    shut = lambda a: F.array_append(F.transform(F.filter("linked", lambda e: e["subject_id"] == a), lambda e: e["object_id"]), a)
    best = F.transform("ids", lambda a: F.array_min(F.transform(F.array_except("ids", shut(a)), lambda b: one(a, b))))
    return rows.select("image_id", F.array_min(best).alias("one")).filter("one is not null").select("image_id", "one.subject_id", "one.object_id")


def multihop_pair(g: Graphs, low: int = 2, high: int = 4, predicate: str | None = None, seed: int = SEED) -> DataFrame:
    """image_id, src, tgt, path, hops: a pair whose shortest path is so long and goes through named entities only."""
    blank = entity_lookup(g).filter(norm_key(F.col("text")) == "").groupBy("image_id").agg(F.collect_set("id").alias("blank")).hint("shuffle_hash")
    named = lambda p: p.join(blank, "image_id", "left").filter("blank is null or not arrays_overlap(path, blank)").drop("blank")
    # a draw from each length, then one of these: no table has all pairs, nor are they dealt again
    each = [drawn(named(p), "multihop", seed, "src", "tgt") for p in levels(g, predicate, hops=high, low=low)]
    return drawn(reduce(DataFrame.unionByName, each), "multihop", seed, "src", "tgt")
