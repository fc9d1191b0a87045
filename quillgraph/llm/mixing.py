"""Mixing sources to target weights by systematic sampling.

Every document expects target / source size copies. Within a source the expected copies are summed in
the order of size, then doc_id; one random offset per source is added, and a document is emitted once for
every integer boundary that its stretch of the sum crosses. Going by size keeps the words taken close to
the target. The sums are made in three levels, by (source, size), by ranges of doc_id within it and within
a range, over keys and sizes only, so that no source and no size has to pass one task; texts move once, to
meet their copies. One row per source passes a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import others, renamed, restored, saved, words

#: A source is repeated three times at most; weights repeat along the sources by code point.
MOST = 3
WEIGHTS = (1, 2, 3)
#: doc_ids of a range, as a power of two.
RANGE_BITS = 12


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size -> the same with weight and target: the water level w * x, cut at most * size,
    whose sum over the sources is that of all sizes. One row per source, null last."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    x = sizes.withColumn("weight", weight.cast("double"))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    cap = (F.col("source_size") * most).cast("double")
    x = (
        x.withColumn("_full", F.coalesce(F.sum(cap).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(whole).cast("double"))
        .withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_left"))
        .withColumn("_x", F.min(F.when(F.col("_level") * F.col("weight") <= cap, F.struct(cap / F.col("weight"), F.col("_level").alias("level")))).over(whole)["level"])
    )
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(cap, F.col("_x") * F.col("weight")))
    return x.select("source", "source_size", "weight", target.alias("target"))


def _ranked(keys: DataFrame) -> DataFrame:
    """keys (d, h, doc_id, source, size, m) with source_size, target and before, the rows ahead in their source."""
    bits = 64 - RANGE_BITS  # rows without doc_id go by their hash, below all others
    x = keys.withColumn("b", F.coalesce(F.shiftright("doc_id", RANGE_BITS), F.shiftright("h", bits) - (1 << 62)))
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_range = Window.partitionBy("source", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = x.groupBy("source", "size", "b").agg(F.sum("m").alias("n"))
    by_size = ranges.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    targets = targets.select(F.col("source").alias("t"), "source_size", "target")
    by_size = by_size.select(F.col("source").alias("s"), F.col("size").alias("z"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("smaller"))
    by_size = by_size.join(targets, F.col("s").eqNullSafe(F.col("t")))
    ranges = ranges.withColumn("earlier", F.coalesce(F.sum("n").over(by_range), F.lit(0)))
    ranges = ranges.join(by_size, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    ranges = ranges.select("s", "z", F.col("b").alias("r"), (F.col("smaller") + F.col("earlier")).alias("ahead"), "source_size", "target")
    inside = Window.partitionBy("source", "size", "b").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("i", F.coalesce(F.sum("m").over(inside), F.lit(0)))
    x = x.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("b") == F.col("r")))
    return x.select("d", "h", "size", "source_size", "target", (F.col("ahead") + F.col("i")).alias("before"))


def _mixed(docs: DataFrame, names: list[str], seed: str) -> DataFrame:
    """The columns in names, renamed, with size, source_size, target and copies of each row of docs."""
    source, doc_id = F.col("source").cast("string"), F.col("doc_id").cast("long")
    h = F.xxhash64("text", F.col("text").isNull(), source, source.isNull(), doc_id.isNull())
    key = (F.coalesce(doc_id, F.lit(-1)).alias("d"), h.alias("h"))
    keys = docs.select(*key, doc_id.alias("doc_id"), source.alias("source"), words("text").alias("size"))
    keys = saved(keys.groupBy(*keys.columns).agg(F.count("*").alias("m")))
    # of equal rows each takes its own place among them
    place = F.row_number().over(Window.partitionBy("d", "h").orderBy(F.col("owner").asc_nulls_first()))
    x = docs.select(*key, source.alias("owner"), *renamed(names)).join(_ranked(keys), ["d", "h"]).withColumn("at", F.col("before") + place)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), "owner"), F.lit(f"{seed}|")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    copies = F.floor(start + rate * F.col("at")) - F.floor(start + rate * (F.col("at") - 1))
    return x.select(*[f"own_{i}" for i in range(len(names))], "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target, copies and taken (columns of docs with these names, in whatever case, are
    replaced; other names of docs can be anything).

    A null or wordless text has size 0 and is emitted at its source's rate, like any other. Null is a source
    of its own, last in order. Sources without words have target 0 and no copies. A null doc_id comes before
    all others. Rows that share doc_id, source and text are told apart by nothing, so which of them gets an
    extra copy does not change the result as a set of rows.
    """
    rest = others(docs, "size", "source_size", "target", "copies", "taken")
    x = _mixed(docs, rest, seed)
    return x.select(*restored(rest), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of docs as often as it is emitted, with the columns of docs."""
    x = _mixed(docs, docs.columns, seed).filter("copies > 0")
    return x.withColumn("nth", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*restored(docs.columns))
