"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
FREE_SCAN = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set: on one machine a temporary folder, on a cluster one
    beside the warehouse, which is shared as well."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        own = tempfile.mkdtemp(prefix="quillgraph-") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"
        sc.setCheckpointDir(own)
        found = sc.getCheckpointDir()
    return found


def dealt(df: DataFrame) -> DataFrame:
    """Rows of graphs dealt by graph as kept tables are: what follows by graph, and keeping it, shuffles nothing more."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")


def materialized(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what follows is planned by itself and does not compute it
    again, and a lost executor takes nothing along.

    Rows of graphs lie in buckets by image_id, as many as there are shuffle partitions, so that what joins or counts
    them by graph has nothing to shuffle. A task has one bucket, also where nothing but this writing asks for them;
    else it would read as many as fit a split of files, and sort all their rows.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{shared_folder(spark)}/graphs/{name}"
    if "image_id" not in df.columns:
        df.write.parquet(path, compression="zstd")
        return spark.read.schema(df.schema).parquet(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of a graph are together, so they are for any further key as well; a task has one bucket, so nothing is sorted by bucket
    for_now = {ALL_KEYS: "false", FREE_SCAN: "false", WRITERS: "1"}
    was = {k: spark.conf.get(k) for k in for_now}
    for k, v in for_now.items():
        spark.conf.set(k, v)
    try:
        dealt(df).write.bucketBy(n, "image_id").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(f"graphs_{name}")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    return spark.table(f"graphs_{name}")


def held(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with columns that are made once, however often they are used after: nothing that follows is moved before a
    generator, and no table is written for it."""
    made = rows.withColumn("_held", F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))
    return made.select(*[c for c in rows.columns if c not in values], "_held.*")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their number from 1 on, in order: sorted by ranges, so that no task has them all. Equal rows are
    numbered too, in any order."""
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_k"))
    dealt = materialized(dealt)
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_size"))  # one row for each partition
    before = parts.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_k") + 1).drop("_part", "_k", "_before")
