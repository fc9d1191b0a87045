"""Metrics that follow a stream of reply lines: each batch is parsed and scored, and a table of results is kept
by key, the last line of a key counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.replies import metrics_by_model, parse, score

LINE = (
    "key string, model string, level string, question_type string, answer_type string, is_unanswerable boolean, gold array<string>, options array<struct<label:string,text:string>>, raw_output string, error string, "
    "prompt_tokens bigint, completion_tokens bigint, judge_reply string, open_judge struct<coverage:bigint,correctness:bigint,hallucination:bigint>"
)


def latest(results: DataFrame) -> DataFrame:
    """One row per key, of the last batch that had it."""
    rest = [c for c in results.columns if c != "key"]
    best = results.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("batch", "raw_output")).alias("r"))
    return best.select("key", "r.*")


def follow(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Results of the JSON lines that arrive in source, appended to target with their batch. A batch that is run
    again overwrites its own part, so a restart changes nothing."""

    def keep(batch: DataFrame, number: int) -> None:
        score(parse(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(LINE).json(source).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metrics(spark: SparkSession, target: str) -> DataFrame:
    return metrics_by_model(latest(spark.read.option("basePath", target).parquet(target)))
