"""Metrics as sums that merge: each result line changes a small table, and what it replaces is taken back.

All metrics are quotients of sums over results, grouped by model, level, question type and stage of parsing. The state
of a stream keeps, for each key, what its last line contributed; a line with the same key and a later time puts out the
difference. A batch adds its differences, summed by group, to a table, so metrics read as many rows as there are
groups and batches, not results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.replies import UNITS, parse, score, units
from ..sources.shared import materialized
from .replies import LINE

GROUP = ("model", "level", "question_type", "parse_stage")
#: Rates by their sums (numerator, denominator), and whether the numerator is in UNITS.
RATES = {
    "answerable_correct_rate": ("right", "answerable", True), "answerable_false_abstain_rate": ("shy", "answerable", False),
    "unanswerable_correct_abstain_rate": ("wise", "unanswerable", False), "unanswerable_hallucination_rate": ("bold", "unanswerable", False),
    "invalid_response_rate": ("invalid", "judged", False), "multihop_f1": ("f1", "several", True), "l3_open_score": ("open", "opened", True),
}
SUMS = ("n", "right", "answerable", "shy", "wise", "unanswerable", "bold", "invalid", "judged", "f1", "several", "open", "opened", "units", "counted", "prompt_tokens", "completion_tokens")


def contributions(scored: DataFrame) -> DataFrame:
    """scored results with v, what each adds to the SUMS; the stage of a failed one counts nowhere."""
    u, fine, kind = units(), F.col("error").isNull(), F.col("answer_type")
    closed, abstained = fine & (kind != "open"), F.col("parse_action") == "abstained"
    valid = closed & (F.col("parse_action") != "invalid")
    answerable, not_ = valid & ~F.col("is_unanswerable"), valid & F.col("is_unanswerable")
    several, opened = valid & (kind == "multi_select") & F.col("f1_units").isNotNull(), fine & (kind == "open") & u.isNotNull()
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    of = lambda c, value: F.coalesce(F.when(c, value), F.lit(0)).cast("long")
    parts = {
        "n": F.lit(1).cast("long"), "right": of(answerable & ~abstained, u), "answerable": one(answerable), "shy": one(answerable & abstained), "wise": one(not_ & abstained), "unanswerable": one(not_),
        "bold": one(not_ & ~abstained), "invalid": one(~fine | (closed & ~valid)), "judged": one(~fine | closed), "f1": of(several, F.col("f1_units")), "several": one(several), "open": of(opened, u), "opened": one(opened),
        "units": of(u.isNotNull(), u), "counted": one(u.isNotNull()), "prompt_tokens": F.coalesce("prompt_tokens", F.lit(0)).cast("long"), "completion_tokens": F.coalesce("completion_tokens", F.lit(0)).cast("long"),
    }
    stage = F.when(fine, F.col("parse_stage"))
    return scored.select("key", "at", "model", "level", "question_type", stage.alias("parse_stage"), F.array(*[parts[s] for s in SUMS]).alias("v"))


def summed(rows: DataFrame) -> DataFrame:
    """GROUP and SUMS of rows with v."""
    return rows.groupBy(*GROUP).agg(*[F.sum(F.get("v", F.lit(i))).alias(s) for i, s in enumerate(SUMS)])


def merged(tables: list[DataFrame]) -> DataFrame:
    """One table of sums in place of several."""
    return reduce(DataFrame.unionByName, tables).groupBy(*GROUP).agg(*[F.sum(s).alias(s) for s in SUMS])


def _rate(up: str, down: str, in_units: bool) -> Column:
    rate = F.sum(up) / F.nullif(F.sum(down), F.lit(0))
    return rate / UNITS if in_units else rate


def metrics_of(sums: DataFrame) -> DataFrame:
    """What replies.metrics_by_model() gives of the results, of their sums."""
    rates = [_rate(*of).alias(name) for name, of in RATES.items()]
    made = sums.groupBy("model").agg(F.sum("n").alias("n"), *rates, F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return made.filter("n > 0")


def metrics_of_by(sums: DataFrame, column: str) -> DataFrame:
    """What replies.metrics_by() gives, for level or question_type."""
    return sums.groupBy("model", column).agg(F.sum("counted").alias("n"), F.sum("units").alias("units")).filter("n > 0")


def stages_of(sums: DataFrame) -> DataFrame:
    """What replies.stage_counts() gives."""
    return sums.filter("parse_stage is not null").groupBy("model", "parse_stage").agg(F.sum("n").alias("n")).filter("n > 0")


_STATE = "at double, tie string, model string, level string, question_type string, parse_stage string, v array<long>"
_OUT = "model string, level string, question_type string, parse_stage string, v array<long>"


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the last of a key's lines adds, and what the line before it takes back."""
    held = state.get if state.exists else None
    best = held
    for frame in frames:
        for r in frame.itertuples(index=False):
            row = (r.at, r.tie, r.model, r.level, r.question_type, r.parse_stage, [int(x) for x in r.v])
            if best is None or row[:2] >= tuple(best[:2]):
                best = row
    if best is not None and best is not held:
        state.update(best)
        out = [tuple(best[2:])]
        if held is not None:
            out.append((*held[2:6], [-int(x) for x in held[6]]))
        yield pd.DataFrame(out, columns=["model", "level", "question_type", "parse_stage", "v"])


def age(lines: DataFrame) -> Column:
    """struct<at, tie> by which lines with one key are in order: time (0 where there is none), then text, then the rest."""
    rest = F.sha2(F.to_json(F.struct(*[c for c in lines.columns if c != "at"])).cast("binary"), 256)
    return F.struct(F.coalesce("at", F.lit(0.0)).alias("at"), F.concat(F.coalesce("raw_output", F.lit("")), F.lit("\n"), rest).alias("tie"))


def follow_sums(spark: SparkSession, source: str, target: str, checkpoint: str, compat: bool = True) -> StreamingQuery:
    """Sums of the JSON lines that arrive in source, added to target batch by batch.

    Of several lines with a key the one with the latest `at` counts, of equal times the one whose text is greatest, in
    whatever order and however often they come. A batch that is run again overwrites its own part. The state holds one
    row for each key.
    """
    lines = spark.readStream.schema(f"{LINE}, at double").json(source)
    rows = contributions(score(parse(lines.withColumn("at", age(lines)), compat))).select("key", "at.at", "at.tie", *GROUP, "v")
    changes = rows.groupBy("key").applyInPandasWithState(_changes, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)

    def add(batch: DataFrame, number: int) -> None:
        summed(batch).coalesce(1).write.mode("overwrite").parquet(f"{target}/batch={number}")  # a row for each group

    return changes.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sums(spark: SparkSession, target: str) -> DataFrame:
    """The sums up to now."""
    return materialized(merged([spark.read.option("basePath", target).parquet(target).select(*GROUP, *SUMS)]))
