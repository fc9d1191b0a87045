"""Command line: `generate` makes a dataset of questions from annotations, `evaluate` scores replies to it.

Run it with spark-submit, or with python on one machine.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate as evaluation
from .operators import questions
from .operators.providers import ReplyProvider, TableReplies
from .sources import annotations
from .sources.images import encoded
from .sources.journal import Journal
from .sources.shared import materialized


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="quillgraph")
    commands = made.add_subparsers(dest="command", required=True)
    g = commands.add_parser("generate", help="questions from a folder of annotations")
    g.add_argument("--input", required=True)
    g.add_argument("--output", required=True)
    g.add_argument("--types", nargs="*", help="question types; all but the one on conflicts unless named")
    g.add_argument("--max-per-type", type=int, default=1)
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--unanswerable", type=float, default=0.5)
    g.add_argument("--split", nargs=3, type=float, metavar=("TRAIN", "VAL", "TEST"))
    e = commands.add_parser("evaluate", help="metrics of replies to questions")
    e.add_argument("--questions", required=True)
    e.add_argument("--replies", help="JSON lines with key, raw_output and token counts, of predictions and of judgements")
    e.add_argument("--provider", help="module:Class of a CallingProvider that serves the models")
    e.add_argument("--judge-provider", help="module:Class of a CallingProvider that judges")
    e.add_argument("--judge-model", default="gpt-4o-mini")
    e.add_argument("--cache", help="a folder of JSON lines of earlier runs, to which new replies are added")
    e.add_argument("--images", help="a folder with the images that questions name")
    e.add_argument("--workers", type=int, default=1, help="calls in flight in each task")
    e.add_argument("--rate", type=float, help="calls a second of all tasks together")
    e.add_argument("--models", nargs="+", required=True)
    e.add_argument("--output", required=True)
    e.add_argument("--limit", type=int)
    return made


def generate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Writes questions/split=... and manifest; returns the counts by split."""
    g = annotations.read_annotations(spark, args.input)
    split = tuple(args.split) if args.split else None
    made = materialized(questions.dataset(g, args.types or None, split, args.seed, args.unanswerable, args.max_per_type))
    annotations.write_dataset(made, f"{args.output}/questions")
    counts = made.groupBy("split", "level", "question_type", "answer_type").agg(F.count("*").alias("n"))
    config = {
        "types": args.types or "default", "max_per_type": args.max_per_type, "seed": args.seed,
        "unanswerable": args.unanswerable, "split": args.split or "none",
    }
    annotations.write_manifest(counts, config, f"{args.output}/manifest")
    return counts


def loaded(name: str, args: argparse.Namespace) -> ReplyProvider:
    """The provider module:Class, with the calls in flight, the rate and the cache folder that the arguments name."""
    module, _, kind = name.partition(":")
    journal = Journal(args.cache) if args.cache else None
    return getattr(importlib.import_module(module), kind)(window=args.workers, rate=args.rate, journal=journal)


def evaluate(spark: SparkSession, args: argparse.Namespace, provider: ReplyProvider | None = None, judge: ReplyProvider | None = None) -> DataFrame:
    """Writes results and metrics; returns the metrics. Without a provider replies come from the file of them."""
    q = annotations.read_questions(spark, args.questions, args.limit, lines=True)
    if provider is None and args.provider:
        provider = loaded(args.provider, args)
    if judge is None and args.judge_provider:
        judge = loaded(args.judge_provider, args)
    if provider is None:
        if not args.replies:
            raise SystemExit("one of --replies and --provider is needed")
        provider = TableReplies(spark.read.schema("key string, raw_output string, prompt_tokens long, completion_tokens long").json(args.replies))
        judge = judge or provider
    cache = annotations.read_cache(spark, args.cache) if args.cache and annotations.exists(spark, args.cache) else spark.createDataFrame([], "key string, value string")
    images = encoded(annotations.question_images(spark, args.images)) if args.images else None
    made = evaluation.evaluate(evaluation.asked(q, args.models), cache, provider, judge=judge, judge_model=args.judge_model, images=images, cache_path=args.cache)
    scored = materialized(made)
    scored.write.mode("overwrite").json(f"{args.output}/results")
    metrics = evaluation.report(scored)
    metrics.write.mode("overwrite").json(f"{args.output}/metrics")
    return metrics


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillgraph").getOrCreate()
    shown = generate(spark, args) if args.command == "generate" else evaluate(spark, args)
    shown.show(200, truncate=False)


if __name__ == "__main__":
    main()
