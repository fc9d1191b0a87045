"""From questions to scored replies, in three passes: what the cache lacks is asked for, replies that no rule resolves
go to a judge, and so do replies to open questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.annotations import append_cache
from ..sources.shared import materialized
from .providers import ReplyProvider, with_images
from .replies import metrics_document, parse, prompts, sample_id, score

#: Kinds of keys, and whether what failed is asked again in a later run.
PREDICTION, PARSED, OPEN = "pred", "parse2", "open_judge"
ASKED_AGAIN = {PREDICTION: True, PARSED: False, OPEN: False}
MARKS = ("coverage", "correctness", "hallucination")

SYSTEM = "You answer questions about a diagram. Rely only on what the picture shows, and say so if it does not show the answer."
PARSE_SYSTEM = "You read an answer to a multiple-choice question and report which option it settles on. You do not answer the question yourself. Reply with one JSON object and nothing else."
PARSE_ONE = '{"action": "selected" | "abstained" | "invalid", "letter": "A" | "B" | "C" | "D" | null}'
PARSE_SEVERAL = '{"action": "selected" | "abstained" | "invalid", "letters": ["A", ...]}'
PARSE_NOTE = "abstained: it says that the question cannot be answered from the diagram. invalid: no option can be told."
OPEN_SYSTEM = "You grade a description of a diagram against a reference. Reply with one JSON object and nothing else."
OPEN_NOTE = (
    "Give whole numbers from 0 to 2. coverage: how much of the reference is there. correctness: how much of what it says is right. "
    'hallucination: 2 if it invents nothing, 0 if it invents much.\n{"coverage": n, "correctness": n, "hallucination": n}'
)

_CACHED = (
    "raw_output string, error string, prompt_tokens bigint, completion_tokens bigint, usage struct<prompt_tokens:bigint,completion_tokens:bigint>, action string, letter string, "
    "letters array<string>, stage string, judge struct<coverage:bigint,correctness:bigint,hallucination:bigint>, raw string"
)


def key(kind: str = PREDICTION) -> Column:
    """Key of a question put to a model: kind::model::image::position::type::digest."""
    sample = sample_id(F.col("image_id"), F.col("idx"), F.col("question_type"), F.col("question"), F.col("options"), F.col("gold"), F.col("answer_type"))
    return F.concat_ws("::", F.lit(kind), F.col("model"), sample)


def asked(questions: DataFrame, models: list[str]) -> DataFrame:
    """Questions as files have them (read_questions), put to every model: the input of evaluate()."""
    several = F.col("answer_type") == "multi_select"
    gold = F.when(several, F.from_json("answer", "array<string>")).otherwise(F.array("answer"))
    unanswerable = F.coalesce(F.get_json_object("metadata", "$.is_unanswerable").cast("boolean"), F.coalesce(F.size("correct_option_indices"), F.lit(-1)) == 0)
    return questions.select(
        F.coalesce("image_id", F.lit("unk")).alias("image_id"), "idx", "level", "question_type", "question", "answer_type", unanswerable.alias("is_unanswerable"), gold.alias("gold"), "options",
        F.col("answer_text").alias("reference"), F.explode(F.array(*map(F.lit, models))).alias("model"),
    )


def _known(cache: DataFrame, kind: str) -> DataFrame:
    """key and the fields of the cached lines of one kind; counts of tokens stand by themselves or under usage."""
    v = cache.filter(F.col("key").startswith(f"{kind}::")).select("key", F.from_json("value", _CACHED).alias("v")).select("key", "v.*")
    return v.withColumns({c: F.coalesce(c, f"usage.{c}") for c in ("prompt_tokens", "completion_tokens")}).drop("usage")


def answered(work: DataFrame, cache: DataFrame, kind: str, provider: ReplyProvider | None, path: str | None = None, images: DataFrame | None = None) -> DataFrame:
    """The cached fields of every key of work (key, model, prompt, system), new ones among them; a pass of its own.

    Only what the cache lacks is asked for, and what it has with an error where the kind's policy says so. What is new
    is written once, before anything reads it, so nothing is asked twice; a provider with a journal has it in the cache
    by then, for another provider it is added there (path).
    """
    known = _known(cache, kind)
    if provider is None:
        return known
    done = known.filter(F.col("error").isNull()) if ASKED_AGAIN[kind] else known
    missing = work.join(done.select("key"), "key", "left_anti")
    new = materialized(provider.replies(with_images(missing, images) if images is not None else missing))
    if path and not provider.journal:
        append_cache(new, path)
    old = done.join(work.select("key"), "key", "left_semi")
    return old.unionByName(new.select("key", "raw_output", "error", "prompt_tokens", "completion_tokens"), allowMissingColumns=True)


def _options() -> Column:
    return F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit(". "), o["text"])), "\n")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _parse_work(open_: DataFrame, judge_model: str) -> DataFrame:
    form = F.when(F.col("answer_type") == "multi_select", PARSE_SEVERAL).otherwise(PARSE_ONE)
    prompt = _text("Question: ", F.col("question"), "\n\nOptions:\n", _options(), "\n\nAnswer:\n", F.coalesce("raw_output", F.lit("")), "\n\n", PARSE_NOTE, "\n", form)
    return open_.select(key(PARSED).alias("key"), F.lit(judge_model).alias("model"), F.lit(PARSE_SYSTEM).alias("system"), prompt.alias("prompt"))


def _open_work(open_: DataFrame, judge_model: str) -> DataFrame:
    prompt = _text("Reference:\n", F.coalesce("reference", F.lit("")), "\n\nDescription:\n", F.coalesce("raw_output", F.lit("")), "\n\n", OPEN_NOTE)
    return open_.select(key(OPEN).alias("key"), F.lit(judge_model).alias("model"), F.lit(OPEN_SYSTEM).alias("system"), prompt.alias("prompt"))


def _marks(reply: Column) -> Column:
    """The marks in a judge's reply: whole numbers, 0 where one is missing; null if there is no JSON object in it."""
    obj = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    fields = F.from_json(obj, "map<string,string>")
    marks = [F.coalesce(F.get_json_object(obj, f"$.{m}").cast("double").cast("long"), F.lit(0)).alias(m) for m in MARKS]
    return F.when(F.size(F.map_keys(fields)) > 0, F.struct(*marks))


def evaluate(
    questions: DataFrame, cache: DataFrame, provider: ReplyProvider, compat: bool = True, judge: ReplyProvider | None = None, judge_model: str = "gpt-4o-mini",
    images: DataFrame | None = None, cache_path: str | None = None,
) -> DataFrame:
    """questions (image_id, idx, model, level, question_type, question, answer_type, is_unanswerable, gold, options;
    reference for open ones) with replies, parsed and scored.

    cache has key and value (JSON lines, see read_cache), of all three kinds of keys. A failed prediction is an error
    of its row and is asked for again in the next run; a failed judgement is invalid, or no score, and stays so.
    Without a judge, what no rule resolves is invalid unless the cache has a judgement. images (image_id, image, mime)
    go with the questions on them. With cache_path, replies of providers that keep no journal are added to it.
    """
    work = prompts(questions.withColumn("key", key()))
    wanted = work.select("key", "model", F.lit(SYSTEM).alias("system"), "prompt", "image_id")
    found = answered(wanted, cache, PREDICTION, provider, cache_path, images).select("key", "raw_output", "error", "prompt_tokens", "completion_tokens")
    said = work.join(found, "key", "left").withColumn("judge_reply", F.lit(None).cast("string"))
    said = materialized(parse(said, compat))
    fine = F.col("error").isNull() & F.col("raw_output").isNotNull()

    unclear = said.filter(fine & (F.col("parse_stage") == "judge"))
    parsed = answered(_parse_work(unclear, judge_model), cache, PARSED, judge, cache_path)
    form = F.when(F.col("letters").isNotNull(), F.to_json(F.struct("action", "letters"))).otherwise(F.to_json(F.struct("action", "letter")))
    reply = F.when(F.col("action").isNotNull(), form).otherwise(F.col("raw_output"))
    parsed = parsed.select(F.col("key").alias("parse_key"), reply.alias("judge_reply"), F.col("action").alias("_action"), F.col("letter").alias("_letter"), F.col("letters").alias("_letters"), F.col("stage").alias("_stage"))
    said = said.drop("judge_reply", "parse_action", "parse_letters", "parse_stage").join(parsed, key(PARSED) == F.col("parse_key"), "left").drop("parse_key")
    said = _as_cached(parse(said, compat))

    opened = said.filter(fine & (F.col("answer_type") == "open"))
    judged = answered(_open_work(opened, judge_model), cache, OPEN, judge, cache_path)
    judged = judged.select(F.col("key").alias("open_key"), F.coalesce("judge", _marks(F.coalesce("raw_output", "raw"))).alias("open_judge"))
    said = said.join(judged, key(OPEN) == F.col("open_key"), "left").drop("open_key")
    return score(said.withColumn("open_judge", F.when(fine & (F.col("answer_type") == "open"), F.col("open_judge"))))


def _as_cached(parsed: DataFrame) -> DataFrame:
    """Parsed rows with what the cache says of them in place of the rules' result, where it has a result."""
    told = F.col("_action").isNotNull() & (F.col("answer_type") != "open")
    letters = F.coalesce("_letters", F.when(F.col("_letter").isNotNull(), F.array("_letter")))
    x = parsed.withColumns({
        "parse_action": F.when(told, F.col("_action")).otherwise(F.col("parse_action")), "parse_letters": F.when(told, letters).otherwise(F.col("parse_letters")),
        "parse_stage": F.when(told, F.coalesce("_stage", F.lit("cache"))).otherwise(F.col("parse_stage")),
    })
    return x.drop("_action", "_letter", "_letters", "_stage")


def report(scored: DataFrame) -> DataFrame:
    """One nested row of metrics for each model."""
    return metrics_document(scored)
