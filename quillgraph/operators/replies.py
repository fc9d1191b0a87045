"""Free-text replies: prompts, a parsing cascade (abstention, patterns, option text, judge), scores, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import reply_norm
from ..sources.annotations import json_string

# The patterns of the cascade.
ABSTAIN = (
    r"(?i)cannot be determined|can'?t be determined|cannot determine|(?:does|do)\s*not\s*(?:directly\s*)?(?:point|lead|connect|map)\s*to\s*any|"
    r"none of the (?:above|options|listed|choices|modules|given|four)|no module is (?:visually )?enclosed|nothing is (?:visually )?enclosed|"
    r"is a standalone (?:module|box|node|component)|none (?:of these )?(?:fit|apply|are correct)|"
    r"no (?:such )?(?:arrow|module|connection|edge|option|stage) (?:exists|is present|is shown|is enclosed)"
)
STATED = r"(?i)(?:correct\s+)?(?:answer|option|choice)\s*(?:is|are|:|=|would\s+be)\s*\(?\*{0,2}([ABCD])\b"
LONE = r"(?iU)^\W*([ABCD])\W*$"
MARKED = r"(?<![A-Za-z])([ABCD])(?:\)|\*\*|[.\]:])"
ANCHOR = r"(?i)(?:correct|right|final|selected)\s+(?:options?|answers?|choices?|modules?)\s*(?:are|is|:|=)|(?:the\s+)?answers?\s*(?:are|is|:|=)"
NEGATION = r"(?i)\b(?:not|no|never|isn'?t|aren'?t|does\s*not|doesn'?t|don'?t|cannot|can'?t|outside|rather\s+than|instead\s+of|exclud)"
NEGATION_FIXED = r"(?i)\b(?:(?:not|no|never|isn'?t|isn t|aren'?t|aren t|does\s*not|doesn'?t|doesn t|don'?t|don t|cannot|can'?t|can t|outside|rather\s+than|instead\s+of)\b|exclud)"
ACTIONS = ("selected", "abstained", "invalid")
TAIL, BEFORE = 90, 40
#: 1 / (|P| + |G|) is a whole number of 1 / 27720 for up to 12 letters together, so F1 sums are exact.
UNITS = 27720


def prompts(questions: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit(". "), o["text"])), "\n")
    head = F.concat(F.lit("Question: "), "question")
    return questions.withColumn("prompt", F.when(F.col("answer_type") == "open", head).otherwise(F.concat(head, F.lit("\n\nOptions:\n"), lines)))


def sample_id(image: Column, idx: Column, kind: Column, question: Column, options: Column, answer: Column, answer_type: Column) -> Column:
    """Key of a question: image::idx::type::md5 of a JSON text of answer, options and question.

    The text has a blank after colons and commas; an answer that is no list of several is one string.
    """
    listed = lambda items: F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    answers = F.when(answer_type == "multi_select", listed(F.transform(answer, json_string))).otherwise(json_string(F.get(answer, F.lit(0))))
    pairs = listed(
        F.transform(
            F.coalesce(options, F.array().cast("array<struct<label:string,text:string>>")),
            lambda o: listed(F.array(json_string(o["label"]), json_string(o["text"]))),
        )
    )
    body = F.concat(F.lit('{"ans": '), answers, F.lit(', "opts": '), pairs, F.lit(', "q": '), json_string(question), F.lit("}"))
    return F.concat_ws("::", image, idx.cast("string"), kind, F.substring(F.md5(body.cast("binary")), 1, 8))


def abstains(raw: Column) -> Column:
    return F.coalesce(raw.rlike(ABSTAIN), F.lit(False))


def stated_letter(raw: Column) -> Column:
    """The last stated letter; or the whole reply; or the only letter marked as an option."""
    t = F.trim(raw)
    stated = F.upper(F.try_element_at(F.regexp_extract_all(t, F.lit(STATED), 1), F.lit(-1)))
    lone = F.upper(F.nullif(F.regexp_extract(t, LONE, 1), F.lit("")))
    marked = F.array_distinct(F.regexp_extract_all(t, F.lit(MARKED), 1))
    return F.coalesce(stated, lone, F.when(F.size(marked) == 1, F.get(marked, F.lit(0))))


def stated_letters(raw: Column, compat: bool = True) -> Column:
    """Letters of the last anchor that only letters follow, up to the end of the sentence; null if there is none.

    compat keeps an old rule by which the word `and` itself counts as the letters A and D.
    """
    parts = F.split(F.regexp_replace(raw, ANCHOR, "\u0001"), "\u0001", -1)
    n = F.size(parts)

    def letters(part: Column, i: Column) -> Column:
        tail = F.split(F.substring(part, 1, TAIL), r"[.\n;]", -1)
        ends = (F.size(tail) > 1) | (F.length(part) >= TAIL) | (i == n - 1)  # else the next anchor is in the tail
        first = F.get(tail, F.lit(0))
        clean = F.trim(F.regexp_replace(first, r"(?i)and|&|[ABCDEF,\s()*]", "")) == ""
        text = first if compat else F.regexp_replace(first, "(?i)and", " ")
        return F.when((i > 0) & ends & clean, F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit("([ABCDEF])"), 1)))

    found = F.filter(F.transform(parts, letters), lambda x: x.isNotNull() & (F.size(x) > 0))
    return F.try_element_at(found, F.lit(-1))


def option_hit(raw: Column, options: Column, compat: bool = True) -> Column:
    """Label of the only option whose text occurs without a negation shortly before."""
    nr = reply_norm(raw)
    negation = NEGATION if compat else NEGATION_FIXED

    def hit(o: Column) -> Column:
        text = reply_norm(o["text"])
        at = F.instr(nr, text) - 1
        start = F.greatest(F.lit(0), at - BEFORE)
        before = nr.substr(start + 1, at - start)
        return F.when((F.length(text) >= 3) & (at >= 0) & ~F.coalesce(before.rlike(negation), F.lit(False)), o["label"])

    hits = F.filter(F.transform(options, hit), lambda x: x.isNotNull())
    return F.when((F.size(hits) == 1) & (raw != ""), F.get(hits, F.lit(0)))


def judged(reply: Column, multi: bool) -> Column:
    """struct<action, letter, letters> of a judge's reply; anything unreadable is invalid."""
    obj = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    action = F.get_json_object(obj, "$.action")
    action = F.coalesce(F.when(action.isin(*ACTIONS), action), F.lit("invalid"))
    if not multi:
        return F.struct(
            action.alias("action"), F.when(action == "selected", F.get_json_object(obj, "$.letter")).alias("letter"),
            F.lit(None).cast("array<string>").alias("letters"),
        )
    said = F.from_json(F.get_json_object(obj, "$.letters"), "array<string>")
    letters = F.array_distinct(F.filter(F.transform(F.coalesce(said, F.array().cast("array<string>")), F.upper), lambda x: F.contains(F.lit("ABCDEF"), x)))
    action = F.when((action == "selected") & (F.size(letters) == 0), "invalid").otherwise(action)
    return F.struct(action.alias("action"), F.lit(None).cast("string").alias("letter"), F.when(action == "selected", letters).alias("letters"))


def parse(replies: DataFrame, compat: bool = True) -> DataFrame:
    """replies (answer_type, raw_output, options, judge_reply) with parse_action, parse_letters, parse_stage.

    Only what no rule resolves falls to the judge. Open replies are not parsed.
    """
    raw, multi = F.coalesce("raw_output", F.lit("")), F.col("answer_type") == "multi_select"
    one = F.coalesce(F.array(stated_letter(raw)), F.array(F.lit(None).cast("string")))
    text = F.array(option_hit(raw, F.col("options"), compat))
    many = stated_letters(raw, compat)
    x = replies.withColumn("_abstains", abstains(raw))
    x = x.withColumn(
        "_regex", F.when(multi, many).when(F.get(one, F.lit(0)).isNotNull(), one),
    ).withColumn("_text", F.when(~multi & F.get(text, F.lit(0)).isNotNull(), text))
    x = x.withColumn("_judge", F.when(multi, judged(F.col("judge_reply"), True)).otherwise(judged(F.col("judge_reply"), False)))
    stage = F.when(F.col("_abstains"), "abstain_rule").when(F.col("_regex").isNotNull(), "regex").when(F.col("_text").isNotNull(), "substring").otherwise("judge")
    x = x.withColumn("parse_stage", stage)
    by_judge = F.when(multi, F.col("_judge.letters")).when(F.col("_judge.letter").isNotNull(), F.array("_judge.letter"))
    action = F.when(F.col("parse_stage") == "abstain_rule", "abstained").when(F.col("parse_stage") == "judge", F.col("_judge.action")).otherwise("selected")
    letters = F.when(F.col("parse_stage") == "regex", F.col("_regex")).when(F.col("parse_stage") == "substring", F.col("_text")).when(F.col("parse_stage") == "judge", by_judge)
    closed = F.col("answer_type") != "open"
    x = x.withColumns({"parse_action": F.when(closed, action), "parse_letters": F.when(closed, letters), "parse_stage": F.when(closed, F.col("parse_stage"))})
    return x.drop("_abstains", "_regex", "_text", "_judge")


def score(parsed: DataFrame) -> DataFrame:
    """parsed with correct (0 or 1; null if open) and f1_units (of UNITS; null unless several may be right)."""
    action, multi = F.col("parse_action"), F.col("answer_type") == "multi_select"
    said, gold = F.array_distinct(F.coalesce("parse_letters", F.array().cast("array<string>"))), F.array_distinct("gold")
    same = F.array_sort(said) == F.array_sort(gold)
    single = F.when(action == "abstained", F.col("is_unanswerable").cast("int")).when(action == "invalid", 0).otherwise((~F.col("is_unanswerable") & same).cast("int"))
    exact = ((action == "selected") & same).cast("int")
    hits, both = F.size(F.array_intersect(said, gold)), F.size(said) + F.size(gold)
    units = F.when((action == "selected") & (hits > 0), F.floor(hits * 2 * UNITS / both)).otherwise(0).cast("long")
    closed = F.col("answer_type") != "open"
    return parsed.withColumns({"correct": F.when(closed, F.when(multi, exact).otherwise(single)).cast("long"), "f1_units": F.when(multi, units)})


def units() -> Column:
    """Score of a row that counts for levels and types, in UNITS; null if it counts for none."""
    j = F.col("open_judge")
    opened = F.when(j.isNotNull(), ((j["coverage"] + j["correctness"] + j["hallucination"]) * (UNITS // 6)).cast("long"))
    closed = F.when(F.col("parse_action") == "invalid", 0).otherwise(F.coalesce("f1_units", F.col("correct") * UNITS)).cast("long")
    return F.when(F.col("error").isNull(), F.when(F.col("answer_type") == "open", opened).otherwise(closed))


def _rate(x: Column) -> Column:
    """Mean of the rows that x is not null for; null if there are none. Sums are of whole numbers."""
    return F.sum(x) / F.count(x)


def metrics_by_model(scored: DataFrame) -> DataFrame:
    x = scored.withColumn("u", units())
    fine = F.col("error").isNull()
    closed, valid = fine & (F.col("answer_type") != "open"), F.col("parse_action") != "invalid"
    yes = lambda c: c.cast("long")
    abstained = F.col("parse_action") == "abstained"
    answerable, not_ = closed & valid & ~F.col("is_unanswerable"), closed & valid & F.col("is_unanswerable")
    return x.groupBy("model").agg(
        F.count("*").alias("n"),
        (_rate(F.when(answerable, F.when(abstained, 0).otherwise(F.col("u")))) / UNITS).alias("answerable_correct_rate"),
        _rate(F.when(answerable, yes(abstained))).alias("answerable_false_abstain_rate"),
        _rate(F.when(not_, yes(abstained))).alias("unanswerable_correct_abstain_rate"),
        _rate(F.when(not_, yes(~abstained))).alias("unanswerable_hallucination_rate"),
        _rate(F.when(~fine, F.lit(1)).when(closed, yes(~valid))).alias("invalid_response_rate"),
        (_rate(F.when(closed & valid & (F.col("answer_type") == "multi_select"), F.col("f1_units"))) / UNITS).alias("multihop_f1"),
        (_rate(F.when(fine & (F.col("answer_type") == "open"), F.col("u"))) / UNITS).alias("l3_open_score"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
    )


def token_usage(replies: DataFrame) -> DataFrame:
    """Tokens by model, of every reply that has a count, failed ones too."""
    both = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")]
    return replies.groupBy("model").agg(F.count_if(F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull()).alias("counted"), *both)


def metrics_by(scored: DataFrame, column: str) -> DataFrame:
    """model, column, n, units (their mean over UNITS is the score)."""
    x = scored.withColumn("u", units()).filter("u is not null")
    return x.groupBy("model", column).agg(F.count("*").alias("n"), F.sum("u").alias("units"))


def stage_counts(scored: DataFrame) -> DataFrame:
    x = scored.filter(F.col("error").isNull() & F.col("parse_stage").isNotNull())
    return x.groupBy("model", "parse_stage").agg(F.count("*").alias("n"))


def metrics_document(scored: DataFrame) -> DataFrame:
    """One nested row per model, rates rounded to four places, as a metrics file has it."""
    rates = metrics_by_model(scored)
    kinds = {f.name: f.dataType.typeName() for f in rates.schema.fields}
    rates = rates.select("model", *[F.round(c, 4).alias(c) if kinds[c] == "double" else F.col(c) for c in rates.columns if c not in ("model", "n")])
    for name, column in (("by_level", "level"), ("by_qtype", "question_type")):
        part = metrics_by(scored, column).groupBy("model").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, F.round(F.col("units") / F.col("n") / UNITS, 4).alias("v"))))).alias(name)
        )
        rates = rates.join(part, "model", "left")
    stages = stage_counts(scored).groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("parse_stage", "n"))).alias("parse_stage_counts"))
    return rates.join(stages, "model", "left")
