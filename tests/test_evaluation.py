"""Three passes over models and judge: what is called when, what the cache keeps, calls in parallel."""

import json
import os
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import evaluate
from quillgraph.operators.providers import Bucket, CallingProvider, Reply, Request, Rules, TableReplies, waits, with_images
from quillgraph.sources import annotations
from quillgraph.sources.journal import Journal

QUESTION = "image_id string, idx long, model string, level string, question_type string, question string, answer_type string, is_unanswerable boolean, gold array<string>, options array<struct<label:string,text:string>>, reference string"
OPTIONS = [("A", "amber gate"), ("B", "blue lock"), ("C", "coal yard"), ("D", "dry dock")]


def logged():
    """A provider that notes each call in a file of its own."""

    class Logged(CallingProvider):
        def __init__(self, folder, answer, **options):
            super().__init__(retries=3, base=0.001, **options)
            self.folder, self.answer = str(folder), answer

        def call(self, request):
            path = pathlib.Path(self.folder) / f"{time.time_ns()}-{os.getpid()}-{request.key.replace('/', '_').replace(':', '-')}"
            path.write_text(json.dumps({"key": request.key, "model": request.model, "system": request.system, "prompt": request.prompt, "image": None if request.image is None else len(request.image), "mime": request.mime}))
            return Reply(self.answer(request), 3, 4)

    return Logged


def calls(folder):
    return [json.loads(f.read_text()) for f in sorted(pathlib.Path(folder).iterdir())]


def asked(spark, n=8):
    """Of each image a question that rules read, one that they do not, one of several choices and an open one."""
    rows = []
    for k in range(n):
        rows += [
            (f"i{k}.png", 4 * k, "m", "L1", "t", f"plain {k}", "single_choice", False, ["A"], OPTIONS, None),
            (f"i{k}.png", 4 * k + 1, "m", "L1", "t", f"vague {k}", "single_choice", False, ["B"], OPTIONS, None),
            (f"i{k}.png", 4 * k + 2, "m", "L2", "t", f"vague several {k}", "multi_select", False, ["A", "B"], OPTIONS, None),
            (f"i{k}.png", 4 * k + 3, "m", "L3", "t", f"open {k}", "open", False, ["x"], [], "It moves water."),
        ]
    return spark.createDataFrame(rows, QUESTION)


def answers():
    """What the model says, and the judge; made here so that they travel with the provider."""

    def model_says(request):
        if "plain 3" in request.prompt:
            raise ValueError("never")
        return "The answer is A." if "plain" in request.prompt else "Something about pipes."

    def judge_says(request):
        if "vague 2" in request.prompt:
            raise ValueError("judge is out")
        if request.key.startswith("open"):
            return 'Well: {"coverage": 2, "correctness": "1", "note": "x"}'
        return '{"action": "selected", "letters": ["A", "b", "Z"]}' if "several" in request.prompt else 'so {"action": "selected", "letter": "B"}'

    return model_says, judge_says


def test_three_passes_over_two_runs(spark, tmp_path):
    q, cache = asked(spark), str(tmp_path / "cache")
    kinds = []
    for run in range(2):
        said, judged = tmp_path / f"said{run}", tmp_path / f"judged{run}"
        said.mkdir(), judged.mkdir()
        provider, judge = (logged()(d, f, journal=Journal(cache, every=2), window=3, tasks=2) for d, f in zip((said, judged), answers(), strict=True))
        known = annotations.read_cache(spark, cache) if run else spark.createDataFrame([], "key string, value string")
        rows = {(r["image_id"], r["question"]): r for r in evaluate.evaluate(q, known, provider, judge=judge, judge_model="j").collect()}
        kinds.append(sorted([c["key"].split("::")[0] for c in calls(said)] + [c["key"].split("::")[0] for c in calls(judged)]))
        assert len(rows) == 32
        assert rows["i3.png", "plain 3"]["error"].startswith("ValueError") and rows["i3.png", "plain 3"]["open_judge"] is None
        assert (rows["i1.png", "plain 1"]["parse_stage"], rows["i1.png", "plain 1"]["correct"]) == ("regex", 1)
        assert (rows["i1.png", "vague 1"]["parse_stage"], rows["i1.png", "vague 1"]["parse_letters"], rows["i1.png", "vague 1"]["correct"]) == ("judge", ["B"], 1)
        assert (rows["i2.png", "vague 2"]["parse_action"], rows["i2.png", "vague 2"]["correct"]) == ("invalid", 0)
        assert rows["i4.png", "vague several 4"]["parse_letters"] == ["A", "B"] and rows["i4.png", "vague several 4"]["correct"] == 1
        assert tuple(rows["i5.png", "open 5"]["open_judge"]) == (2, 1, 0) and rows["i5.png", "open 5"]["parse_stage"] is None
    # all 32 predictions; a judgement of all 16 vague ones and of all 8 open ones
    assert kinds[0] == ["open_judge"] * 8 + ["parse2"] * 16 + ["pred"] * 32
    # the failed prediction is asked again, the failed judgement is not
    assert kinds[1] == ["pred"]


def test_caches_of_published_form(spark):
    """Lines with usage, parsed letters and judgements, keyed by image, position, type and digest."""
    q = asked(spark, 1)
    keys = {r["question"]: r["k"] for r in q.select("question", evaluate.key("K").alias("k")).collect()}
    assert keys["plain 0"].startswith("K::m::i0.png::0::t::") and len(keys["plain 0"].rsplit("::", 1)[1]) == 8
    lines = [{"key": k.replace("K", "pred", 1), "raw_output": "Hm.", "usage": {"prompt_tokens": 7, "completion_tokens": 1}} for k in keys.values()]
    lines += [{"key": keys["plain 0"].replace("K", "parse2", 1), "action": "selected", "letter": "A", "stage": "judge"}]
    lines += [{"key": keys["vague several 0"].replace("K", "parse2", 1), "action": "selected", "letters": ["A", "B"], "stage": "regex"}]
    lines += [{"key": keys["open 0"].replace("K", "open_judge", 1), "judge": {"coverage": 2, "correctness": 2, "hallucination": 1}, "raw": "{}"}]
    cache = spark.createDataFrame([(x["key"], json.dumps(x)) for x in lines], "key string, value string")
    none = TableReplies(spark.createDataFrame([], "key string, raw_output string"))
    rows = {r["question"]: r for r in evaluate.evaluate(q, cache, none).collect()}
    assert {r["prompt_tokens"] for r in rows.values()} == {7} and all(r["error"] is None for r in rows.values())
    assert (rows["plain 0"]["correct"], rows["plain 0"]["parse_stage"]) == (1, "judge")
    assert (rows["vague several 0"]["correct"], rows["vague several 0"]["parse_stage"]) == (1, "regex")
    assert rows["vague 0"]["parse_action"] == "invalid" and tuple(rows["open 0"]["open_judge"]) == (2, 2, 1)


def test_a_run_that_is_killed_asks_only_for_the_rest(spark, tmp_path):
    q, cache, first, second = asked(spark, 10).filter("question like 'plain%' and idx <> 12"), str(tmp_path / "cache"), tmp_path / "a", tmp_path / "b"
    first.mkdir(), second.mkdir()

    folder = str(first)

    def dies(request):
        if len(os.listdir(folder)) > 4:
            raise SystemExit("killed")
        return "The answer is A."

    with pytest.raises(Exception, match="killed"):
        evaluate.evaluate(q, spark.createDataFrame([], "key string, value string"), logged()(first, dies, journal=Journal(cache, every=1), tasks=1))
    held = {r["key"] for r in annotations.read_cache(spark, cache).collect()}
    assert len(held) == 4
    provider = logged()(second, answers()[0], journal=Journal(cache, every=1), tasks=1)
    rows = evaluate.evaluate(q, annotations.read_cache(spark, cache), provider).collect()
    assert {r["correct"] for r in rows} == {1} and len(rows) == 9
    again = {c["key"] for c in calls(second)}
    assert len(again) == 5 and not again & held


def test_a_later_attempt_of_a_task_goes_on(tmp_path):
    journal = Journal(str(tmp_path), every=2)
    lines = journal.of_range("k0", 1)
    for k in range(5):
        lines.add({"key": f"k{k}", "raw_output": "x", "error": "no" if k == 3 else None})
    seen = journal.of_range("k0", 2).earlier()
    assert set(seen) == {"k0", "k1", "k2"} and journal.of_range("k9", 1).earlier() == {}
    lines.commit()
    assert set(journal.of_range("k0", 2).earlier()) == {"k0", "k1", "k2", "k4"}
    assert seen["k0"] == {"key": "k0", "raw_output": "x", "error": None}
    assert not [f for f in tmp_path.rglob("*") if f.name.startswith("_")]


def test_replies_of_tables_are_added_to_the_cache(spark, tmp_path):
    q, cache = asked(spark, 2).filter("question like 'plain%'"), str(tmp_path / "cache")
    said = TableReplies(q.select(evaluate.key().alias("key"), F.lit("The answer is A.").alias("raw_output")))
    evaluate.evaluate(q, spark.createDataFrame([], "key string, value string"), said, cache_path=cache).collect()
    none = TableReplies(spark.createDataFrame([], "key string, raw_output string"))
    rows = evaluate.evaluate(q, annotations.read_cache(spark, cache), none).collect()
    assert [r["correct"] for r in rows] == [1, 1]


def test_images_go_with_their_questions(spark, tmp_path):
    (tmp_path / "calls").mkdir(), (tmp_path / "images").mkdir()
    for k in range(5):
        (tmp_path / "images" / f"i{k}.png").write_bytes(b"\x89PNG" + bytes(k))
    images = annotations.question_images(spark, str(tmp_path / "images"))
    q = asked(spark, 4)
    work = q.select(evaluate.key().alias("key"), "image_id")
    assert with_images(work, images).filter("key is null").count() == 4
    provider = logged()(tmp_path / "calls", lambda r: "The answer is A.", window=4, tasks=3)
    evaluate.evaluate(q, spark.createDataFrame([], "key string, value string"), provider, images=images)
    made = calls(tmp_path / "calls")
    assert len(made) == 16 and all(c["image"] == 4 + int(c["key"].split("::")[2][1]) and c["mime"] == "image/png" and c["system"] for c in made)


def test_calls_run_in_parallel(spark):
    class Slow(CallingProvider):
        def call(self, request):
            time.sleep(0.25)
            if request.key == "7":
                raise ValueError("bad")
            return Reply(request.prompt.upper())

    work = spark.createDataFrame([(str(k), "m", f"p{k}") for k in range(48)], "key string, model string, prompt string")
    took = []
    for window in (1, 12):
        began = time.time()
        got = {r["key"]: r for r in Slow(window=window, tasks=2).replies(work).collect()}
        took.append(time.time() - began)
        assert len(got) == 48 and got["5"]["raw_output"] == "P5" and got["7"]["error"] == "ValueError: bad" and sum(r["error"] is not None for r in got.values()) == 1
    assert took[0] > 6 and took[1] < took[0] / 2


def test_rate(spark):
    class Quick(CallingProvider):
        def call(self, request):
            return Reply("x")

    work = spark.createDataFrame([(str(k), "m", "p") for k in range(30)], "key string, model string, prompt string")
    began = time.time()
    assert Quick(window=8, tasks=1, rate=10.0).replies(work).count() == 30
    assert time.time() - began > 2.8
    bucket, began = Bucket(50.0, most=5), time.monotonic()
    for _ in range(15):
        bucket.take()
    assert 0.15 < time.monotonic() - began < 2


def test_waits_and_rules():
    made = waits("k", 6, 4.0)
    assert made == waits("k", 6, 4.0) != waits("other", 6, 4.0)
    assert all(min(60, 4 * 2**k) * 0.7 <= w <= min(60, 4 * 2**k) * 1.3 for k, w in enumerate(made)) and len(made) == 6

    class RateLimited(Exception):
        pass

    class Odd(RateLimited):
        pass

    def of(**fields):
        error = Exception("x")
        error.__dict__.update(fields)
        return error

    plain = Rules()
    assert [plain.passes(e) for e in (TimeoutError(), Odd(), RateLimited(), ValueError(), of(status_code=503), of(response=of(status_code=429)), of(status_code=404), of(code="503"))] == [True, True, True, False, True, True, False, False]
    assert Rules(("ratelimited",), (404,)).passes(Odd()) and Rules(statuses=(404,)).passes(of(status=404))


def test_calls_are_tried_again(spark, tmp_path):
    class Flaky(CallingProvider):
        """Fails twice for one prompt, always and for good for another."""

        def __init__(self, folder):
            super().__init__(retries=3, base=0.001)
            self.folder = folder

        def call(self, request):
            tries = pathlib.Path(self.folder) / request.prompt
            n = len(tries.read_text()) if tries.exists() else 0
            tries.write_text("x" * (n + 1))
            if request.prompt == "slow" and n < 2 or request.prompt == "never":
                raise TimeoutError("later")
            if request.prompt == "bad":
                raise ValueError("never")
            return Reply(f"{request.model} on {request.prompt}", 3, 4)

    work = spark.createDataFrame([(p, "m", p) for p in ("fine", "slow", "bad", "never")], "key string, model string, prompt string")
    got = {r["key"]: r for r in Flaky(str(tmp_path)).replies(work).collect()}
    assert (got["fine"]["raw_output"], got["fine"]["prompt_tokens"], got["fine"]["error"]) == ("m on fine", 3, None)
    assert got["slow"]["raw_output"] == "m on slow" and len((tmp_path / "slow").read_text()) == 3
    assert got["bad"]["raw_output"] is None and got["bad"]["error"].startswith("ValueError") and len((tmp_path / "bad").read_text()) == 1
    assert got["never"]["error"].startswith("TimeoutError") and len((tmp_path / "never").read_text()) == 4


def test_request_of_a_row_without_image():
    assert Request("k", "m", "p") == ("k", "m", "p", None, None, None)
