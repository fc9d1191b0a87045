"""Where replies come from. The default is a table of them; one that calls a service implements call().

Calls run inside tasks: every task keeps a window of them in flight, takes a token from a bucket before each, and
passes results on as they come. With a journal, what was answered is committed while the job runs.
"""

from __future__ import annotations

import hashlib
import threading
import time
from abc import ABC, abstractmethod
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from operator import attrgetter
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.journal import Journal

# Prefixes of model names and the family that serves them, names that are served elsewhere than
# their prefix says, what is worth another try, and how long to wait for it.
FAMILIES = {"gpt": "openai", "o": "openai", "claude": "anthropic", "gemini": "gemini", "qwen": "dashscope"}
MODELS = {
    "gpt-4o": ("openrouter", "openai/gpt-4o"),
    "gpt-4o-mini": ("openrouter", "openai/gpt-4o-mini"),
    "gemini-2.5-flash": ("openrouter", "google/gemini-2.5-flash"),
    "gemini-2.5-pro": ("openrouter", "google/gemini-2.5-pro"),
    "claude-sonnet-4.6": ("openrouter", "anthropic/claude-sonnet-4.6"),
    "llama-3.2-11b-vision": ("openrouter", "meta-llama/llama-3.2-11b-vision-instruct"),
    "gemma-3-27b": ("openrouter", "google/gemma-3-27b-it"),
    "qwen2.5-vl-72b": ("openrouter", "qwen/qwen2.5-vl-72b-instruct"),
    "qwen-vl-max": ("dashscope", "qwen-vl-max"),
    "qwen-vl-plus": ("dashscope", "qwen-vl-plus"),
}
AGAIN = ("ratelimit", "overloaded", "apiconnection", "timeout", "serviceunavailable", "internalserver")
AGAIN_STATUS = (408, 429, 500, 502, 503, 504, 529)
RETRIES, BASE, LONGEST = 6, 4.0, 60.0
LEAST_LUCK, MOST_LUCK = 0.7, 1.3

#: Where clients put the HTTP status of an error.
STATUS_PLACES = ("status_code", "response.status_code", "status", "code")
REPLY = "key string, raw_output string, prompt_tokens long, completion_tokens long, error string"
WORK = ("key", "model", "system", "prompt", "image", "mime")


class Request(NamedTuple):
    key: str
    model: str
    prompt: str
    system: str | None = None
    image: bytes | None = None
    mime: str | None = None


class Reply(NamedTuple):
    text: str
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


class ReplyProvider(ABC):
    #: Whether it commits replies by itself.
    journal: Journal | None = None

    @abstractmethod
    def replies(self, work: DataFrame) -> DataFrame:
        """work (key, model, prompt; maybe system, image, mime) -> key, raw_output, prompt_tokens, completion_tokens,
        error."""


class TableReplies(ReplyProvider):
    """Replies that are known already; what is missing has an error."""

    def __init__(self, known: DataFrame):
        self.known = known

    def replies(self, work: DataFrame) -> DataFrame:
        counts = [F.col(c) if c in self.known.columns else F.lit(None).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens")]
        found = work.select("key").join(self.known.select("key", "raw_output", *counts), "key", "left")
        return found.withColumn("error", F.when(F.col("raw_output").isNull(), "no reply"))


class Rules:
    """Which errors pass: by a part of the name of their class, or by their status. A provider can add to both."""

    def __init__(self, names: tuple[str, ...] = AGAIN, statuses: tuple[int, ...] = AGAIN_STATUS):
        self.names, self.statuses = names, frozenset(statuses)

    @staticmethod
    def status(error: Exception) -> int | None:
        for place in STATUS_PLACES:
            try:
                found = attrgetter(place)(error)
            except AttributeError:
                continue
            if isinstance(found, int):
                return found
        return None

    def passes(self, error: Exception) -> bool:
        kinds = " ".join(c.__name__.lower() for c in type(error).__mro__)
        return self.status(error) in self.statuses or any(map(kinds.__contains__, self.names))


def waits(key: str, retries: int = RETRIES, base: float = BASE) -> list[float]:
    """The seconds to wait before each further try of a call: doubling up to LONGEST, each with luck of its own that
    follows from the key, so that calls that failed together do not come back together."""
    luck = hashlib.sha256(key.encode()).digest()
    return [min(LONGEST, base * (1 << k)) * (LEAST_LUCK + (MOST_LUCK - LEAST_LUCK) * luck[k % len(luck)] / 255) for k in range(retries)]


class Bucket:
    """Tokens that come at a rate, and are kept up to a number; take() waits for one."""

    def __init__(self, rate: float, most: float = 1.0):
        self.rate, self.most, self.held, self.seen, self.lock = rate, most, most, time.monotonic(), threading.Lock()

    def take(self) -> None:
        with self.lock:  # those who wait do so in turn
            now = time.monotonic()
            self.held = min(self.most, self.held + (now - self.seen) * self.rate)
            self.seen = now
            if self.held < 1:
                pause = (1 - self.held) / self.rate
                time.sleep(pause)
                self.held, self.seen = 1, now + pause
            self.held -= 1


class CallingProvider(ReplyProvider):
    """Calls a service for every row.

    window calls are in flight in a task, in `tasks` tasks; rate is the most calls a second of all of them together
    (further tries count as calls). What fails for good is an error of its row and does not fail the job. Images come
    before the questions on them (rows with an image and no key), so each is held once, for the questions that follow.
    """

    def __init__(self, retries: int = RETRIES, base: float = BASE, window: int = 1, rate: float | None = None, tasks: int = 8, journal: Journal | None = None, rules: Rules | None = None):
        self.retries, self.base, self.window, self.rate, self.tasks, self.journal, self.rules = retries, base, window, rate, tasks, journal, rules or Rules()

    @abstractmethod
    def call(self, request: Request) -> Reply:
        """The reply to one request; an error is raised. Several threads call it at once if window is over 1."""

    def settled(self, request: Request, bucket: Bucket | None) -> dict:
        """The row of a request, after as many tries as it takes."""
        left = iter(waits(request.key, self.retries, self.base))
        while True:
            if bucket:
                bucket.take()
            try:
                return {"key": request.key, "error": None} | dict(zip(("raw_output", "prompt_tokens", "completion_tokens"), self.call(request), strict=True))
            except Exception as e:  # whatever a client raises goes to the row
                pause = next(left, None) if self.rules.passes(e) else None
                if pause is None:
                    return {"key": request.key, "raw_output": None, "prompt_tokens": None, "completion_tokens": None, "error": f"{type(e).__name__}: {e}"}
                time.sleep(pause)

    def _requests(self, frames: Iterator[pd.DataFrame]) -> Iterator[Request]:
        image = mime = owner = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.key is None:
                    owner, image, mime = row.image_id, bytes(row.image), row.mime
                else:
                    own = row.image_id is not None and row.image_id == owner
                    yield Request(row.key, row.model, row.prompt, row.system, image if own else None, mime if own else None)

    def _rows(self, requests: Iterator[Request]) -> Iterator[dict]:
        """Rows in the order in which calls end; what an earlier attempt of this task committed is not asked again."""
        bucket = Bucket(self.rate / self.tasks) if self.rate else None
        first = next(requests, None)
        if first is None:
            return
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        lines = self.journal.of_range(first.key, attempt) if self.journal else None
        known = lines.earlier() if lines else {}
        flying: set[Future] = set()

        def landed(done: set[Future]) -> Iterator[dict]:
            for future in done:
                row = future.result()
                if lines:
                    lines.add(row)
                yield row

        with ThreadPoolExecutor(self.window) as pool:
            request: Request | None = first
            while request is not None:
                if request.key in known:
                    yield known[request.key]
                else:
                    if len(flying) >= self.window:
                        done, flying = wait(flying, return_when=FIRST_COMPLETED)
                        yield from landed(done)
                    flying.add(pool.submit(self.settled, request, bucket))
                request = next(requests, None)
            while flying:
                done, flying = wait(flying, return_when=FIRST_COMPLETED)
                yield from landed(done)
        if lines:
            lines.commit()

    def replies(self, work: DataFrame) -> DataFrame:
        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            columns, held, since = ["key", "raw_output", "prompt_tokens", "completion_tokens", "error"], [], time.monotonic()
            frame = lambda: pd.DataFrame(held, columns=columns).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})
            for row in self._rows(self._requests(frames)):
                held.append(row)
                if len(held) >= 500 or time.monotonic() - since > 5:
                    yield frame()
                    held, since = [], time.monotonic()
            if held:
                yield frame()

        return dealt(work, self.tasks).mapInPandas(ask, REPLY)


def dealt(work: DataFrame, tasks: int) -> DataFrame:
    """Work by image and key, in as many parts; the questions on an image follow it. images are rows without key."""
    whole = work
    for c, kind in (("image_id", "string"), ("system", "string"), ("image", "binary"), ("mime", "string")):
        if c not in work.columns:
            whole = whole.withColumn(c, F.lit(None).cast(kind))
    by = F.coalesce("image_id", "key")
    return whole.select("image_id", *WORK).repartition(tasks, by).sortWithinPartitions(by, F.col("key").asc_nulls_first())


def with_images(work: DataFrame, images: DataFrame) -> DataFrame:
    """work (key, model, prompt, image_id) and, as rows without key, those of images (image_id, image, mime) that it
    asks about. The bytes of an image travel once, whatever the number of questions and models."""
    wanted = images.join(work.select("image_id").distinct(), "image_id", "left_semi").select("image_id", "image", "mime")
    return work.unionByName(wanted, allowMissingColumns=True)


def family(model: str) -> str:
    """Family of a model that is in no table, by the longest prefix of its name."""
    name = model.lower().rsplit("/", 1)[-1]
    fit = [p for p in FAMILIES if name.startswith(p)]
    if not fit:
        raise ValueError(f"unknown model: {model}")
    return FAMILIES[max(fit, key=len)]


def served(model: str) -> tuple[str, str]:
    """Who serves a model that results name so, and the name it is called by there."""
    return MODELS.get(model) or (family(model), model)
