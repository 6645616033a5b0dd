"""Calls to a model from executors: generation, judging, retries, outcomes.

A client is an object with `complete(messages, options) -> reply`, where a reply
has `content` and `usage`; it travels to the executors with the task. Partitions
and calls in flight within each (`in_flight`, for clients that threads may share)
bound how many run at a time. Store what these functions return before using it twice: each reading of
an unstored result calls again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import verdicts as V
from concord.functions.prompts import INSUFFICIENT
from concord.functions.text import strip

GENERATION_OPTIONS = {"max_completion_tokens": 400, "response_format": "json_object"}
JUDGE_OPTIONS_2 = {"max_tokens": 10}
JUDGE_OPTIONS_3 = {"max_tokens": 5, "temperature": 0}


@dataclass
class Reply:
    content: str | None
    usage: int = 0


class Client(Protocol):
    def complete(self, messages: list[dict], options: dict) -> Reply | None: ...


@dataclass
class OfflineClient:
    """Deterministic replies: a passage's first words as a question and answer; an answer is supported if the passage has it."""

    words: int = 5

    def complete(self, messages: list[dict], options: dict) -> Reply:
        import json

        user = messages[-1]["content"]
        if user.startswith("Passage:\n"):
            passage, _, rest = user.removeprefix("Passage:\n").partition("\nQuestion: ")
            answer = rest.partition("\nAnswer: ")[2].removesuffix("\nOne word.")
            return Reply(V.SUPPORTED if answer and answer in passage else V.NOT_SUPPORTED, len(user.split()))
        head = user.partition("\n")[2].partition("\nTheme")[0].split()[: self.words]
        if not head:
            return Reply(INSUFFICIENT, len(user.split()))
        return Reply(json.dumps({"question": f"What does the passage say of {head[0]}?", "answer": " ".join(head), "type": "factual", "difficulty": "easy"}), len(user.split()))


@dataclass
class Retry:
    """How often to try, which errors to try again, how long to wait, and whether the last error is raised or gives no reply."""

    tries: int = 5
    only: str | None = "429"
    wait: Callable[[int], float] = field(default=lambda attempt: 2.0**attempt)
    raises: bool = False
    sleep: Callable[[float], None] = time.sleep


def call(client: Client, messages: list[dict], options: dict, retry: Retry) -> tuple[Reply | None, str | None]:
    """The reply, or no reply and the error."""
    error: Exception | None = None
    for attempt in range(retry.tries):
        try:
            return client.complete(messages, options), None
        except Exception as e:  # noqa: BLE001  what a client raises is its own affair
            error = e
            if retry.only is not None and retry.only not in str(e):
                break
            if attempt + 1 < retry.tries:
                retry.sleep(retry.wait(attempt))
    if retry.raises and error is not None:
        raise error
    return None, None if error is None else str(error)


def _each(df: DataFrame, prompts: Sequence[str], client: Client, options: dict, retry: Retry, pause: float, partitions: int | None, in_flight: int = 1) -> DataFrame:
    """df with columns content, usage, error for each column of prompts, their names followed by that of the prompt."""
    fields = (("content", T.StringType()), ("usage", T.LongType()), ("error", T.StringType()), ("answered", T.BooleanType()))
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{name}_{p}", kind) for p in prompts for name, kind in fields)])

    def one(messages) -> tuple:
        reply, error = call(client, [dict(m) if isinstance(m, dict) else m.asDict() for m in messages], options, retry)
        if pause:
            retry.sleep(pause)
        return reply.content if reply else None, reply.usage if reply else None, error, reply is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in prompts:
                if in_flight > 1:
                    with ThreadPoolExecutor(in_flight) as pool:
                        found = list(pool.map(one, batch[p]))
                else:
                    found = [one(messages) for messages in batch[p]]
                for k, name in enumerate(("content", "usage", "error", "answered")):
                    batch[f"{name}_{p}"] = pd.Series([f[k] for f in found], index=batch.index, dtype=object)
            yield batch

    return (df.repartition(partitions) if partitions else df).mapInPandas(run, schema)


REPLY = "question STRING, answer STRING, supporting_verses ARRAY<STRUCT<surah:INT,ayat:INT>>, type STRING, difficulty STRING"


def routed(content: Column, error: Column, schema: str = REPLY) -> tuple[Column, Column]:
    """Outcome and parsed reply. ok; insufficient: the model said so; filtered: refused by a content filter; failed: no or no readable reply, to be tried again."""
    content = strip(content)
    parsed = F.from_json(content, schema)
    outcome = (
        F.when(F.contains(error, F.lit("content_filter")), "filtered").when(content == INSUFFICIENT, "insufficient")
        .when(parsed.isNotNull() & parsed["question"].isNotNull(), "ok").otherwise("failed")
    )
    return outcome, parsed


def generate(items: DataFrame, prompt, client: Client, keys: Sequence[str] = ("surah", "ayat"), retry: Retry | None = None, partitions: int | None = 6, in_flight: int = 1) -> DataFrame:
    """Pairs of items (keys and what the prompt reads), with status, usage, outcome (see `routed`) and error."""
    asked = _each(items.withColumn("p", prompt), ["p"], client, GENERATION_OPTIONS, retry or Retry(tries=3, only=None, wait=lambda _: 1.0), 0, partitions, in_flight)
    outcome, parsed = routed(F.col("content_p"), F.col("error_p"))
    out = asked.select(*items.columns, parsed.alias("__r"), outcome.alias("outcome"), F.col("usage_p").alias("usage"), F.col("error_p").alias("error"))
    ok = F.col("outcome") == "ok"
    fields = [F.when(ok, F.col(f"__r.{f}")).alias(f) for f in ("question", "answer", "supporting_verses", "type", "difficulty")]
    rest = [c for c in items.columns if c not in ("question", "answer", "supporting_verses", "type", "difficulty")]
    return out.select(*rest, *fields, F.when(F.col("outcome") == "insufficient", INSUFFICIENT).alias("status"), "usage", "outcome", "error")


def validate(items: DataFrame, prompt, clients: dict[str, Client], keys: Sequence[str] = ("surah", "ayat"), parse: bool = True, options: dict | None = None, retry: Retry | None = None, pause: float = 0.2, partitions: int | None = 3, in_flight: int = 1) -> DataFrame:
    """keys and a verdict from each client; items that a client gave no reply for are left out, to be tried again.

    parse: verdicts are read from replies; else they are the replies, stripped.
    """
    asked = items.withColumn("p", prompt)
    out = list(keys)
    for name, client in clients.items():
        asked = _each(asked.withColumnRenamed("p", f"p{name}"), [f"p{name}"], client, options or JUDGE_OPTIONS_3, retry or Retry(), pause, partitions if name == next(iter(clients)) else None, in_flight)
        asked = asked.where(F.col(f"answered_p{name}")).withColumnRenamed(f"p{name}", "p")
        content = F.col(f"content_p{name}")
        asked = asked.withColumn(name, V.parse(content) if parse else strip(content)).drop(f"content_p{name}", f"usage_p{name}", f"error_p{name}", f"answered_p{name}")
        out.append(name)
    return asked.select(*out)


def outcomes(df: DataFrame) -> DataFrame:
    """How many rows each outcome has, and their tokens."""
    return df.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("usage").alias("usage"))


def progress(done: int, total: int, seconds: float) -> dict[str, float | None]:
    """Seconds per item, and seconds that remain at that pace."""
    each = seconds / done if done else None
    return {"done": done, "each": each, "remaining": None if each is None else (total - done) * each}


def observed(df: DataFrame, write: Callable[[DataFrame], object], total: int | None = None, clock: Callable[[], float] = time.monotonic) -> dict[str, object]:
    """What a run of write(df) did, measured while it ran: rows, tokens, rows of each outcome, seconds, and its pace against `total` items.

    df needs no second pass: the counts come from the rows that write reads.
    """
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("done"), F.sum("usage").alias("usage") if "usage" in df.columns else F.lit(None).alias("usage")]
    if "outcome" in df.columns:
        counts += [F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "insufficient", "filtered", "failed")]
    began = clock()
    write(df.observe(seen, *counts))
    seconds = clock() - began
    found = dict(seen.get)
    return found | {"seconds": seconds} | progress(found["done"], found["done"] if total is None else total, seconds)
