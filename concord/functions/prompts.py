"""Prompts as columns: arrays of structs (role, content), built by the optimiser's own expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions import text as T

INSUFFICIENT = "INSUFFICIENT_EVIDENCE"
_ROLE = "You write one question and its answer about a passage, using nothing but the passage."
_SHAPE = (
    'Reply with a JSON object: question, answer, supporting_verses (a list of objects with the passage\'s keys), type ("factual" or "conceptual"), '
    f"difficulty (easy, medium or hard). If the passage doesn't allow a question, reply {INSUFFICIENT}."
)
_DIFFICULTY = (
    "Difficulty is that of the passage's form, not of its subject's weight. easy: short, one idea, the answer stands there as it is. "
    "medium: several things or descriptions, of which the answer is one. hard: long, dense, figurative or conditional, or with numbers or rules to put together."
)
_JUDGE = "You check whether an answer follows from a passage. Reply with one word: SUPPORTED or NOT_SUPPORTED."
_STRICT_JUDGE = (
    "You sort answers into two classes by a passage. An answer is supported only if the passage says all of it outright; one part beyond the passage, or one "
    "that has to be inferred, makes it not supported. Give no reasons and repeat nothing. Reply with one word: SUPPORTED or NOT_SUPPORTED."
)


def _messages(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def generation(keys: Sequence[str], text: str = "text_id", paths: str | None = None, all_paths: bool = False) -> Column:
    """The prompt for a question: without a theme, with the first path, or with all paths as numbered lines."""
    parts = [F.lit("Passage "), T.key_text(keys), F.lit(":\n"), F.coalesce(text, F.lit(""))]
    if paths:
        theme = T.numbered_paths(F.col(paths)) if all_paths else T.path_text(T.first_path(F.col(paths)))
        parts += [F.lit("\nThemes:\n" if all_paths else "\nTheme: "), theme]
    return _messages(f"{_ROLE} {_SHAPE} {_DIFFICULTY}", F.concat(*parts))


def judgement(text: str = "text_id", strict: bool = False) -> Column:
    """The prompt for a verdict on question and answer, of two (plain) or three (strict) judges; a missing passage is empty."""
    parts = [F.lit("Passage:\n"), F.coalesce(text, F.lit("")), F.lit("\nQuestion: "), F.col("question"), F.lit("\nAnswer: "), F.col("answer")]
    if strict:
        parts.append(F.lit("\nOne word."))
    return _messages(_STRICT_JUDGE if strict else _JUDGE, F.concat(*parts))
