"""Projections for people: validation sets and annotation sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import text as T
from concord.functions import verdicts as V
from concord.operators import keyed


def validation_set(accepted: DataFrame, open_keys: DataFrame, verses: DataFrame, keys: Sequence[str] = ("surah", "ayat"), seq: str | None = None) -> DataFrame:
    """Accepted pairs whose key is open to doubt, with the verse and all its paths; of verses with one key the last by seq, a column of verses."""
    some = keyed.only_keys(accepted, open_keys, keys)
    used = F.col("theme_path_used") if "theme_path_used" in some.columns else F.lit(None).cast("array<string>")
    some = some.select("question", "answer", "difficulty", *keys, used.alias("theme_path_used_for_generation"))
    lookup = verses.withColumnRenamed("theme_paths", "theme_paths_full")
    found = keyed.enriched(some, lookup, keys, {"text_id": F.lit(""), "theme_paths_full": F.array().cast("array<array<string>>")}, seq)
    return found.select("question", "answer", "difficulty", *keys, "text_id", "theme_path_used_for_generation", "theme_paths_full")


def sheet(pairs: DataFrame, keys: Sequence[str] = ("surah", "ayat"), text: str = "text_id", paths: str = "theme_paths_full") -> DataFrame:
    """A row to annotate for each pair, with three columns to fill in."""
    names = [k[:1].upper() + k[1:] for k in keys]
    blank = [F.lit("").alias(c) for c in ("Human_Verdict", "Error_Type", "Notes")]
    return pairs.select(
        T.key_text(keys).alias("ID"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(text).alias("Verse_Text"), F.col("question").alias("Question"),
        F.col("answer").alias("Answer"), F.coalesce("difficulty", F.lit("")).alias("Difficulty_Model"), T.paths_text(F.col(paths)).alias("Theme_Paths"), *blank,
    )


def non_strict_sheet(log: DataFrame, gold: DataFrame, verses: DataFrame, raters: Sequence[str] = ("A", "B", "C"), keys: Sequence[str] = ("surah", "ayat"), seq: str | None = None) -> DataFrame:
    """The sheet of pairs whose verdicts aren't all supported; blank verdicts leave a row out, missing ones don't.

    A row of the log gives one row. Of gold and verses with one key the last by seq,
    a column of both, counts; without seq any one does.
    """
    open_ = log.where(V.none_blank(raters) & ~V.all_supported(raters)).select(*keys)
    asked = gold.where(F.col("question").isNotNull())
    pairs = open_.join(keyed.last_wins(asked, keys, seq).drop(seq) if seq else asked.dropDuplicates(list(keys)), list(keys))
    if "theme_paths" not in pairs.columns:
        pairs = pairs.withColumn("theme_paths", F.array().cast("array<array<string>>"))
    return sheet(keyed.enriched(pairs, verses.select(*keys, "text_id", *([seq] if seq else [])), keys, {"text_id": F.lit("")}, seq), keys, paths="theme_paths")


def with_human_labels(log: DataFrame, labels: DataFrame, names: dict[str, str], keys: Sequence[str] = ("surah", "ayat"), seq: str = "seq") -> DataFrame:
    """The log with a column of verdicts for each evaluator; names: column by evaluator. Labels come with a textual key ID and an order."""
    wide = keyed.pivoted(labels, "ID", "nama_evaluator", "verdict", list(names), seq)
    found = wide.select(*[T.key_part(F.col("ID"), i).alias(k) for i, k in enumerate(keys)], *[F.col(n).alias(c) for n, c in names.items()])
    return log.join(found, list(keys), "left")


def stray_labels(labels: DataFrame, names: Sequence[str], most: int = 2) -> DataFrame:
    """Labels whose evaluator is none of names, with the name that was meant: the nearest within `most` edits, case and white space aside, the first of those as near; null if none is."""
    own = labels.where(~F.coalesce(F.col("nama_evaluator").isin(list(names)), F.lit(False)))
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s", ""))
    edits = F.array(*[F.struct(F.levenshtein(plain(F.col("nama_evaluator")), plain(F.lit(n))).alias("edits"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    near = F.array_min(F.filter(edits, lambda x: x["edits"] <= most))
    return own.withColumn("meant", near["name"])


def mended_labels(labels: DataFrame, names: Sequence[str], most: int = 2) -> DataFrame:
    """labels in which stray evaluators that are near one of names bear that name; others keep theirs."""
    known = F.coalesce(F.col("nama_evaluator").isin(list(names)), F.lit(False))
    stray = stray_labels(labels, names, most)
    return labels.where(known).unionByName(stray.withColumn("nama_evaluator", F.coalesce("meant", "nama_evaluator")).drop("meant"))


def consensus(gold: DataFrame, log: DataFrame, raters: Sequence[str], least: int, keys: Sequence[str] = ("surah", "ayat")) -> DataFrame:
    """Pairs of which at least so many verdicts are supported; the log has one row per key."""
    return gold.join(log.where(V.text_votes(raters) >= least).select(*keys), list(keys), "left_semi")
