"""Operators on keyed records: lookups, semi and anti joins, last-wins maps, pivots, set operations.

Joins state no physical strategy: sizes are known to the optimiser when they run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def last_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per key, the one with the largest seq: what a map holds after all rows were put in order."""
    rest = [c for c in df.columns if c not in keys]
    # partial maxima go before the shuffle, so a key with many rows sends one from each task
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__row"))
    return kept.select(*[F.col(k) if k in keys else F.col(f"__row.`{k}`").alias(k) for k in df.columns])


def as_mapped(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """What a map that keeps its order holds after all rows were put: a key's last row at its first row's place, which seq then is."""
    rest = [c for c in df.columns if c not in keys and c != seq]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(F.lit(True), *rest), F.col(seq)).alias("__row"), F.min(seq).alias("__first"))
    return kept.select(*[F.col(k) if k in keys else F.col("__first").alias(k) if k == seq else F.col(f"__row.`{k}`").alias(k) for k in df.columns])


def first_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("__row"))
    return kept.select(*[F.col(k) if k in keys else F.col(f"__row.`{k}`").alias(k) for k in df.columns])


def matched(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    """left with columns of right, whose keys may have other names; inner."""
    renamed = right.select(*[F.col(r).alias(f"__{i}") for i, (_, r) in enumerate(on)], *keep)
    found = left
    condition = [F.col(a) == F.col(f"__{i}") for i, (a, _) in enumerate(on)]
    return found.join(renamed, condition, "inner").drop(*[f"__{i}" for i in range(len(on))])


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of left without a partner."""
    renamed = right.select(*[F.col(r).alias(f"__{i}") for i, (_, r) in enumerate(on)])
    return left.join(renamed, [F.col(a) == F.col(f"__{i}") for i, (a, _) in enumerate(on)], "left_anti")


def only_keys(left: DataFrame, keys_of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left, repeats included, whose key is in the other table."""
    return left.join(keys_of.select(*keys), list(keys), "left_semi")


def remaining(left: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left that are still to do: their key isn't in the log. Place it before costly calls; no optimiser moves it there."""
    return left.join(done.select(*keys), list(keys), "left_anti")


def enriched(left: DataFrame, lookup: DataFrame, keys: Sequence[str], defaults: dict[str, Column], seq: str | None = None) -> DataFrame:
    """left with columns of a lookup; a default where there is no row, null where the row holds null.

    Of a lookup's rows with one key the last by seq counts; without seq keys are
    taken to be unique, and of repeated ones any row counts: left keeps its rows.
    """
    lookup = last_wins(lookup, keys, seq) if seq else lookup.dropDuplicates(list(keys))
    side = lookup.select(*keys, *[F.col(c).alias(f"__{c}") for c in defaults], F.lit(True).alias("__matched"))
    found = left.join(side, list(keys), "left")
    own = [F.col(c) for c in left.columns if c not in defaults]
    return found.select(*own, *[F.when(F.col("__matched"), F.col(f"__{c}")).otherwise(d).alias(c) for c, d in defaults.items()])


def missing_keys(all_: DataFrame, done: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """Distinct keys of all_ that done lacks; most: the first ones in order."""
    found = all_.select(*keys).subtract(done.select(*keys))
    return found.orderBy(*keys).limit(most) if most is not None else found


def pivoted(df: DataFrame, index: str, column: str, value: str, names: Sequence[str], seq: str) -> DataFrame:
    """One row per index, a column for each name, the first value by seq that isn't null. Other names are ignored, their rows kept."""
    return df.groupBy(index).pivot(column, list(names)).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(seq)))) if len(names) > 1 else df.groupBy(index).agg(
        F.min_by(value, F.when((F.col(column) == names[0]) & F.col(value).isNotNull(), F.col(seq))).alias(names[0])
    )


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows of a log, whatever columns either lacks."""
    return old.unionByName(new, allowMissingColumns=True)


def collected_paths(leaves: DataFrame, keys: Sequence[str], order: str = "ord", path: str = "path") -> DataFrame:
    """keys and theme_paths: all paths of a key, repeats included, in document order."""
    found = leaves.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, path))).alias("__paths"))
    return found.select(*keys, F.transform("__paths", lambda x: x[path]).alias("theme_paths"))
