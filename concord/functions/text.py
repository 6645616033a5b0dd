"""Scalar functions as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ARROW, BAR = " → ", " || "


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in keys])


def key_part(c: Column, k: int, strict: bool = False) -> Column:
    """The k-th part of a key text, as int; strict: what isn't one raises an error, else it gives null."""
    part = F.get(F.split(c, ":"), F.lit(k))
    return part.cast("int") if strict else part.try_cast("int")


def path_text(path: Column) -> Column:
    return F.concat_ws(ARROW, path)


def paths_text(paths: Column) -> Column:
    """All paths in a line; empty for none."""
    return F.concat_ws(BAR, F.transform(F.coalesce(paths, F.array()), path_text))


def numbered_paths(paths: Column) -> Column:
    """A numbered line to a path; None for none."""
    lines = F.transform(paths, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), path_text(p)))
    return F.when(F.size(F.coalesce(paths, F.array())) > 0, F.array_join(lines, "\n")).otherwise(F.lit("None"))


def first_path(paths: Column) -> Column:
    return F.coalesce(F.get(paths, F.lit(0)), F.array().cast("array<string>"))


def with_step(path: Column, step: Column) -> Column:
    return F.concat(path, F.array(step))


def blocks_text(blocks: Column) -> Column:
    """The texts of a reply's blocks (structs with a field text), joined."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "")


def node_kind(c: Column) -> Column:
    """object, list or scalar: what a JSON text is, told by its first character; null for null."""
    node = F.ltrim(c)
    return F.when(node.isNull(), None).when(F.startswith(node, F.lit("{")), "object").when(F.startswith(node, F.lit("[")), "list").otherwise("scalar")


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def back_off(attempt: Column) -> Column:
    """Seconds to wait after an attempt, from 0."""
    return F.pow(F.lit(2.0), attempt)


def count_of(values: Column, value: str) -> Column:
    return F.size(F.filter(values, lambda x: x == value))


def default_if_missing(matched: Column, c: Column, default: Column) -> Column:
    """c where the lookup row was there, null included; the default where there was none."""
    return F.when(matched, c).otherwise(default)
