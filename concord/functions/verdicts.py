"""Verdicts: parsing replies, encoding, votes and the sets that votes define."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.text import strip

#: Fixed values of a parsed reply.
SUPPORTED, NOT_SUPPORTED, EMPTY, ERROR = "SUPPORTED", "NOT_SUPPORTED", "EMPTY", "ERROR"


def parse(content: Column, answered: Column | None = None) -> Column:
    """A reply's verdict. answered: whether there was a reply at all. Only the form with an underscore counts as not supported."""
    upper = F.upper(strip(content))
    verdict = F.when(upper.contains(NOT_SUPPORTED), NOT_SUPPORTED).when(upper.contains(SUPPORTED), SUPPORTED).otherwise(EMPTY)
    return verdict if answered is None else F.when(answered, verdict).otherwise(ERROR)


def encode(c: Column) -> Column:
    """1 for supported, 0 for not supported, else null."""
    return F.when(c == SUPPORTED, 1).when(c == NOT_SUPPORTED, 0)


def votes(raters: Sequence[str]) -> Column:
    """How many encoded raters (columns of 1, 0 or null) say 1."""
    total = F.lit(0)
    for r in raters:
        total = total + F.coalesce(F.col(r), F.lit(0))
    return total


def text_votes(raters: Sequence[str]) -> Column:
    """How many raters (columns of verdicts) say supported."""
    return F.size(F.filter(F.array(*raters), lambda x: x == SUPPORTED))


def at_least(count: Column, least: int) -> Column:
    return (count >= least).cast("int")


def all_supported(raters: Sequence[str]) -> Column:
    """Whether all verdicts are supported; false if one is null."""
    same = F.lit(True)
    for r in raters:
        same = same & (F.col(r) == SUPPORTED)
    return F.coalesce(same, F.lit(False))


def none_blank(raters: Sequence[str]) -> Column:
    """Whether no verdict is the empty string; null verdicts pass."""
    out = F.lit(True)
    for r in raters:
        out = out & ~F.col(r).eqNullSafe("")
    return out


def any_not_supported(raters: Sequence[str]) -> Column:
    return F.exists(F.array(*raters), lambda x: x.eqNullSafe(NOT_SUPPORTED))
