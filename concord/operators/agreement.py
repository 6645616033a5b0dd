"""Agreement of raters, each measure an aggregation of counts and arithmetic on one row.

Counts are summed before the shuffle, so a measure moves a row from each task.
Divisions by zero (no rows, one category only) give null.

`patterns` counts how often each tuple of verdicts occurs: a table whose size depends
on raters and verdicts only, and from which every measure here follows. Tables of
parts of the data add up (`merged`), so new rows need no second look at old ones.
Measures take such a table where `n` names its column of counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.verdicts import NOT_SUPPORTED, SUPPORTED


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _how_many(condition: Column, n: str | None) -> Column:
    """Rows with a condition; n: a column that says how many rows a row stands for."""
    return F.count_if(condition) if n is None else F.coalesce(F.sum(F.when(condition, F.col(n))), F.lit(0).cast("bigint"))


def patterns(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """How many rows (n) have each tuple of the raters' verdicts, null being one."""
    return df.groupBy(*raters).agg(F.count(F.lit(1)).alias("n"))


def merged(tables: Sequence[DataFrame]) -> DataFrame:
    """The table of patterns of all parts' rows together."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first.groupBy(*[c for c in first.columns if c != "n"]).agg(F.sum("n").alias("n"))


def confusion(a: str, b: str, n: str | None = None) -> dict[str, Column]:
    """Aggregates tp, tn, fp, fn of two columns of verdicts."""
    x, y = F.col(a), F.col(b)
    return {
        "tp": _how_many((x == SUPPORTED) & (y == SUPPORTED), n), "tn": _how_many((x == NOT_SUPPORTED) & (y == NOT_SUPPORTED), n),
        "fp": _how_many((x == SUPPORTED) & (y == NOT_SUPPORTED), n), "fn": _how_many((x == NOT_SUPPORTED) & (y == SUPPORTED), n),
    }


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often two values meet: a row for each pair that occurs."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def cohen(df: DataFrame, a: str, b: str, policy: str = "listwise", n: str | None = None) -> DataFrame:
    """observed and kappa of two raters (columns of verdicts), in one row.

    all_rows: agreement and marginals over all rows, unparseable verdicts included.
    pairwise: agreement over rows valid for both, marginals over all rows by the
    count of valid ones (they may exceed 1). listwise: valid rows only.
    """
    if policy not in ("all_rows", "pairwise", "listwise"):
        raise ValueError(policy)
    if policy == "listwise":
        valid = [SUPPORTED, NOT_SUPPORTED]
        df = df.where(F.col(a).isin(valid) & F.col(b).isin(valid))
    sums = df.agg(
        *[c.alias(k) for k, c in confusion(a, b, n).items()], _how_many(F.lit(True), n).alias("rows"),
        _how_many(F.col(a) == SUPPORTED, n).alias("sa"), _how_many(F.col(b) == SUPPORTED, n).alias("sb"),
    )
    return _kappa(sums, F.col("rows") if policy == "all_rows" else F.expr("tp + tn + fp + fn"))


def _kappa(sums: DataFrame, total: Column) -> DataFrame:
    out = sums.select(_ratio(F.expr("tp + tn"), total).alias("observed"), _ratio(F.col("sa"), total).alias("pa"), _ratio(F.col("sb"), total).alias("pb"))
    expected = F.expr("pa * pb + (1 - pa) * (1 - pb)")
    return out.select("observed", F.try_divide(F.col("observed") - expected, 1 - expected).alias("kappa"))


def _pair_sums(raters: Sequence[str], policy: str, n: str | None) -> list[Column]:
    """Aggregates tp, tn, fp, fn, rows, sa and sb of each pair of raters, their names followed by the pair's number."""
    out = []
    for i, (a, b) in enumerate(combinations(raters, 2)):
        counts = confusion(a, b, n) | {"rows": _how_many(F.lit(True), n), "sa": _how_many(F.col(a) == SUPPORTED, n), "sb": _how_many(F.col(b) == SUPPORTED, n)}
        if policy == "listwise":
            counts |= {"rows": counts["tp"] + counts["tn"] + counts["fp"] + counts["fn"], "sa": counts["tp"] + counts["fp"], "sb": counts["tp"] + counts["fn"]}
        out += [c.alias(f"{k}{i}") for k, c in counts.items()]
    return out


def _chance(po: Column, pe: Column) -> Column:
    return F.try_divide(po - pe, 1 - pe)


def pairwise_cohen(df: DataFrame, raters: Sequence[str], policy: str = "pairwise", n: str | None = None) -> DataFrame:
    """rater1, rater2, observed, kappa of all pairs of raters, from one pass over df."""
    pairs = list(combinations(raters, 2))
    one = df.agg(*_pair_sums(raters, policy, n))
    fields = ("tp", "tn", "fp", "fn", "rows", "sa", "sb")
    rows = F.inline(F.array(*[F.struct(F.lit(a).alias("rater1"), F.lit(b).alias("rater2"), *[F.col(f"{k}{i}").alias(k) for k in fields]) for i, (a, b) in enumerate(pairs)]))
    total = F.col("rows") if policy == "all_rows" else F.expr("tp + tn + fp + fn")
    out = one.select(rows).select("rater1", "rater2", _ratio(F.expr("tp + tn"), total).alias("observed"), _ratio(F.col("sa"), total).alias("pa"), _ratio(F.col("sb"), total).alias("pb"))
    return out.select("rater1", "rater2", "observed", _chance(F.col("observed"), F.expr("pa * pb + (1 - pa) * (1 - pb)")).alias("kappa"))


def _said(raters: Sequence[str], verdict: str) -> Column:
    return F.size(F.filter(F.array(*raters), lambda x: x == verdict))


def _complete(raters: Sequence[str]) -> Column:
    return _said(raters, SUPPORTED) + _said(raters, NOT_SUPPORTED) == len(raters)


def _fleiss_sums(raters: Sequence[str], policy: str, n: str | None, name: str) -> list[Column]:
    """Aggregates items, agree (sum of the items' agreement) and yes, of rows that the policy takes."""
    k, yes = len(raters), _said(raters, SUPPORTED).cast("double")
    taken = _complete(raters) if policy == "listwise" else F.lit(True)
    times = F.lit(1) if n is None else F.col(n)
    agree = (yes * yes + (k - yes) * (k - yes) - k) / (k * (k - 1))
    sums = {"items": _how_many(taken, n), "agree": F.sum(F.when(taken, agree * times)), "yes": F.sum(F.when(taken, yes * times))}
    return [c.alias(f"{name}_{key}") for key, c in sums.items()]


def _fleiss_kappa(k: int, name: str) -> Column:
    items, p = F.col(f"{name}_items").cast("double"), F.try_divide(F.col(f"{name}_yes"), F.col(f"{name}_items") * F.lit(float(k)))
    return _chance(F.try_divide(F.col(f"{name}_agree"), items), p * p + (1 - p) * (1 - p))


def fleiss(df: DataFrame, raters: Sequence[str], policy: str = "all_rows", n: str | None = None) -> DataFrame:
    """items and kappa of any number of raters over two categories (columns of verdicts).

    all_rows: what isn't supported counts as not supported. listwise: rows with a
    verdict that is neither are left out.
    """
    return df.agg(*_fleiss_sums(raters, policy, n, "f")).select(F.col("f_items").alias("items"), _fleiss_kappa(len(raters), "f").alias("kappa"))


def _alpha_sums(raters: Sequence[str], n: str | None) -> list[Column]:
    yes, no = _said(raters, SUPPORTED).cast("double"), _said(raters, NOT_SUPPORTED).cast("double")
    m, times = yes + no, F.lit(1) if n is None else F.col(n)
    sums = {"differ": F.try_divide(m * m - yes * yes - no * no, m - 1), "yes": yes, "no": no}
    return [F.coalesce(F.sum(F.when(m > 1, c * times)), F.lit(0.0)).alias(f"alpha_{k}") for k, c in sums.items()]


def _alpha() -> Column:
    total = F.expr("alpha_yes + alpha_no")
    return 1 - F.try_divide(F.col("alpha_differ") * (total - 1), F.expr("2 * alpha_yes * alpha_no"))


def krippendorff_wide(df: DataFrame, raters: Sequence[str], n: str | None = None) -> DataFrame:
    """alpha of columns of verdicts; what is neither supported nor not is missing."""
    return df.agg(*_alpha_sums(raters, n)).select(_alpha().alias("alpha"))


def krippendorff(ratings: DataFrame, item: str = "item", value: str = "value") -> DataFrame:
    """alpha of nominal ratings in long form, any number of categories, missing ratings left out, as null values are."""
    by = ratings.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count(F.lit(1)).alias("n"))
    units = by.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("squares")).where("m > 1")
    differ = units.agg(F.sum(F.expr("(m * m - squares) / cast(m - 1 as double)")).alias("d"), F.sum("m").alias("total"))
    used = by.join(units.select(item), item, "left_semi").groupBy(value).agg(F.sum("n").alias("n"))
    chance = used.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("same"))
    both = differ.crossJoin(chance)  # one row each
    return both.select((1 - F.try_divide(F.col("d") * (F.col("total") - 1), F.expr("cast(total as double) * total - same"))).alias("alpha"))


def long_form(df: DataFrame, item: str, raters: Sequence[str]) -> DataFrame:
    """item, rater, value of a table with a column for each rater."""
    return df.unpivot([item], list(raters), "rater", "value")


def rates(df: DataFrame, **flags: Column) -> DataFrame:
    """The means of flags (0, 1 or boolean), and items."""
    return df.agg(F.count(F.lit(1)).alias("items"), *[F.avg(f.cast("double")).alias(k) for k, f in flags.items()])


def report(df: DataFrame, item: str, models: Sequence[str], people: Sequence[str]) -> DataFrame:
    """Sizes, rates and agreement of models and people (columns of verdicts) in one row, from one pass over df; see `report_of`."""
    return report_of(patterns(df, [*models, *people]), models, people)


def report_of(table: DataFrame, models: Sequence[str], people: Sequence[str]) -> DataFrame:
    """The report of a table of patterns.

    items, n_majority, n_strict, majority, strict: votes of the models. labelled,
    human_observed, human_kappa: the models' majority against any supporting person,
    over items that all people labelled. fleiss_models, fleiss_all (complete items),
    alpha (missing ratings left out), and kappa_X_Y of each pair of models.
    """
    raters, pairs = [*models, *people], list(combinations(models, 2))
    most, strict = _said(models, SUPPORTED) >= len(models) // 2 + 1, _said(models, SUPPORTED) == len(models)
    labelled, person = _complete(people), _said(people, SUPPORTED) > 0
    counts = {"items": F.lit(True), "n_majority": most, "n_strict": strict, "labelled": labelled}
    counts |= {"h_tp": labelled & most & person, "h_tn": labelled & ~most & ~person, "h_fp": labelled & most & ~person, "h_fn": labelled & ~most & person}
    one = table.agg(
        *[_how_many(c, "n").alias(k) for k, c in counts.items()], *_pair_sums(models, "pairwise", "n"), *_alpha_sums(raters, "n"),
        *_fleiss_sums(models, "all_rows", "n", "models"), *_fleiss_sums(raters, "listwise", "n", "all"),
    )
    pa, pb = _ratio(F.expr("h_tp + h_fp"), F.col("labelled")), _ratio(F.expr("h_tp + h_fn"), F.col("labelled"))
    observed = _ratio(F.expr("h_tp + h_tn"), F.col("labelled"))

    def kappa(i: int) -> Column:
        total = F.expr(f"tp{i} + tn{i} + fp{i} + fn{i}")
        a, b = _ratio(F.col(f"sa{i}"), total), _ratio(F.col(f"sb{i}"), total)
        return _chance(_ratio(F.expr(f"tp{i} + tn{i}"), total), a * b + (1 - a) * (1 - b))

    return one.select(
        "items", "n_majority", "n_strict", _ratio(F.col("n_majority"), F.col("items")).alias("majority"), _ratio(F.col("n_strict"), F.col("items")).alias("strict"), "labelled",
        observed.alias("human_observed"), _chance(observed, pa * pb + (1 - pa) * (1 - pb)).alias("human_kappa"), _fleiss_kappa(len(models), "models").alias("fleiss_models"),
        _fleiss_kappa(len(raters), "all").alias("fleiss_all"), _alpha().alias("alpha"), *[kappa(i).alias(f"kappa_{a}_{b}") for i, (a, b) in enumerate(pairs)],
    )
