"""Agreement of any number of raters, from ratings in long form with most of them missing.

Ratings are rows (item, rater, value). What two raters agree on follows from how
often their values meet on items that both rated. An item's ratings are short lists,
and pairs are made from a list where it stands and summed there before the shuffle,
so what is moved depends on the pairs of raters and not on the items. An item with
over `most` ratings is dealt to blocks of raters; pairs of its blocks are made by
different tasks. Work on an item is the square of its ratings, as the pairs are.

Null values are missing ratings; of several values that a rater gave an item the
smallest counts; divisions by zero give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.shared import held


def _unique(ratings: DataFrame, item: str, rater: str, value: str) -> DataFrame:
    """item, rater, value: one row for each item and rater."""
    own = ratings.select(F.col(item).alias("item"), F.col(rater).alias("rater"), F.col(value).alias("value"))
    return own.where("item IS NOT NULL AND rater IS NOT NULL AND value IS NOT NULL").groupBy("item", "rater").agg(F.min("value").alias("value"))


def _met(left: str, right: str, ordered: bool) -> Column:
    """Pairs of two lists' ratings as structs, the smaller rater first. ordered: of one list with itself, each pair once."""
    pair = lambda a, b: F.struct(a["rater"].alias("rater1"), b["rater"].alias("rater2"), a["value"].alias("value1"), b["value"].alias("value2"))
    if ordered:
        return F.flatten(F.transform(left, lambda a: F.transform(F.filter(right, lambda b: a["rater"] < b["rater"]), lambda b: pair(a, b))))
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.when(a["rater"] < b["rater"], pair(a, b)).otherwise(pair(b, a)))))


def meetings(ratings: DataFrame, item: str = "item", rater: str = "rater", value: str = "value", most: int = 256) -> DataFrame:
    """rater1 < rater2, value1, value2 and n: on how many items they gave these values."""
    own = held(_unique(ratings, item, rater, value), "ratings")
    sizes = own.groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    large = held(sizes.where(F.col("m") > most).select("item", F.ceil(F.col("m") / most).alias("blocks")), "large")
    one = F.collect_list(F.struct("rater", "value")).alias("list")
    small = own.join(large, "item", "left_anti").groupBy("item").agg(one).select(F.explode(_met("list", "list", True)).alias("p"))
    dealt = own.join(large, "item").withColumn("block", F.pmod(F.xxhash64("rater"), F.col("blocks")))
    lists = held(dealt.groupBy("item", "block", "blocks").agg(one), "lists")
    within = lists.select(F.explode(_met("list", "list", True)).alias("p"))
    # a block goes to each other block of its item: as the left one of the pair to later ones, as the right one to earlier ones
    each = lists.select("item", "block", "list", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")).where("block != other")
    cells = each.groupBy("item", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).agg(
        F.max(F.when(F.col("block") < F.col("other"), F.col("list"))).alias("left"), F.max(F.when(F.col("block") > F.col("other"), F.col("list"))).alias("right")
    )
    across = cells.where("left IS NOT NULL AND right IS NOT NULL").select(F.explode(_met("left", "right", False)).alias("p"))
    return small.unionByName(within).unionByName(across).select("p.*").groupBy("rater1", "rater2", "value1", "value2").agg(F.count(F.lit(1)).alias("n"))


def pairwise(met: DataFrame) -> DataFrame:
    """rater1, rater2, items (that both rated), observed and Cohen's kappa over any number of categories, from `meetings`."""
    sides = F.inline(F.array(F.struct(F.col("value1").alias("value"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b")), F.struct(F.col("value2").alias("value"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"))))
    same = F.when(F.col("value1") == F.col("value2"), F.col("n")).otherwise(0)
    by_value = met.select("rater1", "rater2", (same / 2).alias("same"), sides).groupBy("rater1", "rater2", "value").agg(*[F.sum(c).alias(c) for c in ("a", "b", "same")])
    sums = by_value.groupBy("rater1", "rater2").agg(F.sum("a").alias("items"), F.sum("same").alias("same"), F.sum(F.col("a").cast("double") * F.col("b")).alias("chance"))
    n = F.col("items").cast("double")
    out = sums.select("rater1", "rater2", "items", F.try_divide(F.col("same"), n).alias("observed"), F.try_divide("chance", n * n).alias("pe"))
    return out.select("rater1", "rater2", "items", "observed", F.try_divide(F.col("observed") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


def fleiss(ratings: DataFrame, item: str = "item", rater: str = "rater", value: str = "value") -> DataFrame:
    """items with two ratings or more, and kappa: the items' mean agreement against that of values drawn from all their ratings. With as many ratings an item, Fleiss' kappa."""
    by = _unique(ratings, item, rater, value).groupBy("item", "value").agg(F.count(F.lit(1)).alias("n"))
    lists = by.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.collect_list(F.struct("value", "n")).alias("values")).where("m > 1")
    lists = held(lists, "units")  # a row for each item, with a count for each of its values
    mean = lists.agg(F.count(F.lit(1)).alias("items"), F.avg(F.expr("(squares - m) / (cast(m as double) * (m - 1))")).alias("observed"), F.sum("m").cast("double").alias("total"))
    used = lists.select(F.inline("values")).groupBy("value").agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("same"))
    pe = F.try_divide(F.col("same"), F.col("total") * F.col("total"))
    return mean.crossJoin(used).select("items", F.try_divide(F.col("observed") - pe, 1 - pe).alias("kappa"))  # one row each
