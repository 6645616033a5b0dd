"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import FEW_ROWS, shuffled, stored


def _signature(edges: DataFrame) -> tuple:
    """How many links there are, and the sum of their hashes: equal for equal sets, from one pass."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).head()
    return r["n"], r["sum"]


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node and label (its component's smallest node) of all nodes of links (a, b).

    Alternates large-star and small-star steps until the links are stars. Each
    step is a minimum per node, summed up before the shuffle, and a join; links
    are written to the shared folder between steps and never collected.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known = _signature(edges)
    for _ in range(most if known[0] else 0):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        side = shuffled if 2 * known[0] > FEW_ROWS else lambda least: least
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(side(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(side(least), "a").select("b", "m").union(least.select(F.col("a").alias("b"), "m"))
        after = stored(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        was, known, edges = known, _signature(after), after
        if was == known:
            break
    else:
        if known[0]:
            raise RuntimeError("components have not converged")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
