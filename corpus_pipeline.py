"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame; all but the last return the columns of docs. `run`
writes what a stage returns to the shared folder and reads it as the next one's
docs. Where a stage changes texts, n_chars follows; documents that lose all of
their text to duplicates go, those that were empty before stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import jaccard, lines, packing, quality, suffixes
from concord.llm.common import SPACES, bitmap, shuffled, sized, split_by_bitmap, stored, table
from concord.llm.queries import tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with doc_id, text and a number for the name of each other column: columns of docs may have any name."""
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")])


def _named(numbered: DataFrame, docs: DataFrame) -> DataFrame:
    return numbered.select(*[F.col(c if c in ("doc_id", "text") else f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def _blank(text: str):
    return F.length(F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")) == 0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines of a host go; documents that fail the base rules or are depleted go."""
    return _counted(quality.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within an edit of an earlier line go."""
    found = lines.deduplicate(_numbered(docs))
    return _counted(_named(found.where(~(_blank("text") & (F.col("n_removed") > 0))), docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that with the smallest id (null last), then by a hash; of equal ids and texts, one row."""
    id_ = F.col("doc_id")
    keyed = _numbered(docs).withColumn("key", F.xxhash64(id_.isNull(), id_, F.coalesce(F.col("text"), F.lit(""))))
    found = stored(jaccard.similar(keyed.select(F.col("key").alias("doc_id"), "text"), size=5, percent=80), "found")
    rows = found.where("n_shingles > 0").selectExpr("doc_id AS key", "component_id AS component", "1 AS n", "component_id != doc_id AS linked")
    firsts = rows.where("linked").selectExpr("component AS key", "component", "0 AS n", "linked")
    members = rows.unionByName(firsts).groupBy("key").agg(F.min("component").alias("component"), F.sum("n").alias("n"), F.max("linked").alias("linked"))
    members = stored(members.where("linked OR n > 1").select("key", "component"), "members")
    flat = bitmap(members.select("key"), "key", 25)
    held, rest = split_by_bitmap(keyed, F.col("key"), flat)  # only what may go is joined
    named = held.groupBy("key").agg(F.first("doc_id").alias("doc_id")).join(sized(members), "key")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("one")
    kept = named.groupBy("component").agg(one).select(F.col("one.key").alias("key"))
    fates = stored(members.join(shuffled(kept.withColumn("stays", F.lit(True))), "key", "left").select("key", F.coalesce("stays", F.lit(False)).alias("stays")), "fates")
    judged = held.join(sized(fates), "key", "left")
    stay = judged.where("stays IS NULL").unionByName(judged.where("stays").dropDuplicates(["key"]))
    return _named(rest, docs).unionByName(_named(stay, docs))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that start elsewhere too go."""
    found = suffixes.deduplicate(_numbered(docs).withColumn("was_blank", _blank("text")), length=200)
    return _counted(_named(found.where(F.col("was_blank") | ~_blank("text")), docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, packed into sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), size=2048, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]
#: Suffix sorting and packing can't be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
