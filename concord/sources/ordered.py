"""Logs in the order of their files: every line gets its place, and good and bad lines are told apart in one scan.

A log of JSON lines has no sequence column; what counts as last is what stands last
in the file. Lines are read in splits by many tasks. A line's place is its file, the
start of its split and its place among the rows of that split, which one task reads
in order. `seq` is these three, in a struct that orders as the files do: it takes no
further pass. `numbered` turns it into line numbers from 0 by prefix sums over the
splits, a row for each split of the input (128 MB by default).

Several files are in the order of their names, or of other fields of Spark's file
metadata first, such as file_modification_time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from concord.shared import held

#: What a line may be.
RECORD, INCOMPLETE, MALFORMED = "record", "incomplete", "malformed"


def read_lines(spark: SparkSession, path: str, order: Sequence[str] = ("file_path",), numbered: bool = False) -> DataFrame:
    """value and seq of every line, blank ones included. numbered: seq is the line's number, from 0 over all files."""
    by = [c for c in dict.fromkeys((*order, "file_path"))]
    place = F.struct(*[F.col(f"_metadata.{c}").alias(c) for c in by], F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("seq"))
    if not numbered:
        return lines
    split = F.struct(*[F.col(f"seq.{c}") for c in (*by, "split")])
    counts = lines.groupBy(split.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("seq.line").alias("least"))
    before = F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = held(counts.select("at", "least", before.alias("before")), "splits")  # with its size known, a small one is broadcast
    found = lines.withColumn("at", split).join(starts, "at")
    return found.select("value", (F.col("before") + F.col("seq.line") - F.col("least")).alias("seq"))


def _told(schema: str, required: Sequence[str]) -> tuple[Column, Column]:
    """The parsed line, with a field _bad, and what kind it is."""
    parsed = F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lacking = F.lit(False)
    for f in required:
        lacking = lacking | parsed[f].isNull()
    return parsed, F.when(parsed["_bad"].isNotNull(), MALFORMED).when(lacking, INCOMPLETE).otherwise(RECORD)


def read_told(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), order: Sequence[str] = ("file_path",), numbered: bool = False) -> DataFrame:
    """kind, seq, the schema's fields (null in malformed lines) and line (null in records) of every line that isn't blank. Fields can't have these three names."""
    lines = read_lines(spark, path, order, numbered).where(F.length(F.btrim("value", F.lit(" \t\r\n"))) > 0)
    parsed, kind = _told(schema, required)
    told = lines.select(kind.alias("kind"), "seq", parsed.alias("_p"), "value")
    fields = [c for c in told.select("_p.*").columns if c != "_bad"]
    if {"kind", "seq", "line"} & set(fields):
        raise ValueError("kind, seq and line are names of the reader's own columns")
    good = F.col("kind") != MALFORMED
    return told.select("kind", "seq", *[F.when(good, F.col(f"_p.`{c}`")).alias(c) for c in fields], F.when(F.col("kind") != RECORD, F.col("value")).alias("line"))


def read_ordered(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), order: Sequence[str] = ("file_path",), numbered: bool = False) -> DataFrame:
    """The records of a log with seq, for `keyed.last_wins`; malformed, incomplete and blank lines are left out."""
    return read_told(spark, path, schema, required, order, numbered).where(F.col("kind") == RECORD).drop("kind", "line")


def sift(spark: SparkSession, path: str, schema: str, to: str, required: Sequence[str] = (), strict: bool = False, numbered: bool = False) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Records, other lines (kind, seq, line) and how many there are of each kind, from one scan written to the folder `to`.

    strict: a line that is no record raises an error that names the first one in the
    order of the files, after all have been counted.
    """
    seen = Observation()
    kinds = (RECORD, INCOMPLETE, MALFORMED)
    told = read_told(spark, path, schema, required, numbered=numbered)
    first = F.min(F.when(F.col("kind") != RECORD, F.struct("seq", "line")))["line"]
    observed = told.observe(seen, *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], first.alias("first"))
    observed.write.mode("overwrite").partitionBy("kind").parquet(to)
    found = dict(seen.get)
    worst = found.pop("first")
    if strict and found[RECORD] < sum(found.values()):
        raise ValueError(f"{found[MALFORMED]} malformed and {found[INCOMPLETE]} incomplete lines in {path}, the first of them: {worst[:200]}")
    out = spark.read.schema(told.schema).parquet(to)
    return out.where(F.col("kind") == RECORD).drop("kind", "line"), out.where(F.col("kind") != RECORD).select("kind", "seq", "line"), found
