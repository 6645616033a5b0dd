"""Queries of whole runs, files and reports, each with its SQL; registered with those of `reference`."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import prompts as P
from concord.functions import text as T
from concord.operators import agreement, judging, keyed, sheets, tree
from concord.plans.reference import PAIRS, RATERS, SQL, WITH, pairs, query, rated, scratch, table
from concord.sources import readers, writers
from concord.streaming import log

BENCHMARK = "benchmark_words AS (SELECT item_id, text, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM benchmark)"


def passages(spark, sf_dir):
    """The benchmark's texts as passages with a key."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("surah"), F.lit(0).alias("ayat"), F.col("text").alias("text_id"))


@query(f"""WITH {BENCHMARK} SELECT CAST(item_id AS INT) AS surah, CASE WHEN len(w) > 0 THEN 'What does the passage say of ' || w[1] || '?' END AS question,
  CASE WHEN len(w) > 0 THEN array_to_string(w[1:5], ' ') END AS answer, CASE WHEN len(w) > 0 THEN 'ok' ELSE 'insufficient' END AS outcome, len(w) + 2 AS usage FROM benchmark_words""")
def e05_e06_generate(spark, sf_dir):
    """Offline generation over the benchmark's passages."""
    return judging.generate(passages(spark, sf_dir), P.generation(["surah", "ayat"]), judging.OfflineClient(), in_flight=2).select("surah", "question", "answer", "outcome", "usage")


@query(f"""WITH {PAIRS}, asked AS (SELECT conv_id, turn, question || ' ' || answer AS passage, CASE WHEN turn % 4 = 0 THEN answer ELSE 'no' END AS answer FROM pairs WHERE question IS NOT NULL AND answer IS NOT NULL)
SELECT conv_id, turn, CASE WHEN answer <> '' AND contains(passage, answer) THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS A,
  CASE WHEN answer <> '' AND contains(passage, answer) THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS B FROM asked""")
def e08_e10_e11_validate(spark, sf_dir):
    """Offline judging of pairs of turns against the user's own words, by two judges."""
    some = pairs(spark, sf_dir).where(F.col("question").isNotNull() & F.col("answer").isNotNull())
    items = some.select("conv_id", "turn", F.concat_ws(" ", "question", "answer").alias("text_id"), "question", F.when(F.col("turn") % 4 == 0, F.col("answer")).otherwise("no").alias("answer"))
    return judging.validate(items, P.judgement(strict=True), {"A": judging.OfflineClient(), "B": judging.OfflineClient()}, ["conv_id", "turn"], pause=0)


class FlakyClient(judging.OfflineClient):
    """Refuses some passages: by their number's remainder twice by 429, always by 500, or by a content filter."""

    def complete(self, messages, options):
        number = int(messages[-1]["content"].removeprefix("Passage ").partition(":")[0])
        tries = self.__dict__.setdefault("tries", {})
        tries[number] = tries.get(number, 0) + 1
        if number % 4 == 1 and tries[number] < 3:
            raise RuntimeError("status 429")
        if number % 4 > 1:
            raise RuntimeError("status 500" if number % 4 == 2 else "status 400: content_filter")
        return super().complete(messages, options)


def flaky(spark, sf_dir):
    retry = judging.Retry(tries=5, wait=lambda attempt: 0.0)
    return judging.generate(passages(spark, sf_dir), P.generation(["surah", "ayat"]), FlakyClient(), retry=retry)


FLAKY = f"WITH {BENCHMARK}, flaky AS (SELECT CAST(item_id AS INT) AS surah, CASE item_id % 4 WHEN 2 THEN 'failed' WHEN 3 THEN 'filtered' ELSE CASE WHEN len(w) > 0 THEN 'ok' ELSE 'insufficient' END END AS outcome, CASE item_id % 4 WHEN 2 THEN 'status 500' WHEN 3 THEN 'status 400: content_filter' END AS error, CASE WHEN item_id % 4 < 2 THEN len(w) + 2 END AS usage FROM benchmark_words) "


@query(FLAKY + "SELECT surah, outcome, error FROM flaky")
def e07_p20_retries(spark, sf_dir):
    """Which calls are tried again, given up, or refused."""
    return flaky(spark, sf_dir).select("surah", "outcome", "error")


@query(FLAKY + "SELECT surah, outcome, outcome = 'filtered' AS rejected FROM flaky WHERE outcome <> 'failed'")
def k06_outcomes_split(spark, sf_dir):
    """Results and refusals of a run, each from its own log."""
    results, rejects = scratch(spark, "results"), scratch(spark, "rejects")
    writers.write_outcomes(flaky(spark, sf_dir), results, rejects)
    schema = "surah INT, outcome STRING"
    return readers.read_optional(spark, results, schema).withColumn("rejected", F.lit(False)).union(readers.read_optional(spark, rejects, schema).withColumn("rejected", F.lit(True)))


@query(FLAKY + """SELECT count(*) AS done, CAST(sum(usage) AS BIGINT) AS usage, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'insufficient') AS insufficient,
  count(*) FILTER (outcome = 'filtered') AS filtered, count(*) FILTER (outcome = 'failed') AS failed, true AS timed FROM flaky""")
def a21_a22_f20_run_summary(spark, sf_dir):
    """What a run did, observed while it wrote its results; seconds differ, so only that there are some."""
    path = scratch(spark, "run")
    seen = judging.observed(flaky(spark, sf_dir), lambda df: writers.write_lines(df, path))
    timed = seen["seconds"] > 0 and seen["remaining"] == 0
    row = [(seen["done"], seen["usage"], seen["ok"], seen["insufficient"], seen["filtered"], seen["failed"], timed)]
    return spark.createDataFrame(row, "done bigint, usage bigint, ok bigint, insufficient bigint, filtered bigint, failed bigint, timed boolean")


def damaged(spark, sf_dir) -> str:
    """A log of events in which every seventh line is cut off, every fifth lacks a field and some are blank."""
    path = scratch(spark, "damaged")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"))
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    e.select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 12)).when(F.col("event_id") % 11 == 0, F.concat(line, F.lit("\n"))).otherwise(line).alias("value")).write.text(path)
    return path


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_type IS NOT NULL")
def s03_s04_tolerant_log(spark, sf_dir):
    return readers.read_log(spark, damaged(spark, sf_dir), "event_id BIGINT, user_id BIGINT, event_type STRING", required=("event_id", "event_type"))


@query("SELECT substr('{\"event_id\":' || event_id, 1, 12) AS value FROM events WHERE event_id % 7 = 0")
def s03_malformed_lines(spark, sf_dir):
    return readers.malformed_lines(spark, damaged(spark, sf_dir), "event_id BIGINT, user_id BIGINT, event_type STRING")


@query("SELECT n_regionkey AS surah, n_nationkey AS ayat, r_name || ' → ' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey")
def s10_t02_document_file(spark, sf_dir):
    """A tree written to a file, read as one document and walked; a text that looks like a list isn't."""
    path = scratch(spark, "tree")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = F.array(F.struct(F.col("n_regionkey").alias("surah"), F.col("n_nationkey").alias("ayat")))
    by_region = n.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", leaf.alias("leaf")))).alias("m"))
    trees = by_region.agg(F.struct(F.map_from_entries(F.collect_list(F.struct("r_name", "m"))).alias("tree"), F.lit('[{"surah": 1, "ayat": 2}]').alias("note")).alias("t"))
    trees.select(F.to_json("t").alias("value")).coalesce(1).write.text(path)
    found = tree.leaves(readers.read_document(spark, path))
    return found.select("surah", "ayat", T.path_text(F.slice("path", 2, 2)).alias("path"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS \"ID\", c_name || ' <&> ' || chr(10) || '_x0041_' AS \"Question\", CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS \"Notes\" FROM customer")
def k04_workbook(spark, sf_dir):
    """A sheet written as workbooks and read."""
    path = scratch(spark, "sheet")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID"), F.concat("c_name", F.lit(" <&> \n_x0041_")).alias("Question"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("Notes"))
    writers.write_workbooks(c, path)
    return readers.read_workbook(spark, path)


@query("SELECT c_custkey AS \"ID\", c_name AS \"Question\", '\"' || c_mktsegment || '\",' AS \"Answer\" FROM customer")
def k04_sheet(spark, sf_dir):
    """A sheet written as CSV and read."""
    path = scratch(spark, "sheet")
    writers.write_sheet(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("Question"), F.concat(F.lit('"'), "c_mktsegment", F.lit('",')).alias("Answer")), path)
    return spark.read.csv(path, header=True, escape='"', schema="ID BIGINT, Question STRING, Answer STRING")


@query("SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + abs(event_id % 2) END AS n FROM events")
def k05_resumed_log(spark, sf_dir):
    """A log begun, then resumed in two batches: what it holds isn't worked on again."""
    path, schema, keys = scratch(spark, "log"), "user_id BIGINT, event_id BIGINT, n BIGINT, seq BIGINT", ["event_id"]
    items = table(spark, sf_dir, "events").select("user_id", "event_id")
    batch = log.resume(items.where("event_id % 3 = 0"), path, schema, keys, lambda df: df.withColumn("n", F.lit(0).cast("bigint")))
    log.resume(items, path, schema, keys, lambda df: df.withColumn("n", 1 + F.abs(F.col("event_id") % 2)), batch, batches=2)
    return log.current(spark, path, schema, keys).select("user_id", "event_id", "n")


@query("SELECT user_id, min(event_id) AS seq, min_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def o04_o05_first_seen(spark, sf_dir):
    """Order is a column: the first row of each key, whatever order rows come in."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "event_type").repartition(3, "event_type")
    return keyed.first_wins(e, ["user_id"], "seq")


@query(WITH + """SELECT d.doc_id, d.source AS question, d.lang AS answer, CAST(NULL AS VARCHAR) AS difficulty, CASE WHEN b.item_id IS NULL THEN '' ELSE b.text END AS text_id, d.lang || ' → ' || d.source AS used,
  CASE WHEN b.item_id IS NULL THEN '' ELSE d2.lang END AS full_paths FROM documents d JOIN rated r USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN documents d2 ON d2.doc_id = b.item_id WHERE r.A = 'NOT_SUPPORTED'""")
def p07_validation_set_with_paths(spark, sf_dir):
    """The optional column of the path that was used, where it is there; the full paths come from the verses."""
    d = table(spark, sf_dir, "documents")
    gold = d.select("doc_id", F.col("source").alias("question"), F.col("lang").alias("answer"), F.lit(None).cast("string").alias("difficulty"), F.array("lang", "source").alias("theme_path_used"))
    verses = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("text_id")).join(d.select("doc_id", F.array(F.array("lang")).alias("theme_paths")), "doc_id")
    found = sheets.validation_set(gold, rated(spark, sf_dir).where("A = 'NOT_SUPPORTED'"), verses, ["doc_id"])
    return found.select("doc_id", "question", "answer", "difficulty", "text_id", T.path_text(F.col("theme_path_used_for_generation")).alias("used"), T.paths_text(F.col("theme_paths_full")).alias("full_paths"))


@query("""WITH gold AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS question FROM orders GROUP BY o_custkey)
SELECT CAST(c_custkey AS VARCHAR) AS "ID", c_custkey AS "K", c_name AS "Verse_Text", question AS "Question" FROM customer JOIN gold ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'""")
def j11_last_gold(spark, sf_dir):
    """Gold with several rows for a key: the last counts, and a row of the log gives one row."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_mktsegment") == "BUILDING", "SUPPORTED").otherwise("NOT_SUPPORTED").alias("A"), "c_name")
    gold = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("question"), F.lit("").alias("answer"), F.lit("").alias("difficulty"), F.col("o_orderkey").alias("seq"))
    verses = c.select("k", F.col("c_name").alias("text_id"), F.lit(1).alias("seq"))
    return sheets.non_strict_sheet(c.select("k", "A"), gold, verses, ["A"], ["k"], "seq").select("ID", "K", "Verse_Text", "Question")


@query("SELECT p_partkey, round_even(p_retailprice / 8, 1) AS rounded FROM part")
def f16_half_even(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.half_even(F.col("p_retailprice") / 8, 1).alias("rounded"))


_PAIRWISE = ", ".join(f"max(CASE WHEN rater1 = '{a}' AND rater2 = '{b}' THEN kappa END) AS kappa_{a}_{b}" for a, b in (("A", "B"), ("A", "C"), ("B", "C")))


@query(f"""SELECT r.items, r.majority, r.strict, s.n_majority, s.n_strict, h.observed AS human_observed, h.kappa AS human_kappa, s2.labelled, f3.kappa AS fleiss_models, f5.kappa AS fleiss_all, k.alpha, p.*
FROM ({SQL["a05_a06_rates"]}) r, ({WITH} SELECT count(*) FILTER (coalesce(A, 0) + coalesce(B, 0) + coalesce(C, 0) >= 2) AS n_majority, count(*) FILTER (coalesce(A, 0) + coalesce(B, 0) + coalesce(C, 0) = 3) AS n_strict FROM coded) s,
({SQL["a11_a14_cohen_listwise"]}) h, ({WITH} SELECT count(*) AS labelled FROM human) s2, ({SQL["a16_fleiss_three"]}) f3, ({SQL["a17_fleiss_five"]}) f5, ({SQL["a18_f19_krippendorff_missing"]}) k,
(SELECT {_PAIRWISE} FROM ({SQL["a15_pairwise"]})) p""")
def k07_report(spark, sf_dir):
    """Sizes, rates and all measures of agreement in one row."""
    found = agreement.report(rated(spark, sf_dir), "doc_id", RATERS, ["D", "E"])
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in found.dtypes])
