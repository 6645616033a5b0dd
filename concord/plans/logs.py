"""Queries of logs, increments and many raters, each with its SQL; registered with those of `reference`."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import text as T
from concord.operators import agreement, keyed, progress, raters, sheets, tree
from concord.plans.reference import RATERS, SQL, query, rated, table
from concord.shared import held, scratch
from concord.sources import ordered
from concord.streaming import batches, keyed_log

DOCUMENT = "source STRING, lang STRING, n_chars BIGINT"


def plain_log(spark, sf_dir) -> str:
    """Documents as JSON lines over several files, without a sequence column: their order is that of the files."""
    path = scratch(spark, "plain")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    d.repartitionByRange(24, "doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.json(path)
    return path


LINES = "lines AS (SELECT source, lang, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL)"


@query(f"""WITH {LINES} SELECT source, lang, n_chars % 1000 AS k, max_by(n_chars, line) AS n_chars, min(line) AS first_line FROM lines GROUP BY ALL""")
def a03_x05_plain_log(spark, sf_dir):
    """What a map holds after a plain log was read: a key's last line, at the place of its first."""
    log = ordered.read_ordered(spark, plain_log(spark, sf_dir), DOCUMENT, required=("source", "lang", "n_chars"), numbered=True)
    found = keyed.as_mapped(log.withColumn("k", F.col("n_chars") % 1000), ["source", "lang", "k"], "seq")
    return found.select("source", "lang", "k", "n_chars", F.col("seq").alias("first_line"))


@query(f"WITH {LINES} SELECT source, n_chars % 1000 AS k, max_by(lang, line) AS lang, max_by(n_chars, line) AS n_chars FROM lines GROUP BY ALL")
def o04_file_order_last(spark, sf_dir):
    """The last line of each key by file, split and place, without numbering lines."""
    log = ordered.read_ordered(spark, plain_log(spark, sf_dir), DOCUMENT, required=("source", "lang", "n_chars"))
    return keyed.last_wins(log.withColumn("k", F.col("n_chars") % 1000), ["source", "k"], "seq").select("source", "k", "lang", "n_chars")


def damaged_documents(spark, sf_dir) -> str:
    """A log of documents in which every seventh line is cut off, every fifth lacks a field and some are blank."""
    path = scratch(spark, "damaged")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"))
    line = F.to_json(F.struct("doc_id", "lang"))
    d.select(F.when(F.col("doc_id") % 7 == 0, F.substring(line, 1, 10)).when(F.col("doc_id") % 11 == 0, F.concat(line, F.lit("\n"))).otherwise(line).alias("value")).write.text(path)
    return path


@query("""WITH told AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'malformed' WHEN doc_id % 5 = 0 THEN 'incomplete' ELSE 'record' END AS kind,
  CASE WHEN doc_id % 7 = 0 THEN substr('{"doc_id":' || doc_id, 1, 10) WHEN doc_id % 5 = 0 THEN '{"doc_id":' || doc_id || '}' END AS line FROM documents)
SELECT kind, CASE WHEN kind = 'record' THEN doc_id END AS doc_id, line, count(*) OVER (PARTITION BY kind) AS n FROM told""")
def s02_s03_s04_s09_sifted_log(spark, sf_dir):
    """A damaged log: its records, its malformed and incomplete lines and how many there are of each, from one scan."""
    records, others, counts = ordered.sift(spark, damaged_documents(spark, sf_dir), "doc_id BIGINT, lang STRING", scratch(spark, "sifted"), required=("doc_id", "lang"))
    all_ = records.select(F.lit(ordered.RECORD).alias("kind"), "doc_id", F.lit(None).cast("string").alias("line")).unionByName(others.select("kind", F.lit(None).cast("bigint").alias("doc_id"), "line"))
    n = F.coalesce(*[F.when(F.col("kind") == k, F.lit(c).cast("bigint")) for k, c in counts.items()])
    return all_.withColumn("n", n)


@query(SQL["k07_report"])
def k07_a05_a18_merged_patterns(spark, sf_dir):
    """The whole report from tables of patterns of three parts of the data, each counted once and stored."""
    r = rated(spark, sf_dir)
    raters_ = [*RATERS, "D", "E"]
    parts = [held(agreement.patterns(r.where(F.pmod("doc_id", F.lit(3)) == k), raters_), f"patterns{k}") for k in range(3)]
    found = agreement.report_of(agreement.merged(parts), RATERS, ["D", "E"])
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in found.dtypes])


def many_raters(spark, sf_dir):
    """item, rater, value: the languages that a hundred raters, told by length, give to groups of a hundred documents; every third document goes to one item that all share."""
    d = table(spark, sf_dir, "documents")
    item = F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.floor(F.col("doc_id") / 100))
    return d.select(item.alias("item"), (F.col("n_chars") % 100).alias("rater"), F.col("lang").alias("value"))


MANY = """ratings AS (SELECT CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id // 100 END AS item, n_chars % 100 AS rater, min(lang) AS value FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {MANY}, met AS (SELECT a.rater AS rater1, b.rater AS rater2, a.value AS x, b.value AS y, count(*) AS n FROM ratings a JOIN ratings b ON a.item = b.item AND a.rater < b.rater GROUP BY ALL),
totals AS (SELECT rater1, rater2, CAST(sum(n) AS BIGINT) AS items, CAST(coalesce(sum(n) FILTER (x = y), 0) AS DOUBLE) AS same FROM met GROUP BY rater1, rater2),
lefts AS (SELECT rater1, rater2, x AS v, sum(n)::DOUBLE AS a FROM met GROUP BY ALL), rights AS (SELECT rater1, rater2, y AS v, sum(n)::DOUBLE AS b FROM met GROUP BY ALL),
chances AS (SELECT rater1, rater2, sum(a * b) AS c FROM lefts JOIN rights USING (rater1, rater2, v) GROUP BY ALL),
parts AS (SELECT rater1, rater2, items, same / items AS po, coalesce(c, 0) / (items::DOUBLE * items) AS pe FROM totals LEFT JOIN chances USING (rater1, rater2))
SELECT rater1, rater2, items, round(po, 6) AS observed, round(CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM parts""")
def a15_many_raters(spark, sf_dir):
    """Cohen's kappa of every two of a hundred raters with most ratings missing, over all categories."""
    found = raters.pairwise(raters.meetings(many_raters(spark, sf_dir), most=32))
    return found.select("rater1", "rater2", "items", F.round("observed", 6).alias("observed"), F.round("kappa", 6).alias("kappa"))


@query(f"""WITH {MANY}, by_value AS (SELECT item, value, count(*)::DOUBLE AS n FROM ratings GROUP BY ALL), units AS (SELECT item, sum(n) AS m, sum(n * n) AS q FROM by_value GROUP BY item HAVING sum(n) > 1),
used AS (SELECT sum(s * s) AS same FROM (SELECT sum(n) AS s FROM by_value WHERE item IN (SELECT item FROM units) GROUP BY value)),
parts AS (SELECT count(*) AS items, avg((q - m) / (m * (m - 1))) AS po, sum(m) AS total FROM units)
SELECT items, round((po - same / (total * total)) / (1 - same / (total * total)), 6) AS kappa FROM parts, used""")
def a16_many_raters(spark, sf_dir):
    """Fleiss' kappa where items have different numbers of ratings."""
    return raters.fleiss(many_raters(spark, sf_dir)).select("items", F.round("kappa", 6).alias("kappa"))


@query("SELECT count(*) AS n FROM (SELECT 1 FROM documents WHERE source IS NULL OR nullif(lang, 'en') IS NULL LIMIT 1)")
def s09_first_incomplete_hit(spark, sf_dir):
    """The probe for an incomplete row, on a table that has such rows."""
    from concord.sources.readers import first_incomplete

    d = table(spark, sf_dir, "documents").select("source", F.nullif("lang", F.lit("en")).alias("lang"))
    return first_incomplete(d, "source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, n_chars, count(*) OVER () AS done, true AS rose, true AS ended FROM documents")
def a21_live_progress(spark, sf_dir):
    """Documents written under watch: what was written, rows that were done at the end, whether figures only rose, and whether none remained."""
    path, seen = scratch(spark, "watched"), []
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    last = progress.watched(d.repartition(12), lambda df: df.write.parquet(path), seen.append, total=d.count(), every=0.1)
    rose = all(a.rows <= b.rows for a, b in zip(seen, seen[1:], strict=False))
    return spark.read.parquet(path).select("doc_id", "n_chars", F.lit(last.rows).cast("bigint").alias("done"), F.lit(rose).alias("rose"), F.lit(last.remaining == 0).alias("ended"))


@query("SELECT doc_id, n_chars, abs(doc_id % 3) AS batch FROM documents")
def k02_k05_replayed_batches(spark, sf_dir):
    """Three batches, one of which runs twice and one of which first broke off before its marker."""
    path = scratch(spark, "batches")
    part = lambda k: table(spark, sf_dir, "documents").where(F.abs(F.col("doc_id") % 3) == k).select("doc_id", "n_chars")
    for k in (0, 1, 1):
        batches.commit(part(k), path, k)
    part(2).write.parquet(f"{path}/data/batch=2/attempt={'0' * 32}")  # without a marker it isn't there
    batches.commit(part(2), path, 2)
    return batches.read(spark, path, "doc_id BIGINT, n_chars BIGINT")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0")
def j05_u02_keyed_resume(spark, sf_dir):
    """What a log of a compacted base and a batch since lacks of all documents."""
    path, keys, schema = scratch(spark, "keyed"), ["doc_id"], "doc_id BIGINT, n_chars BIGINT"
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    batches.commit(d.where("doc_id % 5 IN (1, 2)"), path, 0)
    batches.commit(d.where("doc_id % 5 IN (2, 3, 4)"), path, 1)
    keyed_log.compact(spark, path, schema, keys, per_bucket=20_000)
    batches.commit(d.where("doc_id % 7 = 0"), path, 2)
    return keyed_log.remaining(d, path, schema, keys)


@query("""WITH parts AS (SELECT source, n_chars % 500 AS k, CAST(doc_id % 2 AS BIGINT) AS batch, max_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY ALL)
SELECT source, k, max_by(n_chars, batch) AS n_chars, max(batch) AS batch FROM parts GROUP BY source, k""")
def u02_a03_compacted_log(spark, sf_dir):
    """The last row of each key from a base and a batch that was compacted into it."""
    path, keys, schema = scratch(spark, "compacted"), ["source", "k"], "source STRING, k BIGINT, n_chars BIGINT"
    for b in (0, 1):
        part = table(spark, sf_dir, "documents").where(F.abs(F.col("doc_id") % 2) == b).select("source", (F.col("n_chars") % 500).alias("k"), "n_chars", "doc_id")
        batches.commit(keyed.last_wins(part, keys, "doc_id").drop("doc_id"), path, b)
        keyed_log.compact(spark, path, schema, keys, per_bucket=20_000)
    return keyed_log.current(spark, path, schema, keys)


@query("SELECT source, n_chars, 1 AS n FROM documents GROUP BY source, n_chars")
def a03_j05_stream_once(spark, sf_dir):
    """A stream of documents in several micro-batches of which each key goes through once, by keyed state."""
    source, path, keys, schema = scratch(spark, "stream"), scratch(spark, "once"), ["source", "n_chars"], "source STRING, n_chars BIGINT"
    table(spark, sf_dir, "documents").select(*keys).repartition(6).write.parquet(source)
    items = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    batches.stream(items, path, schema, keys, lambda df: df, scratch(spark, "states"), once=True, remaining=lambda df: df).awaitTermination()
    return batches.read(spark, path, schema).groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT conv_id, turn, 'turns → ' || role AS path FROM conversations")
def t01_t02_many_trees(spark, sf_dir):
    """Each conversation as a document, its turns as leaves below their roles; a text that looks like a leaf isn't one."""
    c = table(spark, sf_dir, "conversations")
    turn = F.struct(F.col("turn").alias("surah"), F.lit(0).alias("ayat"), F.lit('[{"surah": 1, "ayat": 1}]').alias("text"))
    by_role = c.groupBy("conv_id", "role").agg(F.collect_list(turn).alias("turns")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "turns"))).alias("roles"))
    documents = by_role.select("conv_id", F.to_json(F.struct(F.struct("roles").alias("unused"), F.col("roles").alias("turns"))).alias("value"))
    found = tree.leaves(documents, carry=["conv_id"]).where(F.col("path")[0] == "turns")
    return found.select("conv_id", F.col("surah").cast("bigint").alias("turn"), T.path_text(F.col("path")).alias("path"))


@query("""WITH verses AS (SELECT doc_id % 500 AS k, arg_max_null(source || ':' || n_chars, doc_id) AS text_id FROM documents GROUP BY doc_id % 500)
SELECT l.doc_id AS question, l.doc_id % 600 AS k, CASE WHEN v.k IS NULL THEN '' ELSE text_id END AS text_id FROM labels l LEFT JOIN verses v ON v.k = l.doc_id % 600 WHERE l.toxic = 0""")
def j04_last_verse(spark, sf_dir):
    """Accepted pairs with their verse, of which there are many for a key: the last counts."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question"), F.lit("").alias("answer"), F.lit("").alias("difficulty"), (F.col("doc_id") % 600).alias("k"), "toxic")
    verses = table(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("k"), F.concat("source", F.lit(":"), "n_chars").alias("text_id"), F.array().cast("array<array<string>>").alias("theme_paths"), F.col("doc_id").alias("seq"))
    accepted = marks.where("toxic = 0").drop("toxic")
    return sheets.validation_set(accepted, accepted, verses, ["k"], "seq").select("question", "k", "text_id")


@query("""WITH labels_ AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'evaluator ' || upper(lang) WHEN 1 THEN 'Evaluato r ' || lang WHEN 2 THEN source ELSE 'Evaluator ' || lang END AS name FROM documents),
plain AS (SELECT doc_id, name, [levenshtein(lower(replace(name, ' ', '')), 'evaluatoren'), levenshtein(lower(replace(name, ' ', '')), 'evaluatorfr')] AS d FROM labels_ WHERE name NOT IN ('Evaluator en', 'Evaluator fr'))
SELECT doc_id, name AS nama_evaluator, CASE WHEN least(d[1], d[2]) > 1 THEN NULL WHEN d[1] <= d[2] THEN 'Evaluator en' ELSE 'Evaluator fr' END AS meant FROM plain""")
def j10_x10_stray_evaluators(spark, sf_dir):
    """Labels under a misspelt evaluator, and the one that was meant."""
    k, lang = F.col("doc_id") % 5, F.col("lang")
    name = F.when(k == 0, F.concat(F.lit("evaluator "), F.upper(lang))).when(k == 1, F.concat(F.lit("Evaluato r "), lang)).when(k == 2, F.col("source")).otherwise(F.concat(F.lit("Evaluator "), lang))
    labels = table(spark, sf_dir, "documents").select("doc_id", name.alias("nama_evaluator"))
    return sheets.stray_labels(labels, ["Evaluator en", "Evaluator fr"], most=1)
