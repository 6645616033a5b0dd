"""Queries of the engine's operators over the driver's tables, each with its SQL.

Raters of documents: A by length, B by language, C by a character, D and E by
labels. Question and answer pairs are neighbouring turns. Paths lead from a
region over a nation to a part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import prompts as P
from concord.functions import text as T
from concord.functions import verdicts as V
from concord.operators import agreement, keyed, sheets
from concord.shared import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
RATERS = ("A", "B", "C")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _verdict(c: Column) -> Column:
    return F.when(c, V.SUPPORTED).otherwise(V.NOT_SUPPORTED)


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, A to E as verdicts; A is EMPTY between 300 and 400 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", F.contains("text", F.lit("@")).alias("at"))
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    a = F.when((F.col("n_chars") >= 300) & (F.col("n_chars") < 400), V.EMPTY).otherwise(_verdict(F.col("n_chars") >= 300))
    return d.join(marks, "doc_id", "left").select(
        "doc_id", a.alias("A"), _verdict(F.col("lang").isin("en", "fr")).alias("B"), _verdict(~F.col("at")).alias("C"),
        F.when(F.col("quality").isNotNull(), _verdict(F.col("quality") == 1)).alias("D"), F.when(F.col("toxic").isNotNull(), _verdict(F.col("toxic") == 0)).alias("E"),
    )


RATED = """
rated AS (SELECT d.doc_id,
  CASE WHEN n_chars >= 300 AND n_chars < 400 THEN 'EMPTY' WHEN n_chars >= 300 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS A,
  CASE WHEN lang IN ('en', 'fr') THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS B,
  CASE WHEN NOT contains(text, '@') THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS C,
  CASE quality WHEN 1 THEN 'SUPPORTED' WHEN 0 THEN 'NOT_SUPPORTED' END AS D,
  CASE toxic WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'NOT_SUPPORTED' END AS E
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
coded AS (SELECT doc_id,
  CASE A WHEN 'SUPPORTED' THEN 1 WHEN 'NOT_SUPPORTED' THEN 0 END AS A, CASE B WHEN 'SUPPORTED' THEN 1 WHEN 'NOT_SUPPORTED' THEN 0 END AS B,
  CASE C WHEN 'SUPPORTED' THEN 1 WHEN 'NOT_SUPPORTED' THEN 0 END AS C, CASE D WHEN 'SUPPORTED' THEN 1 WHEN 'NOT_SUPPORTED' THEN 0 END AS D,
  CASE E WHEN 'SUPPORTED' THEN 1 WHEN 'NOT_SUPPORTED' THEN 0 END AS E FROM rated),
human AS (SELECT doc_id, CAST(coalesce(A, 0) + coalesce(B, 0) + coalesce(C, 0) >= 2 AS INT) AS llm, CAST(D + E >= 1 AS INT) AS hum
  FROM coded WHERE D IS NOT NULL AND E IS NOT NULL)
"""
WITH = f"WITH {RATED}"


def coded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *[V.encode(F.col(c)).alias(c) for c in "ABCDE"])


def human_subset(df: DataFrame) -> DataFrame:
    """Items that both people labelled; missing model verdicts count as no vote."""
    c = coded(df).dropna(subset=["D", "E"])
    return c.select("doc_id", V.at_least(V.votes(RATERS), 2).alias("llm"), V.at_least(V.votes(["D", "E"]), 1).alias("hum"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


KAPPA = "round(CASE WHEN 1 - pe <> 0 THEN (po - pe) / (1 - pe) END, 6) AS kappa"


@query(WITH + "SELECT doc_id, A, B, C, D, E FROM coded")
def p06_encode(spark, sf_dir):
    return coded(rated(spark, sf_dir))


@query(WITH + """SELECT doc_id, coalesce(A, 0) + coalesce(B, 0) + coalesce(C, 0) AS votes,
  CAST(coalesce(A, 0) + coalesce(B, 0) + coalesce(C, 0) >= 2 AS INT) AS majority, CAST(coalesce(A, 0) + coalesce(B, 0) + coalesce(C, 0) = 3 AS INT) AS strict FROM coded""")
def p08_p10_p11_votes(spark, sf_dir):
    c = coded(rated(spark, sf_dir))
    votes = V.votes(RATERS)
    return c.select("doc_id", votes.alias("votes"), V.at_least(votes, 2).alias("majority"), V.at_least(votes, 3).alias("strict"))


@query(WITH + "SELECT doc_id, CAST((A = 'SUPPORTED')::INT + (B = 'SUPPORTED')::INT + (C = 'SUPPORTED')::INT AS INT) AS votes FROM rated")
def p09_text_votes(spark, sf_dir):
    return rated(spark, sf_dir).select("doc_id", V.text_votes(RATERS).alias("votes"))


@query(WITH + "SELECT doc_id, llm, hum FROM human")
def p12_p18_human_subset(spark, sf_dir):
    return human_subset(rated(spark, sf_dir))


@query(WITH + "SELECT doc_id FROM rated WHERE NOT (A = 'SUPPORTED' AND B = 'SUPPORTED' AND C = 'SUPPORTED') AND A <> '' AND B <> '' AND C <> ''")
def p13_p14_p15_non_strict(spark, sf_dir):
    return rated(spark, sf_dir).where(V.none_blank(RATERS) & ~V.all_supported(RATERS)).select("doc_id")


@query(WITH + "SELECT doc_id, A, B, C FROM rated WHERE A = 'NOT_SUPPORTED' OR B = 'NOT_SUPPORTED' OR C = 'NOT_SUPPORTED'")
def p16_disagreement(spark, sf_dir):
    return rated(spark, sf_dir).where(V.any_not_supported(RATERS)).select("doc_id", *RATERS)


@query(WITH + "SELECT count(*) AS items, round(avg((coalesce(A, 0) + coalesce(B, 0) + coalesce(C, 0) >= 2)::INT::DOUBLE), 6) AS majority, round(avg((coalesce(A, 0) + coalesce(B, 0) + coalesce(C, 0) = 3)::INT::DOUBLE), 6) AS strict FROM coded")
def a05_a06_rates(spark, sf_dir):
    votes = V.votes(RATERS)
    return rounded(agreement.rates(coded(rated(spark, sf_dir)), majority=votes >= 2, strict=votes == 3), "majority", "strict")


@query(WITH + """SELECT count(*) FILTER (A = 'SUPPORTED' AND B = 'SUPPORTED') AS tp, count(*) FILTER (A = 'NOT_SUPPORTED' AND B = 'NOT_SUPPORTED') AS tn,
  count(*) FILTER (A = 'SUPPORTED' AND B = 'NOT_SUPPORTED') AS fp, count(*) FILTER (A = 'NOT_SUPPORTED' AND B = 'SUPPORTED') AS fn FROM rated""")
def a07_confusion(spark, sf_dir):
    return rated(spark, sf_dir).agg(*[c.alias(k) for k, c in agreement.confusion("A", "B").items()])


@query(WITH + "SELECT llm, hum, count(*) AS n FROM human GROUP BY llm, hum")
def a08_crosstab(spark, sf_dir):
    return agreement.crosstab(human_subset(rated(spark, sf_dir)), "llm", "hum")


COHEN = """counts AS (SELECT count(*) AS n, count(*) FILTER (x = 'SUPPORTED' AND y = 'SUPPORTED') AS tp, count(*) FILTER (x = 'NOT_SUPPORTED' AND y = 'NOT_SUPPORTED') AS tn,
  count(*) FILTER (x = 'SUPPORTED' AND y = 'NOT_SUPPORTED') AS fp, count(*) FILTER (x = 'NOT_SUPPORTED' AND y = 'SUPPORTED') AS fn,
  count(*) FILTER (x = 'SUPPORTED') AS sx, count(*) FILTER (y = 'SUPPORTED') AS sy FROM pairs),
parts AS (SELECT (tp + tn)::DOUBLE / {n} AS po, sx::DOUBLE / {n} * (sy::DOUBLE / {n}) + (1 - sx::DOUBLE / {n}) * (1 - sy::DOUBLE / {n}) AS pe FROM counts)
SELECT round(po, 6) AS observed, """ + KAPPA + " FROM parts"


@query(WITH + ", pairs AS (SELECT A AS x, B AS y FROM rated), " + COHEN.format(n="n"))
def a09_a12_cohen_all_rows(spark, sf_dir):
    return rounded(agreement.cohen(rated(spark, sf_dir), "A", "B", "all_rows"), "observed", "kappa")


@query(WITH + ", pairs AS (SELECT A AS x, B AS y FROM rated), " + COHEN.format(n="(tp + tn + fp + fn)"))
def a10_a13_cohen_pairwise(spark, sf_dir):
    return rounded(agreement.cohen(rated(spark, sf_dir), "A", "B", "pairwise"), "observed", "kappa")


@query(WITH + ", pairs AS (SELECT CASE llm WHEN 1 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS x, CASE hum WHEN 1 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS y FROM human), " + COHEN.format(n="n"))
def a11_a14_cohen_listwise(spark, sf_dir):
    h = human_subset(rated(spark, sf_dir)).select(_verdict(F.col("llm") == 1).alias("x"), _verdict(F.col("hum") == 1).alias("y"))
    return rounded(agreement.cohen(h, "x", "y", "listwise"), "observed", "kappa")


@query(WITH + ", pairs AS (SELECT 'A' AS rater1, 'B' AS rater2, A AS x, B AS y FROM rated UNION ALL SELECT 'A', 'C', A, C FROM rated UNION ALL SELECT 'B', 'C', B, C FROM rated), " + COHEN.replace("SELECT count(*) AS n,", "SELECT rater1, rater2, count(*) AS n,").replace("FROM pairs)", "FROM pairs GROUP BY rater1, rater2)").replace("parts AS (SELECT ", "parts AS (SELECT rater1, rater2, ").replace("SELECT round(po", "SELECT rater1, rater2, round(po").format(n="(tp + tn + fp + fn)"))
def a15_pairwise(spark, sf_dir):
    return rounded(agreement.pairwise_cohen(rated(spark, sf_dir), RATERS), "observed", "kappa")


FLEISS = """marks AS ({marks}), parts AS (SELECT count(*) AS items, avg((s * s + ({n} - s) * ({n} - s) - {n}) / ({n} * ({n} - 1.0::DOUBLE))) AS po, avg(s) / {n} AS p FROM marks),
chance AS (SELECT *, p * p + (1 - p) * (1 - p) AS pe FROM parts) SELECT items, """ + KAPPA + " FROM chance"


@query(WITH + ", " + FLEISS.format(n=3, marks="SELECT ((A = 'SUPPORTED')::INT + (B = 'SUPPORTED')::INT + (C = 'SUPPORTED')::INT)::DOUBLE AS s FROM rated"))
def a16_fleiss_three(spark, sf_dir):
    return rounded(agreement.fleiss(rated(spark, sf_dir), RATERS), "kappa")


@query(WITH + ", " + FLEISS.format(n=5, marks="SELECT (A + B + C + D + E)::DOUBLE AS s FROM coded WHERE A IS NOT NULL AND B IS NOT NULL AND C IS NOT NULL AND D IS NOT NULL AND E IS NOT NULL"))
def a17_fleiss_five(spark, sf_dir):
    return rounded(agreement.fleiss(rated(spark, sf_dir), ["A", "B", "C", "D", "E"], "listwise"), "kappa")


ALPHA = """longs AS (SELECT doc_id AS item, v FROM ({source}) UNPIVOT (v FOR r IN (A, B, C, D, E))),
by_value AS (SELECT item, v, count(*) AS n FROM longs GROUP BY item, v), units AS (SELECT item, sum(n) AS m, sum(n * n) AS q FROM by_value GROUP BY item HAVING sum(n) > 1),
d AS (SELECT sum((m * m - q)::DOUBLE / (m - 1)) AS d, sum(m)::DOUBLE AS total FROM units),
e AS (SELECT sum(n::DOUBLE * n) AS same FROM (SELECT v, sum(n) AS n FROM by_value WHERE item IN (SELECT item FROM units) GROUP BY v))
SELECT round(1 - d * (total - 1) / (total * total - same), 6) AS alpha FROM d, e"""


@query(WITH + ", full_rows AS (SELECT * FROM coded WHERE A IS NOT NULL AND B IS NOT NULL AND C IS NOT NULL AND D IS NOT NULL AND E IS NOT NULL), " + ALPHA.format(source="FROM full_rows"))
def a18_krippendorff(spark, sf_dir):
    c = coded(rated(spark, sf_dir)).dropna()
    return rounded(agreement.krippendorff(agreement.long_form(c, "doc_id", "ABCDE"), "doc_id"), "alpha")


@query(WITH + ", " + ALPHA.format(source="FROM coded"))
def a18_f19_krippendorff_missing(spark, sf_dir):
    return rounded(agreement.krippendorff(agreement.long_form(coded(rated(spark, sf_dir)), "doc_id", "ABCDE"), "doc_id"), "alpha")


# pairs of turns


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, question, answer: a user's turn and the assistant's next."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(reply, ["conv_id", "turn"])


PAIRS = "pairs AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


@query(f"WITH {PAIRS} SELECT conv_id, turn, question, answer FROM pairs WHERE question IS NOT NULL AND answer IS NOT NULL")
def p17_valid_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).where(F.col("question").isNotNull() & F.col("answer").isNotNull())


@query(f"WITH {PAIRS} SELECT conv_id, turn, 'Passage:\n' || coalesce(d.text, '') || '\nQuestion: ' || question || '\nAnswer: ' || answer AS content, 'Passage:\n' || coalesce(d.text, '') || '\nQuestion: ' || question || '\nAnswer: ' || answer || '\nOne word.' AS strict FROM pairs LEFT JOIN documents d ON d.doc_id = conv_id")
def e04_j07_judge_prompt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    found = keyed.enriched(pairs(spark, sf_dir), docs, ["conv_id"], {"text": F.lit("")})
    return found.select("conv_id", "turn", P.judgement("text")[1]["content"].alias("content"), P.judgement("text", strict=True)[1]["content"].alias("strict"))


@query(f"""WITH {PAIRS}, replies AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN ' supported' || chr(10) WHEN 1 THEN 'NOT_SUPPORTED.' WHEN 2 THEN 'NOT SUPPORTED' WHEN 3 THEN 'maybe' WHEN 4 THEN NULL ELSE 'unsupported' END AS content FROM pairs)
SELECT conv_id, turn, CASE WHEN contains(upper(content), 'NOT_SUPPORTED') THEN 'NOT_SUPPORTED' WHEN contains(upper(content), 'SUPPORTED') THEN 'SUPPORTED' ELSE 'EMPTY' END AS verdict FROM replies""")
def e08_f02_f03_parse_verdict(spark, sf_dir):
    k = (F.col("conv_id") + F.col("turn")) % 6
    content = F.when(k == 0, " supported\n").when(k == 1, "NOT_SUPPORTED.").when(k == 2, "NOT SUPPORTED").when(k == 3, "maybe").when(k == 4, F.lit(None)).otherwise("unsupported")
    return pairs(spark, sf_dir).select("conv_id", "turn", V.parse(content).alias("verdict"))


# keyed records


def urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of urgent orders; others have none."""
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def j01_lookup(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer")
    return keyed.matched(o, c, [("o_custkey", "c_custkey")], ["c_name"]).select("o_orderkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j02_unmatched(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), urgent(spark, sf_dir).withColumnRenamed("c_custkey", "o_custkey")
    return keyed.unmatched(c, o, [("c_custkey", "o_custkey")])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j03_semi_keeps_repeats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return keyed.only_keys(o, c, ["o_custkey"])


@query("SELECT d.doc_id, coalesce(CASE WHEN l.doc_id IS NULL THEN -1 ELSE l.quality END, -2) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j04_p05_enrich(spark, sf_dir):
    d, marks = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return keyed.enriched(d, marks, ["doc_id"], {"quality": F.lit(-1)})


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j05_j06_remaining(spark, sf_dir):
    return keyed.remaining(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(WITH + "SELECT doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM rated r WHERE r.doc_id = d.doc_id AND A = 'SUPPORTED' AND B = 'SUPPORTED')")
def j08_semi_with_predicate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sheets.consensus(d, rated(spark, sf_dir), ["A", "B"], 2, ["doc_id"])


@query(WITH + "SELECT doc_id, d.lang, d.source FROM documents d JOIN rated r USING (doc_id) WHERE (A = 'SUPPORTED')::INT + (B = 'SUPPORTED')::INT + (C = 'SUPPORTED')::INT >= 2")
def j09_consensus(spark, sf_dir):
    return sheets.consensus(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), rated(spark, sf_dir), RATERS, 2, ["doc_id"])


@query(WITH + ", longs AS (SELECT doc_id, 'D' AS who, D AS verdict FROM rated UNION ALL SELECT doc_id, 'E', E FROM rated) SELECT r.doc_id, r.A, min(verdict) FILTER (who = 'D') AS D, min(verdict) FILTER (who = 'E') AS E FROM rated r JOIN longs USING (doc_id) GROUP BY r.doc_id, r.A")
def j10_a04_f04_human_labels(spark, sf_dir):
    r = rated(spark, sf_dir)
    labels = r.select(F.concat_ws(":", "doc_id", F.lit(0)).alias("ID"), F.inline(F.array(*[F.struct(F.lit(w).alias("nama_evaluator"), F.col(w).alias("verdict"), F.lit(i).alias("seq")) for i, w in enumerate("DE")])))
    log = r.select(F.col("doc_id").cast("int").alias("doc_id"), "A")
    return sheets.with_human_labels(log, labels, {"D": "D", "E": "E"}, ["doc_id"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), "A", "D", "E")


@query(WITH + """SELECT CAST(r.doc_id AS VARCHAR) AS "ID", r.doc_id AS "Doc_id", coalesce(CASE WHEN b.item_id IS NULL THEN '' ELSE b.text END, '') AS "Verse_Text", d.source AS "Question", d.lang AS "Answer", '' AS "Difficulty_Model", '' AS "Theme_Paths", '' AS "Human_Verdict", '' AS "Error_Type", '' AS "Notes"
FROM rated r JOIN documents d ON d.doc_id = r.doc_id LEFT JOIN benchmark b ON b.item_id = r.doc_id WHERE NOT (A = 'SUPPORTED' AND B = 'SUPPORTED' AND C = 'SUPPORTED')""")
def j11_p03_annotation_sheet(spark, sf_dir):
    gold = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("question"), F.col("lang").alias("answer"), F.lit(None).cast("string").alias("difficulty"))
    verses = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("text_id"))
    return sheets.non_strict_sheet(rated(spark, sf_dir), gold, verses, RATERS, ["doc_id"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def a01_distinct_keys(spark, sf_dir):
    return keyed.distinct_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"])


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_partkey, path, ord: distinct region and nation of a part's suppliers."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name", "n_name")
    found = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "r_name", "n_name").distinct()
    return found.select("l_partkey", F.array("r_name", "n_name").alias("path"), F.array("r_name", "n_name").alias("ord"))


PART_PATHS = "steps AS (SELECT DISTINCT l_partkey, r_name, n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"


@query(f"WITH {PART_PATHS} SELECT l_partkey, string_agg(r_name || ' → ' || n_name, ' || ' ORDER BY r_name, n_name) AS themes FROM steps GROUP BY l_partkey")
def a02_f07_f08_paths(spark, sf_dir):
    found = keyed.collected_paths(part_paths(spark, sf_dir), ["l_partkey"])
    return found.select("l_partkey", T.paths_text(F.col("theme_paths")).alias("themes"))


@query(f"WITH {PART_PATHS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY r_name, n_name) AS k FROM steps) SELECT l_partkey, string_agg(k || '. ' || r_name || ' → ' || n_name, chr(10) ORDER BY k) AS themes, max(CASE WHEN k = 1 THEN r_name || ' → ' || n_name END) AS first_theme FROM numbered GROUP BY l_partkey")
def f09_o03_numbered_paths(spark, sf_dir):
    found = keyed.collected_paths(part_paths(spark, sf_dir), ["l_partkey"])
    return found.select("l_partkey", T.numbered_paths(F.col("theme_paths")).alias("themes"), T.path_text(T.first_path(F.col("theme_paths"))).alias("first_theme"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def a03_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("seq"))
    return keyed.last_wins(e, ["user_id", "event_type"], "seq").drop("seq")


@query("SELECT user_id, min_by(value, event_id) FILTER (event_type = 'click') AS click, min_by(value, event_id) FILTER (event_type = 'view') AS \"view\" FROM events GROUP BY user_id")
def a04_pivot_first(spark, sf_dir):
    return keyed.pivoted(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["click", "view"], "event_id")


@query("SELECT event_type AS outcome, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS usage FROM events GROUP BY event_type")
def a19_a20_f13_outcomes(spark, sf_dir):
    from concord.operators.judging import outcomes

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("outcome"), F.from_json("props", "k BIGINT")["k"].alias("usage"))
    return outcomes(e)


@query("SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u01_difference(spark, sf_dir):
    return keyed.missing_keys(table(spark, sf_dir, "customer"), urgent(spark, sf_dir), ["c_custkey"])


@query("SELECT c_custkey FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ORDER BY 1 LIMIT 20")
def o02_first_missing(spark, sf_dir):
    return keyed.missing_keys(table(spark, sf_dir, "customer"), urgent(spark, sf_dir), ["c_custkey"], most=20)


@query("SELECT DISTINCT n_regionkey, n_nationkey FROM nation ORDER BY 1, 2")
def o01_sorted_keys(spark, sf_dir):
    return keyed.distinct_keys(table(spark, sf_dir, "nation"), ["n_regionkey", "n_nationkey"]).orderBy("n_regionkey", "n_nationkey")


@query("SELECT user_id, event_id, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS k FROM (SELECT user_id, event_id, value, NULL AS props, event_id AS seq FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id, NULL, props, event_id + 1000000 FROM events WHERE event_id % 2 = 1)) WHERE k = 1")
def u02_union_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.where("event_id % 2 = 0").select("user_id", "event_id", "value", F.col("event_id").alias("seq"))
    new = e.where("event_id % 2 = 1").select("user_id", "event_id", "props", (F.col("event_id") + 1000000).alias("seq"))
    return keyed.last_wins(keyed.appended(old, new), ["user_id"], "seq").select("user_id", "event_id", "value", "props")


@query("SELECT c_custkey AS key, c_name AS title, c_acctbal AS score, '' AS note FROM customer")
def p01_p02_p04_projection(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("score"))
    return c.withColumns({"note": F.lit("")})


@query("SELECT l_orderkey, l_linenumber, l_orderkey || ':' || l_linenumber AS \"ID\", CAST(split_part(l_orderkey || ':' || l_linenumber, ':', 1) AS INT) AS k0, CAST(split_part(l_orderkey || ':' || l_linenumber, ':', 2) AS INT) AS k1 FROM lineitem")
def f04_f05_f06_key_text(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").withColumn("ID", T.key_text(["l_orderkey", "l_linenumber"]))
    return x.select("l_orderkey", "l_linenumber", "ID", T.key_part(F.col("ID"), 0).alias("k0"), T.key_part(F.col("ID"), 1).alias("k1"))


@query("SELECT c_custkey, 'Customer ' || c_name || ' of ' || c_mktsegment AS line, upper(c_mktsegment) AS up, contains(c_name, '1') AS has FROM customer")
def f02_f03_f11_template(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.format_string("Customer %s of %s", "c_name", "c_mktsegment").alias("line"), F.upper("c_mktsegment").alias("up"), F.contains("c_name", F.lit("1")).alias("has"))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation")
def f14_to_json(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("line"))


@query("SELECT conv_id, trim(string_agg(text, '' ORDER BY turn)) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def f01_f15_blocks(spark, sf_dir):
    blocks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("b")).where(F.exists("b", lambda x: x["text"].isNotNull()))
    return blocks.select("conv_id", T.strip(T.blocks_text(F.col("b"))).alias("text"))


@query("SELECT p_partkey, round(p_retailprice * 0.25, 2) AS rounded, p_size * p_size AS squared, pow(2.0, p_size % 5) AS wait, CASE WHEN p_size % 5 <> 0 THEN p_retailprice / (p_size % 5) END AS ratio FROM part")
def f16_f17_arithmetic(spark, sf_dir):
    k = F.col("p_size") % 5
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 0.25, 2).alias("rounded"), (F.col("p_size") * F.col("p_size")).alias("squared"), T.back_off(k).alias("wait"), F.try_divide("p_retailprice", k).alias("ratio"))


@query(WITH + "SELECT doc_id, CAST((A = 'SUPPORTED')::INT + (B = 'SUPPORTED')::INT AS INT) AS n, A = 'SUPPORTED' OR B = 'SUPPORTED' AS some, A = 'SUPPORTED' AND B = 'SUPPORTED' AS every FROM rated")
def f18_membership(spark, sf_dir):
    v = F.array("A", "B")
    return rated(spark, sf_dir).select("doc_id", T.count_of(v, V.SUPPORTED).alias("n"), F.exists(v, lambda x: x == V.SUPPORTED).alias("some"), F.forall(v, lambda x: x == V.SUPPORTED).alias("every"))


def e01_e02_e03_generation_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(F.array("source", "lang"), F.array("lang")).alias("paths"))
    one = P.generation(["doc_id"], "text"), P.generation(["doc_id"], "text", "paths"), P.generation(["doc_id"], "text", "paths", all_paths=True)
    return d.select("doc_id", *[p[1]["content"].alias(n) for p, n in zip(one, ("plain", "single", "multi"), strict=True)])


QUERIES["e01_e02_e03_generation_prompts"] = e01_e02_e03_generation_prompts
SQL["e01_e02_e03_generation_prompts"] = """SELECT doc_id, 'Passage ' || doc_id || ':\n' || coalesce(text, '') AS plain,
  'Passage ' || doc_id || ':\n' || coalesce(text, '') || '\nTheme: ' || source || ' → ' || lang AS single,
  'Passage ' || doc_id || ':\n' || coalesce(text, '') || '\nThemes:\n1. ' || source || ' → ' || lang || '\n2. ' || lang AS multi FROM documents"""


def t02_tree_paths(spark, sf_dir):
    """A tree of regions, nations and their keys, walked."""
    from concord.operators import tree

    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = F.struct(F.col("n_regionkey").alias("surah"), F.col("n_nationkey").alias("ayat"))
    by_region = n.groupBy("r_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", F.array(leaf).alias("leaf"))))).alias("m"))
    document = by_region.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "m")))).alias("value"))
    return tree.leaves(document).select("surah", "ayat", T.path_text(F.col("path")).alias("path"))


QUERIES["t02_tree_paths"] = t02_tree_paths
SQL["t02_tree_paths"] = "SELECT n_regionkey AS surah, n_nationkey AS ayat, r_name || ' → ' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey"


def t01_distinct_leaves(spark, sf_dir):
    from concord.operators import tree

    document = table(spark, sf_dir, "supplier").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("s_nationkey").alias("surah"), F.lit(0).alias("ayat")))).alias("list"))).alias("value"))
    return tree.distinct_leaves(document)


QUERIES["t01_distinct_leaves"] = t01_distinct_leaves
SQL["t01_distinct_leaves"] = "SELECT DISTINCT s_nationkey AS surah, 0 AS ayat FROM supplier"


@query("SELECT count(*) AS n FROM (SELECT 1 FROM documents WHERE source IS NULL OR lang IS NULL LIMIT 1)")
def s09_first_incomplete(spark, sf_dir):
    from concord.sources.readers import first_incomplete

    return first_incomplete(table(spark, sf_dir, "documents").select("source", "lang"), "source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT doc_id AS \"doc_id\", d.source AS question, d.lang AS answer, CAST(NULL AS VARCHAR) AS difficulty, CASE WHEN b.item_id IS NULL THEN '' ELSE b.text END AS text_id, '' AS used, '' AS full_paths FROM documents d JOIN rated r USING (doc_id) LEFT JOIN benchmark b ON b.item_id = doc_id WHERE A = 'NOT_SUPPORTED'")
def p02_j03_j04_validation_set(spark, sf_dir):
    gold = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("question"), F.col("lang").alias("answer"), F.lit(None).cast("string").alias("difficulty"))
    verses = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("text_id"), F.array().cast("array<array<string>>").alias("theme_paths"))
    found = sheets.validation_set(gold, rated(spark, sf_dir).where("A = 'NOT_SUPPORTED'"), verses, ["doc_id"])
    return found.select("doc_id", "question", "answer", "difficulty", "text_id", F.coalesce(T.path_text(F.col("theme_path_used_for_generation")), F.lit("")).alias("used"), T.paths_text(F.col("theme_paths_full")).alias("full_paths"))


@query(WITH + "SELECT doc_id, llm = hum AS same FROM human")
def p22_flags_equal(spark, sf_dir):
    return human_subset(rated(spark, sf_dir)).select("doc_id", (F.col("llm") == F.col("hum")).alias("same"))


@query("""WITH replies AS (SELECT doc_id, CASE WHEN n_chars < 200 THEN ' INSUFFICIENT_EVIDENCE ' WHEN doc_id % 4 = 0 THEN '{"question": "' || lang || '", "answer": "' || source || '"}' WHEN doc_id % 4 = 1 THEN 'no json' END AS content,
  CASE WHEN n_chars >= 200 AND doc_id % 4 > 1 THEN CASE doc_id % 4 WHEN 2 THEN 'status 400: content_filter' ELSE 'status 500' END END AS error FROM documents)
SELECT doc_id, CASE WHEN contains(error, 'content_filter') THEN 'filtered' WHEN trim(content) = 'INSUFFICIENT_EVIDENCE' THEN 'insufficient' WHEN content LIKE '{%' THEN 'ok' ELSE 'failed' END AS outcome,
  CASE WHEN content LIKE '{%' THEN json_extract_string(content, '$.question') END AS question FROM replies""")
def p19_p20_p21_route_replies(spark, sf_dir):
    from concord.operators.judging import routed

    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    reply = F.to_json(F.struct(F.col("lang").alias("question"), F.col("source").alias("answer")))
    content = F.when(F.col("n_chars") < 200, f" {P.INSUFFICIENT} ").when(k == 0, reply).when(k == 1, "no json")
    error = F.when((F.col("n_chars") >= 200) & (k > 1), F.when(k == 2, "status 400: content_filter").otherwise("status 500"))
    outcome, parsed = routed(content, error)
    return d.select("doc_id", outcome.alias("outcome"), parsed["question"].alias("question"))


@query("SELECT n_nationkey, r_name || ' → ' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey")
def f10_extended_path(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", T.path_text(T.with_step(F.array("r_name"), F.col("n_name"))).alias("path"))


@query("SELECT event_id, CASE WHEN props LIKE '{%' THEN 'object' WHEN props LIKE '[%' THEN 'list' ELSE 'scalar' END AS kind FROM events")
def f12_kind_of_node(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.node_kind(F.col("props")).alias("kind"))


@query("SELECT conv_id, turn, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS verdict_A FROM conversations")
def e09_raw_verdict(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip(F.col("text")).alias("verdict_A"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, user_id, event_type FROM events WHERE event_id % 5 = 0")
def s02_s03_k02_k03_log_round_trip(spark, sf_dir):
    """A log written in two batches and read strictly."""
    from concord.sources.readers import read_log
    from concord.sources.writers import write_lines

    path = scratch(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    write_lines(e.where("event_id % 5 <> 0"), path)
    write_lines(e.where("event_id % 5 = 0"), path, append=True)
    return read_log(spark, path, "event_id BIGINT, user_id BIGINT, event_type STRING", strict=True)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s01_k01_array_round_trip(spark, sf_dir):
    """A JSON array written and read."""
    from concord.sources.readers import read_array
    from concord.sources.writers import write_array

    path = scratch(spark, "nations.json")
    write_array(table(spark, sf_dir, "nation"), path)
    return read_array(spark, path, "n_nationkey INT, n_name STRING, n_regionkey INT")


@query("SELECT CAST(c_custkey AS VARCHAR) AS \"ID\", c_name AS verdict, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS error_type FROM customer")
def s05_s06_k04_sheet_round_trip(spark, sf_dir):
    """A delimited file with a header, NULL for null and spaces around a name, written and read."""
    from concord.sources.readers import read_labels

    path = scratch(spark, "labels")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("verdict"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias(" error_type"))
    c.write.csv(path, sep=";", header=True, nullValue="NULL", ignoreLeadingWhiteSpace=False)
    return read_labels(spark, path)


@query("SELECT user_id, event_id FROM events WHERE false")
def s07_missing_source(spark, sf_dir):
    from concord.sources.readers import read_optional

    return read_optional(spark, scratch(spark, "nothing"), "user_id BIGINT, event_id BIGINT")
