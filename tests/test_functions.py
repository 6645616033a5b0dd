from pyspark.sql import functions as F

from concord.functions import prompts as P
from concord.functions import text as T
from concord.functions import verdicts as V


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_verdict_text(spark):
    got = values(spark, V.parse(F.col("x")), [" supported\n", "NOT_SUPPORTED.", "NOT SUPPORTED", "unsupported", "maybe", None])
    assert got == ["SUPPORTED", "NOT_SUPPORTED", "SUPPORTED", "SUPPORTED", "EMPTY", "EMPTY"]
    assert values(spark, V.parse(F.col("x"), F.col("x").isNotNull()), [None, "supported"]) == ["ERROR", "SUPPORTED"]


def test_votes_and_sets(spark):
    rows = [("SUPPORTED", "SUPPORTED", "EMPTY"), ("SUPPORTED", None, "NOT_SUPPORTED"), ("SUPPORTED", "SUPPORTED", "SUPPORTED"), ("", "SUPPORTED", "SUPPORTED")]
    df = spark.createDataFrame(rows, "A string, B string, C string")
    r = "ABC"
    assert [x[0] for x in df.select(V.text_votes(list(r))).collect()] == [2, 1, 3, 2]
    assert [x[0] for x in df.select(V.all_supported(list(r))).collect()] == [False, False, True, False]
    assert [x[0] for x in df.select(V.any_not_supported(list(r))).collect()] == [False, True, False, False]
    assert [x[0] for x in df.select(V.none_blank(list(r))).collect()] == [True, True, True, False]
    coded = df.select(*[V.encode(F.col(c)).alias(c) for c in r])
    assert [tuple(x) for x in coded.collect()][:2] == [(1, 1, None), (1, None, 0)]
    assert [x[0] for x in coded.select(V.votes(list(r))).collect()] == [2, 1, 3, 2]


def test_paths(spark):
    kind = "x array<array<string>>"
    rows = [[["a", "b"], ["c"]], [], None]
    assert values(spark, T.numbered_paths(F.col("x")), rows, kind) == ["1. a → b\n2. c", "None", "None"]
    assert values(spark, T.paths_text(F.col("x")), rows, kind) == ["a → b || c", "", ""]
    assert values(spark, T.first_path(F.col("x")), rows, kind) == [["a", "b"], [], []]


def test_text(spark):
    assert values(spark, T.strip(F.col("x")), ["\t a b\n ", " x ", ""]) == ["a b", "x", ""]
    assert values(spark, T.key_part(F.col("x"), 1), ["2:13", "2", "a:b"]) == [13, None, None]
    blocks = spark.createDataFrame([([("a",), (None,), ("b",)],)], "x array<struct<text:string>>")
    assert blocks.select(T.blocks_text(F.col("x"))).head()[0] == "ab"
    assert values(spark, T.half_even(F.col("x"), 1), [0.25, 0.35], "x double") == [0.2, 0.4]


def test_prompts(spark):
    df = spark.createDataFrame([(1, 2, "words", [["a", "b"], ["c"]]), (1, 3, None, None)], "surah int, ayat int, text_id string, p array<array<string>>")
    plain, one, all_ = (df.select(P.generation(["surah", "ayat"], paths=p, all_paths=a)[1]["content"]).collect() for p, a in ((None, False), ("p", False), ("p", True)))
    assert plain[0][0] == "Passage 1:2:\nwords" and plain[1][0] == "Passage 1:3:\n"
    assert one[0][0].endswith("Theme: a → b") and all_[0][0].endswith("1. a → b\n2. c") and all_[1][0].endswith("None")
