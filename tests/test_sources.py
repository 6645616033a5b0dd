import json
import zipfile

import pytest
from pyspark.sql import functions as F

from concord import schemas
from concord.sources import readers, writers
from concord.streaming import log


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"surah": 1, "ayat": 2}, {"surah": 1}]))
    assert [tuple(r) for r in readers.read_array(spark, str(tmp_path / "a.json"), schemas.KEY_LIST).collect()] == [(1, 2), (1, None)]
    good = '{"surah":1,"ayat":%d,"A":"SUPPORTED","B":"x","C":"y"}'
    (tmp_path / "log.jsonl").write_text("\n".join([good % 1, "bad{", "", good % 2, '{"surah":1}']))
    path = str(tmp_path / "log.jsonl")
    assert readers.read_log(spark, path, schemas.LOG_3).select("*").where("surah = 1").toPandas().shape[0] >= 2
    assert [r["ayat"] for r in readers.read_log(spark, path, schemas.LOG_3, required=("surah", "ayat", "A", "B", "C")).collect()] == [1, 2]
    assert [r[0] for r in readers.malformed_lines(spark, path, schemas.LOG_3).collect()] == ["bad{"]
    with pytest.raises(Exception):  # noqa: B017
        readers.read_log(spark, path, schemas.LOG_3, strict=True).collect()
    assert readers.read_optional(spark, str(tmp_path / "none"), schemas.LOG_3).count() == 0
    (tmp_path / "l.csv").write_text('"nama_evaluator";"ID";"verdict";" error_type "\n"D";"1:2";"SUPPORTED";NULL\n"E";"1:2";"NOT_SUPPORTED";"x;y"\n')
    got = readers.read_labels(spark, str(tmp_path / "l.csv"))
    assert got.columns == ["nama_evaluator", "ID", "verdict", "error_type"] and [r[3] for r in got.collect()] == [None, "x;y"]
    df = spark.createDataFrame([("q", "a"), (None, "b")], "question string, answer string")
    assert readers.first_incomplete(df, "question").count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "é → x", None)], "surah int, t string, n string")
    assert writers.write_array(df, str(tmp_path / "out.json")) == 1
    text = (tmp_path / "out.json").read_text(encoding="utf-8")
    assert json.loads(text) == [{"surah": 1, "t": "é → x", "n": None}] and "→" in text and '\n  {\n    "surah"' in text
    with pytest.raises(ValueError):
        writers.write_array(df.union(df), str(tmp_path / "x.json"), most=1)
    writers.write_sheet(df, str(tmp_path / "sheet"))
    assert spark.read.csv(str(tmp_path / "sheet"), header=True).count() == 1
    out = spark.createDataFrame([(1, "ok"), (2, "filtered"), (3, "failed")], "k int, outcome string")
    writers.write_outcomes(out, str(tmp_path / "r"), str(tmp_path / "f"))
    assert [spark.read.json(str(tmp_path / d)).count() for d in "rf"] == [1, 1]


def test_workbook(spark, tmp_path):
    rows = [(1, "é <&> \"q\"", True, 2.5), (2, " \n\x01_x0041_ ", None, float("nan")), (3, None, False, -1e300)]
    df = spark.createDataFrame(rows, "k int, `a b` string, f boolean, x double")
    path = str(tmp_path / "book.xlsx")
    assert writers.write_excel(df, path) == 3
    got = readers.read_workbook(spark, path)
    assert got.columns == df.columns
    assert [tuple(r) for r in got.collect()] == [("1", rows[0][1], "1", "2.5"), ("2", rows[1][1], None, "nan"), ("3", None, "0", "-1e+300")]
    with pytest.raises(ValueError):
        writers.write_excel(df, path, most=2)
    writers.write_excel(df.limit(0), path)
    assert readers.read_workbook(spark, path).count() == 0


def test_workbooks_of_any_length(spark, tmp_path):
    path = str(tmp_path / "books")
    df = spark.range(0, 100_010, numPartitions=2).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("é\n<&>"), "id")).alias("a b"))
    writers.write_workbooks(df, path, most=30_000)
    books = sorted((tmp_path / "books").glob("part-*"))
    assert len(books) == 4 and all(zipfile.ZipFile(b).testzip() is None for b in books)
    got = readers.read_workbook(spark, path)
    want = df.select(F.col("k").cast("string").alias("k"), "a b")
    assert got.columns == want.columns and got.count() == 100_010 and got.exceptAll(want).count() == 0
    assert readers.read_workbook(spark, str(books[0])).count() == 30_000
    writers.write_workbooks(df.limit(0), str(tmp_path / "none"))
    none = readers.read_workbook(spark, str(tmp_path / "none"))
    assert none.columns == want.columns and none.count() == 0


def test_workbook_query_beyond_one_workbook(spark, tmp_path):
    from concord.plans import audits

    c = spark.range(100_001).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit("m").alias("c_mktsegment"))
    c.write.parquet(str(tmp_path / "customer.parquet"))
    got = audits.k04_workbook(spark, str(tmp_path))
    assert got.agg(F.count("*"), F.count_distinct("ID"), F.count("Notes")).head() == (100_001, 100_001, 50_001)


def test_outcomes_are_read_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def work(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    df = spark.createDataFrame([(k, o) for k, o in enumerate(["ok", "filtered", "failed", "insufficient"])], "k int, outcome string").mapInPandas(work, "k int, outcome string")
    writers.write_outcomes(df, str(tmp_path / "r"), str(tmp_path / "f"))
    assert calls.value == 4 and [spark.read.json(str(tmp_path / d)).count() for d in "rf"] == [2, 1]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["f", "r"]


SCHEMA = "surah int, ayat int, A string, seq bigint"


def test_resume(spark, tmp_path):
    path, asked = str(tmp_path / "log"), spark.sparkContext.accumulator(0)

    def work(df):
        def each(batches):
            for b in batches:
                asked.add(len(b))
                yield b.assign(A="SUPPORTED")

        return df.mapInPandas(each, "surah int, ayat int, A string")

    items = spark.createDataFrame([(1, k) for k in range(5)], "surah int, ayat int")
    log.resume(items.where("ayat < 2"), path, SCHEMA, ["surah", "ayat"], work)
    assert asked.value == 2
    log.resume(items, path, SCHEMA, ["surah", "ayat"], work, batch=1, batches=2)
    assert asked.value == 5 and log.current(spark, path, SCHEMA, ["surah", "ayat"]).count() == 5


def test_stream(spark, tmp_path):
    spark.range(4).select(F.lit(1).alias("surah"), F.col("id").cast("int").alias("ayat")).write.parquet(str(tmp_path / "in"))
    items = spark.readStream.schema("surah int, ayat int").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "log")
    for _ in range(2):
        log.stream(items, path, SCHEMA, ["surah", "ayat"], lambda df: df.withColumn("A", F.lit("SUPPORTED")), str(tmp_path / "checkpoint")).awaitTermination()
    assert log.current(spark, path, SCHEMA, ["surah", "ayat"]).count() == 4


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
