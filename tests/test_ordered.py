import json
import random

import pytest
from pyspark.sql import functions as F

from concord.operators import keyed
from concord.sources import ordered

SCHEMA = "k INT, v STRING"


def written(tmp_path, seed, files=3):
    """Logs with repeated keys, blank, cut and incomplete lines, and all their lines in order."""
    rng = random.Random(seed)
    lines = []
    for f in range(files):
        own = []
        for n in range(rng.randint(50, 400)):
            line = json.dumps({"k": rng.randrange(40), "v": f"{f}-{n}"})
            own.append(rng.choices([line, "", line[:9], '{"k": 3}', " \t"], [20, 1, 1, 1, 1])[0])
        (tmp_path / f"part-{f:02}.jsonl").write_text("\n".join(own) + "\n")
        lines += own
    return str(tmp_path), lines


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_lines_keep_the_order_of_files_and_splits(spark, tmp_path, small_splits):
    path, lines = written(tmp_path, 1)
    got = ordered.read_lines(spark, path)
    assert got.select("seq.split").distinct().count() > 5
    assert [r["value"] for r in got.orderBy("seq").collect()] == lines
    numbered = ordered.read_lines(spark, path, numbered=True).orderBy("seq").collect()
    assert [(r["seq"], r["value"]) for r in numbered] == list(enumerate(lines))


def test_last_line_of_a_key_wins(spark, tmp_path, small_splits):
    path, lines = written(tmp_path, 2)
    held = {}
    for line in lines:
        try:
            r = json.loads(line)
        except ValueError:
            continue
        if "v" in r:
            held[r["k"]] = r["v"]
    for numbered in (False, True):
        log = ordered.read_ordered(spark, path, SCHEMA, required=("k", "v"), numbered=numbered)
        assert {r["k"]: r["v"] for r in keyed.last_wins(log, ["k"], "seq").collect()} == held
        assert [(r["k"], r["v"]) for r in keyed.as_mapped(log, ["k"], "seq").orderBy("seq").collect()] == list(held.items())


def test_newer_files_last(spark, tmp_path):
    import os

    (tmp_path / "b.jsonl").write_text('{"k": 1, "v": "old"}\n')
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "new"}\n')
    os.utime(tmp_path / "b.jsonl", (1_000_000, 1_000_000))
    for order, v in ((("file_path",), "old"), (("file_modification_time",), "new")):
        assert keyed.last_wins(ordered.read_ordered(spark, str(tmp_path), SCHEMA, order=order), ["k"], "seq").first()["v"] == v


def test_sift_tells_lines_apart_in_one_scan(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    path, lines = written(tmp_path / "in", 3)
    full = [x for x in lines if x.strip()]
    bad = [x for x in full if not x.endswith("}")]
    lacking = [x for x in full if x == '{"k": 3}']
    records, others, counts = ordered.sift(spark, path, SCHEMA, str(tmp_path / "out"), required=("k", "v"))
    assert counts == {"record": len(full) - len(bad) - len(lacking), "incomplete": len(lacking), "malformed": len(bad)}
    assert [r["line"] for r in others.where("kind = 'malformed'").orderBy("seq").collect()] == bad
    assert [json.dumps({"k": r["k"], "v": r["v"]}) for r in records.orderBy("seq").collect()] == [x for x in full if x not in bad and x not in lacking]
    with pytest.raises(ValueError, match=f"{len(bad)} malformed and {len(lacking)} incomplete"):
        ordered.sift(spark, path, SCHEMA, str(tmp_path / "strict"), required=("k", "v"), strict=True)
    plan = ordered.read_told(spark, path, SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_empty_log(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("")
    assert ordered.read_lines(spark, str(tmp_path), numbered=True).count() == 0
    records, others, counts = ordered.sift(spark, str(tmp_path / "none.jsonl"), SCHEMA, str(tmp_path / "out"), strict=True)
    assert records.count() == others.count() == sum(counts.values()) == 0
    assert records.select(F.col("k"), F.col("v")).columns == ["k", "v"]
    with pytest.raises(ValueError, match="own columns"):
        ordered.read_told(spark, str(tmp_path), "line INT")
