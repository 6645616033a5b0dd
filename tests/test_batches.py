import shutil

import pytest
from pyspark.sql import functions as F

from concord.streaming import batches, keyed_log

SCHEMA, KEYS = "k BIGINT, v STRING", ["k"]


def rows(spark, ks, v="x"):
    return spark.createDataFrame([(k, v) for k in ks], SCHEMA)


def held(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    assert batches.read(spark, path, SCHEMA).count() == 0
    assert batches.commit(rows(spark, [1, 2]), path, 0) and not batches.commit(rows(spark, [1, 2]), path, 0)
    # a crash between data and marker
    with monkeypatch.context() as m:
        m.setattr(batches, "_mark", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            batches.commit(rows(spark, [3]), path, 1)
    assert held(batches.read(spark, path, SCHEMA)) == [(1, "x", 0), (2, "x", 0)]
    assert batches.commit(rows(spark, [3]), path, 1)
    assert held(batches.read(spark, path, SCHEMA)) == [(1, "x", 0), (2, "x", 0), (3, "x", 1)]
    # a marker that broke off while it was written
    (tmp_path / "commits" / f"{2:015d}").write_text("abc")
    assert not batches.committed(spark, path, 2) and batches.commit(rows(spark, [4]), path, 2)
    assert held(batches.read(spark, path, SCHEMA, after=0)) == [(3, "x", 1), (4, "x", 2)]
    assert batches.sweep(spark, path) == 1 and batches.read(spark, path, SCHEMA).count() == 4


def test_two_runs_of_a_batch_at_once(spark, tmp_path, monkeypatch):
    path, inner = str(tmp_path), batches._mark

    def late(*a):
        monkeypatch.setattr(batches, "_mark", inner)
        assert batches.commit(rows(spark, [1]), path, 0)  # the other run ends first
        return inner(*a)

    monkeypatch.setattr(batches, "_mark", late)
    assert not batches.commit(rows(spark, [1]), path, 0)
    assert held(batches.read(spark, path, SCHEMA)) == [(1, "x", 0)]


def test_a_stream_that_replays(spark, tmp_path):
    path, checkpoint, source = str(tmp_path / "log"), tmp_path / "ckpt", tmp_path / "in"
    items = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    work = lambda df: df.withColumn("v", F.upper("v"))
    rows(spark, [1, 2, 2]).coalesce(1).write.json(str(source))
    rows(spark, [2, 3]).coalesce(1).write.mode("append").json(str(source))
    batches.stream(items(), path, SCHEMA, KEYS, work, str(checkpoint)).awaitTermination()
    first = held(batches.read(spark, path, SCHEMA))
    assert sorted(r[:2] for r in first) in ([(1, "X"), (2, "X"), (2, "X"), (3, "X")], [(1, "X"), (2, "X"), (3, "X")])
    last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    for p in [*(checkpoint / "commits").glob(f"*{last}"), *(checkpoint / "commits").glob(f".{last}.crc")]:
        p.unlink()  # as if it had broken off at its very end
    batches.stream(items(), path, SCHEMA, KEYS, work, str(checkpoint)).awaitTermination()
    assert held(batches.read(spark, path, SCHEMA)) == first


def test_each_key_once_by_state(spark, tmp_path):
    schema = "k BIGINT, v STRING, at TIMESTAMP"
    for once in (dict(once=True), dict(once=True, event_time="at", delay="1 hour")):
        base = tmp_path / str(len(once))
        source = str(base / "in")
        items = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)  # noqa: B023, E731
        make = lambda ks: spark.createDataFrame([(k, "x") for k in ks], SCHEMA).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp")).coalesce(1)
        seen = []
        run = lambda: batches.stream(items(), str(base / "log"), schema, KEYS, lambda df: seen.append(df.count()) or df, str(base / "ckpt"), remaining=lambda df: df, **once).awaitTermination()  # noqa: B023, E731
        make([1, 1, 2]).write.json(source)
        run()
        make([2, 3, 3]).write.mode("append").json(source)
        run()  # a restart: state comes from the checkpoint
        assert [r[0] for r in held(batches.read(spark, str(base / "log"), schema))] == [1, 2, 3] and sum(seen) == 3
        shutil.rmtree(base)


def read_bytes(spark, action):
    """Bytes that an action's stages read from files."""
    sc = spark.sparkContext
    sc.setJobGroup("measured", "measured")
    before = set(sc.statusTracker().getJobIdsForGroup("measured"))
    try:
        action()
        stages = {s for j in sc.statusTracker().getJobIdsForGroup("measured") if j not in before for s in sc.statusTracker().getJobInfo(j).stageIds if sc.statusTracker().getStageInfo(s)}
        return sum(sc._jsc.sc().statusStore().lastStageAttempt(s).inputBytes() for s in stages)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_resume_reads_as_much_whatever_the_base(spark, tmp_path):
    read = {}
    for n in (4_000, 32_000):
        path = str(tmp_path / str(n))
        batches.commit(spark.range(n).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")), path, 0)
        assert keyed_log.compact(spark, path, SCHEMA, KEYS, per_bucket=1000) == 0
        items = rows(spark, [5, 77, n + 1, n + 2])
        got = []
        read[n] = read_bytes(spark, lambda: got.extend(r["k"] for r in keyed_log.remaining(items, path, SCHEMA, KEYS).collect()))  # noqa: B023
        assert sorted(got) == [n + 1, n + 2]
    assert read[32_000] < 1.5 * read[4_000]


def test_base_and_batches_since(spark, tmp_path):
    path = str(tmp_path)
    assert held(keyed_log.remaining(rows(spark, [1]), path, SCHEMA, KEYS)) == [(1, "x")]
    batches.commit(rows(spark, range(100), "old"), path, 0)
    batches.commit(rows(spark, range(50, 60), "new"), path, 1)
    assert keyed_log.compact(spark, path, SCHEMA, KEYS, per_bucket=16) == 1
    assert keyed_log.compact(spark, path, SCHEMA, KEYS) == 1  # nothing since
    batches.commit(rows(spark, [3, 200], "newest"), path, 2)
    for _ in range(2):
        got = {r["k"]: (r["v"], r["batch"]) for r in keyed_log.current(spark, path, SCHEMA, KEYS).collect()}
        assert got == {k: ("newest", 2) if k in (3, 200) else ("new", 1) if 50 <= k < 60 else ("old", 0) for k in [*range(100), 200]}
        items = spark.createDataFrame([(k, "y") for k in (0, 3, 99, 100, 100, 200, 201)] + [(None, "n")], SCHEMA)
        assert sorted(map(str, (r["k"] for r in keyed_log.remaining(items, path, SCHEMA, KEYS).collect()))) == ["100", "100", "201", "None"]
        keyed_log.compact(spark, path, SCHEMA, KEYS, per_bucket=16)
