import time

import pytest
from pyspark.sql import functions as F

from concord.operators import progress


def slow(batches):
    for b in batches:
        time.sleep(0.3)
        yield b


def test_figures_rise_before_the_end(spark, tmp_path):
    df = spark.range(0, 1600, 1, 16).mapInPandas(slow, "id bigint")
    seen, ended = [], []

    def write(d):
        d.write.parquet(str(tmp_path / "out"))
        ended.append(len(seen))

    last = progress.watched(df, write, seen.append, total=1600, every=0.1)
    early = [p for p in seen[: ended[0]] if 0 < p.rows < 1600]
    assert early and all(0 < p.remaining and p.each > 0 for p in early)
    assert [p.rows for p in seen] == sorted(p.rows for p in seen) and len({p.rows for p in early}) > 1
    assert (last.rows, last.tasks, last.remaining) == (1600, last.of_tasks, 0.0) and seen[-1] == last
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1600


def test_without_a_total_tasks_tell(spark):
    p = progress.progress(50, 2, 8, 10.0)
    assert (p.each, p.remaining) == (0.2, 30.0)
    assert progress.progress(0, 0, 0, 1.0).remaining is None


def test_a_failure_is_raised(spark, tmp_path):
    df = spark.range(4).select(F.raise_error(F.lit("no such luck")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no such luck"):
        progress.watched(df, lambda d: d.write.parquet(str(tmp_path / "x")), lambda p: None)
