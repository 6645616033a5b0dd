"""The resumable log: batches of results appended to a sink, and a stream that does so.

A batch is a checkpoint: what is in the log isn't asked again. Tasks that run
twice may append a key twice; readers take the last row of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concord.operators import keyed
from concord.sources.readers import read_log, read_optional
from concord.sources.writers import write_lines


def current(spark: SparkSession, path: str, schema: str, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The log's last row for each key; no rows if there is no log."""
    return keyed.last_wins(read_optional(spark, path, schema, read_log), keys, seq)


def resume(items: DataFrame, path: str, schema: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], batch: int = 0, batches: int = 1, seq: str = "seq") -> int:
    """Work on the items that the log lacks, in `batches` parts by key, each appended when it is done; returns the next batch number."""
    spark = items.sparkSession
    for k in range(batches):
        left = keyed.remaining(items, read_optional(spark, path, schema, read_log), keys)
        part = left.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == k) if batches > 1 else left
        write_lines(work(part).withColumn(seq, F.lit(batch + k).cast("bigint")), path, append=True)
    return batch + batches


def stream(items: DataFrame, path: str, schema: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], checkpoint: str, seq: str = "seq") -> StreamingQuery:
    """The same for a stream of items: each micro-batch appends what the log lacks."""

    def append(df: DataFrame, number: int) -> None:
        left = keyed.remaining(df, read_optional(df.sparkSession, path, schema, read_log), keys)
        write_lines(work(left).withColumn(seq, F.lit(number).cast("bigint")), path, append=True)

    return items.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
