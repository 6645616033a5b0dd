"""Batches that count once however often they run: data first, then a marker.

A batch's rows are written to a folder of this attempt, data/batch=N/attempt=X, and
then a marker commits/N names the attempt. Readers take the attempts that markers
name. A batch that runs again finds its marker and writes nothing; one that broke off
before its marker leaves a folder that nobody reads, until `sweep` removes it. Where
two runs of one batch end at once, the marker that is there first stands.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from concord.operators import keyed
from concord.shared import file_system

_ATTEMPT = 32


def _marker(path: str, batch: int) -> str:
    return f"{path}/commits/{batch:015d}"


def _named(spark: SparkSession, marker: str) -> str | None:
    """The attempt that a marker names; None if there is none, or one that broke off while it was written."""
    fs, p = file_system(spark, marker)
    if not fs.exists(p):
        return None
    with_name = fs.open(p)
    try:
        name = bytes(with_name.readNBytes(_ATTEMPT)).decode()
    finally:
        with_name.close()
    return name if len(name) == _ATTEMPT else None


def _mark(spark: SparkSession, path: str, batch: int, attempt: str) -> bool:
    """Name the attempt, unless another one is named."""
    marker = _marker(path, batch)
    fs, p = file_system(spark, marker)
    broken = fs.exists(p) and _named(spark, marker) is None
    try:
        out = fs.create(p, broken)  # fails if it is there
    except Py4JJavaError:
        if _named(spark, marker) is None:
            raise
        return False
    try:
        out.write(bytearray(attempt.encode()))
    finally:
        out.close()
    return _named(spark, marker) == attempt


def committed(spark: SparkSession, path: str, batch: int) -> bool:
    return _named(spark, _marker(path, batch)) is not None


def commit(df: DataFrame, path: str, batch: int) -> bool:
    """Write df as batch number `batch`, from 0; false, and nothing is done, if that batch is there."""
    spark = df.sparkSession
    if committed(spark, path, batch):
        return False
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/batch={batch}/attempt={attempt}")
    return _mark(spark, path, batch, attempt)


def folders(spark: SparkSession, path: str, after: int = -1) -> dict[int, str]:
    """The folder of each committed batch with a larger number than `after`: a row for each marker."""
    fs, p = file_system(spark, f"{path}/commits")
    if not fs.exists(p):
        return {}
    marks = spark.read.text(f"{path}/commits").select(F.col("_metadata.file_name").cast("bigint").alias("batch"), "value")
    rows = marks.where((F.col("batch") > after) & (F.length("value") == _ATTEMPT)).collect()
    return {r["batch"]: f"{path}/data/batch={r['batch']}/attempt={r['value']}" for r in rows}


def read(spark: SparkSession, path: str, schema: str, after: int = -1) -> DataFrame:
    """The rows of committed batches, each once, with the batch's number as `batch`."""
    found = folders(spark, path, after)
    if not found:
        return spark.createDataFrame([], StructType.fromDDL(f"{schema}, batch BIGINT"))
    rows = spark.read.schema(f"{schema}, batch BIGINT, attempt STRING").option("basePath", f"{path}/data").parquet(*found.values())
    return rows.drop("attempt")


def sweep(spark: SparkSession, path: str) -> int:
    """Remove attempts that no marker names, and return how many there were; not while batches are being written."""
    fs, p = file_system(spark, f"{path}/data")
    kept, gone = {f.rsplit("/", 1)[1] for f in folders(spark, path).values()}, 0
    for batch in fs.listStatus(p) if fs.exists(p) else ():
        for attempt in fs.listStatus(batch.getPath()):
            if attempt.getPath().getName() not in kept:
                gone += bool(fs.delete(attempt.getPath(), True))
    return gone


def stream(
    items: DataFrame, path: str, schema: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], checkpoint: str,
    once: bool = False, event_time: str | None = None, delay: str | None = None, remaining: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Work on what a stream of items brings and the committed batches lack, a batch for each micro-batch; one that runs again after a failure leaves one copy.

    once: of items that the stream repeats, within a micro-batch or across them, only
    the first goes on, by keyed state; else repeats within a micro-batch are all worked
    on. event_time and delay (an interval): state of keys older than that is given up,
    and repeats beyond it are found in the batches only. remaining: what is left of
    items, if not by a join with all committed batches (see `keyed_log`).
    """
    if once:
        items = items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys)) if event_time and delay else items.dropDuplicates(list(keys))

    def run(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        if not committed(spark, path, number):
            left = remaining(df) if remaining else keyed.remaining(df, read(spark, path, schema), keys)
            commit(work(left), path, number)

    return items.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
