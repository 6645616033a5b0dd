"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: the six ASCII white-space characters. Python's
#: bytes.split() and bytes.lower() use exactly these and A-Z.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a string that isn't null, in order."""
    return F.array_remove(F.split(c, SPACE_CLASS), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, a temporary one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="concord-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that shuffles both sides.

    Spark takes the size of what mapInArrow returns for that of its input, and of a stored
    table for that of its compressed files, so it would broadcast tables that grow with the
    corpus, which the driver collects first.
    """
    return df.hint("shuffle_merge")


#: Rows of a table that may be broadcast: 10 MB or so of a hashed relation of a few numbers.
FEW_ROWS = 1 << 17


def sized(kept: DataFrame) -> DataFrame:
    """A stored table as a side of a join: shuffled unless its rows, which the footers of its files tell, are few."""
    return shuffled(kept) if kept.count() > FEW_ROWS else kept


def session_for_narrow_rows(spark: SparkSession, batch: int = 2000) -> SparkSession:
    """A session with the settings of spark in which batches for Python aren't bounded by bytes.

    Spark asks for a batch's bytes after every row, which takes several times as long as
    writing a row of a few numbers. Rows of unbounded size must be cut before they go to
    Python in this session: a batch has `batch` of them.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    return own


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits bits with those of the column's values (64-bit hashes) set: a filter of fixed size that may hold more, never less."""
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1  # numbers of bits begin with 1
    maps = df.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in maps.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect():  # 4 KB for each 32,768 bits
        out[4096 * (r["bucket"] - 1) : 4096 * r["bucket"]] = np.frombuffer(bytes(r["map"]), np.uint8)
    return out


def in_bitmap(flat: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values & (8 * len(flat) - 1)).astype(np.int64)
    return (flat[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def split_by_bitmap(df: DataFrame, key: Column, flat: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows whose key (a 64-bit hash, not null) may be in the bitmap, and the others."""
    held = df.sparkSession.sparkContext.broadcast(flat)

    @F.arrow_udf("boolean")
    def marked(values: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(held.value, values.to_numpy()))

    return df.where(marked(key)), df.where(~marked(key))


def join_split(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int, parts: int = 2000) -> DataFrame:
    """rows joined with keyed, which has a row for each key and n, the rows of that key; total: all rows.

    Keys with more than 1/parts of the rows, fewer than `parts` whatever the data, are
    broadcast: their rows stay where they are. Rows of the others are shuffled.
    """
    often = F.col("n") * parts > total
    hot = F.broadcast(keyed.where(often).drop("n"))
    cold = rows.join(F.broadcast(keyed.where(often).select(*keys)), keys, "left_anti").join(shuffled(keyed.where(~often).drop("n")), keys)
    return rows.join(hot, keys).unionByName(cold)
