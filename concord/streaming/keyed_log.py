"""A large log by key: a base in buckets of bounded size with a Bloom filter, and the batches since.

`compact` merges the batches of `batches` into a new version of the base, a key's last
batch winning: rows lie in buckets by the hash of their key, one for each `per_bucket`
keys, and each bucket has a bitmap of sixteen bits a key. `remaining` tells what the
log lacks of a batch of items: first by the batches since; then by the bitmaps of the
buckets that the items fall in, of which most new keys are absent; only the buckets of
the others are read, and of those the keys alone. What a batch reads depends on the
batch and on the size of a bucket, and not on the base.

Compacting rewrites the base; run it when the batches since are a good part of it.
A version counts from its marker on, and the one before stays until the next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators import keyed
from concord.shared import file_system, held
from concord.streaming import batches

_MAP = 1 << 15  # bits of a bitmap that Spark builds
_BITS_A_KEY = 16


def _versions(spark: SparkSession, path: str) -> dict | None:
    """What the last version's marker says: folder, buckets, maps (bitmaps a bucket), rows and through (its last batch)."""
    fs, p = file_system(spark, f"{path}/versions")
    if not fs.exists(p):
        return None
    said = spark.read.text(f"{path}/versions").where("value LIKE '%}'").select(F.max(F.struct(F.col("_metadata.file_name").alias("n"), "value"))["value"]).first()[0]
    return json.loads(said) if said else None


def _placed(df: DataFrame, keys: Sequence[str], buckets: int, maps: int) -> DataFrame:
    """df with __bucket, and __map and __bit of its key in the bucket's bitmaps."""
    h = F.xxhash64(*keys)
    place = F.pmod(F.xxhash64(h, F.lit("bit")), F.lit(maps * _MAP))
    return df.withColumns({"__bucket": F.pmod(h, F.lit(buckets)).cast("int"), "__map": F.floor(place / _MAP).cast("int"), "__bit": (place % _MAP).cast("int")})


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at % 8) == 1


def compact(spark: SparkSession, path: str, schema: str, keys: Sequence[str], per_bucket: int = 1_000_000) -> int:
    """Merge the batches since the last version into a new one; returns its last batch. Nothing is done if there are none."""
    last = _versions(spark, path)
    since = last["through"] if last else -1
    found = batches.folders(spark, path, since)
    if not found:
        return since
    through = max(found)
    fresh = batches.read(spark, path, schema, since).where(F.col("batch") <= through)
    rows = (last["rows"] if last else 0) + fresh.count()
    buckets, maps = max(1, -(-rows // per_bucket)), max(1, -(-per_bucket * _BITS_A_KEY // _MAP))
    both = fresh.unionByName(_base(spark, last, schema)) if last else fresh
    folder = f"{path}/base/{uuid.uuid4().hex}"
    own = _placed(keyed.last_wins(both, keys, "batch"), keys, buckets, maps)
    own.drop("__map", "__bit").repartition("__bucket").write.partitionBy("__bucket").parquet(f"{folder}/rows")
    written = _placed(spark.read.schema(f"{schema}, batch BIGINT, __bucket INT").parquet(f"{folder}/rows").select(*keys), keys, buckets, maps)
    bits = written.groupBy("__bucket", "__map").agg(F.bitmap_construct_agg(F.col("__bit").cast("bigint")).alias("bits"), F.count(F.lit(1)).alias("n"))
    bits.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{folder}/bits")
    rows = spark.read.parquet(f"{folder}/bits").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fs, p = file_system(spark, f"{path}/versions/{through:015d}-{uuid.uuid4().hex}")
    out = fs.create(p, False)
    try:
        out.write(bytearray(json.dumps({"folder": folder, "buckets": buckets, "maps": maps, "rows": rows, "through": through}).encode()))
    finally:
        out.close()
    return through


def _base(spark: SparkSession, version: dict, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch BIGINT, __bucket INT").parquet(f"{version['folder']}/rows").drop("__bucket")


def current(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The log's last row for each key, with its batch."""
    last = _versions(spark, path)
    fresh = batches.read(spark, path, schema, last["through"] if last else -1)
    return keyed.last_wins(fresh.unionByName(_base(spark, last, schema)) if last else fresh, keys, "batch")


def remaining(items: DataFrame, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """Rows of items whose key the log lacks; keys that hold null are never in it."""
    spark = items.sparkSession
    last = _versions(spark, path)
    left = keyed.remaining(items, batches.read(spark, path, schema, last["through"] if last else -1), keys)
    if not last:
        return left
    left = held(_placed(left, keys, last["buckets"], last["maps"]), "items")
    names = lambda df: [r[0] for r in df.select("__bucket").distinct().collect()]  # noqa: E731  one for each bucket that the batch touches
    bits = spark.read.schema("__map INT, bits BINARY, __bucket INT").parquet(f"{last['folder']}/bits").where(F.col("__bucket").isin(names(left)))
    marked = left.join(bits, ["__bucket", "__map"], "left").withColumn("__maybe", F.coalesce(_is_set(F.col("bits"), F.col("__bit")), F.lit(False)))
    marked = held(marked.drop("bits", "__map", "__bit"), "marked")
    maybe = marked.where("__maybe")
    there = spark.read.schema(f"{schema}, batch BIGINT, __bucket INT").parquet(f"{last['folder']}/rows").where(F.col("__bucket").isin(names(maybe))).select(*keys)
    return marked.where("NOT __maybe").unionByName(keyed.remaining(maybe, there, keys)).select(*items.columns)
