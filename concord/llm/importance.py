"""Resampling by importance towards a target: hashed n-gram features, gains of buckets, a draw without replacement.

1. A text's features are all runs of 1 to n consecutive words, each in a bucket by
   its checksum. Texts over `chunk` bytes are split at word boundaries; a chunk
   carries the n-1 words that follow it, but owns only the features that begin in
   it. Chunks of long texts are dealt over the cluster, so that a few long texts
   don't hold up a task; the others stay where they are.
2. Bucket counts, summed by task before the shuffle, go to the driver for the
   documents and for the target: two arrays with a place for each bucket, whatever
   the corpus. A bucket's gain is its log ratio.
3. Counts and gains of chunks are summed by document; the mean gain is the weight.
4. Gumbel noise from the id's digest makes the largest scores a draw in proportion
   to the weights. Ranks come from the histogram of scores, whole numbers whose
   range depends on gains and noise only, and from the order within a score, so
   no task sorts all documents.

Checksums are computed a byte place at a time for all words of a chunk.

Defined cases: null and empty texts, and texts without words, have no features, a
weight of 0 and no rank; equal scores rank by smaller id, null last; repeated rows
each get a row and may each be drawn; a null id draws by the digest of the empty
id; an empty target gives every bucket the gain of a count of 0; extra columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import stored, text_or_empty
from concord.llm.wordhash import slices, text_buffers

BUCKETS = 10_000
CHUNK = 1 << 15

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Words as bytes; bytes of characters beyond ASCII are letters.
_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_NO_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_LONG = 64


def _crc_table() -> np.ndarray:
    """The register after a byte, from zero: the table of the reflected polynomial 0xEDB88320."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, (r >> 1) ^ np.uint32(0xEDB88320), r >> 1).astype(np.uint32)
    return r


_TABLE = _crc_table()


def split_at_words(text: bytes, chunk: int, carry: int) -> Iterator[tuple[bytes, int]]:
    """Chunks with the `carry` words that follow, and how many of a chunk's bytes are its own."""
    lo = 0
    while len(text) - lo > chunk:
        cut = _NO_WORD.search(text, lo + chunk)
        if cut is None:
            break
        own, at, more = text[lo : cut.start()], cut.start(), []
        while len(more) < carry and (word := _WORD_BYTES.search(text, at)):
            more.append(word[0])
            at = word.end()
        yield b" ".join([own, *more]), len(own)
        lo = cut.start()
    yield text[lo:], len(text) - lo


def _advanced(state: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Checksum registers after the bytes begin to end of data follow: a place of all words in a step, long words at once."""
    out = state.copy()
    length = end - begin
    for k in np.flatnonzero(length > _LONG):
        out[k] = zlib.crc32(data[begin[k] : end[k]].tobytes(), int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = np.flatnonzero(length <= _LONG)
    order = short[np.argsort((_LONG - length[short]).astype(np.uint8), kind="stable")]  # words that go on are a prefix
    lengths, at, r = length[order], begin[order], out[order]
    for k in range(int(lengths[0]) if len(lengths) else 0):
        m = int(np.searchsorted(-lengths, -k, "left"))
        r[:m] = _TABLE[(r[:m] ^ data[at[:m] + k]) & 0xFF] ^ (r[:m] >> np.uint32(8))
    out[order] = r
    return out


def features(data: np.ndarray, at: np.ndarray, own: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every feature that begins in its text's own bytes, and the words of each text. data: bytes; at: where texts begin, and the end."""
    data = _LOWER[data]
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(at, begin, "right") - 1
    mine = begin < at[text] + own[text]
    state = _advanced(np.full(len(begin), 0xFFFFFFFF, np.uint32), data, begin, end)
    found, owner = [(state ^ np.uint32(0xFFFFFFFF))[mine] % buckets], [text[mine]]
    for k in range(1, n):
        whole = np.flatnonzero(mine[: max(len(text) - k, 0)] & (text[:-k] == text[k:])) if len(text) > k else np.zeros(0, np.int64)
        r = np.full(len(begin), 0, np.uint32)
        r[whole] = state[whole]
        r[whole] = _TABLE[(r[whole] ^ np.uint32(0x20)) & 0xFF] ^ (r[whole] >> np.uint32(8))
        r[whole] = _advanced(r[whole], data, begin[whole + k], end[whole + k])
        state = r
        found.append((r[whole] ^ np.uint32(0xFFFFFFFF)) % buckets)
        owner.append(text[whole])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner), np.bincount(text[mine], minlength=len(at) - 1)


def chunked(docs: DataFrame, chunk: int, carry: int) -> DataFrame:
    """doc_id, copy (hash of the text), place, own and text (binary) of every chunk; those of long texts dealt out."""
    own = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("copy"), "text", F.octet_length("text").alias("size"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for i, copy, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                parts = [(i, copy, k, mine, data) for k, (data, mine) in enumerate(split_at_words(text, chunk, carry))]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*parts, strict=True), kinds, strict=True)], names=["doc_id", "copy", "place", "own", "text"])

    long = own.where(F.col("size") > chunk).select(F.col("doc_id").cast("bigint"), "copy", "text").mapInArrow(cut, "doc_id bigint, copy bigint, place int, own int, text binary")
    short = own.where(F.col("size") <= chunk).select(F.col("doc_id").cast("bigint"), "copy", F.lit(0).alias("place"), F.col("size").alias("own"), "text")
    return short.unionByName(long.repartition("copy", "place"))


def _parts(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for some in slices(batch, 4):
            data, at = text_buffers(some.column(4))
            yield some, *features(data, at, some.column(3).to_numpy().astype(np.int64), n, buckets)


def bucket_counts(docs: DataFrame, n: int = 2, buckets: int = BUCKETS, chunk: int = CHUNK) -> np.ndarray:
    """How many features of docs fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for _, found, _, _ in _parts(batches, n, buckets):
            sums += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(sums[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in chunked(docs, chunk, n - 1).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    s_all, t_all, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, n: int = 2, chunk: int = CHUNK) -> DataFrame:
    """doc_id, copy, n_words, n_features and weight of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, found, owner, n_words in _parts(batches, n, len(held.value)):
            count = np.bincount(owner, minlength=some.num_rows)
            sums = np.bincount(owner, held.value[found], some.num_rows)  # whole numbers, exact below 2**53
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), *(pa.array(x.astype(np.int64)) for x in (n_words, count, sums))], names=["doc_id", "copy", "place", "n_words", "n_features", "gain"])

    each = chunked(docs, chunk, n - 1).mapInArrow(weigh, "doc_id bigint, copy bigint, place int, n_words bigint, n_features bigint, gain bigint")
    sums = each.groupBy("doc_id", "copy").agg(F.count_if(F.col("place") == 0).alias("rows"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    one = sums.select("doc_id", "copy", "rows", *[F.expr(f"{c} div rows").alias(c) for c in ("n_words", "n_features", "gain")])  # repeated rows have equal sums
    weight = F.coalesce(F.expr("(gain - pmod(gain, nullif(n_features, 0))) div nullif(n_features, 0)"), F.lit(0).cast("bigint"))
    return one.select("doc_id", "copy", "n_words", "n_features", weight.alias("weight"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("nth"))


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, n: int = 2, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank, from 1, of the `percent` hundredths drawn among texts of enough words.

    target: a table with a column text, whose distribution is drawn towards.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, n, buckets, chunk), bucket_counts(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), n, buckets, chunk))
    scored = weighted(docs, gain, n, chunk)
    scored = stored(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    counts = scored.where(F.col("n_words") >= least_words).groupBy("score").count().orderBy(F.desc("score")).collect()  # a row a score: tens of thousands
    most = sum(r["count"] for r in counts) * percent // 100
    before, base = 0, []
    for r in counts:
        if before < most:
            base.append((r["score"], before))
        before += r["count"]
    bases = F.broadcast(spark.createDataFrame(base, "score bigint, before bigint"))
    open_ = F.col("n_words") >= least_words
    high = scored.where(open_).join(bases, "score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "copy", "nth")
    ranked = high.withColumn("rank", F.col("before") + F.row_number().over(order))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    low = scored.where(~open_).unionByName(scored.where(open_).join(bases, "score", "left_anti")).withColumn("rank", F.lit(None).cast("bigint"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(low.select(*columns))
