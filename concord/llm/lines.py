"""Line deduplication: a join of deletion neighbourhoods.

A line is removed if an earlier line of the corpus (by document id and line
number) is within `max_edits` edits of it: 0 or 1 insertion, deletion or
substitution of a character. Lines under `min_chars` characters are left alone.

Two lines are one substitution apart if deleting the same place from both gives
the same string, and one insertion apart if deleting a place from the longer
gives the shorter. So each line emits, as hashed keys, all strings with one
character deleted, with and without the place; lines that share a key with the
place, and lines whose own hash equals another's key without it, meet. Every line
is compared with the earliest of its key only, which is enough to tell whether
there is an earlier one and never lists all pairs; the edit distance is verified
on the texts.

Emitting neighbourhoods of all lines would multiply the corpus by the length of
its lines. Lines within one edit share their first or their last half, so lines
that share neither half with another line are left out first, and a line that
shares its first half has only places of the last deleted, and the other way
round: exact filters, since one edit touches one half only. Shared halves are
marked in a bitmap of fixed size (`bitmap_bits`); when it is fuller, more lines
emit keys than need to, no fewer.

Order and identity of a line are (document id, hash of the document's text, line
number): repeated rows are the same document, and each keeps what the first
keeps. Null text has no lines and stays null; an empty table gives an empty one;
other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import bitmap, in_bitmap, join_split, shuffled, split_by_bitmap, stored, text_or_empty
from concord.llm.wordhash import slices

_LINES = "lid bigint, lid2 bigint, doc bigint, copy bigint, no int"
_TEXTS = "lid bigint, lid2 bigint, doc bigint, copy bigint, no int, line string, sides int"
#: Odd multipliers of the hashes, and the inverse of the first modulo 2**64.
_BASE, _MIX, _PLACE = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_INVERSE = pow(_BASE, -1, 1 << 64)


def _lid(line: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(line), np.int64).tolist())


def _halves(line: str) -> list[tuple[int, int]]:
    """Tag (0: first, 1: last) and key of the characters that lines within one edit have in common: as many as half the shorter has."""
    n = len(line)
    out = []
    for m in {(n - 1) // 2, n // 2}:
        for tag, part in ((0, line[:m]), (1, line[n - m :])):
            out.append((tag, xxhash.xxh3_64_intdigest(part.encode(), seed=2 * m + tag) - (1 << 63)))
    return out


def neighbourhood(line: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Key of the line itself, keys of it with each place deleted, and those keys with the place."""
    n = len(line)
    with np.errstate(over="ignore"):
        c = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        c *= np.uint64(_MIX)
        c ^= c >> np.uint64(29)
        powers = np.empty(n + 1, np.uint64)
        powers[0] = 1
        powers[1:] = _BASE
        powers = np.multiply.accumulate(powers)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(c * powers[:n], out=sums[1:])
        deleted = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)

        def key(h: np.ndarray, size: int) -> np.ndarray:
            h = (h + np.uint64(size)) * np.uint64(_MIX)
            return h ^ (h >> np.uint64(31))

        whole = key(sums[-1:], n)
        without = key(deleted, n - 1)
        placed = (without + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_PLACE)) * np.uint64(_BASE)
        placed ^= placed >> np.uint64(32)
    return whole.view(np.int64)[0], without.view(np.int64), placed.view(np.int64)


def _documents() -> list[Column]:
    """doc, copy (hash of the text) and text."""
    text = text_or_empty()
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text")]


def _split(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[int, int, int, str]]:
    for doc, copy, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        for no, line in enumerate(text.split("\n")):
            if len(line) >= min_chars:
                yield doc, copy, no, line


def _columns(rows: list[tuple], names: str, *last: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *last]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in names.split(", ")])


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2):
                if rows := [(*_lid(line.encode()), doc, copy, no) for doc, copy, no, line in _split(some, min_chars)]:
                    yield _columns(rows, _LINES)

    return docs.select(*_documents()).mapInArrow(read, _LINES)


def _shared_halves(docs: DataFrame, min_chars: int) -> DataFrame:
    """Keys of halves that different lines have."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2):
                keys: dict[tuple[int, int], None] = {}
                for _, _, _, line in _split(some, min_chars):
                    lid = _lid(line.encode())[0]
                    keys.update(((half, lid), None) for _, half in _halves(line))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*keys, strict=True)], names=["half", "lid"])

    halves = docs.select(*_documents()).mapInArrow(read, "half bigint, lid bigint")
    return halves.groupBy("half").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi")).where("lo != hi").select("half")


def _texts(docs: DataFrame, shared: np.ndarray, min_chars: int) -> DataFrame:
    """Distinct lines with a shared half, which halves (1: first, 2: last), and their order as one number."""
    held = docs.sparkSession.sparkContext.broadcast(shared)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2):
                lines = list(_split(some, min_chars))
                halves = [_halves(x[3]) for x in lines]
                marks = iter(in_bitmap(held.value, np.array([h for x in halves for _, h in x], np.int64)).tolist())
                sides = [sum({1 << tag for tag, _ in x if next(marks)}) for x in halves]
                if rows := [(*_lid(line.encode()), doc, copy, no, line, side) for (doc, copy, no, line), side in zip(lines, sides, strict=True) if side]:
                    yield _columns(rows, _TEXTS, pa.string(), pa.int32())

    places = docs.select(*_documents()).mapInArrow(read, _TEXTS)
    distinct = places.groupBy("lid", "lid2").agg(F.min(F.struct("doc", "copy", "no")).alias("first"), F.first("line").alias("line"), F.first("sides").alias("sides"))
    # sorted by range: the ids then increase with the order of the lines
    return distinct.select("lid", "first.*", "line", "sides").orderBy("doc", "copy", "no").select("lid", "line", "sides", F.monotonically_increasing_id().alias("order"))


def _keys(texts: DataFrame) -> DataFrame:
    """key and twice the line's order, plus one if the key is that of the line itself."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 0, 1 << 17):  # 32 bytes a character
                keys, values = [], []
                for line, sides, order in zip(*(some.column(k).to_pylist() for k in range(3)), strict=True):
                    own, without, placed = neighbourhood(line)
                    n = len(line)
                    part = slice((n - 1) // 2 if not sides & 2 else 0, None if sides & 1 else n - (n - 1) // 2)
                    keys += [np.array([own]), without[part], placed[part]]
                    of = np.full(1 + 2 * len(without[part]), 2 * order)
                    of[0] += 1
                    values.append(of)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(values))], names=["key", "value"])

    return texts.select("line", "sides", "order").mapInArrow(emit, "key bigint, value bigint")


def _near(texts: DataFrame) -> DataFrame:
    """lid of the lines with an earlier line one edit away."""
    keys = _keys(texts)
    whole = F.col("value") % 2 == 1
    met = keys.groupBy("key").agg(F.min(F.when(whole, F.col("value"))).alias("own"), F.min(F.when(~whole, F.col("value"))).alias("cut"), F.max(F.when(~whole, F.col("value"))).alias("late"))
    met = met.where(F.col("cut").isNotNull() & (F.col("own").isNotNull() | (F.col("cut") != F.col("late")))).select("key", "own", "cut")
    # without a whole line under the key, it may be one with the place: the earliest of the others counts
    other = F.when(whole, F.col("cut")).otherwise(F.coalesce("own", "cut"))
    pairs = keys.join(shuffled(met), "key").select(F.floor(F.col("value") / 2).alias("order"), F.floor(other / 2).alias("with")).where(F.col("with") < F.col("order")).distinct()
    both = pairs.join(shuffled(texts.select("lid", "line", "order")), "order").join(shuffled(texts.select(F.col("order").alias("with"), F.col("line").alias("line2"))), "with")
    return both.where(F.levenshtein("line", "line2", 1).between(0, 1)).select("lid").distinct()


def removals(docs: DataFrame, max_edits: int = 1, min_chars: int = 20, bitmap_bits: int = 25) -> DataFrame:
    """doc, copy and removed (numbers of lines, from 0) of documents that lose lines."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    lines = _occurrences(docs, min_chars)
    twice = stored(lines.groupBy("lid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("lid"), "twice")
    if max_edits:
        shared = bitmap(_shared_halves(docs, min_chars), "half", bitmap_bits)
        texts = stored(_texts(docs, shared, min_chars), "texts")
        near = stored(_near(texts), "near")
    else:
        near = twice.limit(0)
    # only lines found twice, or near an earlier one, can go
    wanted = twice.withColumn("near", F.lit(False)).union(near.withColumn("near", F.lit(True))).groupBy("lid").agg(F.max("near").alias("near"))
    some = stored(lines.join(shuffled(wanted), "lid"), "lines")
    first = stored(some.groupBy("lid", "lid2").agg(F.min(F.struct("doc", "copy", "no")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    gone = join_split(some, first, ["lid", "lid2"], some.count()).where(F.col("near") | (F.col("first") != F.struct("doc", "copy", "no")))
    return gone.groupBy("doc", "copy").agg(F.collect_set("no").alias("removed"))


def deduplicate(docs: DataFrame, max_edits: int = 1, min_chars: int = 20, bitmap_bits: int = 25) -> DataFrame:
    """docs with the text less removed lines, and n_lines, n_removed; all rows are kept, those emptied as well."""
    gone = stored(removals(docs, max_edits, min_chars, bitmap_bits), "removed")
    # numbers for names: columns of docs may have any
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    marked = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], *_documents()[:2])
    # documents that lose nothing aren't moved
    flat = bitmap(gone.select(F.xxhash64("doc", "copy").alias("key")), "key", bitmap_bits)
    hit, rest = split_by_bitmap(marked, F.xxhash64("doc", "copy"), flat)
    both = hit.join(shuffled(gone), ["doc", "copy"], "left").unionByName(rest.withColumn("removed", F.lit(None).cast("array<int>")))
    text = F.col(f"c{kept.index('text')}")
    parts = F.split(text, "\n")
    left = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("removed", i)), "\n"))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    n_removed = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    own = [(left if c == "text" else F.col(f"c{k}")).alias(c) for k, c in enumerate(kept)]
    return both.select(*own, n_lines.alias("n_lines"), n_removed.alias("n_removed"))
