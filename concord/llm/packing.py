"""Packing documents into sequences: shortest-pack-first over the length histogram.

1. Every document is tokenised, ends with the end id, and is cut at multiples of
   the sequence length. A row per piece keeps counts and a checksum, no ids.
2. The histogram of piece lengths, at most one count per possible length, goes to
   the driver. Lengths are placed longest first, each into the shortest open pack
   that has room; what is kept is how many packs have each pattern of lengths, so
   the work depends on the sequence length and not on the number of documents.
3. Patterns are joined back to the pieces by rank: the k-th piece of a length
   takes the k-th slot that patterns have for it. Ranks are sums over
   (partition, length) counts plus the place within the partition, so a length
   that a third of all pieces has is never gathered in one task.

The pieces are stored in the shared folder between 1 and 3: ranks are then those
of the rows that were counted, whatever executors are lost.

Defined cases: null text is empty and packs as its end id alone; repeated rows
are packed once each; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import stored, text_or_empty
from concord.llm.wordhash import slices

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, place bigint"
PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: A run of white space over which the merge loop's pattern would run out of stack; the tokenizer itself takes such texts.
_LONG_SPACE = re.compile(r"\s{1000}")

#: The published split of byte-level BPE into pre-tokens: a fixed value.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    Texts go to tiktoken's merge loop, built from the same tokenizer file, which
    gives the same ids several times as fast, if the file's merges are in the order
    of their ids; else to the tokenizer itself, which also takes texts that may
    hold special tokens or very long runs of white space. Nothing is kept between
    texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._merges()

    def _merges(self):
        about = json.loads(self.tokenizer.to_str())
        model, vocab = about["model"], about["model"].get("vocab", {})
        before = about.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not about.get("normalizer")
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges", [])] if plain else []
        if not merged or merged != sorted(merged) or merged[0] != 256:
            return None
        import tiktoken

        letters = _byte_alphabet()
        special = {t["content"] for t in about.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("merges", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast and "<|" not in text and not _LONG_SPACE.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 1) -> DataFrame:
    """A row per piece of at most `size` ids, with its place among those of its length in its partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen, tail = encoder(tokenizer), TaskContext.get().partitionId(), {}, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for some in slices(batch, 1):
                rows: list[tuple] = []
                for doc, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    view = memoryview(enc.encode(text) + tail)
                    n = len(view) // 4
                    for start in range(0, n, size):
                        length = min(size, n - start)
                        place = seen.get(length, 0)
                        seen[length] = place + 1
                        rows.append((doc, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n, part, place))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order) and how many packs have each; every pack's sum is `size` at most."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []  # ascending; the last is that of the shortest packs

    def put(room: int, pattern: list[int], count: int) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                pattern, count = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop()
                used = min(left, count)
                if count > used:
                    put(room, pattern, count - used)
                put(room - length, [*pattern, length], used)
                left -= used
            else:
                put(size - length, [length], left)
                left = 0
    return [x for room in rooms for x in open_[room]]


def slots(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset): ranks from the first on have consecutive sequences."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.setdefault(length, []).append((ranks.get(length, 0), sequence, offset))
            ranks[length] = ranks.get(length, 0) + count
            offset += length
        sequence += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kept = stored(pieces(docs, tokenizer, size, end_id), "pieces")
    counts = kept.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    table = slots(shortest_pack_first(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = kept.join(offsets, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("place")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for x in np.unique(length):
                own = length == x
                of = table[int(x)]
                k = np.searchsorted(of[:, 0], rank[own], "right") - 1
                sequence[own] = of[k, 1] + rank[own] - of[k, 0]
                offset[own] = of[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[x.split(" ")[0] for x in PACKED.split(", ")])

    return ranked.mapInArrow(place, PACKED)
