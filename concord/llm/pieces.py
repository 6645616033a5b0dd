"""SentencePiece encoding and decoding by a relational lattice.

A text is split into words (each with the spaces before it, as U+2581), and words
into segments at places that no piece reaches over. The distinct segments of a
chunk of documents make the lattice: their substrings, bounded by the longest piece
that starts there, are exploded and equi-joined to the piece table, the edges found
are grouped by segment and end, and Spark's aggregate function folds them in order
of their ends into the scores of the best paths (Viterbi): of all segmentations the
one with the largest sum of scores, ties to the longer last piece. The path is then
read back from the scores. A character that is no piece is written as its bytes, if
need be. Decoding joins pieces and bytes again and restores spaces.

The scores are those of the model file. For a unigram model this is its own
encoding; for a BPE model it is the best-scoring segmentation over its pieces,
which its merges may not reach. Pieces that score less than other pieces which make
up the same text are on no best path and stay out of the lattice.

It runs several times as fast in a session from `common.session_for_narrow_rows`.
Nothing is shuffled: the substrings of a segment follow each other out of explode
and the broadcast join, so edges are grouped as they come, and the documents of a
slice of a chunk, packed, follow the segments that are new in it through the plan.
Slices are small: Spark's vectors of a column that goes to Python keep the size of
their largest batch and are zeroed at each, so one row of megabytes makes all later
batches dear. Edges carry their segment's number, and a slice whose segments didn't
come back complete before it raises an error. Rows are streamed; a task holds the ids
of the segments of one chunk. The fold takes ends in blocks
and carries the scores that pieces can reach, so a segment of any length is folded
in the same way. The piece table has the size of the vocabulary, at most
`MOST_PIECES`, and is broadcast.

Segments are told apart by 64-bit hashes; each document is decoded again from its
ids, and one that differs is encoded by the same recurrence in plain Python.

Defined cases: null and empty texts have no pieces; repeated rows give a row each;
extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import text_or_empty
from concord.llm.wordhash import _BASE, _powers, lean, mix

SPACE = "▁"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_NORMAL, _BYTE, _USER = 1, 6, 4
MOST_PIECES = 1_000_000
#: Bytes of a row of text on its way to Python, so that a batch of rows is bounded.
_PART = 1 << 13
#: Bytes of text, or those of one longer document, that are packed in a row.
_SLICE = 1 << 18
#: Ends in a block of the fold.
_BLOCK = 256
_SLOTS = 1 << 20


@cache
def model(path: str):
    """Pieces (id, text, score) that take part in the lattice, first byte piece's id, all pieces' texts, score of an unknown character."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only models without normalisation rules and with a dummy prefix are supported")
    table = [(i, p.piece, p.score) for i, p in enumerate(m.pieces) if p.type in (_NORMAL, _USER)]
    if len(table) > MOST_PIECES:
        raise ValueError(f"over {MOST_PIECES} pieces")
    bytes_ = [i for i, p in enumerate(m.pieces) if p.type == _BYTE]
    if len(bytes_) != 256 or bytes_[-1] - bytes_[0] != 255:
        raise ValueError("the model has no byte pieces in a row")
    return table, bytes_[0], [p.piece for p in m.pieces], min(p.score for p in m.pieces) - 10


def split(text: str) -> list[str]:
    return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def viterbi(word: str, path: str) -> list[int]:
    """Ids of the best segmentation; an unknown character as minus its code point."""
    table, longest, unknown = _lookup(path)
    n = len(word)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(-np.inf, 0, 0)] * n
    for i in range(n):
        here, single = best[i][0], False
        for j in range(i + 1, min(n, i + longest) + 1):
            found = table.get(word[i:j])
            if found is not None:
                single |= j == i + 1
                if here + found[1] > best[j][0]:
                    best[j] = (here + found[1], i, found[0])
        if not single and here + unknown > best[i + 1][0]:
            best[i + 1] = (here + unknown, i, -ord(word[i]))
    out, at = [], n
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return out[::-1]


@cache
def _lookup(path: str):
    table, _, _, unknown = model(path)
    return {t: (i, s) for i, t, s in table}, max(len(t) for _, t, _ in table), unknown


def decode(ids: list[int], path: str) -> str:
    """The text that ids stand for."""
    _, first, texts, _ = model(path)
    out = b"".join(bytes([i - first]) if first <= i < first + 256 else texts[i].encode() for i in ids).decode(errors="replace").replace(SPACE, " ")
    return out[1:] if out[:1] == " " else out


class Lattice(NamedTuple):
    """What the lattice needs of a model: arrays by character index and by piece id."""

    pieces: list[tuple[int, str, float]]  # on some best path
    longest: int
    index: np.ndarray  # of each code point; 0 for those of no longer piece than one character
    joins: np.ndarray  # whether a piece holds two characters in a row
    starts: np.ndarray  # whether a piece starts with two characters
    reach: np.ndarray  # by a hash of three characters, the longest piece that starts with them
    score: np.ndarray  # of each id
    text: np.ndarray  # the bytes of all pieces in a row, byte pieces as their byte
    at: np.ndarray  # where an id's bytes begin


def _worth(text: str, score: float, scores: dict[str, float], unknown: float) -> bool:
    """Whether no other pieces make up the text with a larger sum."""
    best = [0.0] + [-np.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            if j - i < len(text):
                one = scores.get(text[i:j], unknown if j == i + 1 else -np.inf)
                best[j] = max(best[j], best[i] + one)
    return best[-1] <= score + 1e-9 * abs(score)


def _slot(a, b, c):
    return (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) >> 7 & _SLOTS - 1


@cache
def lattice_of(path: str) -> Lattice:
    table, first, texts, unknown = model(path)
    scores = {t: s for _, t, s in table}
    kept = [(i, t, s) for i, t, s in table if len(t) == 1 or _worth(t, s, scores, unknown)]
    chars = sorted({c for _, t, _ in kept if len(t) > 1 for c in t} | {SPACE})
    index = np.zeros(0x110000, np.uint16)
    if len(chars) > 4095:  # tables of pairs stay within 16 MB each
        raise ValueError("over 4,095 characters in pieces of several aren't supported")
    for k, c in enumerate(chars, 1):
        index[ord(c)] = k
    n = int(index.max()) + 1
    joins, starts, reach = np.zeros((n, n), bool), np.zeros((n, n), bool), np.zeros(_SLOTS, np.uint8)
    for _, t, _ in kept:
        of = [int(index[ord(c)]) for c in t]
        for a, b in zip(of, of[1:], strict=False):
            joins[a, b] = True
        if len(t) > 1:
            starts[of[0], of[1]] = True
        if len(t) > 2:
            slot = _slot(*of[:3])
            reach[slot] = max(reach[slot], min(len(t), 255))
    joins[np.arange(n) != index[ord(SPACE)], index[ord(SPACE)]] = False  # a word begins there
    joins[0] = joins[:, 0] = False
    bytes_ = [bytes([i - first]) if first <= i < first + 256 else t.encode() for i, t in enumerate(texts)]
    score = np.full(len(texts), unknown)
    score[[i for i, _, _ in kept]] = [s for _, _, s in kept]
    longest = max(len(t) for _, t, _ in kept)
    if longest > 255:
        raise ValueError("pieces of over 255 characters aren't supported")
    return Lattice(kept, longest, index, joins, starts, reach, score, np.frombuffer(b"".join(bytes_), np.uint8), np.cumsum([0, *map(len, bytes_)]))


class Segments(NamedTuple):
    """The segments of some texts, in a row."""

    text: str  # of all texts, spaces as U+2581
    index: np.ndarray  # of its characters
    hashes: np.ndarray
    begin: np.ndarray  # where segments begin, and the end
    first: np.ndarray  # the first segment of each text, and the end


def segments(texts: list[str], path: str) -> Segments:
    of = lattice_of(path)
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    text = "".join(marked)
    places = np.cumsum([0, *map(len, marked)])
    n = len(text)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    index = of.index[points]
    new = np.ones(n + 1, bool)
    new[1:-1] = ~of.joins[index[:-1], index[1:]]
    new[places] = True
    begin = np.flatnonzero(new) if n else np.zeros(1, np.int64)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = mix(mix((sums[begin[1:]] - sums[begin[:-1]]) * down[begin[:-1]]) + np.diff(begin).astype(np.uint64) * np.uint64(_BASE))
    return Segments(text, index, hashes.view(np.int64), begin, np.searchsorted(begin, places))


def bounds(index: np.ndarray, left: np.ndarray, path: str) -> np.ndarray:
    """Characters of the longest piece that may start at each character; left: characters to its segment's end."""
    of = lattice_of(path)
    index = np.append(index.astype(np.int64), [0, 0])
    a, b, c = index[:-2], index[1:-1], index[2:]
    most = np.where((left > 1) & of.starts[a, b], 2, 1)
    return np.minimum(np.where(left > 2, np.maximum(most, of.reach[_slot(a, b, c)]), most), left).astype(np.int16)


def _bits(number, start, size):
    """Number, start and size of a substring as one number; columns or arrays."""
    return number * (1 << 36) + start * (1 << 8) + size


def lattice(chunks: DataFrame, path: str) -> DataFrame:
    """code (see `_bits`) and id of the edges of segments (number, segment, most, packed), in the order of segments; rows of no segment keep packed."""
    table = lattice_of(path).pieces
    known = F.broadcast(chunks.sparkSession.createDataFrame(table, "id int, piece string, score double").select("id", "piece", F.xxhash64("piece").alias("hash")))
    # places and lengths are exploded as numbers and cut out in generated code
    at = chunks.select("number", "packed", "segment", F.posexplode_outer("most").alias("start", "size"))
    spans = at.select("number", "packed", "segment", "start", F.explode_outer(F.when(F.col("size").isNotNull(), F.sequence(F.lit(1), F.col("size").cast("int")))).alias("size"))
    spans = spans.select("packed", _bits(F.col("number"), F.col("start").cast("long"), F.col("size")).alias("code"), F.substring("segment", F.col("start") + 1, F.col("size")).alias("span"), "size")
    # one number is the key; that the texts are equal, too, is said so that it doesn't become a second key
    same = F.startswith("span", F.col("piece")) & F.startswith("piece", F.col("span"))
    joined = spans.withColumn("hash", F.xxhash64("span")).alias("s").join(known.alias("k"), (F.col("s.hash") == F.col("k.hash")) & same, "left")
    joined = joined.where(F.col("id").isNotNull() | F.col("size").isNull() | (F.col("size") == 1))
    return joined.select("code", F.coalesce("id", -F.ascii("span")).alias("id"), "packed")


def _scores(longest: int) -> Column:
    """The score of the best path to each end, in order, from the column blocks.

    blocks: of `_BLOCK` ends each; an end is the scores of its edges from the shortest
    to the longest piece that ends there, minus infinity where there is none between.
    """

    def step(done: Column, edges: Column) -> Column:
        return F.array_append(done, F.array_max(F.transform(edges, lambda score, k: score + F.element_at(done, -1 - k))))

    def block(state: Column, ends: Column) -> Column:
        before = F.size(state["carry"])
        kept = lambda x: F.slice(x, F.greatest(F.size(x) - (longest - 1), F.lit(1)), longest)
        found = F.transform(F.array(F.aggregate(ends, state["carry"], step)), lambda x: F.struct(kept(x).alias("carry"), F.concat(state["all"], F.slice(x, before + 1, F.size(ends))).alias("all")))
        return F.get(found, F.lit(0))

    return F.aggregate("blocks", F.struct(F.array(F.lit(0.0)).alias("carry"), F.array().cast("array<double>").alias("all")), block, lambda x: x["all"])


_GROUPED = "number bigint, blocks array<array<array<double>>>, edges binary, packed binary"


def _lists(begin: np.ndarray, total: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(begin, total).astype(np.int32)), values)


def _binary(at: np.ndarray, values: np.ndarray) -> pa.Array:
    """values, parted at `at` (which ends with their number), as binaries."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _grouped(edges: DataFrame, path: str) -> DataFrame:
    """number, blocks (see `_scores`) and edges (code and id) of each segment, edges by end and start; edges of a segment come one after another."""
    names = [x.split(" ")[0] for x in _GROUPED.split(", ")]

    def give(code: np.ndarray, id_: np.ndarray) -> pa.RecordBatch:
        of = lattice_of(path)
        start, size = code >> 8 & (1 << 28) - 1, code & 255
        end = (code >> 36 << 28) + start + size  # with the number
        order = np.argsort(end, kind="stable")
        code, id_, start, end = code[order], id_[order].astype(np.int64), start[order], end[order]
        first = np.flatnonzero(np.diff(end, prepend=-1))
        place = (end & (1 << 28) - 1) - 1  # of each edge's end, from 0
        widths = np.maximum.reduceat(size[order], first)
        offsets = np.cumsum(widths) - widths
        scores = np.full(int(widths.sum()), -np.inf)
        scores[np.repeat(offsets, np.diff(np.append(first, len(code)))) + size[order] - 1] = np.where(id_ >= 0, of.score[np.maximum(id_, 0)], of.score.min())
        number, place = end[first] >> 28, place[first]
        begin = np.flatnonzero(place % _BLOCK == 0)
        words = np.flatnonzero(np.diff(number[begin], prepend=-1))
        rows = np.append(first[begin[words]], len(code))
        blocks = _lists(words, len(begin), _lists(begin, len(first), _lists(offsets, len(scores), pa.array(scores))))
        both = np.stack([code, id_], axis=1).ravel()
        return pa.RecordBatch.from_arrays(
            [pa.array(number[begin[words]]), blocks, _binary(2 * rows, both), pa.array([None] * len(words), pa.binary())], names=names
        )

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        code, id_ = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in batches:
            marks = np.flatnonzero(np.asarray(batch.column(2).is_valid()))
            lo = 0
            for hi in [*marks.tolist(), batch.num_rows]:
                if hi > lo:
                    some = batch.slice(lo, hi - lo)
                    code, id_ = np.concatenate([code, some.column(0).to_numpy()]), np.concatenate([id_, some.column(1).to_numpy()])
                if hi < batch.num_rows:
                    if len(code):
                        yield give(code, id_)
                        code, id_ = code[:0], id_[:0]
                    lacking = [pa.nulls(1, t) for t in (pa.int64(), pa.list_(pa.list_(pa.list_(pa.float64()))), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*lacking, batch.column(2).slice(hi, 1)], names=names)
                elif len(code) > 100_000:  # the last segment may go on
                    last = int(np.searchsorted(code, code[-1] >> 36 << 36))
                    if last:
                        yield give(code[:last], id_[:last])
                        code, id_ = code[last:], id_[last:]
                lo = hi + 1
        if len(code):
            yield give(code, id_)

    return edges.mapInArrow(group, _GROUPED)


def _trace(scores: np.ndarray, place: np.ndarray, number: np.ndarray, edges: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best paths, and where each segment's begin. scores: of all ends, a segment's from `place` on; edges: code and id, a segment's from `at` on.

    Of the edges that reach an end with its score the first, the longest, is taken.
    """
    code, id_, score = edges
    owner = np.repeat(np.arange(len(number)), np.diff(at))
    start = code >> 8 & (1 << 28) - 1
    # a place for 0, then one for each end
    base = place[:-1] + np.arange(len(number))
    known = np.insert(scores, place[:-1], 0.0)
    to = base[owner] + start + (code & 255)
    best = np.flatnonzero(known[base[owner] + start] + score == known[to])
    best = best[np.append(True, to[best][1:] != to[best][:-1])]
    if len(best) != len(scores):
        raise RuntimeError("the scores of the fold aren't those of its edges")
    back, by = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    back[to[best]], by[to[best]] = base[owner[best]] + start[best], id_[best]
    here, who, steps = base + np.diff(place), np.arange(len(number)), []
    while len(here):
        steps.append((who, by[here]))
        here = back[here]
        more = here != base[who]
        here, who = here[more], who[more]
    who, ids = np.concatenate([x for x, _ in steps][::-1]), np.concatenate([x for _, x in steps][::-1])
    order = np.argsort(who, kind="stable")
    return ids[order], np.searchsorted(who[order], np.arange(len(number) + 1))


def _whole_texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` bytes, of doc_id and text, from rows (doc_id, part of the text as bytes, whether it is the last)."""
    ids: list[int | None] = []
    texts: list[bytes] = []
    held, parts = 0, []

    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            for doc, part, last in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                parts.append(part)
                if last:
                    ids.append(doc)
                    texts.append(b"".join(parts) if len(parts) > 1 else part)
                    held += len(texts[-1])
                    parts = []
                    if held > size:
                        yield give()
                        ids, texts, held = [], [], 0
    if ids:
        yield give()


_CHUNK = "number bigint, segment string, most array<smallint>, packed binary"


def _chunks(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """For each slice of a chunk number, segment and most (bounds of its substrings) of the segments that are new to the chunk, then a row with its documents and their segments' numbers, packed.

    A chunk ends beyond `chunk` bytes of text, or an eighth as many characters of distinct segments, which are what a task holds.
    """
    names = [x.split(" ")[0] for x in _CHUNK.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        known, numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)  # hashes, ascending, and their segments' numbers
        size = held = 0  # bytes of text, characters of the distinct segments

        def packed(row: pa.RecordBatch) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(row)
            data = sink.getvalue()
            one = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.size], np.int32)), data])
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.list_(pa.int16()))), one], names=names)

        for some in _whole_texts(batches, _SLICE):
            found = segments(some.column(1).to_pylist(), path)
            hashes, where, which = np.unique(found.hashes, return_index=True, return_inverse=True)
            at = np.searchsorted(known, hashes)
            fresh = at == len(known)
            fresh[~fresh] = known[at[~fresh]] != hashes[~fresh]
            n = len(known)
            of = np.empty(len(hashes), np.int64)
            of[~fresh] = numbers[at[~fresh]]
            of[fresh] = np.arange(n, n + fresh.sum())
            known, numbers = np.insert(known, at[fresh], hashes[fresh]), np.insert(numbers, at[fresh], of[fresh])
            occurring = of[which]  # in two columns, which are smaller when compressed
            parts = [_binary(found.first, occurring.astype(np.uint16)), _binary(found.first, (occurring >> 16).astype(np.uint16))]
            kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("low", pa.binary()), ("high", pa.binary())], {"segments": str(len(known))})
            row = pa.RecordBatch.from_arrays([*some.columns, *parts], schema=kind)
            size += some.column(1).nbytes
            where = where[fresh]
            begin, end = found.begin[where], found.begin[where + 1]
            held += int((end - begin).sum())
            for lo in range(0, len(where), 4096):
                b, e = begin[lo : lo + 4096], end[lo : lo + 4096]
                text = [found.text[x:y] for x, y in zip(b.tolist(), e.tolist(), strict=True)]
                offsets = np.append(0, np.cumsum(e - b))
                chars = np.repeat(b - offsets[:-1], e - b) + np.arange(offsets[-1])
                most = bounds(found.index[chars], np.repeat(e, e - b) - chars, path)
                some_numbers = np.arange(n + lo, n + lo + len(b))
                yield pa.RecordBatch.from_arrays([pa.array(some_numbers), pa.array(text, pa.string()), _lists(offsets[:-1], offsets[-1], pa.array(most)), pa.array([None] * len(b), pa.binary())], names=names)
            yield packed(row)
            if size > chunk or held > chunk // 8:
                known, numbers, size, held = known[:0], numbers[:0], 0, 0

    text = text_or_empty().cast("binary")
    last = F.floor(F.greatest(F.octet_length(text) - 1, F.lit(0)) / _PART)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"), last.alias("last"))
    rows = rows.select("doc_id", F.substring("text", (F.col("part") * _PART + 1).cast("int"), F.lit(_PART)).alias("text"), (F.col("part") == F.col("last")).alias("last"))
    return rows.mapInArrow(read, _CHUNK)


def _ragged(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of values, each from at[row] to at[row + 1], one after another; and where each begins, with the end."""
    n = at[rows + 1] - at[rows]
    begin = np.append(0, np.cumsum(n))
    return values[np.repeat(at[rows] - begin[:-1], n) + np.arange(begin[-1])], begin


def decodes(ids: np.ndarray, at: np.ndarray, path: str) -> list[str]:
    """The texts that ids stand for, each one's from `at` on."""
    of = lattice_of(path)
    data, begin = _ragged(of.text, of.at, ids.astype(np.int64))
    whole, ends = data.tobytes(), begin[at].tolist()
    texts = [whole[a:b].decode(errors="replace").replace(SPACE, " ") for a, b in zip(ends, ends[1:], strict=False)]
    return [t[1:] if t[:1] == " " else t for t in texts]


class _Codes:
    """The segments of a chunk so far: ids of all, by number, and where each one's begin."""

    def __init__(self, path: str):
        self.path, self.n = path, 0
        self.ids, self.at = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def add(self, number: np.ndarray, scores: pa.Array, edges: pa.Array) -> None:
        of, first = lattice_of(self.path), model(self.path)[1]
        if number[0] == 0:  # of the next chunk
            self.n = 0
        n, self.n = self.n, self.n + len(number)
        if not np.array_equal(number, np.arange(n, self.n)):
            raise RuntimeError("the segments of a chunk didn't come back as they were numbered")
        place = scores.offsets.to_numpy().astype(np.int64)
        values = scores.values.to_numpy()[place[0] : place[-1]]
        data = np.frombuffer(edges.buffers()[2], np.int64).reshape(-1, 2)
        at = np.frombuffer(edges.buffers()[1], np.int32)[edges.offset : edges.offset + len(edges) + 1].astype(np.int64) // 16
        code, id_ = data[at[0] : at[-1], 0], data[at[0] : at[-1], 1]
        score = np.where(id_ >= 0, of.score[np.maximum(id_, 0)], of.score.min())
        ids, begin = _trace(values, place - place[0], number, (code, id_, score), at - at[0])
        if (ids < 0).any():  # characters of no piece, as bytes
            each = [chr(-i).encode() if i < 0 else None for i in ids.tolist()]
            size = np.array([len(b) if b else 1 for b in each])
            begin = np.append(0, np.cumsum(size))[begin]
            ids = np.concatenate([[first + x for x in b] if b else [i] for b, i in zip(each, ids.tolist(), strict=True)])
        held = int(self.at[n])
        self.at, self.ids = _room(self.at, n + 1, self.n + 1), _room(self.ids, held, held + len(ids))
        self.at[n + 1 : self.n + 1], self.ids[held : held + len(ids)] = held + begin[1:], ids


def _room(values: np.ndarray, used: int, size: int) -> np.ndarray:
    """values, or the used ones in an array twice as long, so that size of them have room."""
    if size <= len(values):
        return values
    out = np.zeros(2 * size, values.dtype)
    out[:used] = values[:used]
    return out


ENCODED = "doc_id bigint, n_pieces bigint, n_bytes_pieces bigint, ids_crc32 bigint, round_trip boolean"


def encode(docs: DataFrame, path: str, schema: str, give, chunk: int = 64 << 20) -> DataFrame:
    """give(doc_ids, texts, ids, where each one's ids begin, texts decoded from them), as columns of schema, for slices of docs; ids: little-endian unsigned 32-bit."""
    grouped = _grouped(lattice(_chunks(docs, path, chunk), path), path)
    longest = lattice_of(path).longest
    paths = grouped.select("number", F.when(F.col("blocks").isNotNull(), _scores(longest)).alias("scores"), "edges", "packed")
    kinds = pa.schema([(x.split(" ")[0], {"bigint": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}[x.split(" ")[1]]) for x in schema.split(", ")])

    def slow(text: str) -> list[int]:
        first = model(path)[1]
        return [j for w in split(text) for i in viterbi(w, path) for j in ([i] if i >= 0 else [first + b for b in chr(-i).encode()])]

    def finish(packed: pa.Buffer, codes: _Codes) -> Iterator[pa.RecordBatch]:
        stream = pa.ipc.open_stream(packed)
        n = int(stream.schema.metadata[b"segments"])
        if n and n != codes.n:  # 0: no text in it
            raise RuntimeError("segments of a chunk are missing")
        for some in stream:
            texts = some.column(1).to_pylist()
            first = np.frombuffer(some.column(2).buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64) // 2
            low, high = (np.frombuffer(some.column(k).buffers()[2] or b"", np.uint16)[: first[-1]].astype(np.int64) for k in (2, 3))
            ids, begin = _ragged(codes.ids, codes.at, high << 16 | low)
            begin = begin[first]
            back = decodes(ids, begin, path)
            if wrong := [k for k, (b, t) in enumerate(zip(back, texts, strict=True)) if b != t]:
                # one hash of two segments; or the text holds U+2581 itself, and comes to the same
                each = [ids[x:y].tolist() for x, y in zip(begin.tolist(), begin[1:].tolist(), strict=False)]
                for k in wrong:
                    each[k] = slow(texts[k])
                ids, begin = np.array([i for x in each for i in x], np.int64), np.cumsum([0, *map(len, each)])
                back = decodes(ids, begin, path)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(give(some.column(0), texts, ids.astype("<u4"), begin, back), kinds.types, strict=True)], schema=kinds)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        codes = _Codes(path)
        for batch in batches:
            marks = np.flatnonzero(np.asarray(batch.column(3).is_valid()))
            lo = 0
            for hi in [*marks.tolist(), batch.num_rows]:
                if hi > lo:
                    some = batch.slice(lo, hi - lo)
                    codes.add(some.column(0).to_numpy(), some.column(1), some.column(2))
                if hi < batch.num_rows:
                    yield from finish(batch.column(3)[hi].as_buffer(), codes)
                lo = hi + 1

    return paths.mapInArrow(apply, schema)


def report(docs: DataFrame, path: str, **settings) -> DataFrame:
    """Per row: doc_id, n_pieces, n_bytes_pieces, ids_crc32, and whether decoding the ids gives the text again."""

    def give(doc_ids: pa.Array, texts: list[str], ids: np.ndarray, at: np.ndarray, back: list[str]) -> list:
        first = model(path)[1]
        in_bytes = np.append(0, np.cumsum((ids >= first) & (ids < first + 256)))
        places = at.tolist()
        return [doc_ids, np.diff(at), in_bytes[at[1:]] - in_bytes[at[:-1]], [zlib.crc32(ids[a:b]) for a, b in zip(places, places[1:], strict=False)], [b == t for b, t in zip(back, texts, strict=True)]]

    return encode(docs, path, ENCODED, give, **settings)


def encoded(docs: DataFrame, path: str, **settings) -> DataFrame:
    """Per row: doc_id and ids."""

    def give(doc_ids: pa.Array, _texts: list[str], ids: np.ndarray, at: np.ndarray, _back: list[str]) -> list:
        return [doc_ids, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))]

    return encode(docs, path, "doc_id bigint, ids array<int>", give, **settings)


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); ids outside of the vocabulary raise an error, null ids give null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(read, "doc_id bigint, text string")


def session_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The piece table of a model file: id, piece, score."""
    return spark.createDataFrame(model(path)[0], "id int, piece string, score double")
