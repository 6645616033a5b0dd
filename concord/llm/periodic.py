"""Runs of repeated words, and texts without the repeats, by Kolpakov and Kucherov's algorithm.

A run is a stretch of consecutive words with smallest period q and a length of at
least max(least, 2q) that no neighbouring word extends. For each text:

1. Words are numbered. In a run, some window of least/2 words that holds a given
   word stands there again q words on, so stretches whose windows stand nowhere
   else in the text are left out; of the others each is searched on its own.
2. A suffix automaton gives the LZ factors: each is the longest that stands
   earlier too, or a new word.
3. Main's algorithm finds the runs that cross or touch the border of two factors.
   Those that end in a factor u reach back over less than 2|u'| + |u| words, u'
   being the factor before, so the borders of all factors take linear time.
4. Runs strictly within a factor are copied from the place where it stood before.

Time is linear in the words. Memory is a few bytes a word, and about half a
kilobyte for each word of the longest stretch that passes 1.

Defined cases: null and empty texts have no words and no runs; repeated rows give
a row each; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import text_or_empty, words
from concord.llm.wordhash import slices

RUN = "struct<start: bigint, length: bigint, period: bigint>"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def numbered(text: bytes, piece: int = 1 << 20) -> tuple[np.ndarray, list[bytes]]:
    """The words as numbers, and the distinct words by number."""
    known: dict[bytes, int] = {}
    parts, lo = [np.zeros(0, np.int32)], 0
    while lo < len(text):  # a piece's words at a time
        cut = _SPACE.search(text, lo + piece)
        hi = cut.start() if cut else len(text)
        some = text[lo:hi].split()
        fresh = [w for w in dict.fromkeys(some) if w not in known] if known else dict.fromkeys(some)
        known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        parts.append(np.fromiter(map(known.__getitem__, some), np.int32, len(some)))
        lo = hi
    return np.concatenate(parts), list(known)


def stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Begin and end of the stretches that may hold runs: each word lies in a window of least/2 words that stands elsewhere too."""
    size = max(1, least // 2)
    n = len(ids) - size + 1
    if len(ids) < least or n < 2:
        return []
    with np.errstate(over="ignore"):
        windows = np.zeros(n, np.uint64)
        for k in range(size):
            windows = windows * _BASE + ids[k : k + n].astype(np.uint64)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]  # equal by chance only adds a stretch
    if not len(twice):
        return []
    edges = np.zeros(len(ids) + 1, np.int32)
    again = np.flatnonzero(np.isin(windows, twice))
    edges[again] += 1
    edges[again + size] -= 1
    inside = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
    begins, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    return [(a, b) for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if b - a >= least]


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """LZ factors: begin, end and an earlier begin, which may overlap, or -1 for a word that is new."""
    step: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]  # first: where a state's strings end for the first time
    last = 0
    for i, c in enumerate(w):
        own = len(step)
        step.append({})
        length.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = own
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 != length[q]:
                copy = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = q = copy
            link[own] = q
        last = own
    out, i = [], 0
    while i < len(w):
        state, j = 0, i
        while j < len(w):
            to = step[state].get(w[j])
            if to is None or first[to] - (j - i) >= i:  # it stands nowhere before
                break
            state, j = to, j + 1
        out.append((i, j, first[state] - (j - i) + 1) if j > i else (i, i + 1, -1))
        i = max(j, i + 1)
    return out


def _common(w: list[int]) -> list[int]:
    """For each place, how much of w from there on equals w's beginning."""
    n = len(w)
    out = [0] * n
    lo = hi = 0
    for i in range(1, n):
        k = min(out[i - lo], hi - i) if i < hi else 0
        if i + k >= hi:
            while i + k < n and w[i + k] == w[k]:
                k += 1
            lo, hi = i, i + k
        out[i] = k
    return out


def at_border(w: list[int], lo: int, border: int, hi: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Main's algorithm: first, last and period of the runs of w that cross or touch the border, as far as w[lo:hi] shows them whole."""
    t, v = w[lo:border], w[border:hi]
    ahead = np.array(_common([*v, -1, *t, *v]), np.int64)  # equal to v's beginning
    back = np.array(_common([*t[::-1], -1, *v[::-1], *t[::-1]]), np.int64)  # equal to t's end
    periods = np.arange(1, len(v) + 1)  # a whole period stands right of the border
    right = np.append(ahead[1 : len(v)], 0) if len(v) else periods
    left = back[len(t) + 1 + len(v) - periods]
    yield from _kept(w, border - left, border + periods + right - 1, periods, left + right, least)
    periods = np.arange(1, len(t) + 1)  # or left of it
    left = np.append(back[1 : len(t)], 0) if len(t) else periods
    right = ahead[len(v) + 1 + len(t) - periods]
    yield from _kept(w, border - periods - left, border + right - 1, periods, left + right, least)


def _kept(w: list[int], first: np.ndarray, last: np.ndarray, periods: np.ndarray, beyond: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    for k in np.flatnonzero((beyond >= periods) & (beyond + periods >= least)).tolist():
        i, j, p = int(first[k]), int(last[k]), int(periods[k])
        if (i == 0 or w[i - 1] != w[i - 1 + p]) and (j + 1 == len(w) or w[j + 1] != w[j + 1 - p]):
            yield i, j, p


def runs_of(w: list[int], least: int) -> list[tuple[int, int, int]]:
    """first, last and smallest period of all runs."""
    found: dict[int, dict[int, int]] = {}  # by first place, then last place

    def add(i: int, j: int, p: int) -> None:
        ends = found.setdefault(i, {})
        ends[j] = min(p, ends.get(j, p))

    before = 0
    parts = factors(w)
    for k, (s, e, source) in enumerate([*parts, (len(w), len(w), -1)]):
        if k and 2 * (before + e - s) >= least:
            for run in at_border(w, max(0, s - 2 * before - (e - s)), s, e, least):
                add(*run)
        d = s - source
        if source >= 0 and e - s > least:
            for i in range(source + 1, e - d - least):
                for j, p in list(found.get(i, {}).items()):
                    if j < e - d - 1:
                        add(i + d, j + d, p)
        before = e - s
    return [(i, j, p) for i, ends in found.items() for j, p in ends.items()]


def runs(ids: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """start, length and period of all runs, by start, then period."""
    out = []
    for a, b in stretches(ids, least):
        out += [(a + i, j - i + 1, p) for i, j, p in runs_of(ids[a:b].tolist(), least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(text: bytes, least: int) -> tuple[int, list[tuple[int, int, int]], bytes]:
    ids, known = numbered(text)
    found = runs(ids, least)
    if not found:
        return len(ids), found, b" ".join(text.split())
    edges = np.zeros(len(ids) + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = ids[np.cumsum(edges[:-1]) == 0]
    return len(ids), found, b" ".join([known[k] for k in kept.tolist()])


def collapse(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, in order) and text: the words that no run holds after its first period, joined by one space."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # automata are many small objects without cycles
        for batch in batches:
            for some in slices(batch, 1):
                found = [_collapsed(text, least) for text in some.column(1).cast(pa.binary()).to_pylist()]
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r, _ in found]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                text = pa.array([t for _, _, t in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array(rows, kind), text], names=["doc_id", "n_words", "runs", "text"])

    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")).mapInArrow(work, f"doc_id bigint, n_words bigint, runs array<{RUN}>, text string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which every tenth text by the checksum of its id repeats the words from some word on; null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    # structs in arrays of one hold what is worked out once a text
    held = F.transform(F.array(words(text_or_empty())), lambda w: F.struct(w.alias("w"), (g % F.nullif(F.size(w), F.lit(0))).alias("a")))
    held = F.transform(held, lambda s: F.struct(s["w"].alias("w"), s["a"].alias("a"), (1 + F.floor((F.size(s["w"]) - s["a"]) / (3 + g % 8))).alias("p")))
    word = lambda s: lambda x, i: F.when(i < s["a"], x).otherwise(F.get(s["w"], (s["a"] + F.pmod(i - s["a"], s["p"])).cast("int")))
    altered = F.get(F.transform(held, lambda s: F.array_join(F.transform(s["w"], word(s)), " ")), F.lit(0))
    return docs.select("doc_id", F.when(F.coalesce(h % 10 == 0, F.lit(False)), altered).otherwise(text_or_empty()).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_runs, the longest run with its exponent, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = collapse(docs).select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("_best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    best = {"start": -F.col("_best.start"), "length": F.col("_best.length"), "period": -F.col("_best.period")}
    return found.select("doc_id", "n_runs", *[c.alias(k) for k, c in best.items()], F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
