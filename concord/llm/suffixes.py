"""Removal of byte strings that repeat in a corpus, by grouped suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts anywhere
else. Every such string has an anchor, the first of its smallest hashed k-grams,
which depends on the string alone; so equal strings meet under equal anchors.
Strings of a text with one anchor are neighbours and form a context.

1. All anchors and the hashes of their contexts are counted.
2. Contexts found twice or more, by the 128 bits of anchor and context, go as a whole. What is left are anchors with
   different contexts: their distinct texts are gathered, in buckets of about
   `bucket` bytes, and the suffixes of each anchor's texts are sorted by linear
   grouping construction: short ones of a bucket in step, as array operations
   (`suffix_arrays`), long ones one by one (`suffix_array`). Starts in suffix order
   whose next `length` bytes equal those of a neighbour are repeats.
3. An anchor with more than `block` distinct contexts is dealt over blocks, each
   sorted by itself. Blocks then exchange hashes of one start of each string
   they hold, dealt by the hash into parts of bounded size, and what two blocks
   have is a repeat too.
4. Repeats go back to the documents, where their bytes are united and cut out.

Anchors of step 2 are found again in the texts by bitmaps of fixed size; when
these are fuller, more contexts are read than need be, no fewer. No step gathers
the places of a string, or all contexts of an anchor, in one task.

Defined cases: null text has no bytes; texts shorter than `length` lose none;
repeated rows are different places, so both lose what they share; extra columns
are kept by `deduplicate`; no rows give no rows. Bytes are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import bitmap, in_bitmap, split_by_bitmap, stored, text_or_empty
from concord.llm.wordhash import _LETTERS, _powers, lean, mix, slices, text_buffers

_ODD1, _ODD2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_PLACES = "doc bigint, copy bigint, a bigint, c bigint, start bigint, size int, context binary"
_RUNS = "a bigint, c bigint, runs array<int>"
_MOST_TASKS = 20_000


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of text in ascending order; a prefix comes before what it begins.

    Grouping construction. Groups of suffixes begin as those with equal first
    bytes and are processed in descending order. Each member finds its previous
    smaller suffix: the next to its left that is in a lower group, over pointers of
    members of higher groups. Suffixes pointed to grow by the group's prefix, once
    for each pointer, and leave for new groups right above their own. In the end
    groups are in the order of Lyndon prefixes. Then suffixes are emitted in
    ascending order: each one emitted settles, along the pointers, the next place
    in the groups of those it is the next smaller suffix of.
    """
    n = len(text)
    group = [b + 1 for b in text]
    group.append(0)  # the empty suffix
    members: list[list[int]] = [[] for _ in range(257)]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    used = [g for g in range(257) if size[g]]
    lower = [-1] * 257
    upper = [-1] * 257
    for a, b in zip(used, used[1:], strict=False):
        lower[b], upper[a] = a, b
    before = [-1] * (n + 1)
    done = bytearray(n + 1)
    g = used[-1]
    while g >= 0:
        pointed: dict[int, int] = {}
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            if p >= 0:
                if group[p] == g:
                    p = before[p]
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
            before[i] = p
        for i in own:
            done[i] = 1
        moved: dict[int, dict[int, list[int]]] = {}
        for p in sorted(pointed):
            moved.setdefault(group[p], {}).setdefault(pointed[p], []).append(p)
        for h, by_count in moved.items():
            counts = sorted(by_count)
            if sum(map(len, by_count.values())) == size[h]:
                counts = counts[1:]  # all grow: those that grow least stay
            last = h
            for c in counts:
                new, some = len(members), by_count[c]
                members.append(some)
                size.append(len(some))
                size[h] -= len(some)
                above = upper[last]
                lower.append(last)
                upper.append(above)
                upper[last] = new
                if above >= 0:
                    lower[above] = new
                for p in some:
                    group[p] = new
                last = new
        g = lower[g]
    place = [0] * len(members)
    g, at = used[0], 0
    while g >= 0:
        place[g] = at
        at += size[g]
        g = upper[g]
    out = [n] * (n + 1)
    settled = bytearray(n + 1)
    settled[n] = 1
    for k in range(n + 1):
        j = out[k] - 1
        while j >= 0 and not settled[j]:
            settled[j] = 1
            h = group[j]
            out[place[h]] = j
            place[h] += 1
            j = before[j]
    return out[1:]


def suffix_arrays(texts: list[bytes]) -> list[np.ndarray]:
    """`suffix_array` of each text, by the same construction in step: the k-th highest group of every text is one array operation.

    Each text stands between a guard, where chains of pointers end, and its empty
    suffix. Members that point within their group double their pointers.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths + 2) - lengths - 1
    end, total = begin + lengths, int((lengths + 2).sum())
    letters = np.frombuffer(b"".join(b"\0" + t + b"\0" for t in texts), np.uint8).astype(np.int64) + 1
    letters[end] = 0
    text_of = np.repeat(np.arange(len(texts)), lengths + 2)
    at = np.delete(np.arange(total), begin - 1)

    def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places by their keys, these keys, and where a key is first."""
        code = np.sort(keys[at] * total + at)
        key, where = np.divmod(code, total)
        return where, key, np.flatnonzero(np.diff(key, prepend=-1))

    where, key, first = ranked(text_of * 257 + letters)
    used, n = len(at), len(first)
    pool = np.empty(2 * total, np.int32)  # members of groups, each group's in a row; some have left
    pool[:used] = where
    room = 2 * n
    start, size, live, lower, upper, step_of = (np.zeros(room, np.int32) for _ in range(6))
    start[:n] = first
    size[:n] = live[:n] = np.diff(np.append(first, used))
    ids, same = np.arange(n), np.append(False, np.diff(key[first] // 257) == 0)
    lower[:n] = np.where(same, ids - 1, -1)
    upper[:n] = np.where(np.append(same[1:], False), ids + 1, -1)
    group = np.full(total, -1, np.int32)
    group[where] = np.repeat(ids, size[:n])
    before, done = np.zeros(total, np.int32), np.zeros(total, bool)
    current, step = ids[upper[:n] < 0], 0
    while len(current):
        step += 1
        step_of[current] = step
        some = size[current]
        i = pool[np.repeat(start[current] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))]
        g = np.repeat(current, some)
        own = group[i] == g
        i, g = i[own], g[own]
        p = i - 1
        m = np.flatnonzero(done[p])
        while len(m):
            p[m] = q = before[p[m]]
            m = m[done[q]]
        before[i] = p
        m = np.flatnonzero(group[p] == g)
        while len(m):
            p[m] = q = before[p[m]]
            before[i[m]] = q
            m = m[group[q] == g[m]]
        done[i] = True
        q = np.sort(p[group[p] >= 0])
        if len(q):
            first = np.flatnonzero(np.diff(q, prepend=-1))
            count = np.diff(np.append(first, len(q)))
            q = q[first]
            code = group[q].astype(np.int64) * (int(count.max()) + 1) + count
            by = np.argsort(code, kind="stable")
            q, code = q[by], code[by]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            each, h = np.diff(np.append(first, len(q))), group[q[first]]
            opens = np.flatnonzero(np.diff(h, prepend=-1))
            stay = np.zeros(len(first), bool)
            stay[opens] = np.add.reduceat(each, opens) == live[h[opens]]  # all grow: those that grow least stay
            q = q[np.repeat(~stay, each)]
            each, h = each[~stay], h[~stay]
        if len(q):
            while n + len(h) > room:
                start, size, live, lower, upper, step_of = (np.concatenate([x, np.zeros(room, np.int32)]) for x in (start, size, live, lower, upper, step_of))
                room *= 2
            new = np.arange(n, n + len(h))
            n += len(h)
            opens = np.diff(h, prepend=-1) != 0
            o, closes = np.flatnonzero(opens), np.append(opens[1:], True)
            live[h[o]] -= np.add.reduceat(each, o)
            size[new] = live[new] = each
            start[new] = used + np.cumsum(each) - each
            pool[used : used + len(q)] = q
            used += len(q)
            group[q] = np.repeat(new, each)
            above = upper[h]
            lower[new] = np.where(opens, h, new - 1)
            upper[new] = np.where(closes, above, new + 1)
            upper[h[o]] = new[o]
            top = closes & (above >= 0)
            lower[above[top]] = new[top]
        current = lower[current]
        current = current[current >= 0]
    order = np.zeros(total, np.int64)
    order[at] = text_of[at] * (step + 1) + step - step_of[group[at]]
    where, _, first = ranked(order)
    place = np.zeros(n, np.int64)
    place[group[where[first]]] = first
    slot = np.cumsum(lengths + 1) - lengths - 1
    out = np.zeros(len(at), np.int32)
    out[slot] = end
    settled = np.zeros(total, bool)
    settled[end] = settled[begin - 1] = True
    by = np.argsort(-lengths, kind="stable")
    longer = np.searchsorted(-lengths[by], -np.arange(int(lengths.max()) + 1), "right")
    for k, active in enumerate(longer.tolist()):
        j = out[slot[by[:active]] + k] - 1
        j = j[~settled[j]]
        while len(j):
            settled[j] = True
            h = group[j]
            s = place[h]
            out[s] = j
            place[h] = s + 1
            j = before[j]
            j = j[~settled[j]]
    return [out[s + 1 : s + n + 1] - b for s, n, b in zip(slot.tolist(), lengths.tolist(), begin.tolist(), strict=True)]


def contexts(data: np.ndarray, at: np.ndarray, length: int, k: int):
    """Anchor hash, context hash, start in data and number of strings, of each context; data: texts in a row, at: where each begins."""
    empty = np.zeros(0, np.int64)
    starts = np.zeros(len(data) + 1, np.int32)
    long_ = np.flatnonzero(at[1:] - at[:-1] >= length)
    if not len(long_):
        return empty, empty, empty, empty
    np.add.at(starts, at[long_], 1)
    np.add.at(starts, at[long_ + 1] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(starts[:-1]))
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[data] * up[: len(data)], out=sums[1:])
        grams = mix((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        span, width = length - k + 1, 1
        while 2 * width <= span:  # least of the next `width` grams, doubled
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        anchor = (low[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(valid), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(new)
        begin, count = valid[first], np.diff(np.append(first, len(valid)))
        end = begin + count - 1 + length
        hashed = mix((sums[end] - sums[begin]) * down[begin] + (anchor[first] - begin).astype(np.uint64) * np.uint64(_ODD1) + (end - begin).astype(np.uint64) * np.uint64(_ODD2))
    return grams[anchor[first]].view(np.int64), hashed.view(np.int64), begin, count


def _documents(*more: Column) -> list[Column]:
    """doc, copy (hash of the text) and text, and more."""
    text = text_or_empty()
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text"), *more]


def _anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2):
                a, c, _, _ = contexts(*text_buffers(some.column(2)), length, k)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "c"])

    return docs.select(*_documents()).mapInArrow(read, "a bigint, c bigint")


def _places(docs: DataFrame, length: int, k: int, repeated, mixed) -> DataFrame:
    """Contexts of anchors found twice or more; the text comes with a context of a mixed anchor, once in a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sent = [x.split(" ")[0] for x in _PLACES.split(", ")], set()
        for batch in batches:
            for some in slices(batch, 2):
                data, at = text_buffers(some.column(2))
                a, c, begin, count = contexts(data, at, length, k)
                keep = np.flatnonzero(in_bitmap(repeated.value, a)) if len(a) else np.zeros(0, np.int64)
                if not len(keep):
                    continue
                a, c, begin, count = a[keep], c[keep], begin[keep], count[keep]
                owner = np.searchsorted(at, begin, "right") - 1
                whole, texts = data.tobytes(), []
                for x, y, b, n, m in zip(a.tolist(), c.tolist(), begin.tolist(), count.tolist(), in_bitmap(mixed.value, a).tolist(), strict=True):
                    if m and (x, y) not in sent:
                        sent.add((x, y))
                        texts.append(whole[b : b + n - 1 + length])
                    else:
                        texts.append(None)
                if len(sent) > 500_000:
                    sent = set()
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([some.column(0).take(rows), some.column(1).take(rows), pa.array(a), pa.array(c), pa.array(begin - at[owner]), pa.array((count - 1 + length).astype(np.int32)), pa.array(texts, pa.binary())], names=names)

    return docs.select(*_documents()).mapInArrow(read, _PLACES)


def _windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in a row, parted by a byte that UTF-8 has not, where strings start, and the index of their text."""
    data = np.frombuffer(b"\xff".join(texts) + b"\xff" * length, np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    counts = np.array([len(t) - length + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + at[owner]
    return data, begin, owner


#: Texts up to so many bytes are sorted in step, in batches of about `_BATCH` bytes.
_TOGETHER, _BATCH = 8192, 1 << 19


def _suffix_order(texts: list[bytes]) -> np.ndarray:
    """Starts of the suffixes of each text, in order, text after text; places are those in all texts, parted by a byte."""
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    batch, held = [], 0
    by = sorted((k for k in range(len(texts)) if len(texts[k]) <= _TOGETHER), key=lambda k: len(texts[k]))
    for k in by:
        batch.append(k)
        held += len(texts[k])
        if held > _BATCH or k == by[-1]:
            for j, order in zip(batch, suffix_arrays([texts[j] for j in batch]), strict=True):
                found[j] = order + at[j]
            batch, held = [], 0
    for k, t in enumerate(texts):
        if len(t) > _TOGETHER:
            found[k] = np.array(suffix_array(t), np.int64) + at[k]
    return np.concatenate(found)


def repeats(texts: list[bytes], length: int, anchors: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all starts: index of the text, place in it, whether the string is found twice or more, whether it is the first of its kind.

    anchors: of each text, those of one anchor in a row; only these are compared.
    """
    lean()
    data, begin, owner = _windows(texts, length)
    same_anchor = [list(g) for _, g in groupby(range(len(texts)), (lambda k: anchors[k]) if anchors else lambda k: 0)]
    order = _suffix_order([b"\xff".join([texts[k] for k in g]) for g in same_anchor])
    number = np.full(len(data), -1, np.int64)
    number[begin] = np.arange(len(begin))
    order = order[number[order] >= 0]
    rows = np.lib.stride_tricks.sliding_window_view(data, length)
    same = np.zeros(len(order), bool)  # as the one before in suffix order
    for lo in range(1, len(order), 50_000):
        hi = min(len(order), lo + 50_000)
        same[lo:hi] = (rows[order[lo:hi]] == rows[order[lo - 1 : hi - 1]]).all(axis=1)
    twice = same.copy()
    twice[:-1] |= same[1:]
    found, first = np.zeros(len(begin), bool), np.zeros(len(begin), bool)
    found[number[order]] = twice
    first[number[order]] = ~same
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return owner, begin - at[owner], found, first


def _spans(places: np.ndarray, length: int) -> list[int]:
    """Begin and end, in turn, of the runs of bytes that strings at ascending places cover."""
    if not len(places):
        return []
    cut = np.flatnonzero(places[1:] > places[:-1] + length)
    begin, end = places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)] + length
    return np.stack([begin, end], axis=1).ravel().tolist()


def runs(docs: DataFrame, length: int = 200, k: int = 64, block: int = 512, bucket: int = 1 << 20, bits: int = 26) -> DataFrame:
    """doc, copy and runs (begin and end, in turn, of removed bytes, perhaps overlapping) of documents that lose bytes."""
    sc = docs.sparkSession.sparkContext
    seen = _anchors(docs, length, k).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    seen = stored(seen.select("a", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    repeated = sc.broadcast(bitmap(seen, "a", bits))  # 8 MB each, whatever the corpus
    mixed = sc.broadcast(bitmap(seen.where("mixed"), "a", bits))
    places = stored(_places(docs, length, k, repeated, mixed), "places")
    found = places.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.first("context", ignorenulls=True).alias("context"), F.first("size").alias("size"))
    exact = seen.where("mixed").select("a")
    texts = stored(found.join(exact, "a", "left_semi"), "contexts")
    whole = found.where("n > 1").select("a", "c", F.array(F.lit(0), F.col("size")).alias("runs"))

    large = texts.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block)
    total = texts.agg(F.sum("size")).head()[0] or 0
    buckets, tasks = max(1, -(-total // bucket)), max(1, min(_MOST_TASKS, -(-2 * total // bucket)))
    keyed = texts.join(large, "a", "left").select(
        "a", "c", "n", "context", F.coalesce("m", F.lit(0)).alias("m"),
        F.when(F.col("m").isNotNull(), F.col("a")).otherwise(F.pmod(F.xxhash64("a"), F.lit(buckets))).alias("key"),
        F.when(F.col("m").isNotNull(), F.pmod(F.xxhash64("c"), F.ceil(F.col("m") / block))).otherwise(F.lit(-1)).alias("part"),
    )
    schema = "a bigint, c bigint, runs array<int>, q int, digests binary, at binary"

    def sort(t: pa.Table) -> pa.Table:
        t = t.sort_by("a")
        contexts_ = t.column("context").to_pylist()
        owner, place, twice, first = repeats(contexts_, length, t.column("a").to_pylist())
        n = t.column("n").to_numpy()
        a, c = t.column("a").to_numpy(), t.column("c").to_numpy()
        split = np.searchsorted(owner, np.arange(len(contexts_) + 1))
        out: list[tuple] = []
        for i in range(len(contexts_)):
            own = slice(split[i], split[i + 1])
            if n[i] == 1 and twice[own].any():
                out.append((a[i], c[i], _spans(place[own][twice[own]], length), None, None, None))
        m = t.column("m")[0].as_py()
        if m > block:  # hashes of one start of each string, for the other blocks
            data, begin, _ = _windows(contexts_, length)
            send = np.flatnonzero(first | ~twice)
            digest = _digests(data, begin[send], length)
            parts = -(-m * length // (1 << 18))
            q = (digest[:, 0] % np.uint64(parts)).astype(np.int64)
            for part in np.unique(q):
                some = np.flatnonzero(q == part)
                at = np.stack([c[owner[send[some]]], place[send[some]], twice[send[some]] | (n[owner[send[some]]] > 1)], axis=1)
                out.append((a[0], None, None, int(part), digest[some].tobytes(), at.astype(np.int64).tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, y) for x, y in zip(columns, kinds, strict=True)], names=["a", "c", "runs", "q", "digests", "at"])

    # small for a shuffle, dear for a task: dealt by weight and not by size
    done = stored(keyed.repartition(tasks, "key", "part").groupBy("key", "part").applyInArrow(sort, schema), "sorted")

    def exchange(t: pa.Table) -> pa.Table:
        digest = np.frombuffer(b"".join(t.column("digests").to_pylist()), np.uint64).reshape(-1, 2)
        at = np.frombuffer(b"".join(t.column("at").to_pylist()), np.int64).reshape(-1, 3)
        order = np.lexsort((digest[:, 1], digest[:, 0]))
        same = (digest[order[1:]] == digest[order[:-1]]).all(axis=1)
        twice = np.zeros(len(order), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        some = at[twice & (at[:, 2] == 0)]
        some = some[np.lexsort((some[:, 1], some[:, 0]))]
        out_c, out_runs = [], []
        for c in np.unique(some[:, 0]):
            out_c.append(int(c))
            out_runs.append(_spans(some[some[:, 0] == c, 1] if len(some) < 1000 else some[np.searchsorted(some[:, 0], c) : np.searchsorted(some[:, 0], c, "right"), 1], length))
        return pa.table({"a": pa.array([t.column("a")[0].as_py()] * len(out_c), pa.int64()), "c": pa.array(out_c, pa.int64()), "runs": pa.array(out_runs, pa.list_(pa.int32()))})

    across = done.where("q IS NOT NULL").select("a", "q", "digests", "at").groupBy("a", "q").applyInArrow(exchange, _RUNS)
    gone = whole.unionByName(done.where("q IS NULL").select("a", "c", "runs")).unionByName(across)
    hit = places.select("doc", "copy", "a", "c", "start").join(gone, ["a", "c"])
    return hit.select("doc", "copy", F.transform("runs", lambda x: x + F.col("start")).alias("runs")).groupBy("doc", "copy").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _digests(data: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit hashes of each string."""
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        out = np.empty((len(begin), 2), np.uint64)
        for k, letters in enumerate((_LETTERS, mix(_LETTERS * np.uint64(_ODD1)))):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(letters[data] * up[: len(data)], out=sums[1:])
            out[:, k] = mix((sums[begin + length] - sums[begin]) * down[begin])
    return out


CUT = "doc bigint, copy bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def cut(text: bytes, pairs: list[int]) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left."""
    spans = sorted(zip(pairs[::2], pairs[1::2], strict=True))
    removed = count = at = 0
    kept = []
    end = -1
    for b, e in spans:
        if b > end:
            count += 1
            kept.append(text[at:b])
            end, removed = e, removed + e - b
        elif e > end:
            removed += e - end
            end = e
        at = max(at, end)
    kept.append(text[at:])
    return removed, count, b"".join(kept)


def cut_out(docs: DataFrame, schema: str, give, names: tuple[str, ...], **settings) -> DataFrame:
    """docs (all columns) with what give(text, pairs) returns for each row."""
    found = stored(runs(docs, **settings), "runs")
    kept = [f for f in docs.schema.fields if f.name not in names and f.name != "text"]
    # numbers for names: columns of docs may have any
    own = [F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(kept)]
    marked = docs.select(*own, *_documents(F.col("text").isNull().alias("null")))
    # documents that lose nothing aren't moved
    flat = bitmap(found.select(F.xxhash64("doc", "copy").alias("key")), "key", 25)
    hit, rest = split_by_bitmap(marked, F.xxhash64("doc", "copy"), flat)
    wanted = [*(f"c{k}" for k in range(len(kept))), "text", "runs", "null"]
    both = hit.join(found, ["doc", "copy"], "left").select(*wanted).unionByName(rest.withColumn("runs", F.lit(None).cast("array<int>")).select(*wanted))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(kept)
        for batch in batches:
            for some in slices(batch, n):
                out = [give(t, r, x) for t, r, x in zip(some.column(n).to_pylist(), some.column(n + 1).to_pylist(), some.column(n + 2).to_pylist(), strict=True)]
                made = [pa.array(x) if x.count(None) < len(x) else pa.array(x, pa.string()) for x in map(list, zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([*some.columns[:n], *made], names=[*(f.name for f in kept), *names])

    from pyspark.sql.types import StructType

    return both.mapInArrow(apply, StructType([*kept, *StructType.fromDDL(schema).fields]))


def report(docs: DataFrame, **settings) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def give(text: str, pairs: list[int] | None, _null: bool) -> tuple:
        data = text.encode()
        removed, count, kept = cut(data, pairs or [])
        return len(data), removed, count, hashlib.sha256(kept).hexdigest()

    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    return cut_out(docs.select("doc_id", "text"), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", give, names, **settings)


def deduplicate(docs: DataFrame, **settings) -> DataFrame:
    """docs with the bytes cut out of text; parts of characters that a cut leaves go with it. All rows are kept."""

    def give(text: str, pairs: list[int] | None, null: bool) -> tuple:
        return (None if null else text if not pairs else cut(text.encode(), pairs)[2].decode(errors="ignore"),)

    return cut_out(docs, "text string", give, ("text",), **settings).select(*docs.columns)
