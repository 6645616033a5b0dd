"""N-gram Jaccard join by prefix trees, down to groups of linked documents.

Documents link when the Jaccard similarity of their sets of word n-grams is at
least `percent` / 100. The result is one row per document with its component.

1. Documents of equal sets form a class; classes stand for their documents.
2. N-grams get a global order, rare ones first, by counts in a table of fixed
   size. The order only serves speed: any order that all documents share gives
   the same links. Similar sets share at least l n-grams among the first
   n - ceil(s n) + l of each. With l a twentieth of the set, a class of which
   fewer of these n-grams occur in other classes is done.
3. Groups of classes that share such an n-gram are joined by prefix trees. Sets
   are stored in a tree with common n-grams first, so that near copies share
   long paths; a set is probed against the tree, its overlap with a path is
   counted once for all sets below, and a subtree is left when the n-grams that
   remain can't reach the similarity for any length found there, or when all its
   sets are already known to be in the set's component.
   First, every class joins its largest group only. Components of these links
   settle almost all groups. In groups that still hold several components,
   those members outside the largest one are probed against all members, in
   blocks. Groups with the same members count once.

Groups are split in blocks of `block` classes, so that no task holds more than
two blocks of sets, however many classes share an n-gram. In the first step a
block only misses links that the second step looks for.

Defined cases: null and empty texts have an empty set and are linked with
nothing; with fewer words than an n-gram has, the sequence counts as one n-gram;
repeated rows are in one class; a null id takes part and gets its component's
smallest id, null if there is none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import bitmap, in_bitmap, shuffled, sized, stored, text_or_empty
from concord.llm.components import components
from concord.llm.wordhash import mix, shingles, slices

_BUCKETS, _BLOCKS = 1 << 20, 16
_SEEN = "doc_id bigint, n bigint, cls bigint, block int, part int, counts binary"


def _class(found: np.ndarray) -> int:
    """Identity of a set: a hash of its n-grams and their number."""
    with np.errstate(over="ignore"):
        h = mix(found * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + mix(found ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        return int(mix(np.array([h + np.uint64(len(found))], np.uint64)).view(np.int64)[0])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))


def _read(docs: DataFrame, size: int) -> DataFrame:
    """Rows of documents with their class, and, for each partition, blocks of n-gram counts by bucket."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _SEEN.split(", ")]
        total = np.zeros(_BUCKETS, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for some in slices(batch, 1):
                sets = shingles(some.column(1), size)
                total += np.bincount((np.concatenate(sets) & np.uint64(_BUCKETS - 1)).astype(np.int64), minlength=_BUCKETS)
                n, none = some.num_rows, [None] * some.num_rows
                columns = [some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        n, none = _BLOCKS, pa.array([None] * _BLOCKS, pa.int64())
        counts = pa.array([x.tobytes() for x in np.split(np.minimum(total, 2**31 - 1).astype("<i4"), n)], pa.binary())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), counts], names=names)

    return _rows(docs).mapInArrow(read, _SEEN)


def _order(seen: DataFrame) -> np.ndarray:
    """How often n-grams of each bucket occur: a table of fixed size, summed over partitions in two steps."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i4").astype(np.int64) for x in t.column("counts").to_pylist())
        return pa.table({"block": t.column("block")[:1], "counts": pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})

    counts = seen.where("block IS NOT NULL").select("block", (F.col("part") % 32).alias("part"), "counts")
    some = counts.groupBy("block", "part").applyInArrow(add, "block int, counts binary")
    whole = {r["block"]: r["counts"] for r in some.groupBy("block").applyInArrow(add, "block int, counts binary").collect()}
    empty = bytes(4 * _BUCKETS // _BLOCKS)
    return np.concatenate([np.frombuffer(whole.get(k, empty), "<i4") for k in range(_BLOCKS)])


def _ordered(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set with rare n-grams first."""
    return found[np.lexsort((found, counts[(found & np.uint64(_BUCKETS - 1)).astype(np.int64)]))]


def _extra(n: int) -> int:
    """How many n-grams of their prefixes similar sets have in common at least: l of a set of n."""
    return 1 + n // 20


def _prefix(found: np.ndarray, percent: int, order: np.ndarray) -> np.ndarray:
    n = len(found)
    return _ordered(found, order)[: n - -(-percent * n // 100) + _extra(n)].view(np.int64)


def _prefixes(docs: DataFrame, size: int, percent: int, counts, only=None) -> DataFrame:
    """token, cls, n; only: bitmap of the tokens to give."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, done = counts.value, set()
        for batch in batches:
            for some in slices(batch, 1):
                tokens, classes, sizes = [], [], []
                for found in shingles(some.column(1), size):
                    cls = _class(found) if len(found) else None
                    if cls is None or cls in done:
                        continue
                    done.add(cls)
                    own = _prefix(found, percent, order)
                    tokens.append(own if only is None else own[in_bitmap(only.value, own)])
                    classes.append(np.full(len(tokens[-1]), cls))
                    sizes.append(np.full(len(tokens[-1]), len(found)))
                if len(done) > 200_000:
                    done = set()
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (tokens, classes, sizes)], names=["token", "cls", "n"])

    return _rows(docs).mapInArrow(read, "token bigint, cls bigint, n bigint")


def _shared(rows: DataFrame) -> DataFrame:
    """Tokens of two classes or more."""
    return rows.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("token")


def _sets(docs: DataFrame, wanted: DataFrame, size: int, bits: int = 25) -> DataFrame:
    """cls and its n-grams of the wanted classes, found by a bitmap of fixed size and then exactly."""
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "cls", bits))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for some in slices(batch, 1):
                found = [x for x in shingles(some.column(1), size) if len(x)]
                names = np.array([_class(x) for x in found], np.int64)
                classes, sets = [], []
                for cls, x, held in zip(names.tolist(), found, in_bitmap(marks.value, names).tolist(), strict=True):
                    if held and cls not in done:
                        done.add(cls)
                        classes.append(cls)
                        sets.append(x.view(np.int64))
                if classes:
                    yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "grams"])

    found = _rows(docs).mapInArrow(read, "cls bigint, grams array<bigint>")
    return found.join(shuffled(wanted), "cls", "left_semi").dropDuplicates(["cls"])


class Tree:
    """A prefix tree of sets, each an ascending array of ranks in a common order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        self.root = self._node(order, 0)

    def _node(self, members: list[int], depth: int):
        """A node: run of ranks that all its sets have from depth on, depth after it, sets that end there, children, members, least and largest size."""
        first, last = self.sets[members[0]], self.sets[members[-1]]  # in order: what these share, all share
        n = min(len(first), len(last))
        differs = np.flatnonzero(first[depth:n] != last[depth:n])
        end = depth + int(differs[0]) if len(differs) else n
        ends = [k for k in members if len(self.sets[k]) == end]
        rest = [k for k in members if len(self.sets[k]) > end]
        children, lo = [], 0
        while lo < len(rest):
            token, hi = self.sets[rest[lo]][end], lo + 1
            while hi < len(rest) and self.sets[rest[hi]][end] == token:
                hi += 1
            children.append(self._node(rest[lo:hi], end))
            lo = hi
        sizes = [len(self.sets[k]) for k in members]
        return first[depth:end], end, ends, children, members, min(sizes), max(sizes)

    def probe(self, own: np.ndarray, held: np.ndarray, percent: int, known) -> Iterator[int]:
        """Sets similar to `own`; held: for each rank whether own has it; known(members): whether they need no visit."""
        size, waiting = len(own), [(self.root, 0)]
        up, total = 100 + percent, percent  # I >= p/(100+p) (|x|+|y|)
        while waiting:
            (run, depth, ends, children, members, least, most), overlap = waiting.pop()
            if known(members):
                continue
            if len(run):
                overlap += int(np.count_nonzero(held[run]))
                left = size - int(np.searchsorted(own, run[-1], "right"))
            else:
                left = size
            best = min(max(depth + left, least), most)
            if up * (overlap + min(best - depth, left)) < total * (best + size):
                continue
            if ends and up * overlap >= total * (depth + size):
                yield from ends
            waiting += [(c, overlap) for c in children]


def _partners(t: pa.Table, percent: int) -> np.ndarray:
    """Which rows of a group (left rows, and right rows marked `other`) have a partner on the other side whose first common token is the group's."""
    other = t.column("other").to_numpy(zero_copy_only=False)
    token, cls, label, n = t.column("token")[0].as_py(), *(t.column(c).to_numpy() for c in ("cls", "label", "n"))
    tokens = [np.sort(np.asarray(x.values)) for x in t.column("tokens")]
    left = np.flatnonzero(~other)
    keep = np.zeros(t.num_rows, bool)
    held = np.concatenate([tokens[k] for k in left]) if len(left) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(left)), [len(tokens[k]) for k in left])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    for r in np.flatnonzero(other):
        lo, hi = np.searchsorted(held, tokens[r], "left"), np.searchsorted(held, tokens[r], "right")
        hits = [owner[a:b] for a, b in zip(lo, hi, strict=True)]
        common = np.bincount(np.concatenate(hits), minlength=len(left)) if hits else np.zeros(len(left), np.int64)
        earlier = [h for h, x in zip(hits, tokens[r], strict=True) if x < token]
        first = np.ones(len(left), bool)
        if earlier:
            first[np.concatenate(earlier)] = False
        small, large = np.minimum(n[left], n[r]), np.maximum(n[left], n[r])
        near = first & (common >= 1 + small // 20) & (100 * small >= percent * large) & (label[left] != label[r]) & (cls[left] != cls[r])
        if near.any():
            keep[r] = True
            keep[left[near]] = True
    return keep


def link(left: list[np.ndarray], right: list[np.ndarray], left_ids: list[int], right_ids: list[int], labels: dict[int, int], percent: int, counts: np.ndarray) -> list[tuple[int, int]]:
    """Links between left and right that connect what is linked; sets of a component by labels are connected from the start."""
    values = np.unique(np.concatenate([*left, *right]))
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts[values & (_BUCKETS - 1)]))] = np.arange(len(values))  # common n-grams first
    left_sets, right_sets = ([np.sort(rank[np.searchsorted(values, s)]) for s in sets] for sets in (left, right))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for ids in (left_ids, right_ids):
        for k in ids:
            parent[find(k)] = find(labels.get(k, k))
    tree, links = Tree(left_sets), []
    held = np.zeros(len(values), bool)
    for own, cls in zip(right_sets, right_ids, strict=True):
        held[own] = True
        for k in tree.probe(own, held, percent, lambda members: all(find(left_ids[m]) == find(cls) for m in members)):  # noqa: B023
            other = left_ids[k]
            if find(other) != find(cls):
                links.append((cls, other))
                parent[find(other)] = find(cls)
        held[own] = False
    return links


def similar(docs: DataFrame, size: int = 3, percent: int = 90, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sc = docs.sparkSession.sparkContext
    seen = stored(_read(docs, size), "seen")
    counts = sc.broadcast(_order(seen))  # 4 MB, whatever the corpus
    rows = seen.where("block IS NULL").select("doc_id", "n", "cls")
    shared = stored(_shared(_prefixes(docs, size, percent, counts).select("token", "cls")), "shared")
    held = sc.broadcast(bitmap(shared, "token", 25))
    members = _prefixes(docs, size, percent, counts, held).distinct().join(sized(shared), "token", "left_semi")
    members = stored(members, "members")
    # a partner of a set of n has 9/10 n n-grams at least, so l of either set is that of 9/10 n or more
    enough = members.groupBy("cls", "n").agg(F.count(F.lit(1)).alias("tokens")).where(F.col("tokens") >= 1 + F.floor(F.col("n") * percent / 2000)).select("cls")
    members = members.join(shuffled(enough), "cls", "left_semi")
    members = stored(members.join(shuffled(_shared(members)), "token", "left_semi"), "members")
    sets = stored(_sets(docs, members.select("cls").distinct(), size), "sets")

    # each class in its largest group
    sizes = members.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    best = members.join(shuffled(sizes), "token").groupBy("cls").agg(F.max(F.struct("size", "token")).alias("best"))
    picked = best.select("cls", F.col("best.token").alias("token"), F.pmod(F.xxhash64("cls"), F.ceil(F.col("best.size") / block)).alias("i"))
    schema = "a bigint, b bigint"

    def within(t: pa.Table) -> pa.Table:
        ids, grams = t.column("cls").to_pylist(), [np.asarray(x.values) for x in t.column("grams")]
        found = link(grams, grams, ids, ids, {}, percent, counts.value.astype(np.int64)) if len(ids) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    links = stored(picked.join(shuffled(sets), "cls").select("token", "i", "cls", "grams").groupBy("token", "i").applyInArrow(within, schema), "first")
    labels = stored(components(links), "labels")

    # groups of several components
    named = members.join(sized(labels), F.col("cls") == F.col("node"), "left").select("token", "cls", "n", F.coalesce("label", "cls").alias("label"))
    by_label = named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("xor"))
    groups = by_label.groupBy("token").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("sum").alias("sum"), F.bit_xor("xor").alias("xor")).where("labels > 1")
    groups = groups.groupBy("size", "sum", "xor").agg(F.min("token").alias("token"), F.first("main").alias("main"))
    groups = groups.select("token", F.col("main.label").alias("main"), F.ceil(F.col("size") / block).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("main.n")) / block).cast("int").alias("others"))
    open_ = named.join(groups, "token")
    left = open_.select("token", "cls", "label", "n", F.lit(False).alias("other"), F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"))
    right = open_.where("label != main").select("token", "cls", "label", "n", F.lit(True).alias("other"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)).alias("i"), F.pmod(F.xxhash64("cls"), F.col("others")).cast("int").alias("j"))
    # by prefixes first, a seventh of the sets: who has enough of them in common with a member of another component, each pair in the group of its first token only
    lists = named.groupBy("cls").agg(F.collect_list("token").alias("tokens"))
    columns = "token bigint, i bigint, j int, cls bigint, label bigint, other boolean"

    def candidates(t: pa.Table) -> pa.Table:
        keep = _partners(t, percent)
        return t.filter(pa.array(keep)).select(["token", "i", "j", "cls", "label", "other"])

    pairs = left.unionByName(right).join(lists, "cls").select("token", "i", "j", "cls", "label", "other", "n", "tokens")
    pairs = stored(pairs.groupBy("token", "i", "j").applyInArrow(candidates, columns), "candidates")

    def across(t: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        other = t.column("other").to_numpy(zero_copy_only=False)
        grams = [np.asarray(x.values) for x in t.column("grams")]
        ids, names = t.column("cls").to_pylist(), t.column("label").to_pylist()
        at = [np.flatnonzero(~other), np.flatnonzero(other)]
        if all(map(len, at)):
            (a, a_ids), (b, b_ids) = (([grams[k] for k in x], [ids[k] for k in x]) for x in at)
            found = link(a, b, a_ids, b_ids, dict(zip(ids, names, strict=True)), percent, counts.value.astype(np.int64))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    more = sized(pairs).join(sets, "cls").select("token", "i", "j", "cls", "label", "other", "grams").groupBy("token", "i", "j").applyInArrow(across, schema)
    final = sized(stored(components(links.union(more)), "final"))
    smallest = rows.where("n > 0").join(final, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("label", "cls").alias("label"), "doc_id")
    least = smallest.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named_rows = rows.join(final, F.col("cls") == F.col("node"), "left").select("doc_id", "n", F.coalesce("label", "cls").alias("label"))
    out = named_rows.join(least, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
