"""Nearest neighbours by inner product: collision-counting hashing.

Base vectors are dealt into blocks by id. In a block each of m random
projections gives one sorted array. A query opens a window centred on its own
projection in every array and widens all windows together (virtual rehashing); what
their ends newly cover is counted for each vector. A vector that reaches `share` * m
collisions is verified at once by its inner product. A query is done when windows are
so wide that a vector as near as the k-th best would have been verified but with
probability `miss`, so nearer ones all the more; no share of the block is set. Until
k are found, windows widen on, in the end over all vectors. By brute force, with the
parameters of `nearest`, recall was 0.97 and more on 500 to 16,384 vectors of 64
dimensions without clear neighbours; candidates were from 0.8 to 0.5 of a block, less
the larger it is.

Inner products become distances in one more dimension: base vectors are
completed to the largest norm, queries by zero and scaled to that norm, which
leaves the order as it is. The projections come from a seed, so all tasks have
the same ones and nothing fitted is sent around.

Queries are a stated set, taken in blocks against blocks of the base; a task
holds one block of either, whatever the sizes of the tables. The best k of each
block are merged by rank. Equal vectors collide alike, so a vector with
thousands of copies makes all of them candidates and ties go to smaller ids.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components take no part; vectors only meet those of their dimension; repeated
rows count once; fewer candidates than k are all returned; extra columns are
ignored.
"""

from __future__ import annotations

from math import ceil, comb
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles, _dim and _norm2 of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(sound & F.exists("embedding", lambda x: x != 0))
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return v.select("vec_id", "embedding", F.size("embedding").alias("_dim"), norm2.alias("_norm2"))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending and without repeats, and their vectors."""
    ids = t.column("vec_id").to_numpy()
    flat = t.column("embedding").combine_chunks()
    flat = (flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy()
    x = flat.reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)
    return ids[new], np.ascontiguousarray(x[new])


def ratio(m: int, least: int, miss: float) -> float:
    """The half width of windows, in distances, at which a vector at that distance collides in `least` of m projections but with probability `miss`."""
    low, high = 0.0, 1.0
    for _ in range(50):
        p = (low + high) / 2
        fewer = sum(comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(least))
        low, high = (p, high) if fewer > miss else (low, p)
    return NormalDist().inv_cdf((1 + high) / 2)


class Block:
    """Base vectors of one block, with a sorted array for each of m random projections."""

    def __init__(self, x: np.ndarray, norm: float, m: int, seed: int):
        self.x, self.norm, n, d = x, norm, *x.shape
        axes = np.random.default_rng(seed).standard_normal((d + 1, m))
        rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", x, x), 0))
        at = (x @ axes[:d] + rest[:, None] * axes[d]).T
        self.axes = axes[:d]
        self.order = np.argsort(at, axis=1, kind="stable")
        self.values = np.take_along_axis(at, self.order, axis=1)
        self.some = at[:, :: max(1, n // 160)]

    def search(self, query: np.ndarray, own: np.ndarray, k: int, least: int, reach: float, step: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vectors that became candidates, and their inner products; own: places that take no part."""
        if not np.isfinite(self.norm):
            near = np.setdiff1d(np.arange(len(self.x)), own)
            return near, self.x[near] @ query
        (_, n), length = self.values.shape, float(np.sqrt(query @ query))
        centre = (query * (self.norm / length)) @ self.axes
        # windows to begin with: as wide as some k of the vectors would need
        needed = np.sort(np.partition(np.abs(self.some - centre[:, None]), least - 1, axis=0)[least - 1])
        width = max(needed[min(len(needed) - 1, k * len(needed) // n)], 1e-9 * self.norm)
        low = high = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centre, strict=True)])
        hits, candidate = np.zeros(n, np.int64), np.zeros(n, bool)
        candidate[own] = True
        found, scores = [], []
        best = np.zeros(0)  # the k largest inner products so far
        while True:
            lower = np.array([np.searchsorted(v, c, "left") for v, c in zip(self.values, centre - width, strict=True)])
            upper = np.array([np.searchsorted(v, c, "right") for v, c in zip(self.values, centre + width, strict=True)])
            ends = [o[a:b] for o, a, b in zip(self.order, lower, low, strict=True)] + [o[a:b] for o, a, b in zip(self.order, high, upper, strict=True)]
            hits += np.bincount(np.concatenate(ends), minlength=n)
            low, high = lower, upper
            new = np.flatnonzero((hits >= least) & ~candidate)
            candidate[new] = True
            if len(new):
                found.append(new)
                scores.append(self.x[new] @ query)
                best = np.concatenate([best, scores[-1]])
                best = np.partition(best, len(best) - k)[-k:] if len(best) > k else best
            if len(best) == k:
                distance = self.norm * np.sqrt(max(0.0, 2 - 2 * best.min() / (self.norm * length)))
                if width >= reach * distance:
                    break
            if not lower.any() and (upper == n).all():
                break
            width *= step  # virtual rehashing: all windows widen together
        return np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(scores or [np.zeros(0)])


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the components: equal rows get equal values."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * q[j]
    return total


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, m: int = 48, share: float = 0.8, miss: float = 0.1, step: float = 1.15, block: int = 16384, query_block: int = 4096, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k vectors found nearest, those with its own id left out."""
    least = max(1, ceil(share * m))
    b, q = usable(base), usable(queries)
    sizes = b.groupBy("_dim").agg(F.count(F.lit(1)).alias("_n"), F.max("_norm2").alias("_max2"))
    asked = q.groupBy("_dim").agg(F.count(F.lit(1)).alias("_q"))
    plan = sizes.join(asked, "_dim").select("_dim", F.sqrt("_max2").alias("_norm"), F.ceil(F.col("_n") / block).cast("int").alias("_blocks"), F.ceil(F.col("_q") / query_block).cast("int").alias("_groups"))
    b, q = (x.select("vec_id", "embedding", "_dim") for x in (b, q))
    b = b.join(plan, "_dim").withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).cast("int")).withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    q = q.join(plan, "_dim").withColumn("_group", F.pmod(F.xxhash64("vec_id"), F.col("_groups")).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    keys, columns = ["_dim", "_group", "_block"], ["_dim", "_group", "_block", "vec_id", "embedding", "_norm"]

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            ids, x = _matrix(left)
            asked_ids, y = _matrix(right)
            norm = left.column("_norm")[0].as_py()
            held, reach = Block(x, norm, m, seed), ratio(m, least, miss)
            for qid, vector in zip(asked_ids, y, strict=True):
                own = np.arange(np.searchsorted(ids, qid), np.searchsorted(ids, qid, "right"))
                near, rough = held.search(vector, own, k, least, reach, step)
                if len(near) > k:  # only rounding tells rough scores from exact ones
                    slack = 1e-9 * norm * float(np.sqrt(vector @ vector))
                    near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack]
                score = products(x[near], vector)
                best = np.lexsort((ids[near], -score))[:k]
                found.append((np.full(len(best), qid), ids[near][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    # both sides get attributes of their own: they may come from one table
    b, q = (x.select(*[F.col(c).alias(c) for c in columns]) for x in (b, q))
    found = b.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(match, FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
