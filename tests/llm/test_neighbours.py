import numpy as np

from concord.llm import neighbours


def brute(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok = list({(i, tuple(v)): (i, v) for i, v in ok}.values())
    out = {}
    for q, v in ok:
        if q in queries:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def run(spark, rows, queries, k, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS rank")
    found = {}
    for r in neighbours.nearest(df, df.where(df.vec_id.isin(queries)), k, **kw).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return found


def test_recall_ties_and_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[300:700] = x[300]  # a vector with many copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = [*range(0, 1500, 100), 310]
    expected = brute([(i, [float(np.float32(a)) for a in v]) for i, v in rows], queries, 10)
    got = run(spark, rows, queries, 10, block=500, query_block=5)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in queries)
    assert hits >= 0.9 * 10 * len(queries)
    assert [i for i, _ in got[310]] == [i for i in range(300, 311) if i != 310]


def verified(x, places, k=20, m=48, share=0.8, miss=0.1, step=1.15):
    """Recall and the share of vectors verified, with the parameters of the query."""
    least = int(np.ceil(share * m))
    block, reach = neighbours.Block(x, float(np.sqrt((x * x).sum(axis=1).max())), m, 7), neighbours.ratio(m, least, miss)
    hits = seen = 0
    for q in places:
        near, scores = block.search(x[q], np.array([q]), k, least, reach, step)
        assert q not in near and len(set(near.tolist())) == len(near) and np.allclose(scores, x[near] @ x[q])
        exact = np.delete(x @ x[q], q)
        hits += (np.sort(scores)[-k:] >= np.sort(exact)[-k] - 1e-12).sum()
        seen += len(near)
    return hits / k / len(places), seen / len(places) / len(x)


def test_recall_and_candidates_by_size():
    rng = np.random.default_rng(5)
    shares = []
    for n in (500, 2000, 20000):
        x = rng.standard_normal((n, 64))
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        recall, share = verified(x, range(0, n, n // 25))
        assert recall >= 0.9, (n, recall)
        shares.append(share)
    assert shares[0] > shares[1] > shares[2]  # candidates grow slower than the table
    x = rng.standard_normal((200, 64)).repeat(20, axis=0) + 0.1 * rng.standard_normal((4000, 64))  # clear neighbours
    recall, share = verified(x, range(0, 4000, 160), k=10)
    assert recall >= 0.95 and share < 0.1, (recall, share)


def test_ratio_of_windows():
    rng = np.random.default_rng(6)
    reach = neighbours.ratio(48, 39, 0.1)
    missed = ((np.abs(rng.standard_normal((20000, 48))) <= reach).sum(axis=1) < 39).mean()
    assert abs(missed - 0.1) < 0.01


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0, 3.0])]
    got = run(spark, rows, list(range(10)), 3)
    assert got == {0: [(7, 5.0), (8, 5.0)], 7: [(0, 5.0), (8, 5.0)], 8: [(0, 5.0), (7, 5.0)]}


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neighbours.nearest(df, df).count() == 0
