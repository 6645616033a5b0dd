import random

from concord.llm import lines
from concord.llm.common import stored


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def brute(docs, most, least):
    seen, done, out = [], {}, []
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0)):
        if docs[k] not in done:
            i, t = docs[k]
            kept = []
            for x in (t or "").split("\n"):
                if len(x) < least or not any(abs(len(x) - len(s)) <= most and distance(x, s) <= most for s in seen):
                    kept.append(x)
                if len(x) >= least:
                    seen.append(x)
            done[docs[k]] = (i, None if t is None else "\n".join(kept), 0 if t is None else t.count("\n") + 1 - len(kept))
        out.append(done[docs[k]])
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [f"the quick brown fox jumps over {k}{k}{k}" for k in range(6)] + ["a" * 25, "ünïcödé lïnes wïth äccents héré", "short"]
    docs = []
    for i in range(n):
        some = []
        for _ in range(rng.randint(0, 5)):
            x = rng.choice(base)
            p = rng.randrange(len(x))
            x = rng.choice([x, x[:p] + rng.choice("abé") + x[p + 1 :], x[:p] + x[p + 1 :], x[:p] + rng.choice("abé") + x[p:]])
            some.append(x)
        docs.append((i, "\n".join(some)))
    return docs + [(n, None), (None, "x" * 30), (n + 1, ""), docs[5], (n + 2, "y" * 20_000)]


def test_against_brute_force(documents):
    docs = corpus(5)
    for most in (1, 0):
        df = documents(docs, n_removed=7, removed="mine")
        got = sorted([(r["doc_id"], r["text"], r["n_removed"]) for r in lines.deduplicate(df, max_edits=most).collect()], key=str)
        assert got == brute(docs, most, 20)


def test_full_bitmap_changes_nothing(documents):
    docs = corpus(8, 30)
    got = sorted([(r["doc_id"], r["text"], r["n_removed"]) for r in lines.deduplicate(documents(docs), bitmap_bits=15).collect()], key=str)
    assert got == brute(docs, 1, 20)


def test_no_rows(documents):
    assert lines.deduplicate(documents([(1, "x")]).limit(0)).count() == 0


def test_keys_and_texts_are_not_broadcast(spark):
    # what mapInArrow returns is taken to be as small as what it reads, but a line has many keys
    texts = spark.createDataFrame([(k, f"a line of twenty or more {k}", 3, k) for k in range(10)], "lid bigint, line string, sides int, order bigint")
    near = lines._near(stored(texts, "texts"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r["lid"] for r in near.collect()} == set(range(1, 10))
