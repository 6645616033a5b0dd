import inspect
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from concord.llm import classlm


def test_base_and_model(documents):
    rng = random.Random(1)
    nouns, verbs = [f"n{k}" for k in range(30)], [f"v{k}" for k in range(30)]
    texts = [" ".join(rng.choice(nouns if k % 2 else verbs) for k in range(rng.randint(1, 60))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(400, None), (401, ""), (402, "Word " * 5000), (7, texts[7]), (403, "never seen words here")]
    got = {}
    found = classlm.score(documents(rows, word="mine", n=1), core=40, classes=6, groups=2).collect()
    assert len(found) == len(rows)
    for r in found:
        got[r["doc_id"]] = r
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    base = model = 0.0
    for i, ws in tokens:
        r = got[i]
        expected = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - expected) < 1e-6
        assert r["score"] < 0
        if r["held_out"] and i < 300:
            base, model = base + r["base_score"], model + r["score"]
    assert model > base  # word classes follow each other in turn


def test_probabilities_sum_to_one(documents):
    """Scores of a history with each known word and an unknown one differ by that word's probability alone."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    train = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(40) if zlib.crc32(str(k).encode()) % 5 != 1]
    held = [k for k in range(1000, 3000) if zlib.crc32(str(k).encode()) % 5 == 1][:15]
    known = sorted({w for _, t in train for w in t.split()})
    probes = list(zip(held, [*known, "unseen"], strict=False))
    rows = train + [(i, f"{known[0]} {w}") for i, w in probes] + [(held[-1], known[0])]
    for extra in ({"core": 4, "classes": 2, "groups": 1}, {"core": 20, "classes": 3, "groups": 2}):
        got = {r["doc_id"]: r["score"] for r in classlm.score(documents(rows), **extra).collect()}
        # p(history, w, end) summed over w can't exceed p(history), and p(history, end) is one of its ways on
        total = sum(10 ** got[i] for i, _ in probes) + 10 ** got[held[-1]]
        assert total < 1


def test_exchange_finds_classes():
    counts = np.zeros((8, 8))
    counts[:4, 4:] = counts[4:, :4] = 10  # words of one half follow those of the other
    own = classlm.exchange(counts, 2)
    assert len(set(own[:4])) == 1 and len(set(own[4:])) == 1 and own[0] != own[4]


def test_exchange_never_lowers_the_likelihood():
    counts = np.random.default_rng(0).poisson(1.0, (30, 30)).astype(float)

    def likelihood(own):
        member = np.eye(4)[own]
        pairs = member.T @ counts @ member
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(pairs) - f(pairs.sum(0)) - f(pairs.sum(1))

    found = [likelihood(classlm.exchange(counts, 4, passes=p)) for p in range(5)]
    assert found == sorted(found) and found[-1] > found[0]


def test_no_rows(documents):
    assert classlm.score(documents([(1, "x")]).limit(0)).count() == 0


def test_gains_are_differences_of_likelihood():
    """Moves of one word out of the other words, held against the likelihood of all bigrams."""
    counts = np.random.default_rng(3).poisson(0.7, (14, 14)).astype(float)
    own = np.array([0, 1, 2, 0, 1, 2, *[3] * 7, 4])  # 3: other words, 4: the end
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()

    def likelihood(own):
        pairs = np.eye(5)[own].T @ counts @ np.eye(5)[own]
        return f(pairs) - f(pairs.sum(0)) - f(pairs.sum(1))

    member = np.eye(5)[own]
    for w in range(6, 13):
        after, before, self_ = counts[w] @ member, counts[:, w] @ member, counts[w, w]
        after[3] -= self_
        before[3] -= self_
        got = classlm.gains(member.T @ counts @ member, np.concatenate([before, after, [self_]])[None])[0]
        expected = np.array([likelihood(np.where(np.arange(14) == w, b, own)) for b in range(3)])
        assert np.allclose(got - got[0], expected - expected[0])


def _lexicon(texts, core, classes):
    train = classlm._texts(texts).where("not held_out")
    top = classlm.word_counts(train).where(f"word != {classlm.END}").orderBy("n", "word", ascending=[False, True]).limit(core).collect()
    words = np.array([r["word"] for r in top], np.int64)
    order = np.argsort(words)
    counts = classlm.bigrams(train, words[order], order)
    own = classlm.exchange(counts, classes, fixed=2)
    member = np.eye(classes + 2)[own]
    found = classlm.assigned(train, words[order], order, own, member.T @ counts @ member)
    return {r["word"]: (r["n"], r["cls"]) for r in found.collect()}, dict(zip(words.tolist(), own, strict=False))


def test_rare_words_are_classed_by_their_neighbours(documents):
    """One text holds rare words of both kinds, each between the common words of the other kind."""
    import pyarrow as pa

    rng = random.Random(5)
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 != 1][:200]
    rows = [(i, " ".join(rng.choice([f"n{k}" for k in range(8)] if j % 2 else [f"v{k}" for k in range(8)]) for j in range(40))) for i in ids]
    rare = [f"rn{k}" for k in range(10)], [f"rv{k}" for k in range(10)]
    rows[0] = (ids[0], " ".join([f"v1 {w} v2 n3" for w in rare[0]] + [f"n1 {w} n2 v3" for w in rare[1]] + ["twice twice"]))
    found, common = _lexicon(documents(rows), 16, 2)
    key = lambda w: int(classlm.word_hashes(pa.array([w]))[0].view(np.int64)[0])
    for names, like in zip(rare, ("n1", "v1"), strict=True):
        assert {found[key(w)] for w in names} == {(1, common[key(like)])}
    assert found[key("twice")][0] == 2
    assert common[key("n1")] != common[key("v1")] and len(found) == 21


def test_number_of_classes_is_bounded(documents):
    for classes in (0, 510):
        with pytest.raises(ValueError, match="509"):
            classlm.score(documents([]), classes=classes)


def test_core_of_the_query():
    assert inspect.signature(classlm.score).parameters["core"].default >= 2048


def test_long_words_with_a_regular_pattern_are_told_apart(documents):
    a, b = "a", "b"
    while len(a) < 1024:
        a, b = a + b, b + a
    train, held = ([k for k in range(99) if (zlib.crc32(str(k).encode()) % 5 == 1) == out] for out in (False, True))
    rows = [(k, f"{a} word") for k in train[:5]] + [(held[0], b), (held[1], a)]
    got = {r["doc_id"]: r["n_known"] for r in classlm.score(documents(rows), core=4, classes=2, groups=1).collect()}
    assert (got[held[0]], got[held[1]]) == (1, 2)  # the end alone, the word and the end
