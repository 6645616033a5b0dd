import random

import numpy as np
import pyarrow as pa

from concord.llm import jaccard
from concord.llm.components import components
from concord.llm.wordhash import shingles


def sets(docs, size):
    out = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def brute(docs, size, percent):
    s = sets(docs, size)
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                label[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return sorted([(i, len(s[k]), ids.get(find(k)) if s[k] else i) for k, (i, _) in enumerate(docs)], key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    shared = " ".join(rng.choice(words) for _ in range(40))
    docs = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(rng.choice([1, 2, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((len(docs), " ".join(w).upper() if rng.random() < 0.3 else " \n".join(w) + (" " + shared if group % 3 == 0 else "")))
    rng.shuffle(docs)
    return docs + [(900, None), (901, ""), (902, " \t"), (903, "two words"), (904, "Two  WORDS"), (905, "one"), docs[0], (None, docs[1][1]), (906, "long " * 5000 + "x")]


def test_against_brute_force(documents):
    docs = corpus(3)
    df = documents(docs, cls="mine", token=1)
    for block in (512, 4):
        got = sorted([tuple(r) for r in jaccard.similar(df, size=3, percent=90, block=block).collect()], key=str)
        assert got == brute(docs, 3, 90)


def test_tree_finds_what_pairs_find():
    rng = random.Random(1)
    found = [np.array(sorted(rng.sample(range(40), rng.randint(1, 25)))) for _ in range(60)]
    tree = jaccard.Tree(found)
    for own in found:
        held = np.zeros(40, bool)
        held[own] = True
        got = sorted(tree.probe(own, held, 60, lambda _: False))
        assert got == [k for k, s in enumerate(found) if 100 * len(set(s) & set(own)) >= 60 * len(set(s) | set(own))]


def test_shingle_hashes_are_sets():
    texts = ["A b  c\nd", "a B c d", "", "x y", "b c d a b c d"]
    got = shingles(pa.array(texts), 3)
    assert got[0].tolist() == got[1].tolist() and [len(x) for x in got] == [2, 2, 0, 1, 4]
    assert shingles(pa.array(["pad", *texts]).slice(1), 3)[3].tolist() == got[3].tolist()


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    label = {x: x for e in links for x in e}
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in links)}


def test_no_rows(documents):
    assert jaccard.similar(documents([(1, "x")]).limit(0)).count() == 0


def thue_morse(length):
    """A word over a and b and its complement: any polynomial modulo 2**64 gives both one value from 1,024 letters on."""
    a, b = "a", "b"
    while len(a) < length:
        a, b = a + b, b + a
    return a, b


def test_texts_shorter_than_a_shingle_alone_in_a_slice(documents):
    for size, n, before in ((3, 1, True), (3, 2, False), (5, 4, True)):
        docs = [(1, "word " * 70_000)] * before + [(2, " ".join(f"w{k}" for k in range(n)))]
        got = sorted([tuple(r) for r in jaccard.similar(documents(docs).coalesce(1), size=size, percent=80).collect()], key=str)
        assert got == brute(docs, size, 80)


def test_words_with_a_regular_pattern_differ(documents):
    docs = []
    for length in (64, 1024, 4096):
        a, b = thue_morse(length)
        docs += [(len(docs) + k, t) for k, t in enumerate((a, b, a.upper(), f"x {b}", f"x {a}"))]
    got = sorted([tuple(r) for r in jaccard.similar(documents(docs), size=3, percent=90).collect()], key=str)
    assert got == brute(docs, 3, 90)
