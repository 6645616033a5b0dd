import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import periodic


def brute(w, least):
    """All runs, period by period."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted([(s, n, q) for (s, n), q in best.items()], key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    w, letters = [], rng.choice([1, 2, 3, 40])
    while len(w) < rng.randint(0, 200):
        kind = rng.random()
        if kind < 0.4:
            root = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
            w += (root * rng.randint(1, 12))[: rng.randint(1, 60)]
        elif kind < 0.7 and w:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randint(1, 80)]
        else:
            w += [rng.randrange(letters) for _ in range(rng.randint(1, 10))]
    return w


def test_runs_of_words_against_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        w = periodic_words(rng)
        for least in (2, 12):
            assert periodic.runs(np.array(w, np.int32), least) == brute(w, least), (w, least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=40))
def test_runs_of_two_words(w):
    assert periodic.runs(np.array(w, np.int32), 2) == brute(w, 2)


def test_factors_are_the_longest_that_stand_before():
    rng = random.Random(2)
    for _ in range(200):
        w = periodic_words(rng)[:60]
        at = 0
        for s, e, source in periodic.factors(w):
            earlier = lambda n, s=s: [a for a in range(s) if w[a : a + n] == w[s : s + n]]
            assert s == at and (e == s + 1 if source < 0 else source in earlier(e - s))
            assert e == len(w) or not earlier(e - s + (source >= 0))
            at = e
        assert at == len(w)


def expected(i, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(i).encode())
    g = h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute(w, 12)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (
        i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), digest(b" ".join(x for k, x in enumerate(w) if k not in gone)),
    )


def test_report_against_brute_force(documents):
    rng = random.Random(3)
    rows = [(k, rng.choice([" ", "\n", "\t \r"]).join(f"é{x}" for x in periodic_words(rng))) for k in range(300)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one " * 500), (304, "a b b c\x1cc " * 40), rows[0], (rows[1][0], rows[2][1]), (None, "x y " * 9), (305, "w" * 5000 + " w")]
    got = periodic.report(periodic.with_planted_runs(documents(rows, runs="mine", period=1, _n=2)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([expected(*r) for r in rows], key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_long_text_and_pieces():
    text = b"\t".join(b"w%d" % (k % 1000) for k in range(50_000))
    ids, known = periodic.numbered(text, piece=100)
    assert len(known) == 1000 and periodic.runs(ids) == [(0, 50_000, 1000)]
    n, found, kept = periodic._collapsed(text, 12)
    assert n == 50_000 and kept.count(b" ") == 999


def test_no_rows(documents):
    assert periodic.report(documents([(1, "x")]).limit(0)).count() == 0
