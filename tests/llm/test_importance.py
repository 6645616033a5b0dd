import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from concord.llm import importance


def tokens(text):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets(text, n=2):
    w = tokens(text)
    return [zlib.crc32(" ".join(w[k : k + m]).encode()) % 10000 for m in range(1, n + 1) for k in range(len(w) - m + 1)]


def brute(docs, target, n=2):
    s, t = (Counter(b for x in texts for b in buckets(x, n)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        b = buckets(text, n)
        gain = [math.floor(1000 * math.log((t[k] + 1) * (s_all + 10000) / ((s[k] + 1) * (t_all + 10000)))) for k in b]
        weight = sum(gain) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    open_ = [r for r, (_, text) in zip(rows, docs, strict=True) if len(tokens(text)) >= 20]
    for k, r in enumerate(sorted(open_, key=lambda r: (-r[3], r[0] is None, r[0]))[: 25 * len(open_) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["A", "Zé", "ß", "the", "x1", "9", "ÀÉ", "日本", "word" * 30, *(f"w{k}" for k in range(300))]
    gaps = [" ", "  ", ".\n", "-", "`", "@[", "{|}", "\t", "\x7f"]
    make = lambda n: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    docs = [(k, make(rng.choice([0, 1, 2, 19, 20, 21, 60]))) for k in range(200)]
    docs += [(200, make(3000)), (201, make(20_000)), (202, "." * 5000 + make(30) + "-" * 5000), (203, "a" * 5000), (204, None), (205, "!?"), (None, make(40))]
    return docs + [docs[3], docs[200], (7, make(50))], [make(50) for _ in range(5)] + [None, docs[200][1][:2000]]


def test_against_brute_force(spark, documents):
    docs, target = corpus(1)
    df, t = documents(docs, rank=1, copy="mine", place=2), spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    for n, chunk in ((2, 1 << 15), (2, 100), (3, 500)):
        got = importance.resample(df, t, n=n, chunk=chunk)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted([tuple(r) for r in got.collect()], key=str) == brute(docs, target, n)


def test_chunks_own_what_begins_in_them():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["é", "a", "B", "7", " ", "..", "\n"]) for _ in range(rng.randint(0, 200))).encode()
        for n in (1, 2, 3):
            got = []
            parts = list(importance.split_at_words(text, rng.choice([1, 7, 30]), n - 1))
            assert b"".join(p[:own] for p, own in parts) == text
            for part, own in parts:
                found, _, _ = importance.features(np.frombuffer(part, np.uint8), np.array([0, len(part)]), np.array([own]), n, 10000)
                got += found.tolist()
            assert sorted(got) == sorted(buckets(text.decode(), n))


def test_few_rows(spark, documents):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(documents([(1, "x")]).limit(0), none).count() == 0
    rows = [(k, "word " * 20) for k in range(8)] + [(8, "word " * 19)]
    assert [tuple(r) for r in importance.resample(documents(rows), none, seed=7).where("rank is not null").orderBy("rank").collect()] == sorted([r for r in brute(rows, []) if r[4]], key=lambda r: r[4])
