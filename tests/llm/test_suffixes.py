import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import suffixes


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=60))
def test_suffix_array(text):
    data = text.encode()
    assert suffixes.suffix_array(data) == sorted(range(len(data)), key=lambda i: data[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(b"ab\xff\0"[x % 4] for x in b)), min_size=1, max_size=6))
def test_suffix_arrays_in_step(texts):
    assert [x.tolist() for x in suffixes.suffix_arrays(texts)] == [sorted(range(len(t)), key=lambda i: t[i:]) for t in texts]


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, b in data:
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] = count.get(b[k : k + length], 0) + 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    passage = "".join(rng.choice("abé ") for _ in range(60))
    docs = []
    for i in range(100):
        r, x = rng.random(), "".join(rng.choice("ab") for _ in range(rng.randint(0, 80)))
        docs.append((i, x[:20] + passage[: rng.randint(30, 60)] + x[20:] if r < 0.5 else "a" * rng.randint(0, 90) if r < 0.6 else x))
    return docs + [(200, None), (201, ""), docs[3], (None, passage * 2), (202, "z" * 3000)]


def test_against_brute_force(documents):
    rows = corpus(3)
    df = documents(rows, a="mine", runs=1, doc_=2, r=3)
    assert sorted([tuple(r) for r in suffixes.report(df, length=20, k=8).collect()], key=str) == brute(rows, 20)


def test_split_anchors_and_full_bitmaps(documents):
    rows = corpus(6)
    got = suffixes.report(documents(rows), length=20, k=8, block=4, bucket=500, bits=15).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 20)


def test_deduplicate_keeps_columns(documents):
    df = documents([(1, "é" * 30), (2, "x" + "é" * 30), (3, None)], kept="mine", runs=1, r=2, DOC_=3, doc=4, key=5)
    out = {r["doc_id"]: r for r in suffixes.deduplicate(df, length=21, k=8).collect()}
    assert suffixes.deduplicate(df, length=21, k=8).columns == df.columns
    assert out[1]["text"] == "" and out[2]["text"] == "x" and out[3]["text"] is None and out[1]["kept"] == "mine"


def test_no_rows(documents):
    assert suffixes.report(documents([(1, "x")]).limit(0)).count() == 0
