import hashlib
import random
import re

from concord.llm import credentials as C


def brute_base(text):
    """The three patterns as they stand, without any test beforehand."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m["v"]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def brute_all(text, reach):
    """Every pair of parts, and every endpoint with every pair."""
    base = brute_base(text)
    parts, taken = [(s, e, {0: 1, 1: 0, 2: 1}[k], k) for s, k, e in base], [(s, e) for s, _, e in base]
    for kind, pattern in C.WEAK:
        fresh = [m.span() for m in pattern.finditer(text or "") if all(e <= m.start() or m.end() <= s for s, e in taken)]
        taken += fresh
        parts += [(s, e, {3: 0, 4: 2, 5: 1}[kind], kind) for s, e in fresh]
    near = lambda a, b: a[0] - reach <= b[1] and b[0] <= a[1] + reach
    out = set(base)
    for a in parts:
        for b in parts:
            if (a[2], b[2]) == (0, 1) and near(a, b):
                out |= {(x[0], x[3], x[1]) for x in (a, b)} | {(u[0], u[3], u[1]) for u in parts if u[2] == 2 and near(a, u) and near(b, u)}
    return base, sorted(out)


def spelled(found):
    return ",".join(f"{C.KINDS[k]}:{s}:{e}" for s, k, e in found)


def expected(i, text, reach):
    base, found = brute_all(text, reach)
    return (i, *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(found))


def corpus(seed):
    rng = random.Random(seed)
    pick = [
        'token = "%s"', "API_KEY:%s", "Password = %s", "passwd='%s'", "secret=%s", "user: %s", "client_id=%s", "login = '%s'", "pwd=%s", "auth: %s", "host=%s", "https://%s.example/x", "10.0.0.1:%s", "ſecret=%s", "toKen=%s", "AKIA%s", "ASIA%s", "%s",
    ]
    value = lambda: "".join(rng.choice(rng.choice(["0123456789abcdef", "ABCDEFGHIJ0123456789", "aZ3/+_"])) for _ in range(rng.choice([2, 5, 6, 8, 16, 24, 40])))
    same = lambda: "".join(rng.choice(s) for s in [rng.choice(["0123456789abcdef", "ABCDEFGHIJ0123456789", "aZ3/+_"])] * rng.choice([2, 5, 6, 8, 16, 24, 40]))
    docs = []
    for k in range(300):
        text = ""
        for _ in range(rng.choice([0, 1, 3, 12])):
            text += "é word. " * rng.choice([0, 1, 4, 12, 30]) + (p % rng.choice([value, same])() if "%" in (p := rng.choice(pick)) else p) + rng.choice([" ", "\n", ", "])
        docs.append((k, text))
    docs += [(400, None), (401, ""), (402, "token " * 20_000), (403, "deadbeef" * 10_000), (404, ("user=abc pw=abcd url=abc " * 300)), (None, docs[5][1]), docs[7], (405, "user: bob " + "x" * 190 + " pw: abcd"), (406, "user: bob " + "x" * 300 + " pw: abcd")]
    return docs


def test_against_brute_force(documents):
    docs = corpus(3)
    for reach in (200, 30):
        got = C.report(documents(docs, spans="mine", row=1, base=2), reach)
        assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        rows = [tuple(r) for r in got.collect()]
        assert sorted(rows, key=str) == sorted([expected(*d, reach) for d in docs], key=str)
    assert sum("id:" in r[-1] for r in rows) > 10 and sum("url:" in r[-1] for r in rows) > 1


def test_weak_parts_alone_are_not_reported(documents):
    rows = [(1, "user: bob, see https://x.example/"), (2, "pw=abcd at https://x.example/"), (3, "user: bob pw=abcd"), (4, "user: bob pw=abcd https://x.example/"), (5, "log of users: a token of thanks; account: none")]
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in C.spans(documents(rows)).collect()}
    assert [got[k] for k in (1, 2, 5)] == [[], [], []]
    assert [k for _, k, _ in got[3]] == [3, 5] and [k for _, k, _ in got[4]] == [3, 5, 4]


def test_links(documents):
    found = C.searched(documents([(1, "user: bob pw=abcd https://x.example/ " + "-" * 500 + " login: eve token=abcdef")]))
    parts = found.selectExpr("row", "inline(parts)")
    assert C.links(parts.limit(0)).count() == 0
    assert sorted((r["id_start"], r["key_start"], r["url_start"]) for r in C.links(parts).collect()) == [(0, 10, 18), (538, 549, None)]


def test_no_rows(documents):
    assert C.report(documents([(1, "x")]).limit(0)).count() == 0
