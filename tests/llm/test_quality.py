import re
from collections import Counter, defaultdict

from concord.llm import quality

LONG = " ".join(f"w{k}" for k in range(60))


def norm(line):
    return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0d]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), line)).strip(" "))


def brute(rows, min_docs, min_share, min_left):
    hosts, where = defaultdict(set), defaultdict(dict)
    for i, t, s in rows:
        t = t or ""
        hosts[s].add(t)
        for x in {norm(x) for x in t.split("\n")} - {""}:
            where[s, x].setdefault(t, []).append(i)
    frequent = {k: min(i for ids in v.values() for i in ids) for k, v in where.items() if len(v) > min_docs and len(v) > min_share * len(hosts[k[0]])}
    out = []
    for i, t, s in rows:
        t = t or ""
        w = t.encode().split()
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = len({k + d for k in range(len(w) - 2) for d in range(3) if c[tuple(w[k : k + 3])] > 1})
        lines = [x for x in t.split("\n") if x.split()]
        gone = sum(len(norm(x).split(" ")) for x in t.split("\n") if norm(x) and frequent.get((s, norm(x)), i) != i)
        failed = len(w) < 50 or 100 * rep > 50 * len(w)
        out.append((i, len(w), sum(len(x.decode()) for x in w), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), rep, failed, not failed and len(w) - gone >= min_left * len(w)))
    return sorted(out, key=str)


def test_against_brute_force(documents):
    rows = [(k, f"Boiler  PLATE {k}9 line " + "x " * 40 + f"\n{LONG} {k}\n\n", "a") for k in range(8)]
    rows += [(20 + k, f"{LONG} unique {k}\nsame\nsame\n### $", "a") for k in range(3)]
    rows += [(30, None, "a"), (31, "", "b"), (32, "a b a b a b a b " * 20, None), (33, LONG, None), (33, LONG, None), (34, LONG * 2000, "c"), (35, "p q r " + " ".join(f"u{k}" for k in range(70_000)) + " p q r", "c"), (36, "ÀÉ\tÜ  A9\x0bB İ" * 9, "c")]
    df = documents(rows, kept=1, n_words="x")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted([tuple(r) for r in quality.verdicts(df, 3, 0.01, 0.5).select(*names).collect()], key=str)
    assert got == brute(rows, 3, 0.01, 0.5)


def test_clean_keeps_first_and_columns(documents):
    rows = [(k, f"plate {k} line here\n{LONG} {chr(97 + k)}", "a") for k in range(8)]
    df = documents(rows, kept="mine", _out=True, _gone="mine", _row=1, _mid=2)
    out = {r["doc_id"]: r for r in quality.clean(df, 3, 0.01, 0.5).collect()}
    assert quality.clean(df).columns == df.columns
    assert len(out) == 8 and out[0]["kept"] == "mine"
    assert out[0]["text"].startswith("plate") and all(out[k]["text"] == f"{LONG} {chr(97 + k)}" for k in range(1, 8))


def test_empty(documents, spark):
    df = documents([(1, "x")]).limit(0)
    assert quality.verdicts(df).count() == 0 and quality.clean(df).count() == 0
