import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from concord.operators import agreement, judging, keyed, sheets, tree
from concord.functions import prompts as P

S, N = "SUPPORTED", "NOT_SUPPORTED"


def test_tree_rules(spark):
    k = lambda s, a, **x: {"surah": s, "ayat": a} | x
    doc = {"Z": {"b": [k(1, 2)], "a": [k(1, 2), k(9, 9, deep=[k(5, 5)])]}, "A": [{"C": [k(1, 2), [k(3, 4)]]}], "D": k(7, 7), "E": 3, "F": [None, "x"]}
    df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    found = [(r["surah"], r["ayat"], r["path"]) for r in tree.leaves(df).orderBy("ord").collect()]
    assert found == [(1, 2, ["Z", "b"]), (1, 2, ["Z", "a"]), (9, 9, ["Z", "a"]), (1, 2, ["A", "C"]), (3, 4, ["A", "C"])]
    assert [tuple(r) for r in tree.distinct_leaves(df).collect()] == [(1, 2), (3, 4), (9, 9)]
    paths = {(r[0], r[1]): r[2] for r in keyed.collected_paths(tree.leaves(df), ["surah", "ayat"]).collect()}
    assert paths[1, 2] == [["Z", "b"], ["Z", "a"], ["A", "C"]]


def test_repeated_object_keys(spark):
    df = spark.createDataFrame([('{"a": [{"surah": 1, "ayat": 1}], "b": [{"surah": 2, "ayat": 2}], "a": [{"surah": 3, "ayat": 3}]}',)], "value string")
    assert [(r[0], r["path"]) for r in tree.leaves(df).orderBy("ord").collect()] == [(3, ["a"]), (2, ["b"])]


def test_deep_tree(spark):
    node = [{"surah": 1, "ayat": 2}]
    for k in range(500):
        node = {f"k{k}": node, "note": '[{"surah": 9, "ayat": 9}]'} if k % 2 else [node]
    rows = tree.leaves(spark.createDataFrame([(json.dumps(node),)], "value string")).collect()
    assert [(r["surah"], r["ayat"], len(r["path"]), len(r["ord"])) for r in rows] == [(1, 2, 250, 501)]


def test_trees_of_many_documents(spark):
    rows = [(1, '{"a": [{"surah": "7", "ayat": 2.5}]}'), (1, '[{"surah": 3000000000, "ayat": true}]'), (2, None), (3, '{"a": [{"surah": 1, '), (4, "[[{\"surah\": -1, \"ayat\": null}]]"), (5, "[" * 3000 + '{"surah": 1, "ayat": 1}' + "]" * 3000)]
    df = spark.createDataFrame(rows, "path int, value string")
    got = tree.leaves(df.withColumnRenamed("path", "doc"), carry=["doc"], batch=1)
    assert sorted([(r["doc"], r["surah"], r["ayat"], r["path"]) for r in got.collect()], key=str) == sorted([(1, 7, None, ["a"]), (1, None, None, []), (4, -1, None, []), (5, 1, 1, [])], key=str)
    assert tree.leaves(df.limit(0)).count() == 0


def test_last_verse_and_stray_labels(spark):
    accepted = spark.createDataFrame([("q", "a", "easy", 1, 2)], "question string, answer string, difficulty string, surah int, ayat int")
    verses = spark.createDataFrame([(1, 2, f"v{k}", [["p"]], k) for k in (3, 9, 5)], "surah int, ayat int, text_id string, theme_paths array<array<string>>, seq int")
    r = sheets.validation_set(accepted, accepted, verses, seq="seq").collect()
    assert [(x["text_id"], x["theme_paths_full"]) for x in r] == [("v9", [["p"]])]
    names = ["Evaluator 17", "Evaluator 9"]
    labels = spark.createDataFrame([(n, k) for k, n in enumerate(["Evaluator 17", "Evaluato r 17", "evaluator17", "Evaluater 9", "someone", None, "Evaluator 9"])], "nama_evaluator string, k int")
    got = {r["k"]: r["meant"] for r in sheets.stray_labels(labels, names).collect()}
    assert got == {1: "Evaluator 17", 2: "Evaluator 17", 3: "Evaluator 9", 4: None, 5: None}
    mended = {r["k"]: r["nama_evaluator"] for r in sheets.mended_labels(labels, names).collect()}
    assert mended == {0: "Evaluator 17", 1: "Evaluator 17", 2: "Evaluator 17", 3: "Evaluator 9", 4: "someone", 5: None, 6: "Evaluator 9"}


def test_tree_against_walk(spark):
    rng = random.Random(1)

    def make(depth):
        r = rng.random()
        if depth == 0 or r < 0.2:
            return rng.choice([1, None, "t", '{"a": [', '[{"surah": 1, "ayat": 2}]', '{"x": [{"surah": 1, "ayat": 2}]}', {"surah": rng.randint(1, 9), "ayat": rng.randint(1, 9)}])
        return {f"k{j}": make(depth - 1) for j in range(rng.randint(0, 3))} if r < 0.6 else [make(depth - 1) for _ in range(rng.randint(0, 3))]

    def walk(node, path, in_list, out):
        if isinstance(node, dict):
            if in_list and "surah" in node and "ayat" in node:
                out.append((node["surah"], node["ayat"], path))
            else:
                for key, v in node.items():
                    walk(v, [*path, key], False, out)
        elif isinstance(node, list):
            for v in node:
                walk(v, path, True, out)

    docs = [make(5) for _ in range(40)]
    expected = []
    for d in docs:
        walk(d, [], False, expected)
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    got = [(r["surah"], r["ayat"], r["path"]) for r in tree.leaves(df).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_keyed(spark):
    log = spark.createDataFrame([(1, 2, "S", 1), (1, 2, "N", 2), (1, 3, None, 3)], "surah int, ayat int, v string, seq int")
    keys = ["surah", "ayat"]
    assert sorted(tuple(r) for r in keyed.last_wins(log, keys, "seq").collect()) == [(1, 2, "N", 2), (1, 3, None, 3)]
    assert sorted(tuple(r) for r in keyed.first_wins(log, keys, "seq").select("ayat", "v").collect()) == [(2, "S"), (3, None)]
    items = spark.createDataFrame([(1, 2), (1, 2), (1, 4)], "surah int, ayat int")
    assert [tuple(r) for r in keyed.remaining(items, log, keys).collect()] == [(1, 4)]
    assert keyed.only_keys(items, log, keys).count() == 2
    lookup = spark.createDataFrame([(1, 2, None)], "surah int, ayat int, t string")
    got = sorted({tuple(r) for r in keyed.enriched(items, lookup, keys, {"t": F.lit("")}).collect()}, key=str)
    assert got == [(1, 2, None), (1, 4, "")]
    assert [tuple(r) for r in keyed.missing_keys(items, log, keys, most=20).collect()] == [(1, 4)]


def test_labels_pivot(spark):
    labels = [("D", "1:2", S, 1), ("E", "1:2", N, 2), ("D", "1:3", None, 3), ("D", "1:3", N, 4), ("Evaluato r 17", "1:4", S, 5)]
    df = spark.createDataFrame(labels, "nama_evaluator string, ID string, verdict string, seq int")
    log = spark.createDataFrame([(1, 2, S), (1, 3, S), (1, 4, S), (1, 5, S)], "surah int, ayat int, A string")
    got = sheets.with_human_labels(log, df, {"D": "D", "E": "E"}).orderBy("ayat").collect()
    assert [(r["D"], r["E"]) for r in got] == [(S, N), (N, None), (None, None), (None, None)]


def kappa(rows, policy):
    both = [(a, b) for a, b in rows if {a, b} <= {S, N}]
    if policy == "listwise":
        rows = both
    total = len(rows) if policy == "all_rows" else len(both)
    if not total:
        return None, None
    po = sum(a == b for a, b in both) / total
    pa, pb = (sum(r[i] == S for r in rows) / total for i in (0, 1))
    pe = pa * pb + (1 - pa) * (1 - pb)
    return po, None if pe == 1 else (po - pe) / (1 - pe)


@pytest.mark.parametrize("seed", range(4))
def test_agreement_against_formulas(spark, seed):
    rng = random.Random(seed)
    rows = [tuple(rng.choice([S, S, N, "EMPTY", None]) for _ in range(3)) for _ in range(rng.choice([1, 40]))]
    if seed == 3:
        rows = [(S, S, S)] * 5
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "item int, A string, B string, C string")
    for policy in ("all_rows", "pairwise", "listwise"):
        for (i, a), (j, b) in itertools.combinations(enumerate("ABC"), 2):
            r = agreement.cohen(df, a, b, policy).head()
            assert tuple(r) == pytest.approx(kappa([(x[i], x[j]) for x in rows], policy))
        pairs = {(r[0], r[1]): (r[2], r[3]) for r in agreement.pairwise_cohen(df, "ABC", policy).collect()}
        assert pairs["A", "C"] == pytest.approx(kappa([(x[0], x[2]) for x in rows], policy))
    yes = [sum(v == S for v in r) for r in rows]
    p = sum(yes) / (3 * len(rows))
    pe = p * p + (1 - p) ** 2
    mean = sum((s * s + (3 - s) ** 2 - 3) / 6 for s in yes) / len(rows)
    assert agreement.fleiss(df, "ABC").head()["kappa"] == (None if pe == 1 else pytest.approx((mean - pe) / (1 - pe)))


def test_alpha_identity(spark):
    rng = random.Random(5)
    rows = [(k, *[rng.choice([S, N]) for _ in range(5)]) for k in range(30)]
    df = spark.createDataFrame(rows, "item int, A string, B string, C string, D string, E string")
    k = agreement.fleiss(df, "ABCDE", "listwise").head()["kappa"]
    alpha = agreement.krippendorff(agreement.long_form(df, "item", "ABCDE")).head()["alpha"]
    assert alpha == pytest.approx(k + (1 - k) / (30 * 5))
    gaps = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b"), (2, "c"), (3, "a")], "item int, value string")
    # coincidences over items 1 and 2: n = 4, a 2, b 1, c 1; disagreement 2
    assert agreement.krippendorff(gaps).head()["alpha"] == pytest.approx(1 - 3 * 2 / (16 - 6))
    assert agreement.krippendorff(gaps.where("item = 1")).head()["alpha"] is None


def test_non_strict_sheet(spark):
    log = spark.createDataFrame([(1, 1, S, S, S), (1, 2, S, S, "EMPTY"), (1, 3, S, None, S), (1, 4, "", S, S)], "surah int, ayat int, A string, B string, C string")
    gold = spark.createDataFrame([(1, k, "q", "a", None) for k in range(1, 5)], "surah int, ayat int, question string, answer string, difficulty string")
    verses = spark.createDataFrame([(1, 2, "verse")], "surah int, ayat int, text_id string")
    got = sheets.non_strict_sheet(log, gold, verses).orderBy("Ayat").collect()
    assert [(r["ID"], r["Verse_Text"], r["Difficulty_Model"], r["Notes"]) for r in got] == [("1:2", "verse", "", ""), ("1:3", "", "", "")]


def test_last_gold_counts(spark):
    log = spark.createDataFrame([(1, "NOT_SUPPORTED"), (1, "EMPTY"), (2, S)], "k int, A string")
    gold = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, None, 3), (2, "q", 1)], "k int, question string, seq int").withColumns({"answer": F.lit("a"), "difficulty": F.lit(None).cast("string")})
    verses = spark.createDataFrame([(1, "early", 1), (1, "late", 2)], "k int, text_id string, seq int")
    got = sheets.non_strict_sheet(log, gold, verses, ["A"], ["k"], "seq").collect()
    assert [(r["ID"], r["Question"], r["Verse_Text"]) for r in got] == [("1", "new", "late")] * 2
    assert sheets.non_strict_sheet(log, gold.drop("seq"), verses.drop("seq"), ["A"], ["k"]).count() == 2


class Flaky:
    def __init__(self, fail, error="429 slow down"):
        self.fail, self.error, self.calls = fail, error, 0

    def complete(self, messages, options):
        self.calls += 1
        if self.calls <= self.fail:
            raise RuntimeError(self.error)
        return judging.Reply("SUPPORTED", 3)


def test_retry():
    waits = []
    retry = judging.Retry(sleep=waits.append)
    assert judging.call(Flaky(2), [], {}, retry)[0].content == "SUPPORTED" and waits == [1.0, 2.0]
    assert judging.call(Flaky(9), [], {}, judging.Retry(sleep=lambda _: None))[0] is None
    client = Flaky(1, "other")
    assert judging.call(client, [], {}, judging.Retry(sleep=lambda _: None)) == (None, "other") and client.calls == 1
    with pytest.raises(RuntimeError):
        judging.call(Flaky(1, "other"), [], {}, judging.Retry(raises=True, sleep=lambda _: None))


class Refusing(judging.OfflineClient):
    def complete(self, messages, options):
        if "bad" in messages[-1]["content"]:
            raise RuntimeError("content_filter: refused")
        return super().complete(messages, options)


def test_generate_and_validate(spark):
    items = spark.createDataFrame([(1, 1, "some words to ask about"), (1, 2, "bad words"), (1, 3, None)], "surah int, ayat int, text_id string")
    got = judging.generate(items, P.generation(["surah", "ayat"]), Refusing(), partitions=2)
    rows = {r["ayat"]: r for r in got.collect()}
    assert [rows[k]["outcome"] for k in (1, 2, 3)] == ["ok", "filtered", "insufficient"]
    assert rows[1]["answer"] == "some words to ask about" and rows[3]["status"] == "INSUFFICIENT_EVIDENCE" and rows[2]["question"] is None
    assert {r["outcome"]: r["n"] for r in judging.outcomes(got).collect()} == {"ok": 1, "filtered": 1, "insufficient": 1}
    judged = judging.validate(got.where("outcome = 'ok'"), P.judgement(), {"A": judging.OfflineClient(), "B": Refusing()}, pause=0).collect()
    assert [tuple(r) for r in judged] == [(1, 1, S, S)]
    assert judging.progress(2, 10, 4.0) == {"done": 2, "each": 2.0, "remaining": 16.0} and judging.progress(0, 1, 0.0)["remaining"] is None


def test_observed_run_and_calls_in_flight(spark, tmp_path):
    items = spark.createDataFrame([(1, k, "word " * (k % 3)) for k in range(20)], "surah int, ayat int, text_id string")
    plain = judging.generate(items, P.generation(["surah", "ayat"]), judging.OfflineClient(), partitions=2)
    both = judging.generate(items, P.generation(["surah", "ayat"]), judging.OfflineClient(), partitions=2, in_flight=4)
    assert sorted(map(str, plain.collect())) == sorted(map(str, both.collect()))
    ticks = iter([10.0, 14.0])
    seen = judging.observed(both, lambda df: df.write.parquet(str(tmp_path / "out")), total=40, clock=lambda: next(ticks))
    assert seen == {"done": 20, "usage": sum(r["usage"] for r in plain.collect()), "ok": 13, "insufficient": 7, "filtered": 0, "failed": 0, "seconds": 4.0, "each": 0.2, "remaining": 4.0}


def test_report_is_one_row(spark):
    rows = [(1, S, S, N, S, N), (2, N, N, N, N, N), (3, S, S, S, None, S), (4, "EMPTY", S, N, S, S)]
    r = agreement.report(spark.createDataFrame(rows, "item int, A string, B string, C string, D string, E string"), "item", "ABC", "DE").collect()
    assert len(r) == 1 and (r[0]["items"], r[0]["n_majority"], r[0]["n_strict"], r[0]["labelled"], r[0]["strict"]) == (4, 2, 1, 3, 0.25)
    assert r[0]["human_observed"] == pytest.approx(2 / 3) and r[0]["kappa_A_B"] == pytest.approx(1.0)
    empty = agreement.report(spark.createDataFrame([], "item int, A string, B string, C string, D string, E string"), "item", "ABC", "DE").collect()
    assert len(empty) == 1 and empty[0]["items"] == 0 and empty[0]["alpha"] is None
