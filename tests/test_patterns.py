import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from concord.operators import agreement, raters

NAMES = ("A", "B", "C", "D", "E")


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(6)
    values = ["SUPPORTED", "SUPPORTED", "NOT_SUPPORTED", "EMPTY", None]
    rows = [(k, *[rng.choice(values) for _ in NAMES]) for k in range(400)]
    return spark.createDataFrame(rows, "item int, " + ", ".join(f"{c} string" for c in NAMES)).cache()


def rounded(df):
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()], key=str)


def test_measures_of_patterns_are_those_of_rows(rated):
    table = agreement.patterns(rated, NAMES)
    for policy in ("all_rows", "pairwise", "listwise"):
        assert rounded(agreement.cohen(table, "A", "D", policy, "n")) == rounded(agreement.cohen(rated, "A", "D", policy))
        assert rounded(agreement.pairwise_cohen(table, NAMES, policy, "n")) == rounded(agreement.pairwise_cohen(rated, NAMES, policy))
    for policy in ("all_rows", "listwise"):
        assert rounded(agreement.fleiss(table, NAMES[:3], policy, "n")) == rounded(agreement.fleiss(rated, NAMES[:3], policy))
    valid = rated.select("item", *[F.when(F.col(c).isin("SUPPORTED", "NOT_SUPPORTED"), F.col(c)).alias(c) for c in NAMES])
    alpha = rounded(agreement.krippendorff(agreement.long_form(valid, "item", NAMES), "item"))
    assert rounded(agreement.krippendorff_wide(table, NAMES, "n")) == rounded(agreement.krippendorff_wide(rated, NAMES)) == alpha


def test_report_of_merged_parts_is_that_of_all(rated):
    models, people = NAMES[:3], NAMES[3:]
    whole = agreement.report(rated, "item", models, people)
    parts = [agreement.patterns(rated.where(F.col("item") % 3 == k), NAMES) for k in range(3)]
    assert rounded(agreement.report_of(agreement.merged(parts), models, people)) == rounded(whole)
    r, n = whole.first(), rated.count()
    votes = [sum(x == "SUPPORTED" for x in row[1:4]) for row in rated.collect()]
    assert (r["items"], r["n_majority"], r["n_strict"]) == (n, sum(v >= 2 for v in votes), sum(v == 3 for v in votes))
    pair = {(x["rater1"], x["rater2"]): x["kappa"] for x in agreement.pairwise_cohen(rated, models).collect()}
    assert all(abs(r[f"kappa_{a}_{b}"] - pair[a, b]) < 1e-9 for a, b in combinations(models, 2))


def test_report_takes_one_pass(spark, rated, tmp_path):
    rated.write.parquet(str(tmp_path / "r"))
    found = agreement.report(spark.read.parquet(str(tmp_path / "r")), "item", NAMES[:3], NAMES[3:])
    found.collect()
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") == 1


def test_report_of_nothing(rated):
    r = agreement.report(rated.limit(0), "item", NAMES[:3], NAMES[3:]).first()
    assert (r["items"], r["labelled"], r["alpha"], r["fleiss_models"], r["human_kappa"]) == (0, 0, None, None, None)


def sparse(seed, items, people, values, hot=0):
    rng = random.Random(seed)
    rows = [(i, f"r{p}", rng.choice(values)) for i in range(items) for p in range(people) if i < hot or rng.random() < 0.2]
    return rows + [(0, "r1", None), (None, "r1", values[0]), (1, None, values[0]), *rows[:3]]


def brute(rows):
    own = {}
    for i, p, v in rows:
        if None not in (i, p, v):
            own.setdefault(i, {})
            own[i][p] = min(v, own[i].get(p, v))
    met = Counter((a, b, r[a], r[b]) for r in own.values() for a, b in combinations(sorted(r), 2))
    pairs = {}
    for a, b in {k[:2] for k in met}:
        part = {k[2:]: n for k, n in met.items() if k[:2] == (a, b)}
        n = sum(part.values())
        po = sum(c for (x, y), c in part.items() if x == y) / n
        left, right = (Counter() for _ in range(2))
        for (x, y), c in part.items():
            left[x] += c
            right[y] += c
        pe = sum(left[x] * right[x] for x in left) / n**2
        pairs[a, b] = (n, po, (po - pe) / (1 - pe) if pe != 1 else None)
    units = [Counter(r.values()) for r in own.values() if len(r) > 1]
    total = sum(map(sum, (u.values() for u in units)))
    po = sum(sum(n * (n - 1) for n in u.values()) / (sum(u.values()) * (sum(u.values()) - 1)) for u in units) / len(units)
    pe = sum(n * n for n in sum(units, Counter()).values()) / total**2
    return met, pairs, (len(units), (po - pe) / (1 - pe))


def test_sparse_raters_against_brute_force(spark):
    rows = sparse(4, 60, 50, ["x", "y", "z"], hot=2)
    met, pairs, total = brute(rows)
    df = spark.createDataFrame(rows, "i int, who string, said string")
    for most in (256, 7):  # with 7, the items that all rated are split in blocks
        found = raters.meetings(df, "i", "who", "said", most)
        assert {(r["rater1"], r["rater2"], r["value1"], r["value2"]): r["n"] for r in found.collect()} == met
    got = {(r["rater1"], r["rater2"]): (r["items"], r["observed"], r["kappa"]) for r in raters.pairwise(found).collect()}
    assert got.keys() == pairs.keys()
    for k, (n, po, kappa) in pairs.items():
        assert got[k][0] == n and abs(got[k][1] - po) < 1e-12 and (kappa is None and got[k][2] is None or abs(got[k][2] - kappa) < 1e-9)
    r = raters.fleiss(df, "i", "who", "said").first()
    assert r["items"] == total[0] and abs(r["kappa"] - total[1]) < 1e-9


def test_fleiss_of_complete_ratings_is_that_of_columns(spark, rated):
    sure = rated.dropna().select("item", *[F.when(F.col(c) == "SUPPORTED", "SUPPORTED").otherwise("NOT_SUPPORTED").alias(c) for c in NAMES])
    wide = agreement.fleiss(sure, NAMES).first()
    assert rounded(raters.fleiss(agreement.long_form(sure, "item", NAMES))) == [(wide["items"], round(wide["kappa"], 9))]
    both = {(r["rater1"], r["rater2"]): r["kappa"] for r in raters.pairwise(raters.meetings(agreement.long_form(sure, "item", NAMES))).collect()}
    assert all(abs(r["kappa"] - both[r["rater1"], r["rater2"]]) < 1e-9 for r in agreement.pairwise_cohen(sure, NAMES, "listwise").collect())


def test_no_ratings(spark):
    none = spark.createDataFrame([], "item int, rater string, value string")
    assert raters.pairwise(raters.meetings(none)).count() == 0
    assert tuple(raters.fleiss(none).first()) == (0, None)
