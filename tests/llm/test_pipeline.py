import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from concord.llm import queries
from tests.llm import test_lines, test_packing, test_quality


def test_registered():
    names = queries.queries()
    assert [f"op{n}_" in " ".join(names) for n in range(1, 11)] == [True] * 10
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "suffix_dedup", "packing"]
    assert set(queries.oracle_sql()) <= set(names)


def test_stages(spark, documents):
    clean = " ".join(f"alpha{k}" for k in range(70))
    passage = "this passage of some words stands in two documents and is long enough " * 5
    rows = [(0, clean), (1, clean), (2, clean.replace("alpha7 ", "beta ")), (3, " ".join(f"b{k}" for k in range(90)) + passage), (4, passage + " ".join(f"c{k}" for k in range(90)))]
    rows += [(5, "too short"), (6, None), (7, "spam spam " * 60), (8, " ".join(f"d{k}" for k in range(60)))]
    docs = documents(rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert set(kept["quality_rules"]) == {0, 1, 2, 3, 4, 8}
    assert 1 not in kept["line_dedup"] and kept["line_dedup"][0] == clean  # emptied by its copy
    assert set(kept["ngram_jaccard"]) == set(kept["line_dedup"]) - {2}
    assert "long enough" not in kept["suffix_dedup"][3] + kept["suffix_dedup"][4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert set(Counter(r["doc_id"] for r in packed)) == set(kept["suffix_dedup"])


def test_jaccard_stage_takes_copies_from_four_fifths(spark, documents):
    words = [f"w{k}" for k in range(200)]
    copies = {
        1: [*words, *(f"x{k}" for k in range(40))],  # five-word shingles 196 of 236
        2: [*words[:60], "other", *words[61:140], "new", *words[141:]],  # 186 of 206
        3: [*words, *(f"y{k}" for k in range(60))],  # 196 of 256, and 196 of 296 with 1
    }
    docs = documents([(0, " ".join(words)), *((k, " ".join(w)) for k, w in copies.items())])
    assert {r["doc_id"] for r in corpus_pipeline.ngram_jaccard(spark, docs, "").collect()} == {0, 3}


def test_one_row_of_a_group_goes_on(spark, documents):
    text = lambda x, n=90: " ".join(f"{x}{k}" for k in range(n))
    rows = [(1, text("a"))] * 3  # repeated rows
    rows += [(2, text("b")), (2, text("c")), (3, text("c")), (0, text("c"))]  # two texts of one id, one of them a copy
    rows += [(None, text("d")), (None, text("d")), (4, text("e")), (None, text("e") + " more")]
    rows += [(5, ""), (5, ""), (None, None), (6, text("f"))]
    out = corpus_pipeline.ngram_jaccard(spark, documents(rows), "")
    expected = [(1, text("a")), (2, text("b")), (0, text("c")), (None, text("d")), (4, text("e")), (5, ""), (5, ""), (None, None), (6, text("f"))]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(expected)
    left = corpus_pipeline.suffix_dedup(spark, spark.createDataFrame(out.collect(), out.schema), "").collect()
    assert [r["text"] for r in left if r["doc_id"] == 1] == [text("a")]


def plain_quality(rows):
    """rows (id, text, source) by the rules, in plain Python."""
    verdicts = {}
    for (i, t, s), r in zip(sorted(rows, key=lambda r: str(r[0])), test_quality.brute(rows, 10, 0.01, 0.5), strict=True):
        verdicts.setdefault(str(i), set()).add(r[-1])
    where, hosts = {}, {}
    for i, t, s in rows:
        hosts.setdefault(s, set()).add(t or "")
        for x in {test_quality.norm(x) for x in (t or "").split("\n")} - {""}:
            where.setdefault((s, x), {}).setdefault(t or "", []).append(i)
    often = {k: min((i for ids in v.values() for i in ids if i is not None), default=None) for k, v in where.items() if len(v) > 10 and len(v) > 0.01 * len(hosts[k[0]])}
    out = []
    for i, t, s in rows:
        assert len(verdicts[str(i)]) == 1
        if verdicts[str(i)] == {True}:
            out.append((i, "\n".join(x for x in t.split("\n") if (s, test_quality.norm(x)) not in often or often[s, test_quality.norm(x)] == i), s))
    return out


def plain_jaccard(rows):
    sets = []
    for _, t, _ in rows:
        w = [x.decode().translate({65 + k: 97 + k for k in range(26)}) for x in (t or "").encode().split()]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and (100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])):
                group = [group[b] if g == group[a] else g for g in group]
    out, done = [], {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        if not sets[k] or group[k] not in done:
            done[group[k]] = True
            out.append(rows[k])
    return out


def plain_suffixes(rows):
    data, count = [(t or "").encode() for _, t, _ in rows], Counter()
    for b in data:
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    out = []
    for (i, t, s), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        left = bytes(x for x, y in zip(b, gone, strict=True) if not y).decode(errors="ignore")
        if left.split() or not (t or "").split():
            out.append((i, left if t is not None else None, s))
    return out


def test_all_stages_against_plain_python(spark, documents):
    rng = random.Random(4)
    text = lambda n=80: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(n))
    bodies = [text() for _ in range(25)]
    passage = text(70)
    rows = [(k, f"{b}\nThe same Line {k % 10} of this host\n{text(60)}", "a") for k, b in enumerate(bodies[:14])]
    rows += [(20, bodies[14], "b")] * 3 + [(21, bodies[15], "b"), (21, bodies[16], "b")]  # repeated rows, equal ids
    rows += [(None, bodies[17], "b"), (None, bodies[17], "b"), (22, bodies[18], None), (23, None, "b"), (24, "", "b"), (25, "short", "b")]
    words = bodies[19].split() + text(60).split()
    rows += [(26, " ".join(words), "b"), (27, " ".join([*words[:70], "other", *words[71:]]), "b"), (28, bodies[19] + "\n" + text(50), "c")]
    rows += [(30 + k, f"{text(60)} {passage} {text(60)}", "c") for k in range(3)] + [(40, text(4000), "d"), (41, "x " * 4000, "d")]
    docs = documents(rows, key="mine", component=1, stays=2, n_removed=3, was_blank=4, c0=5, _row=6)
    stages = dict(corpus_pipeline.STAGES)

    def same(name, docs, expected):
        out = stages[name](spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in rows) == Counter(expected), name
        assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None) and all((r["key"], r["c0"]) == ("mine", 5) for r in rows)
        return spark.createDataFrame(rows, docs.schema), expected

    docs, rows = same("quality_rules", docs, plain_quality(rows))
    found = test_lines.brute([r[:2] for r in rows], 1, 20)
    source = {str(r[0]): r[2] for r in rows}
    docs, rows = same("line_dedup", docs, [(i, t, source[str(i)]) for i, t, n in found if (t or "").split() or not n])
    docs, rows = same("ngram_jaccard", docs, plain_jaccard(rows))
    docs, rows = same("suffix_dedup", docs, plain_suffixes(rows))
    assert {0, 13, 20, 21, 22, 26, 28, 30, 31, 32, 40, None} == {r[0] for r in rows} - set(range(1, 13)) and len(rows) > 20
    expected = []
    for i, t, _ in rows:
        ids = np.array([*test_packing.TOKENIZER.encode(t, add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    packed = stages["packing"](spark, docs, "").collect()
    assert Counter(tuple(r)[:5] for r in packed) == Counter(expected)
    empty = docs.limit(0)
    assert all(stage(spark, empty, "").count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_line_dedup_does_not_broadcast_what_grows(spark, tmp_path, monkeypatch):
    from concord.llm import common

    plans = {}

    def stored(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.stored(df, name)

    monkeypatch.setattr(corpus_pipeline.lines, "stored", stored)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(k, f"some line of twenty or more {k}\nanother line") for k in range(5)], "doc_id bigint, text string").write.parquet(path)
    assert corpus_pipeline.line_dedup(spark, spark.read.parquet(path), str(tmp_path)).count() == 5
    assert "SortMergeJoin" in plans["near"] and "Broadcast" not in plans["near"]


def test_ngram_jaccard_does_not_broadcast_what_grows(spark, tmp_path, monkeypatch):
    from concord.llm import common, components

    plans = {}

    def stored(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return common.stored(df, name)

    for module in (corpus_pipeline, corpus_pipeline.jaccard, corpus_pipeline.lines, components):
        monkeypatch.setattr(module, "stored", stored)
    for module in (common, components):
        monkeypatch.setattr(module, "FEW_ROWS", 1, raising=False)  # all tables of the test are large ones
    rng = random.Random(6)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(6)]
    rows = [(10 * k + j, " ".join([*t[:40], "other", *t[41:]] if j else t)) for k, t in enumerate(texts) for j in range(3)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = corpus_pipeline.ngram_jaccard(spark, corpus_pipeline.line_dedup(spark, spark.read.parquet(path), ""), "")
    plans["all"] = [got._jdf.queryExecution().executedPlan().toString()]
    assert sorted(r["doc_id"] for r in got.collect()) == [10 * k for k in range(6)]
    assert {"members", "sets", "first", "found", "links", "lines"} <= plans.keys()
    # "removed" may broadcast frequent lines, of bounded number; "links" the candidates, of which there are none;
    # sides in "candidates" are joins, which Spark doesn't take for small
    assert [name for name, of in plans.items() for plan in of if "BroadcastHashJoin" in plan and name not in ("removed", "links", "candidates")] == []
    assert "SortMergeJoin" in plans["removed"][0]
