"""Weights held against plain iterative fitting, sampling against its probabilities."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stakelens.llm.mixing import margin_totals, mixed, sample_mixed
from stakelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_weights(cells, temper):
    total = sum(cells.values())
    margins = [Counter(), Counter(), Counter()]
    for c, t in cells.items():
        for m, v in zip(margins, c):
            m[v] += t
    targets = []
    for m in margins:
        raw = {v: t**temper for v, t in m.items()}
        targets.append({v: t / sum(raw.values()) * total for v, t in raw.items()})
    weights = dict.fromkeys(cells, 1.0)
    for _ in range(200):
        for i, target in enumerate(targets):
            now = defaultdict(float)
            for c in cells:
                now[c[i]] += weights[c] * cells[c]
            weights = {c: w * target[c[i]] / now[c[i]] for c, w in weights.items()}
    return weights, targets, total


def test_query(spark):
    out = QUERIES["op4_raking_mix"](spark, SF)
    rows = out.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    cells = Counter()
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    weights, targets, total = plain_weights(cells, 0.9)
    most = max(weights.values())
    for r in rows:
        w = weights[r.source, r.lang, r.topic]
        assert r.weight == pytest.approx(w, rel=1e-4) and r.probability == pytest.approx(w / most, rel=1e-4)
    kept = sum(r.n_tokens for r in rows if r.kept)
    assert kept == pytest.approx(total / most, rel=0.1)
    for r in margin_totals(out).where("margin = 'source'").collect():
        assert r.expected * most == pytest.approx(targets[0][r.value], rel=1e-4)
    docs = docs.limit(20)
    assert sample_mixed(docs).columns == docs.columns
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def odd_frame(spark):
    rows = [(i, "word " * (i % 7 + 1), "a" if i % 3 else "b", "en" if i % 2 else "fr", "x") for i in range(200)]
    rows += [(300 + i, "some words", None, ["en", "fr", None][i % 3], "x") for i in range(60)]
    rows += [(None, None, None, None, None), (200, "", "a", "en", "x"), (200, "", "a", "en", "x"), (201, "w " * 3000, "b", "en", "x"), (202, "w " * 3000, "a", "fr", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept string")


def shares(got):
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.n_tokens * r.weight
    return {k: v / sum(tokens.values()) for k, v in tokens.items()}


def test_given_targets_and_odd_rows(spark):
    rows, docs = odd_frame(spark)
    share = spark.createDataFrame([("a", 0.6), ("b", 0.2), (None, 0.2), ("gone", 5.0)], "source string, target double")
    out = mixed(docs, {"source": share}, topic=F.lit("one"))
    got = out.collect()
    assert len(got) == len(rows) and out.columns[:5] == docs.columns and "_kept" in out.columns
    assert got[0].deviation <= 1e-5
    assert shares(got) == pytest.approx({"a": 0.6, "b": 0.2, None: 0.2}, rel=1e-3)
    assert all(0 < r.probability <= 1 for r in got)
    assert len({(r.weight, r["_kept"]) for r in got if r.doc_id == 200}) == 1
    assert mixed(docs.limit(0)).count() == 0


def test_values_without_a_target_stay_as_rows(spark):
    rows, docs = odd_frame(spark)
    share = spark.createDataFrame([("a", 0.5), (None, 0.5)], "source string, target double")
    got = mixed(docs, {"source": share}, topic=F.lit("one")).collect()
    assert len(got) == len(rows)
    assert all((r.weight, r.probability, r["_kept"]) == (0, 0, False) for r in got if r.source == "b")
    assert all(r.weight > 0 for r in got if r.source != "b")


def test_margins_that_contradict_each_other(spark):
    docs = spark.createDataFrame([(1, "one two", "a", "en"), (2, "three four", "b", "fr")], "doc_id long, text string, source string, lang string")
    by = lambda m, x, y, p: spark.createDataFrame([(x, p), (y, 1 - p)], f"{m} string, target double")
    got = mixed(docs, {"source": by("source", "a", "b", 0.9), "lang": by("lang", "en", "fr", 0.2)}, topic=F.lit("one")).collect()
    assert len(got) == 2 and all(r.deviation > 0.5 for r in got)
