"""Counts and the base score held against plain loops, the recursion against sums over all state paths."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stakelens.llm.hmm import Hmm, held_out_id, score_documents, tokens, train, train_and_score
from stakelens.llm.queries import QUERIES


def small_model(seed=1, symbols=5, states=3):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return Hmm(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def paths(model, row):
    """(probability, states) of each way to make the row."""
    for zs in itertools.product(range(len(model.start)), repeat=len(row)):
        p = model.start[zs[0]] * model.emit[row[0], zs[0]]
        for t in range(1, len(row)):
            p *= model.move[zs[t - 1], zs[t]] * model.emit[row[t], zs[t]]
        yield p, zs


def test_forward_and_expected_counts():
    model = small_model()
    rows = [np.array(r) for r in ([0, 3, 4, 1], [2], [1, 1, 0], [4, 0, 2, 2, 3])]
    got = model.scores(rows)
    want_s, want_m, want_e = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for row, score in zip(rows, got):
        ways = list(paths(model, row))
        total = sum(p for p, _ in ways)
        assert score == pytest.approx(math.log(total))
        for p, zs in ways:
            want_s[zs[0]] += p / total
            for t, z in enumerate(zs):
                want_e[row[t], z] += p / total
                if t:
                    want_m[zs[t - 1], z] += p / total
    counts = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    model.expected(rows, counts)
    for a, b in zip(counts, (want_s, want_m, want_e)):
        assert np.allclose(a, b)


def test_query_against_plain_counts(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    count = Counter(w for k, t in docs.items() if not held_out_id(k) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    got = QUERIES["op3_hidden_markov"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        words = tokens(docs[r.doc_id])
        assert r.held_out == held_out_id(r.doc_id) and r.n_tokens == len(words) and r.train_tokens == n
        assert r.n_known == sum(count[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_few_frequent_words_and_odd_rows(spark):
    rows = [(i, f"a b c{i % 9} d{i}", "x") for i in range(60)] + [(70, None, "x"), (None, "", None), (71, "zz " * 30_000, "x"), (72, "a b", "x"), (72, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    trained = train(docs.where("doc_id < 60"), frequent=4, classes=8, states=2, passes=1 + 1)
    got = score_documents(docs, trained).collect()
    assert len(got) == len(rows)
    count = Counter(w for _, t, _ in rows[:60] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    assert (trained.symbols.n, trained.symbols.v) == (n, v)
    by_id = {r.doc_id: r for r in got}
    for k, t, _ in rows:
        words = tokens(t or "")
        assert by_id[k].n_known == sum(count[w] > 0 for w in words)
        assert by_id[k].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words))
    assert len({r.score for r in got if r.doc_id == 72}) == 1
    _, both = train_and_score(docs, F.col("doc_id") < 60, frequent=4, classes=8, states=2, passes=1 + 1)
    one, two = (sorted([(r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in rows_]) for rows_ in (got, both.collect()))
    assert one == two
    none = train(docs.limit(0), frequent=4, classes=8, states=2, passes=1 + 1)
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in score_documents(docs, none).collect())
    assert score_documents(docs.limit(0), trained).count() == 0


def test_stretches_count_as_the_whole_text():
    from stakelens.llm.hmm import stretches

    model = small_model()
    model.move = 0.9 * np.eye(3) + 0.1 * model.move
    rows = [np.random.default_rng(4).integers(0, 5, n) for n in (1, 1024, 1025, 5000)]
    whole = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for row in rows:
        model.expected([row], whole)
    cut = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    pieces = [p for row in rows for p in stretches(row)]
    model.expected([p[0] for p in pieces], cut, [p[1] for p in pieces])
    for a, b in zip(cut, whole):
        assert np.allclose(a, b, rtol=1e-4)


def test_every_pass_reads_all_texts(spark):
    # ids all null fell into one fold, and passes over the other folds wiped out the states
    docs = spark.createDataFrame([(None, f"a b c{i % 9} d e f a b") for i in range(40)], "doc_id long, text string")
    model = train(docs, frequent=20, classes=4, states=2, passes=2 + 1).model
    assert not np.allclose(model.emit[:, 0], model.emit[:, 1])
    none = train(docs.limit(0), frequent=4, classes=8, states=2, passes=1 + 1).model
    assert not np.allclose(none.emit[:, 0], none.emit[:, 1])
