import math

import numpy as np
from pyspark.sql import functions as F

from stakelens.llm.learned_partitions import balanced_parts, fit_router, nearest, nearest_by_cosine, unit_rows
from stakelens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, asked, k=5):
    """For each asked row the k best scores with their ids, by loops."""
    ok = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v) and any(v)]
    out = []
    for at, (i, q) in enumerate(ok):
        if i is None or not asked(i):
            continue
        scores = []
        for other, (j, v) in enumerate(ok):
            if other != at and len(v) == len(q):
                a, b = np.array(q) / np.abs(q).max(), np.array(v) / np.abs(v).max()
                scores.append((-float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)), j is None, j or 0))
        out.append((i, [(None if n else j, -s) for s, n, j in sorted(scores)[:k]]))
    return out


def grouped(got):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert all(sorted(r.rank for r in rs) == list(range(1, len(rs) + 1)) for rs in by.values())
    return {q: sorted(rs, key=lambda r: r.rank) for q, rs in by.items()}


def recall(got, want):
    by = grouped(got)
    assert set(by) == {q for q, w in want if w} and all(len(by[q]) == len(w) for q, w in want if w)
    hits = 0
    for q, w in want:
        true = dict(w)
        for r in by.get(q, []):
            if r.vec_id in true:
                hits += 1
                assert abs(r.score - true[r.vec_id]) < 1e-12
    return hits / max(1, sum(len(w) for _, w in want))


def test_query_recall(spark):
    got = QUERIES["op11_learned_partitions"](spark, "/root/testdata/sf0.1")
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    assert recall(got.collect(), plain(rows, lambda i: i % 50 == 0)) >= 0.9


def clustered(n, seed, dims=16, centres=40):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, dims))[rng.integers(centres, size=n)] + 0.15 * rng.normal(size=(n, dims))


def test_parts_are_balanced_and_routing_visits_few():
    x = unit_rows(clustered(2000, 1))
    near = nearest(x, 10)
    part = balanced_parts(near, 16)
    assert set(np.bincount(part)) == {125}
    assert (part[near] == part[:, None]).mean() > 0.7
    router = fit_router(x, 16, 5, 0.95)
    assert router.recall >= 0.95 and router.probes <= 6


def test_recall_on_clusters_and_a_hot_vector(spark):
    x = clustered(1500, 2)
    x[::3] = x[0]  # a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = nearest_by_cosine(frame, F.col("vec_id") % 50 == 0, parts=8, shard_rows=64, group_rows=8).collect()
    want = plain(rows, lambda i: i % 50 == 0)
    assert recall(got, want) >= 0.9
    for q, best in grouped(got).items():
        if q % 3 == 0:  # its copies, smallest ids first
            assert [r.vec_id for r in best] == [i for i in range(0, 30, 3) if i != q][:5]


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [
        (0, [1.0, 0.0]), (50, None), (100, []), (150, [0.0, 0.0]), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [None, 1.0]),
        (1, [1.0, 1.0]), (2, [2.0, 2.0]), (350, [-1.0, 0.0]), (3, [1e300, 1e300]), (4, [1e-300, 0.0]), (None, [1.0, 1.0]),
        (400, [1.0, 2.0, 3.0]), (5, [3.0, 2.0, 1.0]), (450, [7.0]), (0, [1.0, 0.0]), (6, [0.0, 1.0]),
    ]
    frame = spark.createDataFrame([(*r, "a", 1) for r in rows], f"{SCHEMA}, part string, row int")
    got = nearest_by_cosine(frame, F.col("vec_id") % 50 == 0).collect()
    want = [(q, [(j, round(s, 12)) for j, s in best]) for q, best in plain(rows, lambda i: i % 50 == 0)]
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
    assert by.pop(0)[:2] == [(0, 1.0), (0, 1.0)]  # two rows of one id, each found by the other
    assert by == {q: best for q, best in want if q and best}


def test_empty(spark):
    assert nearest_by_cosine(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert nearest_by_cosine(spark.createDataFrame([(1, [1.0])], SCHEMA), F.lit(True)).count() == 0
