"""Top-k held against all products, with ties, odd vectors and repeated rows."""

import math

import duckdb
import numpy as np
import pytest

from stakelens.llm.cover_tree import Best, CoverTree, dual_search, top_inner_products
from stakelens.llm.queries import ORACLES, QUERIES

F32 = np.float32


def plain(rows, k=10):
    good = [(i, [math.floor(1024 * float(F32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, v) for i, v in good if len(v) == 3]
    out = set()
    for q, v in {i: v for i, v in sorted(good, reverse=True) if i % 100 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    return out


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(duckdb.sql(ORACLES["op6_cover_tree"]).fetchall())
    got = QUERIES["op6_cover_tree"](spark, sf).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want


def test_shards_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(F32(x)) for x in rng.integers(-3, 4, 3) / 4]) for i in range(700)]
    rows += [(None, [1.0, 1.0, 1.0]), (701, None), (702, [1.0, None, 2.0]), (703, [float("nan"), 0.0, 0.0]), (704, [float("inf"), 0.0, 0.0]), (705, [9.0]), (5, rows[5][1]), (100, rows[100][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnsRenamed({})
    from pyspark.sql import functions as F

    got = top_inner_products(vectors.withColumn("score", F.lit("x")), F.col("vec_id") % 100 == 0, shard_rows=60, group_rows=1, part_rows=40).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == plain(rows) and len(got) == len(plain(rows))
    few = vectors.where("vec_id in (0, 1, 2)")
    assert top_inner_products(few, F.col("vec_id") % 100 == 0).count() == 2
    assert top_inner_products(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_large_components(spark):
    # beyond 2 ** 53 a sum is no longer exact as a double
    rng = np.random.default_rng(5)
    rows = [(i, [float(F32(x)) for x in rng.normal(0, 300_000 if i % 3 else 1, 3)]) for i in range(600)] + [(601, [2000.0, -1.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = top_inner_products(vectors, F.col("vec_id") % 100 == 0, shard_rows=60, group_rows=2, part_rows=40).collect()
    want = plain(rows)
    assert max(abs(s) for *_, s in want) > 1 << 53
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    with pytest.raises(Exception, match="too long"):
        top_inner_products(spark.createDataFrame([*rows, (602, [1e9, 0.0, 0.0])], vectors.schema), F.col("vec_id") % 100 == 0).collect()


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(4)
    points = np.rint(np.concatenate([rng.normal(c, 1, (400, 8)) * 50 for c in (-40, 0, 40)]))
    tree = CoverTree(points)
    for (a, b), centre, radius in zip(tree.span, tree.centre, tree.radius):
        assert np.sqrt(((points[tree.order[a:b]] - centre) ** 2).sum(axis=1)).max() <= radius + 1e-6
    ids = np.arange(len(points))
    best = Best(50, 5)
    dual_search(points[:50], ids[:50], points, ids, best)
    score = (points[:50] @ points.T).astype(np.int64)
    score[np.arange(50), np.arange(50)] = -(1 << 62)
    for q in range(50):
        order = np.lexsort((ids, -score[q]))[:5]
        assert (best.id[q] == order).all() and (best.score[q] == score[q][order]).all()


def test_a_part_meets_its_groups_in_one_task(spark):
    from pyspark.sql import functions as F

    from stakelens.llm.cover_tree import _visits

    pairs = [(s, 0, t, p) for s in range(5) for t in range(3) for p in range(2)]
    visits, tasks = _visits(pairs, {(s, 0): 10 for s in range(5)}, 1000)
    assert sorted((t, p) for _, t, p in tasks) == [(t, p) for t in range(3) for p in range(2)]  # not once for each of the five groups
    assert len(visits) == len(pairs)
    visits, tasks = _visits(pairs, {(s, 0): 10 for s in range(5)}, 20)
    held = [sum(10 for v in visits if v[0] == task) for task, *_ in tasks]
    assert max(held) <= 20 and sum(held) == 10 * len(pairs)
    where = {task: (t, p) for task, t, p in tasks}
    assert sorted((s, g, *where[task]) for task, s, g in visits) == sorted(pairs)
    rng = np.random.default_rng(8)
    rows = [(i, [float(F32(x)) for x in rng.normal(0, 1, 3)]) for i in range(0, 9000, 10)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for most in (7, 16_384):
        got = top_inner_products(vectors, F.col("vec_id") % 100 == 0, shard_rows=80, group_rows=5, part_rows=40, asking_rows=most).collect()
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == plain(rows)
