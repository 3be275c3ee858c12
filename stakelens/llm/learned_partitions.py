"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample of distinct vectors is cut into balanced parts by recursive bisection (spectral order, then
swaps across the cut). A softmax classifier learns, for each sampled vector, how its neighbours spread over the parts. It deals every
row of the table to its most probable part and routes each query to its several most probable parts, whose rows are reranked by exact
cosine. How many parts a query visits is measured, not guessed: the fewest that find ``target_recall`` of the true neighbours within
a fifth of the sample that the classifier did not learn from.

Bounds: ``sample`` vectors and the classifier are held by the driver; everything else stays distributed. A part of any size is split into
shards of ``shard_rows`` rows, its queries into groups of ``group_rows``; one task call holds one shard and one group. Equal
vectors of a shard are scored once, so a vector that fills a third of the table costs no more than another.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers take no part. Vectors meet only those of their own
length; lengths other than the most common one are searched whole. Repeated rows are separate candidates, and a repeated query row
has its own answers; a null id is never a query's, ranks after all others and is returned as null. With k candidates or fewer all are
returned. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stakelens.llm.common import hash_unit
from stakelens.operators.ordered import lookup_join
from stakelens.session import work_path

_NEIGHBOURS = 10
_LAST_ID = np.iinfo(np.int64).max


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by powers of two first, so that no square over- or underflows."""
    x = np.asarray(x, np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by cosine, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        near = x[a : a + 1024] @ x.T
        near[np.arange(len(near)), a + np.arange(len(near))] = -2.0
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        out[a : a + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
    return out


def _halve(u: np.ndarray, v: np.ndarray, n: int, left: int) -> np.ndarray:
    """True for ``left`` of n nodes, so chosen that few of the edges u-v (both ways listed) cross."""
    degree = np.maximum(np.bincount(u, minlength=n), 1).astype(np.float64)
    x = np.cos(np.arange(n) * 2.399963)  # a fixed start without pattern
    for _ in range(120):  # second eigenvector of the lazy random walk
        x -= (degree * x).sum() / degree.sum()
        x = 0.5 * (x + np.bincount(u, weights=x[v], minlength=n) / degree)
        x /= max(np.abs(x).max(), 1e-300)
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[:left]] = True

    def gains() -> np.ndarray:
        across = side[u] != side[v]
        return np.bincount(u, weights=np.where(across, 1.0, -1.0), minlength=n)

    cut = (side[u] != side[v]).sum()
    for share in (20, 20, 20, 50, 50, 50, 200, 200):
        gain = gains()
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        pairs = min(len(a), len(b), max(1, n // share))
        worth = gain[a[:pairs]] + gain[b[:pairs]] > 0
        if not worth.any():
            break
        side[a[:pairs][worth]], side[b[:pairs][worth]] = False, True
        after = (side[u] != side[v]).sum()
        if after >= cut:
            side[a[:pairs][worth]], side[b[:pairs][worth]] = True, False
        else:
            cut = after
    return side


def balanced_parts(neighbours: np.ndarray, parts: int) -> np.ndarray:
    """A part for each node of the neighbour graph; sizes differ by rounding only."""
    n = len(neighbours)
    u = np.concatenate([np.repeat(np.arange(n), neighbours.shape[1]), neighbours.ravel()])
    v = np.concatenate([neighbours.ravel(), np.repeat(np.arange(n), neighbours.shape[1])])
    out, work = np.zeros(n, np.int64), [(np.arange(n), 0, parts)]
    while work:
        nodes, first, count = work.pop()
        if count == 1:
            out[nodes] = first
            continue
        local = np.full(n, -1)
        local[nodes] = np.arange(len(nodes))
        inside = (local[u] >= 0) & (local[v] >= 0)
        half = count // 2
        side = _halve(local[u[inside]], local[v[inside]], len(nodes), round(len(nodes) * half / count))
        work += [(nodes[side], first, half), (nodes[~side], first + half, count - half)]
    return out


@dataclass(frozen=True)
class Router:
    """Softmax classifier over unit vectors, and how many of its parts a query visits."""

    weight: np.ndarray
    bias: np.ndarray
    probes: int
    recall: float  # of those probes, on sampled vectors that the classifier did not learn from

    @property
    def parts(self) -> int:
        return len(self.bias)

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.weight + self.bias


def _train(x: np.ndarray, soft: np.ndarray, steps: int = 250, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on soft labels by Adam over the whole sample."""
    w, b = np.zeros((x.shape[1], soft.shape[1])), np.zeros(soft.shape[1])
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - soft) / len(x)
        for at, (value, grad) in enumerate(((w, x.T @ g + 1e-6 * w), (b, g.sum(axis=0)))):
            m, s = moments[2 * at], moments[2 * at + 1]
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-12)
    return w, b


def fit_router(vectors: np.ndarray, parts: int, k: int, target_recall: float) -> Router:
    """Learn parts and routing from distinct sampled vectors."""
    x = unit_rows(vectors)
    parts = max(1, min(parts, len(x) // 16))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1, 1.0)
    held = np.arange(len(x)) % 5 == 0
    learn = x[~held]
    near = nearest(learn, _NEIGHBOURS)
    part = balanced_parts(near, parts)
    soft = np.zeros((len(learn), parts))
    for seen in (np.arange(len(learn))[:, None], near):
        for column in seen.T:
            soft[np.arange(len(learn)), part[column]] += 1
    w, b = _train(learn, soft / soft.sum(axis=1, keepdims=True))
    # where do the true neighbours of unseen vectors lie in the query's order of parts?
    z = x[held] @ w + b
    mine = z.argmax(axis=1)
    place = np.empty_like(z, dtype=np.int64)
    np.put_along_axis(place, np.argsort(-z, axis=1, kind="stable"), np.arange(parts)[None, :], 1)
    place = np.take_along_axis(place, mine[nearest(x[held], k)], 1)
    found = np.cumsum(np.bincount(place.ravel(), minlength=parts)) / place.size
    probes = min(int(np.searchsorted(found, target_recall)) + 1, parts)
    return Router(w, b, probes, float(found[probes - 1]))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _dealer(router: Router, length: int):
    """Adds to each row its part and the parts in order of probability (queries only)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array(batch.column("size"))
            part, order = router.parts + size.astype(np.int64), [None] * len(size)
            usual = np.flatnonzero(size == length)
            if len(usual):
                z = router.logits(unit_rows(_matrix(batch.column("v").take(pa.array(usual)))))
                part[usual] = z.argmax(axis=1)
                asked = np.array(batch.column("asked"))[usual]
                for at, row in zip(usual[asked], np.argsort(-z[asked], axis=1, kind="stable")):
                    order[at] = row.tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(part), pa.array(order, pa.list_(pa.int64()))], names=[*batch.schema.names, "part", "parts"]
            )

    return deal


def _search(k: int):
    """Exact best k of one shard for each query of one group."""

    def search(shard: pa.Table, group: pa.Table) -> pa.Table:
        rows, ids, scores, cands = [], [], [], []
        if len(shard) and len(group):
            x, q = (_matrix(t.column("v").combine_chunks()) for t in (shard, group))
            vec_id = np.array(shard.column("vec_id").fill_null(_LAST_ID))
            row = np.array(shard.column("row"))
            # one score for equal vectors, of which the first k + 1 can be wanted (one may be the query itself)
            order = np.lexsort((row, vec_id))
            x, vec_id, row = x[order], vec_id[order], row[order]
            _, same = np.unique(x, axis=0, return_inverse=True)
            by = np.argsort(same.ravel(), kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(same.ravel()[by]) != 0])
            nth = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)]))
            keep = np.sort(by[nth <= k])
            x, vec_id, row = x[keep], vec_id[keep], row[keep]
            scale = [np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1]) for m in (x, q)]
            norm = [np.sqrt((m * m).sum(axis=1)) for m in scale]
            near = (scale[1] / norm[1][:, None]) @ (scale[0] / norm[0][:, None]).T
            own = np.array(group.column("row"))
            for i, asked in enumerate(group.column("vec_id").to_pylist()):
                line = near[i]
                line[row == own[i]] = -np.inf
                at = len(line) - min(k, len(line))
                close = np.flatnonzero((line >= np.partition(line, at)[at] - 1e-9) & (line > -np.inf))
                # the product above rounds by its block's shape, these sums do not
                exact = (scale[0][close] * scale[1][i]).sum(axis=1) / (norm[0][close] * norm[1][i])
                best = np.lexsort((row[close], vec_id[close], -exact))[:k]
                rows += [int(own[i])] * len(best)
                ids += [asked] * len(best)
                scores += exact[best].tolist()
                cands += vec_id[close[best]].tolist()
        cands = pa.array([None if c == _LAST_ID else c for c in cands], pa.int64())
        return pa.table({"row": pa.array(rows, pa.int64()), "query_id": pa.array(ids, pa.int64()), "vec_id": cands, "score": pa.array(scores, pa.float64())})

    return search


def nearest_by_cosine(
    vectors: DataFrame,
    asked: Column,
    k: int = 5,
    parts: int = 32,
    sample: int = 8192,
    target_recall: float = 0.95,
    shard_rows: int = 8192,
    group_rows: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row that ``asked`` marks.

    ``vectors`` has vec_id and embedding.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    sound = v.isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    path = work_path(spark, "vectors")
    vectors.where(sound).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"),
        F.size(v).alias("size"), F.coalesce(asked, F.lit(False)).alias("asked"),
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    usual = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    n, length = (usual[0]["count"], usual[0]["size"]) if usual else (0, 1)
    drawn = (
        rows.where((F.col("size") == length) & (hash_unit(F.col("v")) < min(1.0, 1.1 * sample / max(n, 1))))
        .select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    )
    drawn = np.array([r.v for r in drawn], np.float64).reshape(-1, length)
    router = fit_router(drawn, parts, k, target_recall)
    dealt_path = work_path(spark, "dealt-vectors")
    rows.mapInArrow(_dealer(router, length), f"{rows._jdf.schema().toDDL()}, part long, parts array<long>").write.parquet(dealt_path)
    dealt = spark.read.parquet(dealt_path)
    # a query goes on to less probable parts until those visited hold enough rows
    held = {r.part: r["count"] for r in dealt.where(F.col("part") < router.parts).groupBy("part").count().collect()}
    sizes = F.array(*[F.lit(held.get(p, 0)).cast("long") for p in range(router.parts)])
    filled = F.filter("parts", lambda p: F.get(sizes, p) > 0)
    enough = F.transform(F.sequence(F.lit(1), F.greatest(F.size(filled), F.lit(1))), lambda i: F.struct(
        F.when(F.aggregate(F.slice(filled, 1, i), F.lit(0).cast("long"), lambda a, p: a + F.get(sizes, p)) > k, i).alias("i")
    ))
    visits = F.greatest(F.lit(router.probes), F.coalesce(F.array_min(enough["i"]), F.size(filled)))
    routed = spark.read.parquet(dealt_path).where("asked").select(
        "row", "vec_id", "v",
        F.explode(F.when(F.col("parts").isNull(), F.array("part")).otherwise(F.slice(filled, F.lit(1), visits))).alias("part"),
    )
    shape = dealt.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards")).join(
        routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("groups")), "part"
    )

    def cell(own: str, of: str, other: str, others: str) -> list[Column]:
        return [
            F.pmod(F.xxhash64("row"), F.col(of)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias(other),
        ]

    left = lookup_join(dealt.select("row", "vec_id", "v", "part"), shape, ["part"])
    right = lookup_join(routed, shape, ["part"])
    left = left.select("part", "row", "vec_id", "v", *cell("shard", "shards", "group", "groups"))
    right = right.select("part", "row", "vec_id", "v", *cell("group", "groups", "shard", "shards"))
    found = left.groupBy("part", "shard", "group").cogroup(right.groupBy("part", "shard", "group")).applyInArrow(
        _search(k), "row long, query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
