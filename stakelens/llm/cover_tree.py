"""Exact top-k inner products by dual-tree cover-tree search.

Vectors become integers, floor(scale * x). The candidates are dealt to shards around centres drawn from a bounded sample; each shard and the query groups
in it (queries are dealt by the same centres) know their covering radius. A query group first searches the shard of
its own centre, which gives each group's worst kth score; then it visits just the shards whose bound

    centre.centre + radius_q * |shard centre| + radius_s * |group centre| + radius_q * radius_s

does not fall below that score. Inside a task both sides are cover trees (radii halve from level to level) walked in
pairs: a pair of nodes is dropped when its bound is below the worst kth score of the query node, which rises as the walk goes on;
leaves are scored as exact integers. Ties go to the smaller id.

Defined cases: vectors that are null, hold null or non-finite numbers, or whose length differs from the most common one's take no part; null
ids neither; rows that repeat an id are separate candidates, and a row is no candidate of a query with its own id. Fewer than k candidates: all.
Empty tables give an empty result. Large components are scored in whole-number arithmetic; only a vector whose length (of the whole numbers) reaches
2 ** 31 is refused, as its scores need not fit the result's long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.common import checkpointed
from stakelens.session import stored

_LEAF = 256
_LOWEST = -(1 << 62)
_NO_ID = np.iinfo(np.int64).max


class CoverTree:
    """Nodes over consecutive points after reordering: centre, covering radius, children; leaves hold few points."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.norm: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, ...]] = []
        if len(points):
            self._grow(points, 0, len(points))

    def _grow(self, points: np.ndarray, a: int, b: int) -> int:
        at, mine = len(self.centre), self.order[a:b]
        centre = points[mine].mean(axis=0)
        far = np.sqrt(((points[mine] - centre) ** 2).sum(axis=1))
        self.centre.append(centre)
        self.radius.append(float(far.max()))
        self.norm.append(float(np.sqrt((centre**2).sum())))
        self.span.append((a, b))
        self.children.append(())
        if b - a > _LEAF and far.max() > 0:
            # cover the points by balls of half the radius around points of their own, farthest first
            seeds, best = [int(far.argmax())], None
            while True:
                gap = np.sqrt(((points[mine] - points[mine[seeds[-1]]]) ** 2).sum(axis=1))
                owner, best = (np.zeros(len(mine), np.int64), gap) if best is None else (
                    np.where(gap < best, len(seeds) - 1, owner), np.minimum(gap, best)
                )
                if (best.max() <= far.max() / 2 and len(seeds) > 1) or len(seeds) >= 8:
                    break
                seeds.append(int(best.argmax()))
            order = np.argsort(owner, kind="stable")
            self.order[a:b] = mine[order]
            cuts = a + np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(seeds)))])
            if (np.diff(cuts) > 0).sum() > 1:
                self.children[at] = tuple(
                    self._grow(points, int(x), int(y)) for x, y in zip(cuts[:-1], cuts[1:]) if y > x
                )
        return at


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _LOWEST, np.int64)
        self.id = np.full((n, k), _NO_ID, np.int64)

    def take(self, rows: np.ndarray, score: np.ndarray, own: np.ndarray, ids: np.ndarray) -> None:
        """Merge a block of scores (rows x candidates); ``own`` holds the ids of the rows, which are no candidates of their own."""
        least = self.score[rows, -1]
        if score.shape[1] > 4 * self.k and (new := least == _LOWEST).any():
            # nothing is known of these rows: what falls below the kth other candidate of the block stays out
            dense = np.where(own[new][:, None] == ids[None, :], _LOWEST, score[new])
            least[new] = np.partition(dense, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
        row, col = np.nonzero(score >= least[:, None])  # equal scores may enter by their id
        other = own[row] != ids[col]
        row, col = row[other], col[other]
        if not len(row):
            return
        hit = np.unique(row)
        all_row = np.concatenate([row, np.repeat(hit, self.k)])
        all_score = np.concatenate([score[row, col].astype(np.int64), self.score[rows[hit]].ravel()])
        all_id = np.concatenate([ids[col], self.id[rows[hit]].ravel()])
        order = np.lexsort((all_id, -all_score, all_row))
        starts = np.searchsorted(all_row[order], hit)
        best = order[starts[:, None] + np.arange(self.k)]  # each row has its own k entries at least
        self.score[rows[hit]], self.id[rows[hit]] = all_score[best], all_id[best]


def _most(dot: float, radius_a: float, norm_a: float, radius_b: float, norm_b: float) -> float:
    """No product of members of the two balls is above this; ``dot`` is that of the centres. Rounding is allowed for."""
    more = radius_a * norm_b + radius_b * norm_a + radius_a * radius_b
    return dot + more + 1e-9 * (norm_a * norm_b + more) + 1e-6


def _scores(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """Exact products of rows; ``small``: all sums are exact as doubles."""
    return a @ b.T if small else a.astype(np.int64) @ b.astype(np.int64).T


def dual_search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Walk both trees in pairs; ``best`` holds what is known and takes what is found."""
    if not len(queries) or not len(points):
        return
    left, right = CoverTree(queries), CoverTree(points)
    small = float(np.abs(queries).max()) * float(np.abs(points).max()) * queries.shape[1] < 2.0**53

    def bound(q: int, p: int) -> float:
        return _most(float(left.centre[q] @ right.centre[p]), left.radius[q], left.norm[q], right.radius[p], right.norm[p])

    stack = [(bound(0, 0), 0, 0)]
    while stack:
        limit, q, p = stack.pop()
        rows = left.order[slice(*left.span[q])]
        if limit < best.score[rows, -1].min():
            continue
        kids_q, kids_p = left.children[q], right.children[p]
        if not kids_q and not kids_p:
            there = right.order[slice(*right.span[p])]
            best.take(rows, _scores(queries[rows], points[there], small), query_ids[rows], ids[there])
        elif kids_p and (not kids_q or right.radius[p] >= left.radius[q]):
            stack.extend(sorted((bound(q, c), q, c) for c in kids_p))
        else:
            stack.extend(sorted((bound(c, p), c, p) for c in kids_q))


def whole_numbers(vectors: DataFrame, is_query: Column, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v, asks): usable vectors as whole numbers, and whether they are queries."""
    x = F.col(embedding)
    good = (
        F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0)
        & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    )
    made = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    square = F.aggregate(x, F.lit(0.0), lambda s, e: s + F.pow(F.floor(e.cast("double") * scale).cast("double"), 2.0))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"), made.alias("v"), square.alias("square"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    # checked on the doubles: what passes fits the integers
    v = F.when(F.col("square") < 2.0**62, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit("a vector is too long for long scores")))
    return rows.select("vec_id", v.alias("v"), "asks")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of integers, exact as doubles."""
    if not len(column):
        return np.empty((0, 0))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Centres laid as the levels of a cover tree are: each the point farthest from those before it."""
    chosen, gap = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _dealt(rows: DataFrame, centres: np.ndarray, most_rows: int, salt: str) -> tuple[DataFrame, dict]:
    """(vec_id, v, shard, part) checkpointed, and the covering radius of each (shard, part)."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("struct<shard:int,gap:double>")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        half = (shared.value**2).sum(axis=1) / 2
        for batch in batches:
            shard, gap = np.empty(len(batch), np.int32), np.empty(len(batch))
            points = _matrix(batch)
            for at in range(0, len(points), 4096):
                some = points[at : at + 4096]
                near = (some @ shared.value.T - half).argmax(axis=1)
                shard[at : at + 4096] = near
                gap[at : at + 4096] = np.sqrt(((some - shared.value[near]) ** 2).sum(axis=1))
            yield pa.StructArray.from_arrays([pa.array(shard), pa.array(gap)], ["shard", "gap"])

    placed = checkpointed(rows.withColumn("at", nearest("v")).select("vec_id", "v", "at.shard", "at.gap"))
    sizes = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / most_rows).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col("parts")).cast("int")
    parts = placed.join(F.broadcast(sizes), "shard").withColumn("part", part)  # one row for each shard
    ball = {(r.shard, r.part): r.gap for r in parts.groupBy("shard", "part").agg(F.max("gap").alias("gap")).collect()}
    return parts.select("vec_id", "v", "shard", "part"), ball


def _visits(
    pairs: list[tuple[int, ...]], sizes: dict[tuple[int, int], int], asking_rows: int
) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """(task, group) and (task, part) of the pairs: the groups that visit a part share its task until they hold ``asking_rows`` queries."""
    visits, tasks, asked = [], [], {}
    for s, g, t, part in pairs:
        task, held = asked.get((t, part), (-1, asking_rows))
        if held >= asking_rows:
            task, held = len(tasks), 0
            tasks.append((task, t, part))
        visits.append((task, s, g))
        asked[t, part] = task, held + sizes[s, g]
    return visits, tasks


def top_inner_products(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding",
    shard_rows: int = 8192, most_shards: int = 2048, group_rows: int = 1024, part_rows: int = 32_768, asking_rows: int = 16_384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row, exactly.

    Centres come from a sample of at most ``16 * most_shards`` vectors; every vector is dealt to its nearest centre, a shard with
    more than ``part_rows`` rows in parts, queries in groups of about ``group_rows``. A part meets all groups that visit it in one task, or in
    one for each ``asking_rows`` queries, so it travels and grows its tree once. Of query rows that share an id the smallest vector asks.
    """
    spark = vectors.sparkSession
    rows = stored(whole_numbers(vectors, is_query, vec_id, embedding, scale), "vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.size("v") == common.d)
    n = min(most_shards, max(1, common["count"] // shard_rows))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit("centres")), "v").limit(16 * n).select("v").collect()
    centres = _farthest_first(np.array([r.v for r in sample], np.float64), n)
    norms = np.sqrt((centres**2).sum(axis=1))
    points, radius_p = _dealt(rows, centres, part_rows, "part")
    queries, radius_q = _dealt(rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v")), centres, group_rows, "group")

    def search(asking: pa.Table, there: pa.Table) -> pa.Table:
        q_ids, p_ids = asking["q_id"].to_numpy(), there["p_id"].to_numpy()
        best = Best(len(q_ids), k)
        best.score[:] = asking["least"].to_numpy()[:, None]  # lower scores are out
        dual_search(_matrix(asking["q_v"]), q_ids, _matrix(there["p_v"]), p_ids, best)
        row, col = np.nonzero(best.id != _NO_ID)
        return pa.table({"query_id": q_ids[row], "vec_id": best.id[row, col], "score": best.score[row, col]})

    def searched(pairs: list[tuple[int, ...]], known: DataFrame, sizes: dict[tuple[int, int], int]) -> DataFrame:
        """What the given pairs of query group and shard part hold."""
        if not pairs:
            return spark.createDataFrame([], "query_id long, vec_id long, score long")
        visits, tasks = _visits(pairs, sizes, asking_rows)
        groups = spark.createDataFrame(visits, "task int, qs int, qg int")
        parts = spark.createDataFrame(tasks, "task int, ps int, pp int")
        left = known.join(F.broadcast(groups), (F.col("shard") == F.col("qs")) & (F.col("part") == F.col("qg")))
        right = points.join(F.broadcast(parts), (F.col("shard") == F.col("ps")) & (F.col("part") == F.col("pp")))
        asking = left.select(F.col("task").alias("q_task"), F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), "least")
        there = right.select(F.col("task").alias("p_task"), F.col("vec_id").alias("p_id"), F.col("v").alias("p_v"))
        return asking.groupBy("q_task").cogroup(there.groupBy("p_task")).applyInArrow(
            search, "query_id long, vec_id long, score long"
        )

    home = [(*g, *p) for g in sorted(radius_q) for p in sorted(radius_p) if p[0] == g[0]]
    sizes = {(r.shard, r.part): r["count"] for r in queries.groupBy("shard", "part").count().collect()}
    first = checkpointed(searched(home, queries.withColumn("least", F.lit(_LOWEST)), sizes))
    scores = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.array_sort(F.collect_list("score")).alias("s"))
    least = scores.where(F.size("s") >= k).select("vec_id", (F.element_at("s", -k) - 1).alias("least"))
    known = checkpointed(queries.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(_LOWEST))))
    worst = {(r.shard, r.part): r.w for r in known.groupBy("shard", "part").agg(F.min("least").alias("w")).collect()}
    rest = []
    for (s, g), r_q in sorted(radius_q.items()):
        for (t, part), r_p in sorted(radius_p.items()):
            if t != s and _most(float(centres[s] @ centres[t]), r_q, norms[s], r_p, norms[t]) >= worst[s, g]:
                rest.append((s, g, t, part))
    found = first.unionByName(searched(rest, known, sizes))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
    best = found.groupBy("query_id").agg(F.slice(order, 1, k).alias("best")).select("query_id", F.posexplode("best").alias("p", "x"))
    return best.select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )
