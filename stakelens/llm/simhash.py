"""SimHash near-duplicates: fingerprints, exact links within a few bits by vantage-point trees, groups.

A tree over a bounded sample of fingerprints deals all fingerprints to shards: each inner node sends those within its
radius of its vantage point one way and the rest the other. A fingerprint also visits each shard that the triangle bound does not
exclude (its distance to the vantage point is within the link distance of the radius); of two shards, only the lower one's
fingerprints visit the other. Each shard is searched by the same pruning, down to small blocks compared bit by bit. So every
pair within the distance is met, whatever the sample. Equal fingerprints are one node throughout; a shard reports the groups it found,
not all pairs, and the groups are joined into components.

Defined cases: null and empty texts and texts without words get fingerprint zero and link like any other; texts with fewer words
than a shingle have one shingle. Null ids never become a component's id unless there is nothing else. Repeated rows each get their
result. Which row of a group stays is decided for each component, whatever ids are null or repeat in others. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.common import checkpointed, fresh, text_of
from stakelens.llm.components import components

_BLOCK = 1 << 21  # cells of a block compared bit by bit
_PART = 4096  # shingles hashed at a time


def fingerprint(text: str, words_in_shingle: int = 3, seed: int = 42) -> int:
    """64 bits; each is 1 where over half of the shingle hashes have it."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(words_in_shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([np.zeros(1, np.int64), ends[: len(words) - size]])
    ends = ends[size - 1 :] - 1
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), _PART):
        pairs = zip(starts[at : at + _PART].tolist(), ends[at : at + _PART].tolist())
        raw = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in pairs]), np.uint8)
        total += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def fingerprint_column(text: Column, words_in_shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a long (its bits, signed)."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py() or "", words_in_shingle, seed) for t in batch], np.uint64)
            yield pa.array(bits.view(np.int64))

    return of(text)


def hex_column(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


class VantageTree:
    """Shards of the space of fingerprints, learned from a sample."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 0):
        self.nodes: list[tuple] = []  # (vantage, radius, inner child, outer child) or (shard,)
        self.shards = 0
        self._rng = np.random.default_rng(seed)
        self._grow(sample, max(1, leaves))

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if leaves > 1 and len(points) > 1:
            tried = self._rng.choice(points, min(8, len(points)), replace=False)
            spread = [np.bitwise_count(points ^ v).astype(np.int64).var() for v in tried]
            vantage = tried[int(np.argmax(spread))]
            far = np.bitwise_count(points ^ vantage)
            radius = int(np.median(far))
            if far.max() <= radius:
                radius = int(far.max()) - 1
            if radius >= 0:
                inner = self._grow(points[far <= radius], leaves // 2)
                outer = self._grow(points[far > radius], leaves - leaves // 2)
                self.nodes[at] = (vantage, radius, inner, outer)
                return at
        self.nodes[at] = (self.shards,)
        self.shards += 1
        return at

    def visits(self, points: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, whether it is the row's own shard) for each shard that a point may have partners in."""
        rows, shards, own = [], [], []

        def walk(at: int, idx: np.ndarray, home: np.ndarray) -> None:
            if not len(idx):
                return
            node = self.nodes[at]
            if len(node) == 1:
                rows.append(idx)
                shards.append(np.full(len(idx), node[0]))
                own.append(home)
                return
            vantage, radius, inner, outer = node
            far = np.bitwise_count(points[idx] ^ vantage).astype(np.int64)
            near = far <= radius + distance
            walk(inner, idx[near], home[near] & (far[near] <= radius))
            near = far > radius - distance
            walk(outer, idx[near], home[near] & (far[near] > radius))

        walk(0, np.arange(len(points)), np.ones(len(points), bool))
        return np.concatenate(rows), np.concatenate(shards), np.concatenate(own)


class _Groups:
    """Groups of positions, each known by its smallest member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.of[a], self.of[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.of, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def link_within(points: np.ndarray, n_own: int, distance: int, groups: _Groups) -> None:
    """Link the first ``n_own`` points with each other and with the rest, by vantage points and triangle bounds."""

    def search(own: np.ndarray, all_: np.ndarray, depth: int) -> None:
        if not len(own) or not len(all_):
            return
        if len(own) * len(all_) > _BLOCK and len(own) > 64 and depth < 40:
            vantage = points[own[(depth * 7919) % len(own)]]
            far, far_all = np.bitwise_count(points[own] ^ vantage), np.bitwise_count(points[all_] ^ vantage).astype(np.int64)
            radius = int(np.median(far))
            if far.max() <= radius:
                radius = int(far.max()) - 1
            if radius >= int(far.min()):
                search(own[far <= radius], all_[far_all <= radius + distance], depth + 1)
                search(own[far > radius], all_[far_all > radius - distance], depth + 1)
                return
            if depth < 39 and len(np.unique(points[own])) > 64:
                search(own, all_, depth + 1)
                return
        step = max(1, _BLOCK // len(all_))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            a, b = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[all_][None, :]) <= distance)
            groups.link(part[a], all_[b])

    search(np.arange(n_own), np.arange(len(points)), 0)


def near_links(prints: DataFrame, bits: str = "bits", distance: int = 3, shard_rows: int = 32_768, most_shards: int = 8192, sample_per_shard: int = 16) -> DataFrame:
    """(a, b): links that join exactly the distinct fingerprints that chains of near pairs join.

    ``shard_rows`` is the aim for a shard; the tree is learned from at most ``most_shards * sample_per_shard`` fingerprints and
    all fingerprints are dealt out by it. Beyond ``most_shards`` shards grow, and each is searched by further vantage points.
    """
    spark = prints.sparkSession
    distinct = checkpointed(prints.select(F.col(bits).alias("bits")).where(F.col(bits).isNotNull()).distinct())
    leaves = min(most_shards, max(1, distinct.count() // shard_rows))
    sample = distinct.orderBy(F.xxhash64("bits")).limit(leaves * sample_per_shard) if leaves > 1 else distinct.limit(1)
    tree = VantageTree(np.array([r.bits for r in sample.collect()], np.int64).view(np.uint64), leaves)
    shared = spark.sparkContext.broadcast(tree.nodes)

    @F.arrow_udf("array<struct<shard:int,own:boolean>>")
    def visits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dealt = VantageTree(np.empty(0, np.uint64), 1)
        dealt.nodes = shared.value
        for batch in batches:
            points = batch.to_numpy(zero_copy_only=False).view(np.uint64)
            row, shard, own = dealt.visits(points, distance)
            home = np.empty(len(points), np.int64)
            home[row[own]] = shard[own]
            keep = own | (shard > home[row])
            row, shard, own = row[keep], shard[keep], own[keep]
            order = np.argsort(row, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(points)))]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(shard[order].astype(np.int32)), pa.array(own[order])], ["shard", "own"])
            yield pa.ListArray.from_arrays(pa.array(offsets), values)

    def search(group: pa.Table) -> pa.Table:
        points = group["bits"].to_numpy().view(np.uint64)
        own = group["own"].to_numpy()
        points = np.concatenate([points[own], points[~own]])
        groups = _Groups(len(points))
        link_within(points, int(own.sum()), distance, groups)
        linked = np.nonzero(groups.of != np.arange(len(points)))[0]
        signed = points.view(np.int64)
        return pa.table({"a": signed[linked], "b": signed[groups.of[linked]]})

    dealt = distinct.withColumn("v", F.explode(visits("bits"))).select("bits", "v.shard", "v.own")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def _prints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, mark, bits) of every document; mark is a hash of the text."""
    bits = fingerprint_column(text_of(text)).alias("bits")
    return checkpointed(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), bits))


def _rooted(firsts: DataFrame, prints: DataFrame, distance: int) -> DataFrame:
    """``firsts`` (a row for each fingerprint) with the root of its component."""
    roots = components(near_links(prints, distance=distance), "a", "b")
    return firsts.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))


def near_groups(docs: DataFrame, distance: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits, component_id) for every document."""
    prints = _prints(docs, doc_id, text)
    rooted = _rooted(prints.groupBy("bits").agg(F.min("doc_id").alias("first")), prints, distance)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = rooted.join(least, "root").select("bits", "component_id")
    return prints.join(ids, "bits").select("doc_id", "bits", "component_id")


def drop_near_copies(docs: DataFrame, distance: int = 3) -> DataFrame:
    """One document of each group stays: the one with the smallest id, null ids last; of texts under that id the one with the
    smallest hash; of rows alike in both, one."""
    prints = _prints(docs, "doc_id", "text")
    rows = prints.groupBy("bits", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "n")
    rooted = _rooted(rows.groupBy("bits").agg(F.min(place).alias("first")), prints, distance)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.mark", "first.n")
    id_, of, n, mark = (fresh(docs.columns, c) for c in ("_kept_id", "_kept_mark", "_kept_n", "_mark"))
    kept = kept.select(F.col("doc_id").alias(id_), F.col("mark").alias(of), F.col("n").alias(n))
    marked = docs.withColumn(mark, F.xxhash64("text"))
    found = marked.join(kept, marked["doc_id"].eqNullSafe(kept[id_]) & (marked[mark] == kept[of]))
    once = found.where(F.col(n) == 1).select(*[marked[c] for c in docs.columns])
    again = found.where(F.col(n) > 1).dropDuplicates(["doc_id", mark]).select(*docs.columns)
    return once.unionByName(again)
