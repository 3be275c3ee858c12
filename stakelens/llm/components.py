"""Connected components of a link table, by rounds of re-hanging links on the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakelens.llm.common import checkpointed


def _mark(edges: DataFrame) -> tuple:
    """A figure that differs when the set of links differs."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _to_larger(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _to_smaller(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of those."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    Links to itself and null ends are ignored; an empty table gives an empty one. Every round writes a checkpoint; the
    rounds end when the links stay as they are, which takes about log2 of the longest chain. Minima are combined before the
    shuffle, so a node with very many links is no bottleneck.
    """
    edges = (
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges = checkpointed(edges)
    mark = _mark(edges)
    while mark[0]:
        edges = checkpointed(_to_smaller(_to_larger(edges)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
