"""Merkle manifest of a table of documents, by slot pivot.

Every row is a leaf. Rows are put in order within their source by a range sort over the whole cluster, so a source with a third of the
rows is no task of its own. A level of a tree is then one grouping: parent = position / fanout, slot = position % fanout, and conditional
aggregates spread each parent's children into ``fanout`` columns. Concatenating the columns and hashing gives the parent; the
columns before and after a child's own slot are its siblings. The subroots of all sources are the leaves of one more tree built
the same way. Going back down, each parent hands its children the sibling pairs of all levels above, and the leaves come
out of the slot columns of their own parent, so leaf rows move only once after they were sorted.

``verify`` recomputes the root from any changed leaf and the original siblings.

Defined cases: a null field is hashed as '-', an empty one as '0:'. Within a source leaves ascend by doc_id, null ids first; equal ids
follow by leaf digest, so repeated rows are leaves of their own in a defined order. A null source is one source, before all
others. A source of one row has the leaf as its subroot and no siblings; an empty table has no root and gives no rows. Columns other than
the five hashed ones and those asked for by ``keep`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.common import ascii_lower, checkpointed
from stakelens.operators.ordered import lookup_join, null_safe_join, ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PAIR = "struct<pre:string,post:string>"


def digest_of(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf_of(fields: Sequence[Column]) -> Column:
    """Digest of the fields, each '-' or its length in bytes, ':' and its value."""
    texts = [c.cast("string") for c in fields]
    return digest_of(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _pivot(nodes: DataFrame, keys: Sequence[str], values: Sequence[str], fanout: int) -> DataFrame:
    """One row for each parent: its children in columns s0, s1, ..., its digest and how many nodes its level has."""
    child = F.struct(*values)
    slots = [F.max(F.when(F.col("pos") % fanout == k, child)).alias(f"s{k}") for k in range(fanout)]
    parents = nodes.groupBy(*keys, F.floor(F.col("pos") / fanout).alias("up")).agg(*slots, F.max("n").alias("n"))
    digest = digest_of(*[F.col(f"s{k}.digest") for k in range(fanout)])
    return parents.select(*keys, F.col("up").alias("pos"), F.ceil(F.col("n") / fanout).alias("n"), digest.alias("digest"), *[f"s{k}" for k in range(fanout)])


def _children(parents: DataFrame, keys: Sequence[str], values: Sequence[str], fanout: int, carry: Sequence[str]) -> DataFrame:
    """The children of each parent with the sibling pairs from their own level up to the root."""
    slots = [f"s{k}" for k in range(fanout)]
    out = parents.select("*", F.posexplode(F.array_compact(F.array(*slots))).alias("slot", "kid"))  # slots fill from the left
    pre = F.concat_ws("", *[F.when(F.col("slot") > k, F.col(f"{s}.digest")) for k, s in enumerate(slots)])
    post = F.concat_ws("", *[F.when(F.col("slot") < k, F.col(f"{s}.digest")) for k, s in enumerate(slots)])
    pair = F.struct(pre.alias("pre"), post.alias("post"))
    return out.select(
        *keys, (F.col("pos") * fanout + F.col("slot")).alias("pos"), *[F.col("kid")[v].alias(v) for v in values],
        F.concat(F.array(pair), "path").alias("path"), *carry,
    )


def _climb(leaves: DataFrame, keys: Sequence[str], values: Sequence[str], fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of parents, lowest first, and the nodes that remain, one for each key, with the level where they do."""
    levels, tops = [], None
    nodes, kept = leaves, values
    while True:
        done = nodes.where("n = 1").select(*keys, "digest", *[c for c in kept if c != "digest"], F.lit(len(levels)).alias("level"))
        done = done if tops is None else done.select(*keys, "digest", *[F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in values if c != "digest"], "level")
        tops = done if tops is None else tops.unionByName(done)
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            return levels, tops
        levels.append(checkpointed(_pivot(nodes, keys, kept, fanout)))
        nodes, kept = levels[-1].select(*keys, "pos", "n", "digest"), ["digest"]


def _descend(levels: list[DataFrame], tops: DataFrame, keys: Sequence[str], values: Sequence[str], fanout: int, carry: Sequence[str]) -> DataFrame:
    """Every leaf with ``path`` (its sibling pairs up to the root) and the carried columns; ``tops`` has the paths of the top nodes."""
    last = tops.where("level = 0").select(*keys, F.lit(0).cast("long").alias("pos"), *values, "path", *carry)
    nodes = None
    for at in range(len(levels), 0, -1):
        here = tops.where(F.col("level") == at).select(*keys, F.lit(0).cast("long").alias("pos"), "path", *carry)
        nodes = here if nodes is None else here.unionByName(nodes.select(*here.columns))
        parents = null_safe_join(levels[at - 1].drop("digest", "n"), nodes, [*keys, "pos"])
        nodes = _children(parents, keys, values if at == 1 else ["digest"], fanout, carry)
    return last if nodes is None else last.unionByName(nodes.select(*last.columns))


def _tree(leaves: DataFrame, keys: Sequence[str], order: Sequence[str], fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels and tops of the trees over ``leaves`` (any columns, ``digest`` among them), one tree for each key."""
    values = [c for c in leaves.columns if c not in keys]
    placed = ranked(leaves, keys, order, "pos").withColumn("pos", F.col("pos") - 1)
    if keys:
        placed = lookup_join(placed, placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    else:
        placed = placed.withColumn("n", F.lit(placed.count()))
    return _climb(placed, keys, values, fanout)


def manifest(docs: DataFrame, changed: DataFrame | None = None, fanout: int = 16) -> DataFrame:
    """doc_id, source, leaf, now, subroot, root and path of every row.

    ``docs`` has the five fields and, if leaves are to be verified, ``now``: the leaf digest recomputed from what is there today.
    """
    leaves = docs.select("source", "doc_id", leaf_of([F.col(c) for c in FIELDS]).alias("digest"), "now")
    leaves = checkpointed(leaves)
    levels, subroots = _tree(leaves, ["source"], ["doc_id", "digest"], fanout)
    subroots = checkpointed(subroots)
    upper, root = _tree(subroots.select("source", "digest"), [], ["source"], fanout)
    top = root.select("digest").collect()
    if not top:
        return leaves.select("doc_id", "source", F.col("digest").alias("leaf"), "now", F.lit("").alias("subroot"), F.lit("").alias("root"), F.lit(None).cast(f"array<{_PAIR}>").alias("path"))
    root = root.withColumn("path", F.array().cast(f"array<{_PAIR}>"))
    above = _descend(upper, root, [], ["source", "digest"], fanout, []).select("source", F.col("digest").alias("subroot"), "path")
    tops = null_safe_join(subroots, above, ["source"])
    out = _descend(levels, tops, ["source"], ["doc_id", "digest", "now"], fanout, ["subroot"])
    return out.select("doc_id", "source", F.col("digest").alias("leaf"), "now", "subroot", F.lit(top[0].digest).alias("root"), "path")


def proof_of(path: Column) -> Column:
    """Digest of all siblings from the leaf's level to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["pre"], p["post"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["pre"], node, p["post"]), 256))


def tampered(chosen: Column) -> Column:
    """The leaf of a row after lower-casing its text where ``chosen`` holds."""
    fields = [F.col(c) for c in FIELDS[:-1]]
    return leaf_of([*fields, F.when(chosen, ascii_lower(F.col("text"))).otherwise(F.col("text"))])


def verified_manifest(docs: DataFrame, now: Column) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and whether the leaf as it is ``now`` still leads to the root."""
    rows = manifest(docs.select(*FIELDS, now.alias("now")))
    folded = rows.withColumn("folded_root", fold(F.col("now"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
