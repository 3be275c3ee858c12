"""Ordered work that stays parallel when one key holds most of the rows.

Two devices:

* ``ranked`` / ``running_totals``: sort by range over the whole cluster, keep
  the chunk number in the data (written once, so it never changes on retry),
  add chunk offsets. No key is ever confined to one task.
* ``carry_in`` / ``blocked_running_total``: cut each key's history into time
  blocks and hand every block the little it needs from the blocks before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stakelens.session import checkpointed

_CHUNK_BITS = 33


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join treating NULL keys as equal; keeps the left copy of the keys. Without keys every row of the right side, which
    then holds a few rows for the whole table, meets every row of the left."""
    if not on:
        return left.join(F.broadcast(right), how=how, on=F.lit(True))
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


BROADCAST_BYTES = 32 << 20


def text_bytes(df: DataFrame) -> int:
    """Size of all rows, spelled out."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).head()[0]


def lookup_join(rows: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join many rows to a table expected to be small, without moving the rows.

    The table is computed and measured first: up to ``BROADCAST_BYTES`` it is broadcast,
    beyond that the join shuffles and Spark's skew handling applies.
    """
    small = checkpointed(small)
    if text_bytes(small) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return null_safe_join(rows, small, on, how)


def _range_chunks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    staged = (
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("__pos", F.monotonically_increasing_id())
    )
    return checkpointed(staged).withColumn("__chunk", F.shiftright("__pos", _CHUNK_BITS))


def _before(by: Sequence[str], order: Sequence[str | Column]):
    return W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank_no") -> DataFrame:
    """1-based position of each row within ``by`` under a total order."""
    staged = _range_chunks(df, [*by, *order])
    pieces = staged.groupBy(*by, "__chunk").agg(
        F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    offsets = pieces.withColumn("__offset", F.coalesce(F.sum("__rows").over(_before(by, ["__chunk"])), F.lit(0)))
    return (
        lookup_join(staged, offsets.drop("__rows"), [*by, "__chunk"])
        .withColumn(name, F.col("__pos") - F.col("__first") + F.col("__offset") + 1)
        .drop("__pos", "__chunk", "__first", "__offset")
    )


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[str], totals: Mapping[str, str]
) -> DataFrame:
    """Inclusive running sums ``{new column: summed column}`` within ``by``."""
    staged = _range_chunks(df, [*by, *order])
    pieces = staged.groupBy(*by, "__chunk").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    before = _before(by, ["__chunk"])
    offsets = pieces.select(
        *by, "__chunk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )
    local = W.partitionBy(*by, "__chunk").orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    summed = staged.withColumns({f"_l_{n}": F.sum(c).over(local) for n, c in totals.items()})
    out = lookup_join(summed, offsets, [*by, "__chunk"])
    out = out.withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in totals})
    return out.drop("__pos", "__chunk", *[f"_l_{n}" for n in totals], *[f"_o_{n}" for n in totals])


#: Buckets of one narrowing pass, and up to how many rows a bucket is put in order.
_BUCKETS = 1024
_IN_ORDER = 50_000


def _narrowed(rows: DataFrame, targets: DataFrame, by: Sequence[str], log: bool) -> DataFrame:
    """Targets (by, rank, lo, hi, below, inside) after one pass: the bucket that holds the rank, by its own least and greatest value.

    Buckets are of equal width between lo and hi, or of equal width on a signed logarithmic scale.
    """

    def scale(c: Column) -> Column:
        return F.signum(c) * F.log1p(F.abs(c)) if log else c

    wanted = F.col("_lo") < F.col("_hi")
    spans = targets.where(wanted).select(*by, "_lo", "_hi").distinct()
    at = (scale(F.col("_v")) - scale(F.col("_lo"))) / (scale(F.col("_hi")) - scale(F.col("_lo")))
    bucket = F.greatest(F.least(F.floor(F.coalesce(at, F.lit(0.0)) * _BUCKETS), F.lit(_BUCKETS - 1)), F.lit(0))
    counted = (
        lookup_join(rows, spans, by)
        .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*by, "_lo", "_hi", bucket.alias("_b"))
        .agg(F.sum("_w").alias("_n"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    )
    upto = F.sum("_n").over(W.partitionBy(*by, "_lo", "_hi").orderBy("_b"))
    counted = counted.withColumn("_before", upto - F.col("_n"))
    keys = [*by, "_lo", "_hi"]
    met = null_safe_join(targets.where(wanted), counted, keys).withColumn("_skip", F.col("_rank") - F.col("_below"))
    hit = met.where((F.col("_skip") >= F.col("_before")) & (F.col("_skip") < F.col("_before") + F.col("_n")))
    fresh = hit.select(
        *by, "_rank", F.col("_first").alias("_lo"), F.col("_last").alias("_hi"),
        (F.col("_below") + F.col("_before")).alias("_below"), F.col("_n").alias("_inside"),
    )
    return fresh.unionByName(targets.where(~wanted))


def values_at_ranks(rows: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, rank, value) for targets (by, _rank, _lo, _hi, _below, _inside) over rows (by, _v, _w).

    Selection without sorting the rows: each pass counts 1,024 buckets between the bounds of every target, with map-side combine, and keeps
    the one bucket that holds the rank. After the first pass only the rows of those buckets are kept, so later passes read a
    small part. A bucket of up to ``_IN_ORDER`` rows is put in order; so is one that cannot be split because all its values are equal.
    """
    targets, first = checkpointed(targets), True
    for turn in count():
        size = F.when(F.col("_lo") < F.col("_hi"), F.col("_inside"))
        if (targets.agg(F.max(size)).first()[0] or 0) <= _IN_ORDER:
            break
        targets = checkpointed(_narrowed(rows, targets, by, log=turn % 2 == 1))
        if first:
            spans = targets.where("_lo < _hi").select(*by, "_lo", "_hi").distinct()
            kept = lookup_join(rows, spans, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
            rows, first = checkpointed(kept.groupBy(*by, "_v").agg(F.sum("_w").alias("_w"))), False
    open_ = targets.where("_lo < _hi")
    spans = open_.select(*by, "_lo", "_hi").distinct()
    folded = (
        lookup_join(rows, spans, by)
        .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*by, "_lo", "_hi", "_v")
        .agg(F.sum("_w").alias("_n"))
    )
    upto = F.sum("_n").over(W.partitionBy(*by, "_lo", "_hi").orderBy("_v"))
    met = null_safe_join(open_, folded.withColumn("_upto", upto), [*by, "_lo", "_hi"])
    skip = F.col("_rank") - F.col("_below")
    hit = met.where((skip < F.col("_upto")) & (skip >= F.col("_upto") - F.col("_n")))
    settled = targets.where("NOT (_lo < _hi)").select(*by, "_rank", F.col("_lo").alias("_value"))
    return hit.select(*by, "_rank", F.col("_v").alias("_value")).unionByName(settled)


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    bounded: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles ``{column: probability}`` per group.

    ``bounded`` says that the value domain is small by nature (calendar days, whole prices): a plain window over the
    folded (group, value, count) table is enough then. Otherwise the two rows beside each quantile are found by selection
    (``values_at_ranks``). ``weight`` names a column of row counts for folded input. Values that are not a number are left out.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(
        *by, v.alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")
    )
    targets = {name: F.lit(float(p)) * (F.col("_size") - 1) for name, p in probs.items()}
    ranks = F.array_distinct(F.array(*[edge(t).cast("long") for t in targets.values() for edge in (F.floor, F.ceil)]))
    if bounded:
        hist = rows.groupBy(*by, "_v").agg(F.sum("_w").alias("_n"))
        whole = W.partitionBy(*by)
        placed = hist.withColumns({"_upto": F.sum("_n").over(whole.orderBy("_v")), "_size": F.sum("_n").over(whole)})
        wanted = placed.withColumn("_ranks", F.filter(ranks, lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n"))))
        found = wanted.select(*by, "_size", F.explode("_ranks").alias("_rank"), F.col("_v").alias("_value"))
    else:
        sizes = rows.groupBy(*by).agg(F.sum("_w").alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        sizes = checkpointed(sizes.where(F.col("_size") > 0))
        start = sizes.select(
            *by, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_size").alias("_inside")
        )
        found = values_at_ranks(rows, start, by)
        size = sizes.select(*by, "_size")
        found = null_safe_join(found, size, by)
    values = found.groupBy(*by).agg(
        F.max("_size").alias("_size"), F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at")
    )

    def between(target: Column) -> Column:
        lo, hi = (F.element_at("_at", edge(target).cast("long")) for edge in (F.floor, F.ceil))
        return lo + (hi - lo) * (target - F.floor(target))

    return values.select(*by, *[between(t).alias(name) for name, t in targets.items()])


def carry_in(
    df: DataFrame, key: Sequence[str], block: str, order: Sequence[str], rows: int, flag: str = "_carried"
) -> DataFrame:
    """Add to every (key, block) the last ``rows`` rows of the key before the block.

    A bounded look-back window partitioned by (key, block) over the result then
    equals the window partitioned by key, but a key holding a third of the data
    is spread over as many tasks as it has blocks. Carried rows are flagged.
    """
    tail_rank = F.row_number().over(W.partitionBy(*key, block).orderBy(*[F.desc(c) for c in order]))
    tails = (
        df.withColumn("_tail", tail_rank)
        .where(F.col("_tail") <= rows)
        .groupBy(*key, block)
        .agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order]))).alias("_t"))
    )
    blocks_back = W.partitionBy(*key).orderBy(block).rowsBetween(-rows, -1)
    joined = F.flatten(F.collect_list("_t").over(blocks_back))
    halo = tails.select(
        *key, block, F.slice(joined, F.greatest(F.size(joined) - rows + 1, F.lit(1)), rows).alias("_h")
    )
    carried = halo.select(F.col(block).alias("_to"), F.explode("_h").alias("_row")).select(
        *[F.col("_to").alias(c) if c == block else F.col(f"_row.{c}") for c in df.columns],
        F.lit(True).alias(flag),
    )
    return df.withColumn(flag, F.lit(False)).unionByName(carried)


def blocked_running_total(
    df: DataFrame, key: Sequence[str], block: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Exclusive running sum of ``value`` per key, computed block by block."""
    df = df.withColumn("_v", value)
    sums = df.groupBy(*key, block).agg(F.sum("_v").alias("_s"))
    offsets = sums.select(*key, block, F.coalesce(F.sum("_s").over(_before(key, [block])), F.lit(0.0)).alias("_o"))
    local = F.coalesce(F.sum("_v").over(_before([*key, block], order)), F.lit(0.0))
    return (
        df.withColumn("_l", local)
        .join(offsets, [*key, block])
        .withColumn(name, F.col("_l") + F.col("_o"))
        .drop("_v", "_l", "_o")
    )


def look_back(
    df: DataFrame,
    key: Sequence[str],
    at: str,
    order: Sequence[str],
    rows: int,
    hot_rows: int = 1_000_000,
    unit: str = "month",
) -> tuple[DataFrame, list[str], str]:
    """Prepare a window over the previous ``rows`` rows of each key.

    Keys up to ``hot_rows`` rows stay whole. Larger keys are cut into calendar
    blocks, each carrying in the rows it needs. Returns the frame, the window's
    partition columns and the flag column marking carried rows (drop them after).
    """
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > hot_rows).select(*key, F.lit(True).alias("_hot"))
    # looked up, not shuffled: rows of a large key must stay where they are until the block is known
    marked = lookup_join(df, hot, key, "left").withColumn(
        "_block", F.when(F.col("_hot"), F.date_trunc(unit, F.col(at).cast("timestamp")))
    )
    marked = marked.drop("_hot")
    large = carry_in(marked.where(F.col("_block").isNotNull()), key, "_block", order, rows)
    small = marked.where(F.col("_block").isNull()).withColumn("_carried", F.lit(False))
    return small.unionByName(large), [*key, "_block"], "_carried"
