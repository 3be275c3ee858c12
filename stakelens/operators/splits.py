"""Temporal splits: quantile of date, row index, calendar year, fixed season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stakelens.operators.ordered import exact_quantiles, lookup_join, null_safe_join, ranked
from stakelens.operators.stats import stats_from_moments, sums_where


def walk_forward_cells(cells: DataFrame, by: Sequence[str], day: str, fraction: float) -> DataFrame:
    """Train/test statistics split at the interpolated date quantile of each group.

    Works on (group, day) moments, so the split costs no second look at the rows, and
    the quantile's window runs over calendar days only.
    """
    timed = cells.withColumn("_at", (F.unix_date(day) * 86400).cast("double"))
    splits = exact_quantiles(timed, by, "_at", {"_split": fraction}, bounded=True, weight="n")
    split = null_safe_join(timed, splits, by)
    train = F.col("_at") < F.col("_split")
    merged = split.groupBy(*by).agg(
        F.max("_split").alias("split_epoch"), *sums_where(train, "_train"), *sums_where(~train, "_test")
    )
    return merged.select(
        *by,
        "split_epoch",
        *stats_from_moments("_train", clv=False, out_suffix="_train"),
        *stats_from_moments("_test", clv=False, out_suffix="_test"),
    )


def index_split(
    df: DataFrame, by: Sequence[str], day: str, ties: Sequence[str], fractions: Sequence[float], name: str = "part_no"
) -> DataFrame:
    """Number of cut positions ``floor(n * fraction)`` at or before each row's date order; rows without a day are left out.

    Only the days that straddle a cut need a row order at all; every other row gets
    its part from the (group, day) counts. The straddling days are ranked by range
    chunks, so neither a hot group nor a hot day is sorted in one task.
    """
    df = df.where(F.col(day).isNotNull())
    counts = df.groupBy(*by, day).agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy(day).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumns({"_before": before, "_size": F.sum("_n").over(group)})

    def part(position: Column) -> Column:
        out = F.lit(0)
        for f in fractions:
            out = out + (position >= F.floor(F.col("_size") * F.lit(float(f)))).cast("int")
        return out

    days = placed.select(
        *by, day, "_before", "_size",
        part(F.col("_before")).alias("_lo"), part(F.col("_before") + F.col("_n") - 1).alias("_hi"),
    )
    rows = lookup_join(df, days, [*by, day])
    whole = rows.where("_lo = _hi").withColumn(name, F.col("_lo"))
    straddling = ranked(rows.where("_lo <> _hi"), [*by, day], list(ties), "_rank")
    straddling = straddling.withColumn(name, part(F.col("_before") + F.col("_rank") - 1)).drop("_rank")
    return whole.unionByName(straddling).drop("_before", "_size", "_lo", "_hi")


def stable_flag(train: str = "roi_train", test: str = "roi_test") -> Column:
    return F.coalesce((F.col(train) > 0) & (F.col(test) > 0), F.lit(False))
