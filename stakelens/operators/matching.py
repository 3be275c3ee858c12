"""Joins with their own matching rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unordered_pair_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_pair: tuple[str, str], right_pair: tuple[str, str]
) -> DataFrame:
    """Equi join on the sorted pair: same matches as (a=x and b=y) or (a=y and b=x), without a nested loop."""
    lo, hi = F.least, F.greatest
    keyed_left = left.withColumns({"_lo": lo(*left_pair), "_hi": hi(*left_pair)})
    keyed_right = right.withColumns({"_lo": lo(*right_pair), "_hi": hi(*right_pair)})
    return keyed_left.join(keyed_right, [*on, "_lo", "_hi"]).drop("_lo", "_hi")


def resolve(
    left: DataFrame, right: DataFrame, keys: dict[str, tuple[Column, Column]], latest: Column, take: Sequence[str]
) -> DataFrame:
    """Match each left row to at most one right row on normalised keys; the latest right row wins."""
    lk = left.withColumns({k: pair[0] for k, pair in keys.items()})
    rk = right.withColumns({k: pair[1] for k, pair in keys.items()})
    one = rk.groupBy(*keys).agg(F.max_by(F.struct(*take), latest).alias("_hit"))
    return lk.join(one, list(keys), "left").withColumn("resolved", F.col("_hit").isNotNull()).select(
        *left.columns, *[F.col(f"_hit.{c}").alias(c) for c in take], "resolved"
    )


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank_no") -> DataFrame:
    """First k rows per group; Spark limits each task to k rows per group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def only_new(candidates: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(done.select(*keys), list(keys), "left_anti")


def only_known(candidates: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(known.select(*keys), list(keys), "left_semi")


def islands(df: DataFrame, by: Sequence[str], day: str, first: str = "d0", last: str = "d1") -> DataFrame:
    """Runs of consecutive days per group: one row for each run.

    Days are made distinct before they are numbered, so a group's window holds its calendar, not its rows.
    """
    days = df.where(F.col(day).isNotNull()).select(*by, day).distinct()
    number = F.row_number().over(W.partitionBy(*by).orderBy(day))
    runs = days.withColumn("_run", F.date_sub(F.col(day), number))
    return runs.groupBy(*by, "_run").agg(F.min(day).alias(first), F.max(day).alias(last)).drop("_run")


def in_islands(df: DataFrame, runs: DataFrame, by: Sequence[str], day: str, flag: str = "in_window") -> DataFrame:
    """Flag the rows whose day lies within a run of their group.

    A range join by calendar month: each run is listed under the months that it touches, so a row meets only the runs of its own
    month, of which there are at most sixteen and at most one holds the day.
    """
    month = F.trunc(F.col(day), "month")
    steps = F.sequence(F.trunc("d0", "month"), F.trunc("d1", "month"), F.expr("interval 1 month"))
    listed = runs.select(*[F.col(c).alias(f"_r_{c}") for c in by], "d0", "d1", F.explode(steps).alias("_month"))
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    hit = (month == F.col("_month")) & F.col(day).between(F.col("d0"), F.col("d1"))
    for condition in same:
        hit = hit & condition
    out = df.join(listed, hit, "left").withColumn(flag, F.col("d0").isNotNull())
    return out.drop("d0", "d1", "_month", *[f"_r_{c}" for c in by])
