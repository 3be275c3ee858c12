"""Checks that defend a result: replication, multiplicity, clustering, execution price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.operators.stats import Z95, moments, stats_from_moments, steady_round, sums_where


def side_by_side(df: DataFrame, by: Sequence[str], source: str, left: str, right: str) -> DataFrame:
    """Statistics of two sources for the same cuts; confirmed when both returns are positive."""
    cells = moments(df, [*by, source], clv=None)
    both = cells.groupBy(*by).agg(
        *sums_where(F.col(source) == left, "_a"), *sums_where(F.col(source) == right, "_b")
    )
    stats = both.select(
        *by,
        *stats_from_moments("_a", clv=False, out_suffix="_a"),
        *stats_from_moments("_b", clv=False, out_suffix="_b"),
    )
    return stats.withColumn("confirmed", F.coalesce((F.col("roi_a") > 0) & (F.col("roi_b") > 0), F.lit(False)))


def multiplicity(df: DataFrame, by: Sequence[str], unit: str) -> DataFrame:
    """Rows against independent units: inflation factor and largest unit."""
    units = df.groupBy(*by, unit).agg(F.count(F.lit(1)).alias("_n"))
    return units.groupBy(*by).agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).alias("units"),
        F.round(F.avg("_n"), 4).alias("inflation"),
        F.max("_n").alias("max_per_unit"),
    )


def cluster_robust(df: DataFrame, by: Sequence[str], cluster: str, value: str = "profit") -> DataFrame:
    """Mean with naive and cluster-robust (sum of squared cluster residual totals) intervals.

    Residual totals expand to sums over clusters of t^2, t*n and n^2, so the group
    mean is not needed beforehand and one two-level aggregation is enough.
    """
    v = F.col(value)
    per_cluster = df.groupBy(*by, cluster).agg(
        F.count(v).alias("_n"), F.sum(v).alias("_t"), F.sum(v * v).alias("_q")
    )
    n, t = F.col("_n").cast("double"), F.col("_t")
    sums = per_cluster.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.count(F.lit(1)).alias("clusters"),
        F.sum(t).alias("_s"),
        F.sum("_q").alias("_qq"),
        F.sum(t * t).alias("_tt"),
        F.sum(t * n).alias("_tn"),
        F.sum(n * n).alias("_nn"),
    )
    nd = F.col("n").cast("double")
    mean = F.col("_s") / nd
    naive = F.sqrt(F.try_divide(F.greatest(F.col("_qq") - F.col("_s") * mean, F.lit(0.0)), nd - 1)) / F.sqrt(nd)
    robust = (
        F.sqrt(F.greatest(F.col("_tt") - mean * 2 * F.col("_tn") + mean * mean * F.col("_nn"), F.lit(0.0))) / nd
    )

    def pct(c: Column) -> Column:
        return steady_round(c * 100, 2)

    return sums.select(
        *by, "n", "clusters",
        pct(mean).alias("roi"),
        pct(mean - Z95 * naive).alias("naive_lo"),
        pct(mean + Z95 * naive).alias("naive_hi"),
        pct(mean - Z95 * robust).alias("robust_lo"),
        pct(mean + Z95 * robust).alias("robust_hi"),
        F.round(F.try_divide(robust, naive), 4).alias("se_ratio"),
        F.round(nd * F.pow(F.try_divide(naive, robust), 2), 0).alias("effective_n"),
    )


def best_passing(cuts: DataFrame, by: Sequence[str], cut_no: str, passed: str = "passed") -> DataFrame:
    """Highest-return passing cut per group, else the first cut; flags the multiple comparison."""
    row = F.struct(*[c for c in cuts.columns if c not in by])
    picked = cuts.groupBy(*by).agg(
        F.max_by(row, F.when(F.col(passed), F.struct(F.col("roi"), -F.col(cut_no)))).alias("_best"),
        F.min_by(row, F.col(cut_no)).alias("_first"),
    )
    chosen = F.coalesce("_best", "_first")
    return picked.select(*by, chosen.alias("_c")).select(*by, "_c.*")
