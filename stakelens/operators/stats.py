"""Win rate, return, confidence interval and the PASS/FAIL gate.

Everything here is algebraic: one row-level hash aggregation with map-side
combine, however skewed the grouping keys are. ``moments`` keeps the mergeable
form, so a fine-grained aggregate can be rolled into any number of cuts
without touching the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_GRADED = 500
Z95 = 1.96

MOMENTS = ("n", "wins", "s1", "s2", "clv_sum", "clv_n")


def steady_round(value: Column, digits: int) -> Column:
    """Half away from zero, with values a summation error away from a tie counted as the tie:
    the figure is the same however the rows were partitioned."""
    return F.round(value + F.signum(value) * 1e-9, digits)


def _interval(mean: Column, sd: Column, n: Column, sign: int) -> Column:
    return steady_round((mean + sign * Z95 * sd / F.sqrt(n)) * 100, 2)


def roi_columns(win: str = "win", profit: str = "profit", clv: str | None = "clv") -> list[Column]:
    """Aggregate expressions of the return statistic, for use in any ``agg``."""
    mean, sd, n = F.avg(profit), F.stddev_samp(profit), F.count(F.lit(1))
    out = [
        n.alias("n"),
        steady_round(F.avg(F.col(win).cast("int")) * 100, 1).alias("wr"),
        steady_round(mean * 100, 2).alias("roi"),
        _interval(mean, sd, n, -1).alias("roi_lo"),
        _interval(mean, sd, n, 1).alias("roi_hi"),
    ]
    if clv is not None:
        out.append(steady_round(F.avg(clv), 2).alias("clv"))
    return out


def roi_stats(df: DataFrame, by: Sequence[str] = (), clv: str | None = "clv") -> DataFrame:
    return df.groupBy(*by).agg(*roi_columns(clv=clv))


def moments(df: DataFrame, by: Sequence[str], clv: str | None = "clv") -> DataFrame:
    """Mergeable sums per cell."""
    profit = F.col("profit")
    clv_col = F.col(clv) if clv else F.lit(None).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("win").cast("long")).alias("wins"),
        F.sum(profit).alias("s1"),
        F.sum(profit * profit).alias("s2"),
        F.sum(clv_col).alias("clv_sum"),
        F.count(clv_col).alias("clv_n"),
    )


def merge_moments(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return cells.groupBy(*by).agg(*[F.sum(m).alias(m) for m in MOMENTS])


def sums_where(condition: Column, suffix: str) -> list[Column]:
    """Moments of the cells meeting a condition, merged within one ``agg``."""
    return [F.sum(F.when(condition, F.col(m))).alias(f"{m}{suffix}") for m in MOMENTS]


def stats_from_moments(suffix: str = "", clv: bool = True, out_suffix: str = "") -> list[Column]:
    """The return statistic written over merged sums."""
    n = F.coalesce(F.col(f"n{suffix}"), F.lit(0))
    nd = n.cast("double")
    s1, s2 = F.col(f"s1{suffix}"), F.col(f"s2{suffix}")
    mean = F.try_divide(s1, nd)
    spread = F.greatest(s2 - s1 * mean, F.lit(0.0))
    sd = F.when(n > 1, F.sqrt(F.try_divide(spread, nd - 1)))
    out = [
        n.alias(f"n{out_suffix}"),
        steady_round(F.try_divide(F.col(f"wins{suffix}"), nd) * 100, 1).alias(f"wr{out_suffix}"),
        steady_round(mean * 100, 2).alias(f"roi{out_suffix}"),
        _interval(mean, sd, nd, -1).alias(f"roi_lo{out_suffix}"),
        _interval(mean, sd, nd, 1).alias(f"roi_hi{out_suffix}"),
    ]
    if clv:
        covered = F.col(f"clv_n{suffix}")
        out.append(steady_round(F.try_divide(F.col(f"clv_sum{suffix}"), covered), 2).alias(f"clv{out_suffix}"))
    return out


def gate_pass(mode: str = "official", n: str = "n", roi: str = "roi", lo: str = "roi_lo") -> Column:
    """official: n>=500 needs a positive return, smaller samples a positive lower bound.
    strict: n>=500 and a positive lower bound. Both read the rounded figures."""
    size, low = F.col(n), F.coalesce(F.col(lo) > 0, F.lit(False))
    if mode == "strict":
        return (size >= MIN_GRADED) & low
    if mode != "official":
        raise ValueError(f"unknown gate mode: {mode}")
    return F.when(size >= MIN_GRADED, F.coalesce(F.col(roi) > 0, F.lit(False))).otherwise(low)


def verdict(mode: str = "official", **names: str) -> Column:
    return F.when(gate_pass(mode, **names), F.lit("PASS")).otherwise(F.lit("FAIL"))


def picks_to_significance(mean: Column, sd: Column) -> Column:
    """Sample size at which the lower bound of the same mean and spread clears zero."""
    return F.when(mean > 0, F.ceil(F.pow(Z95 * sd / mean, 2)).cast("long"))
