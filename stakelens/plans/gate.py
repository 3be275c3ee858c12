"""Statistics and gate over the graded pick history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakelens.operators import cuts as c
from stakelens.operators.grading import graded_picks
from stakelens.operators.stats import gate_pass, picks_to_significance, roi_columns, roi_stats, verdict
from stakelens.plans.adapters import MARKETS, gate_sql, picks, picks_raw, roi_sql, with_tables
from stakelens.plans.registry import query

_GRADED = with_tables("graded")
_PICKS = with_tables("picks")

_CUTS_SQL = (
    "cut_rows AS (SELECT 'all' AS cut, 0 AS cut_no, g.* FROM graded g "
    "UNION ALL SELECT 'minus-money', 1, g.* FROM graded g WHERE odds < 0 "
    "UNION ALL SELECT 'conf>=60 minus-money', 2, g.* FROM graded g WHERE odds < 0 AND confidence >= 60), "
    f"matrix AS (SELECT market, cut, cut_no, {roi_sql()} FROM cut_rows GROUP BY ALL)"
)


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    return graded_picks(picks_raw(spark, sf))


def gate_matrix(graded: DataFrame) -> DataFrame:
    """Market x cut statistics and verdict from one pass over the picks."""
    stats = c.cut_stats(graded, ["market"], c.gate_cuts())
    return stats.withColumn("verdict", verdict())


@query("graded_picks", _GRADED + "SELECT * FROM graded")
def q_graded_picks(spark, sf):
    return _graded(spark, sf)


@query(
    "roi_stats",
    _GRADED + f"SELECT market, {roi_sql()}, min(game_date) AS first_day, max(game_date) AS last_day "
    "FROM graded GROUP BY market",
)
def q_roi_stats(spark, sf):
    return (
        _graded(spark, sf)
        .groupBy("market")
        .agg(*roi_columns(), F.min("game_date").alias("first_day"), F.max("game_date").alias("last_day"))
    )


@query(
    "gate_cuts",
    with_tables("graded", extra=_CUTS_SQL)
    + f"SELECT market, cut, n, wr, roi, roi_lo, roi_hi, clv, CASE WHEN {gate_sql()} THEN 'PASS' ELSE 'FAIL' END "
    "AS verdict FROM matrix",
)
def q_gate_cuts(spark, sf):
    return gate_matrix(_graded(spark, sf))


def _gate_table(mode: str) -> str:
    return (
        with_tables("picks", extra=f"s AS (SELECT market, side, season, {roi_sql()} FROM picks GROUP BY ALL)")
        + f"SELECT *, {gate_sql(mode)} AS passed FROM s"
    )


@query("gate_official", _gate_table("official"))
def q_gate_official(spark, sf):
    return roi_stats(picks(spark, sf), ["market", "side", "season"]).withColumn("passed", gate_pass())


@query("gate_strict", _gate_table("strict"))
def q_gate_strict(spark, sf):
    return roi_stats(picks(spark, sf), ["market", "side", "season"]).withColumn("passed", gate_pass("strict"))


_CATALOGUE_SQL = "catalogue AS (SELECT unnest([" + ", ".join(f"'{m}'" for m in MARKETS) + "]) AS market)"
_VERDICT_SQL = (
    f"{_CUTS_SQL}, {_CATALOGUE_SQL}, judged AS (SELECT *, {gate_sql()} AS passed FROM matrix), "
    "best AS (SELECT market, max(CASE WHEN cut_no = 0 THEN n END) AS n_total, "
    "arg_min(cut, cut_no) FILTER (WHERE passed) AS best_cut FROM judged GROUP BY market), "
    "verdicts AS (SELECT c.market, CAST(coalesce(n_total, 0) AS BIGINT) AS n_total, best_cut, "
    "CASE WHEN n_total IS NULL THEN 'untestable' WHEN n_total < 500 AND best_cut IS NULL THEN 'insufficient data' "
    "WHEN best_cut IS NOT NULL THEN 'PASS' ELSE 'FAIL' END AS verdict "
    "FROM catalogue c LEFT JOIN best b ON c.market = b.market)"
)


def market_verdicts(matrix: DataFrame, catalogue: tuple[str, ...] = MARKETS) -> DataFrame:
    """First passing cut per market in cut order; every catalogue market is reported."""
    spark = matrix.sparkSession
    best = matrix.groupBy("market").agg(
        F.max(F.when(F.col("cut") == "all", F.col("n"))).alias("n_total"),
        F.min_by("cut", F.when(F.col("verdict") == "PASS", c.cut_order(c.gate_cuts()))).alias("best_cut"),
        F.max(F.col("verdict") == "PASS").alias("any_pass"),
    )
    best = best.withColumn("best_cut", F.when(F.col("any_pass"), F.col("best_cut")))
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in catalogue])).alias("market"))
    return listed.join(best, "market", "left").select(
        "market",
        F.coalesce("n_total", F.lit(0)).alias("n_total"),
        "best_cut",
        F.when(F.col("n_total").isNull(), "untestable")
        .when(F.col("best_cut").isNotNull(), "PASS")
        .when(F.col("n_total") < 500, "insufficient data")
        .otherwise("FAIL")
        .alias("verdict"),
    )


@query("gate_verdict", with_tables("graded", extra=_VERDICT_SQL) + "SELECT * FROM verdicts")
def q_gate_verdict(spark, sf):
    return market_verdicts(gate_matrix(_graded(spark, sf)))


@query(
    "gate_badge",
    with_tables("graded", extra=_VERDICT_SQL)
    + "SELECT g.game_date, count(*) AS picks, count(*) FILTER (WHERE v.verdict = 'PASS') AS pass_picks, "
    "count(*) FILTER (WHERE v.verdict = 'FAIL') AS warned_picks, "
    "count(*) FILTER (WHERE coalesce(v.verdict, 'UNTESTED') NOT IN ('PASS', 'FAIL')) AS untested_picks "
    "FROM graded g LEFT JOIN verdicts v ON g.market = v.market GROUP BY g.game_date",
)
def q_gate_badge(spark, sf):
    graded = _graded(spark, sf)
    badge = market_verdicts(gate_matrix(graded)).select("market", F.col("verdict").alias("badge"))
    label = F.when(F.col("badge").isin("PASS", "FAIL"), F.col("badge")).otherwise(F.lit("UNTESTED"))
    labelled = graded.join(badge, "market", "left").withColumn("badge", label)
    return labelled.groupBy("game_date").agg(
        F.count(F.lit(1)).alias("picks"),
        F.count_if(F.col("badge") == "PASS").alias("pass_picks"),
        F.count_if(F.col("badge") == "FAIL").alias("warned_picks"),
        F.count_if(F.col("badge") == "UNTESTED").alias("untested_picks"),
    )


@query(
    "clv_capture",
    _GRADED + "SELECT market, count(*) AS n, count(clv) AS covered, "
    "round(100e0 * count(clv) / count(*), 1) AS pct FROM graded GROUP BY market",
)
def q_clv_capture(spark, sf):
    return (
        _graded(spark, sf)
        .groupBy("market")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("clv").alias("covered"),
            F.round(F.lit(100.0) * F.count("clv") / F.count(F.lit(1)), 1).alias("pct"),
        )
    )


@query(
    "side_mix",
    _GRADED + "SELECT market, side, count(*) AS n, round(avg(CAST(win AS INT)) * 100, 1) AS wr, "
    "round(avg(odds), 0) AS avg_odds FROM graded GROUP BY market, side",
)
def q_side_mix(spark, sf):
    return (
        _graded(spark, sf)
        .groupBy("market", "side")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(F.col("win").cast("int")) * 100, 1).alias("wr"),
            F.round(F.avg("odds"), 0).alias("avg_odds"),
        )
    )


@query(
    "n_to_significance",
    _PICKS + "SELECT market, confidence, count(*) AS n, "
    "CASE WHEN avg(profit) > 0 THEN CAST(ceil(power(1.96e0 * stddev_samp(profit) / avg(profit), 2)) AS BIGINT) END "
    "AS n_needed FROM picks GROUP BY market, confidence",
)
def q_n_to_significance(spark, sf):
    by = picks(spark, sf).groupBy("market", "confidence")
    return by.agg(
        F.count(F.lit(1)).alias("n"),
        picks_to_significance(F.avg("profit"), F.stddev_samp("profit")).alias("n_needed"),
    )
