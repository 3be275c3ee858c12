"""Correlations, quantiles, factor re-weighting and model metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stakelens.functions.odds import fair_prob, implied_prob
from stakelens.functions.typing import prefixed
from stakelens.operators import cuts as c
from stakelens.operators import factors as fa
from stakelens.operators import form as f
from stakelens.operators import metrics
from stakelens.operators.ordered import exact_quantiles, lookup_join
from stakelens.operators.splits import index_split
from stakelens.operators.stats import gate_pass
from stakelens.plans import adapters as a
from stakelens.plans.adapters import PICK_TIES, gate_sql, roi_sql, with_tables
from stakelens.plans.form import _FORM, weather_totals
from stakelens.plans.registry import query
from stakelens.plans.scalars import _implied
from stakelens.session import checkpointed, table

_FACTORS = ("score_discount", "score_tax", "score_volume", "score_price", "score_sparse", "score_form")
_FULL_FORM = (
    f"{_FORM}, fg AS (SELECT g.season, CAST(home_score > away_score AS INT) AS home_win, "
    "CAST(l10_home_wins - l10_away_wins AS DOUBLE) AS l10_diff, "
    f"{_implied('home_close_ml')} AS mh, {_implied('away_close_ml')} AS ma, "
    f"{_implied('home_open_ml')} AS oh, {_implied('away_open_ml')} AS oa FROM games g JOIN form "
    "ON form.game_pk = g.game_pk WHERE l10_home_games = 10 AND l10_away_games = 10 AND home_close_ml IS NOT NULL "
    "AND away_close_ml IS NOT NULL)"
)


def form_games(spark, sf) -> DataFrame:
    """Games with full form on both sides and a closing price, with market probabilities."""
    games = a.games(spark, sf)
    full = games.join(f.last_n_form(games), "game_pk").where("l10_home_games = 10 AND l10_away_games = 10")
    return full.na.drop(subset=["home_close_ml", "away_close_ml"]).select(
        "season",
        (F.col("home_score") > F.col("away_score")).cast("int").alias("home_win"),
        (F.col("l10_home_wins") - F.col("l10_away_wins")).cast("double").alias("l10_diff"),
        fair_prob("home_close_ml", "away_close_ml").alias("close_prob"),
        fair_prob("home_open_ml", "away_open_ml").alias("open_prob"),
    )


@query(
    "feature_corr",
    with_tables("games", "boxscore", extra="t AS (SELECT game_pk, sum(runs_scored) AS total_runs, "
    "sum(home_runs) AS total_hr FROM boxscore WHERE position_type <> 'Pitcher' GROUP BY 1 "
    "HAVING sum(runs_scored) IS NOT NULL), w AS (SELECT * FROM games g JOIN t ON t.game_pk = g.game_pk "
    "WHERE NOT is_dome)")
    + "SELECT count(*) AS n, round(corr(wind_mph, total_runs), 4) AS wind_runs, "
    "round(corr(temperature_f, total_runs), 4) AS temp_runs, round(corr(wind_mph, total_hr), 4) AS wind_hr, "
    "round(corr(temperature_f, total_hr), 4) AS temp_hr FROM w",
)
def q_feature_corr(spark, sf):
    w = weather_totals(spark, sf)
    return w.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(fa.safe_corr("wind_mph", "total_runs"), 4).alias("wind_runs"),
        F.round(fa.safe_corr("temperature_f", "total_runs"), 4).alias("temp_runs"),
        F.round(fa.safe_corr("wind_mph", "total_hr"), 4).alias("wind_hr"),
        F.round(fa.safe_corr("temperature_f", "total_hr"), 4).alias("temp_hr"),
    )


@query(
    "split_corr",
    with_tables("games", extra=_FULL_FORM)
    + "SELECT CASE WHEN season <= 1998 THEN 'train' ELSE 'test' END AS part, count(*) AS n, "
    "round(corr(l10_diff, home_win), 4) AS l10_corr, round(corr(mh / (mh + ma), home_win), 4) AS close_corr, "
    "round(corr(oh / (oh + oa), home_win), 4) AS open_corr FROM fg GROUP BY 1",
)
def q_split_corr(spark, sf):
    part = F.when(F.col("season") <= 1998, "train").otherwise("test")
    return (
        form_games(spark, sf)
        .groupBy(part.alias("part"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(fa.safe_corr("l10_diff", "home_win"), 4).alias("l10_corr"),
            F.round(fa.safe_corr("close_prob", "home_win"), 4).alias("close_corr"),
            F.round(fa.safe_corr("open_prob", "home_win"), 4).alias("open_corr"),
        )
    )


_PARTS = (
    f"r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY game_date, {', '.join(PICK_TIES)}) - 1 AS i, "
    "count(*) OVER (PARTITION BY market) AS size FROM picks), "
    "t AS (SELECT *, CASE WHEN i < floor(size * 0.6e0) THEN 'train' ELSE 'test' END AS part FROM r), "
    "train AS (SELECT * FROM t WHERE part = 'train')"
)
_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT market, '{x}' AS factor, {x} AS value, CAST(win AS INT) AS y FROM train" for x in _FACTORS
) + ")"
_CORR = (
    f"{_PARTS}, {_LONG}, med AS (SELECT market, factor, median(value) AS md, count(value) AS n_nonnull, "
    "avg(value) AS mu, stddev_pop(value) AS sd FROM long GROUP BY 1, 2), "
    "cr AS (SELECT l.market, l.factor, any_value(n_nonnull) AS n_nonnull, any_value(mu) AS mu, any_value(sd) AS sd, "
    "CASE WHEN stddev_pop(coalesce(value, md)) > 1e-9 THEN corr(coalesce(value, md), y) END AS r "
    "FROM long l JOIN med m ON l.market = m.market AND l.factor = m.factor GROUP BY 1, 2), "
    "top AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY abs(r) DESC, factor) AS rank_no FROM cr "
    "WHERE n_nonnull >= 300 AND abs(r) >= 0.01 QUALIFY rank_no <= 8)"
)


def _halves(spark, sf) -> DataFrame:
    parts = index_split(a.picks(spark, sf), ["market"], "game_date", PICK_TIES, [0.6])
    return parts.withColumn("part", F.when(F.col("part_no") == 0, "train").otherwise("test"))


def _train_top(halves: DataFrame) -> DataFrame:
    train = halves.where("part = 'train'")
    corr = fa.imputed_correlations(train, ["market"], prefixed(halves, "score_"), "win")
    # a handful of rows per market, used by several later passes
    return checkpointed(fa.top_factors(corr, ["market"], min_abs=0.01))


@query(
    "factor_corr_topk",
    with_tables("picks", extra=_CORR) + "SELECT market, factor, n_nonnull, round(r, 4) AS r, rank_no FROM top",
)
def q_factor_corr_topk(spark, sf):
    top = _train_top(_halves(spark, sf))
    return top.select("market", "factor", "n_nonnull", F.round("r", 4).alias("r"), "rank_no")


_COMBO = (
    f"{_CORR}, zz AS ("
    + " UNION ALL ".join(
        f"SELECT t.market, t.part, t.i, t.odds, t.confidence, t.win, t.profit, "
        f"sign(r) * (coalesce({x}, mu) - mu) / sd AS z FROM t JOIN top ON t.market = top.market "
        f"AND factor = '{x}' AND sd > 0"
        for x in _FACTORS
    )
    + "), cb AS (SELECT market, part, i, any_value(odds) AS odds, any_value(confidence) AS confidence, "
    "any_value(win) AS win, any_value(profit) AS profit, round(sum(z), 9) AS combo FROM zz GROUP BY 1, 2, 3)"
)


@query(
    "zscore_combo",
    with_tables("picks", extra=_COMBO)
    + "SELECT market, part, count(*) AS n, round(avg(combo), 4) + 0e0 AS mean_combo, round(stddev_pop(combo), 4) AS sd_combo, "
    "round(min(combo), 4) AS min_combo, round(max(combo), 4) AS max_combo FROM cb GROUP BY 1, 2",
)
def q_zscore_combo(spark, sf):
    halves = _halves(spark, sf)
    scored = fa.with_combo(halves, ["market"], _train_top(halves), prefixed(halves, "score_"))
    return scored.groupBy("market", "part").agg(
        F.count(F.lit(1)).alias("n"),
        (F.round(F.avg("combo"), 4) + F.lit(0.0)).alias("mean_combo"),
        F.round(F.stddev_pop("combo"), 4).alias("sd_combo"),
        F.round(F.min("combo"), 4).alias("min_combo"),
        F.round(F.max("combo"), 4).alias("max_combo"),
    )


@query(
    "factor_reweight",
    with_tables("picks", extra=f"{_COMBO}, th AS (SELECT market, quantile_cont(combo, 0.75) AS cutoff FROM cb "
    "WHERE part = 'train' GROUP BY 1), "
    "u AS (SELECT cb.market, part, 'top quartile' AS rule, win, profit FROM cb JOIN th ON th.market = cb.market "
    "WHERE combo >= cutoff AND odds < 0 UNION ALL SELECT market, part, 'confidence baseline', win, profit FROM cb "
    f"WHERE confidence >= 60 AND odds < 0), s AS (SELECT market, part, rule, {roi_sql(clv=None)} FROM u GROUP BY 1, 2, 3)")
    + f"SELECT *, {gate_sql('strict')} AS passed FROM s",
)
def q_factor_reweight(spark, sf):
    halves = _halves(spark, sf)
    scored = fa.with_combo(halves, ["market"], _train_top(halves), prefixed(halves, "score_"))
    cutoff = exact_quantiles(scored.where("part = 'train'"), ["market"], "combo", {"cutoff": 0.75})
    minus = F.col("odds") < 0
    cuts = [
        ("top quartile", minus & (F.col("combo") >= F.col("cutoff"))),
        ("confidence baseline", minus & (F.col("confidence") >= 60)),
    ]
    stats = c.cut_stats(lookup_join(scored, cutoff, ["market"]), ["market", "part"], cuts, name="rule", clv=None)
    return stats.withColumn("passed", gate_pass("strict"))


# fixed values: weight-column prefixes per market and the reserved prefixes
_WEIGHT_PREFIX = {
    "hits": "w_mlb_hits_", "total_bases": "w_mlb_tb_", "rbis": "w_mlb_rbi_",
    "home_runs": "w_mlb_hr_", "runs_scored": "w_mlb_runs_",
}
_RESERVED = (
    "w_mlb_hits_", "w_mlb_tb_", "w_mlb_rbi_", "w_mlb_hr_", "w_mlb_runs_", "w_mlb_outs_", "w_mlb_bk_",
    "w_mlb_pk_", "w_mlb_side_", "w_mlb_total_",
)
_GENERIC = ("w_mlb_batter_", "w_mlb_pitcher_", "w_mlb_umpire_", "w_mlb_game_")
_FACTOR_KEY = f"^w_mlb_({'|'.join(p.removeprefix('w_mlb_') for p in (*_RESERVED, *_GENERIC))})?(.+)$"
# the wide one-row weight table, measured on the supplier and part tables
_WEIGHTS = [
    "round(avg(l_discount) * 40e0, 4) AS w_mlb_hits_discount", "round(avg(l_tax), 4) AS w_mlb_hits_form",
    "round(avg(l_tax) * 2e0, 4) AS w_mlb_tb_volume", "round(avg(l_discount) * 30e0, 4) AS w_mlb_tb_price",
    "round(avg(l_tax) * 3e0, 4) AS w_mlb_rbi_form", "round(avg(l_quantity) / 20e0, 4) AS w_mlb_rbi_tax",
    "round(avg(l_discount) * 25e0, 4) AS w_mlb_hr_form", "round(avg(l_tax) * 4e0, 4) AS w_mlb_runs_discount",
    "round(avg(l_quantity) / 10e0, 4) AS w_mlb_pitcher_price", "round(avg(l_discount) * 21e0, 4) AS w_mlb_form",
    "round(avg(l_discount), 4) AS w_mlb_umpire_volume", "round(avg(l_tax) * 9e0, 4) AS w_mlb_side_tax",
]
_WEIGHT_NAMES = [w.split(" AS ")[1] for w in _WEIGHTS]


def weights_vs_correlations(weights: DataFrame, corr: DataFrame, k: int = 12, min_nonnull: int = 200) -> DataFrame:
    """Wide weights to long, matched to each market's correlations by factor key and prefix rule."""
    cols = [x for x in weights.columns if x.startswith("w_mlb_")]
    long = weights.unpivot([], [F.col(x).cast("double").alias(x) for x in cols], "weight_col", "weight")
    long = long.withColumn("factor_key", F.regexp_extract("weight_col", _FACTOR_KEY, 2))
    own = F.create_map(*[F.lit(x) for kv in _WEIGHT_PREFIX.items() for x in kv])
    prefix = F.element_at(own, F.col("market"))
    reserved = F.lit(False)
    for p in _RESERVED:
        reserved = reserved | F.col("weight_col").startswith(p)
    fits = F.when(prefix.isNotNull(), F.col("weight_col").startswith(prefix)).otherwise(~reserved)
    r = F.round("r", 3)
    keyed = corr.where((F.col("n_nonnull") >= min_nonnull) & F.col("r").isNotNull()).select(
        "market", F.regexp_replace("factor", "^score_", "").alias("factor_key"), r.alias("corr")
    )
    rank = F.row_number().over(W.partitionBy("market").orderBy(F.desc(F.abs("weight")), "weight_col"))
    flag = F.when((F.abs("weight") >= 1.0) & (F.abs("corr") < 0.03), F.lit("heavy weight, no correlation")).when(
        (F.abs("weight") <= 0.25) & (F.abs("corr") >= 0.08), F.lit("light weight, real correlation")
    )
    return (
        keyed.join(long, "factor_key")
        .where(fits)
        .withColumns({"rank_no": rank, "flag": flag})
        .where(F.col("rank_no") <= k)
        .select("market", "weight_col", "weight", "corr", "rank_no", "flag")
    )


def _weight_case() -> str:
    own = " ".join(f"WHEN '{m}' THEN starts_with(weight_col, '{p}')" for m, p in _WEIGHT_PREFIX.items())
    none = " AND ".join(f"NOT starts_with(weight_col, '{p}')" for p in _RESERVED)
    return f"CASE market {own} ELSE {none} END"


@query(
    "weight_vs_corr",
    with_tables("picks", extra=f"{_CORR}, wt AS (SELECT {', '.join(_WEIGHTS)} FROM lineitem), "
    "wl AS (" + " UNION ALL ".join(f"SELECT '{w}' AS weight_col, {w} AS weight FROM wt" for w in _WEIGHT_NAMES) + "), "
    f"wk AS (SELECT *, regexp_extract(weight_col, '{_FACTOR_KEY}', 2) AS fk FROM wl), "
    "j AS (SELECT market, weight_col, weight, round(r, 3) AS corr FROM cr JOIN wk ON replace(factor, 'score_', '') = fk "
    f"WHERE n_nonnull >= 200 AND r IS NOT NULL AND {_weight_case()})")
    + "SELECT *, row_number() OVER (PARTITION BY market ORDER BY abs(weight) DESC, weight_col) AS rank_no, "
    "CASE WHEN abs(weight) >= 1 AND abs(corr) < 0.03 THEN 'heavy weight, no correlation' WHEN abs(weight) <= 0.25 "
    "AND abs(corr) >= 0.08 THEN 'light weight, real correlation' END AS flag FROM j QUALIFY rank_no <= 12",
)
def q_weight_vs_corr(spark, sf):
    train = _halves(spark, sf).where("part = 'train'")
    corr = fa.imputed_correlations(train, ["market"], prefixed(train, "score_"), "win")
    weights = table(spark, sf, "lineitem").selectExpr(*_WEIGHTS)
    return weights_vs_correlations(weights, corr)


@query(
    "quantile_threshold",
    with_tables("picks")
    + "SELECT market, round(quantile_cont(score_price, 0.25), 6) AS q25, round(quantile_cont(score_price, 0.6), 6) AS q60, "
    "round(quantile_cont(score_price, 0.75), 6) AS q75 FROM picks GROUP BY 1",
)
def q_quantile_threshold(spark, sf):
    probs = {"q25": 0.25, "q60": 0.6, "q75": 0.75}
    edges = exact_quantiles(a.picks(spark, sf), ["market"], "score_price", probs)
    return edges.select("market", *[F.round(q, 6).alias(q) for q in probs])


_FIFTHS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def quantile_bins(df: DataFrame, by: list[str], value: str, label: str, bins: int = 5) -> DataFrame:
    """Right-closed quantile bins with duplicate edges merged; the lowest edge belongs to the first bin."""
    probs = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(df, by, value, probs)
    x, low = F.col(value), F.col("_e0")
    upper = F.least(*[F.when((F.col(e) > low) & (F.col(e) >= x), F.col(e)) for e in list(probs)[1:]])
    binned = lookup_join(df.where(x.isNotNull()), edges, by).withColumn("bin_hi", F.coalesce(upper, F.col(f"_e{bins}")))
    return binned.groupBy(*by, "bin_hi").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(label).cast("int")) * 100, 1).alias("win_rate")
    )


@query(
    "quantile_bins",
    with_tables("picks", extra="e AS (SELECT market, list_distinct([" + ", ".join(
        f"quantile_cont(score_volume, {p})" for p in _FIFTHS) + "]) AS edges, min(score_volume) AS lo FROM picks GROUP BY 1)")
    + "SELECT p.market, list_min(list_filter(edges, lambda x: x > lo AND x >= score_volume)) AS bin_hi, count(*) AS n, "
    "round(avg(CAST(win AS INT)) * 100, 1) AS win_rate FROM picks p JOIN e ON e.market = p.market "
    "WHERE score_volume IS NOT NULL GROUP BY 1, 2",
)
def q_quantile_bins(spark, sf):
    return quantile_bins(a.picks(spark, sf), ["market"], "score_volume", "win")


@query(
    "column_coverage",
    with_tables("picks", extra="n AS (SELECT season, count(*) AS n, "
    + ", ".join(f"count({x}) AS {x}" for x in _FACTORS) + " FROM picks GROUP BY 1), l AS ("
    + " UNION ALL ".join(f"SELECT season, n, '{x}' AS factor, {x} AS n_nonnull FROM n" for x in _FACTORS) + ")")
    + "SELECT *, round(n_nonnull / n, 4) AS share, n_nonnull >= greatest(200e0, n * 0.05e0) AS keep FROM l",
)
def q_column_coverage(spark, sf):
    df = a.picks(spark, sf)
    return fa.coverage(df, ["season"], prefixed(df, "score_"))


_SCORE = f"{_implied('odds')} * (0.8e0 + confidence / 400e0)"


def scored_picks(spark, sf) -> DataFrame:
    price = implied_prob("odds")
    score = price * (F.lit(0.8) + F.col("confidence") / 400.0)
    calibrated = F.lit(0.05) + score * 0.9
    return a.picks(spark, sf).withColumns({"score": score, "calibrated": calibrated})


@query(
    "auc_ranksum",
    with_tables("picks", extra=f"s AS (SELECT market, CAST(win AS INT) AS y, {_SCORE} AS score FROM picks), "
    "k AS (SELECT *, rank() OVER (PARTITION BY market ORDER BY score) + (count(*) OVER (PARTITION BY market, score) - 1) "
    "/ 2e0 AS rk FROM s), g AS (SELECT market, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg, "
    "sum(rk) FILTER (WHERE y = 1) AS rs FROM k GROUP BY 1)")
    + "SELECT market, pos, neg, round((rs - pos * (pos + 1) / 2e0) / (CAST(pos AS DOUBLE) * neg), 6) AS auc FROM g",
)
def q_auc_ranksum(spark, sf):
    area = metrics.auc(scored_picks(spark, sf), ["market"], "score", "win")
    return area.withColumn("auc", F.round("auc", 6))


@query(
    "brier_accuracy",
    with_tables("picks", extra=f"s AS (SELECT market, CAST(win AS INT) AS y, {_SCORE} AS score FROM picks)")
    + "SELECT market, count(*) AS n, round(avg(power(score - y, 2)), 4) AS brier, "
    "round(avg(CAST(CAST(score >= 0.5 AS INT) = y AS INT)), 4) AS accuracy FROM s GROUP BY 1",
)
def q_brier_accuracy(spark, sf):
    return metrics.brier_accuracy(scored_picks(spark, sf), ["market"], "score", "win")


_REL_EDGES = ((0, 0.3), (0.3, 0.4), (0.4, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 1.0))
_REL_CASE = "CASE " + " ".join(f"WHEN score >= {lo} AND score < {hi} THEN '[{lo},{hi})'" for lo, hi in _REL_EDGES) + " END"


@query(
    "reliability_table",
    with_tables("picks", extra=f"s AS (SELECT market, CAST(win AS INT) AS y, {_SCORE} AS score FROM picks), "
    f"b AS (SELECT *, {_REL_CASE} AS bin FROM s)")
    + "SELECT market, bin, count(*) AS n, round(avg(score), 4) AS mean_raw, round(avg(0.05e0 + score * 0.9e0), 4) "
    "AS mean_cal, round(avg(y), 4) AS actual FROM b GROUP BY 1, 2 HAVING count(*) >= 20",
)
def q_reliability_table(spark, sf):
    binned = scored_picks(spark, sf).withColumn("bin", c.half_open(F.col("score"), _REL_EDGES))
    return metrics.reliability(binned, ["market", "bin"], "score", "calibrated", "win")


_SEEDS = (1, 2, 3, 4, 5)
_SEED_EDGE = (
    "(score_form - 2e0) * 0.0225e0 + CAST((event_id * {s} * 7 + player_id) % 11 - 5 AS DOUBLE) * 0.0041e0"
)


@query(
    "seed_stability",
    with_tables("picks", extra="u AS (" + " UNION ALL ".join(
        f"SELECT market, {s} AS seed, profit, win FROM picks WHERE odds < 0 AND {_SEED_EDGE.format(s=s)} > 0" for s in _SEEDS)
    + f"), s AS (SELECT market, seed, {roi_sql(clv=None)} FROM u GROUP BY 1, 2), "
    f"j AS (SELECT *, {gate_sql()} AS passed FROM s)")
    + "SELECT market, count(*) AS runs, min(roi) AS min_roi, max(roi) AS max_roi, round(avg(roi), 4) AS avg_roi, "
    "count(*) FILTER (WHERE passed) AS passes FROM j GROUP BY 1",
)
def q_seed_stability(spark, sf):
    """Spread of one cut's return over reruns; all runs are graded in the same pass."""
    bets = a.picks(spark, sf).where("odds < 0")
    cuts = [(str(s), F.expr(_SEED_EDGE.format(s=s)) > 0) for s in _SEEDS]
    runs = c.cut_stats(bets, ["market"], cuts, name="seed", clv=None).withColumn("passed", gate_pass())
    return runs.groupBy("market").agg(
        F.count(F.lit(1)).alias("runs"),
        F.min("roi").alias("min_roi"),
        F.max("roi").alias("max_roi"),
        F.round(F.avg("roi"), 4).alias("avg_roi"),
        F.count_if("passed").alias("passes"),
    )
