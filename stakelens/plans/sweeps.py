"""Buckets, grids and replication sweeps: one pass over the rows, then cell algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stakelens.functions.odds import implied_prob, rating_prob, unit_profit
from stakelens.operators import cuts as c
from stakelens.operators.ordered import exact_quantiles
from stakelens.operators.splits import walk_forward_cells
from stakelens.operators.stats import (
    gate_pass,
    merge_moments,
    moments,
    roi_stats,
    stats_from_moments,
    steady_round,
    sums_where,
)
from stakelens.plans.adapters import gate_sql, games, picks, roi_sql, round_sql, with_tables
from stakelens.plans.registry import query
from stakelens.plans.scalars import _implied

_PICKS = with_tables("picks")
_BUCKET = (
    "CASE WHEN odds >= 100 THEN 'plus' WHEN odds >= -150 THEN '-100..-149' "
    "WHEN odds >= -250 THEN '-150..-249' ELSE '<=-250' END"
)
_BAND = (
    "CASE WHEN odds <= -250 THEN '<=-250' WHEN odds > -250 AND odds <= -150 THEN '-249..-150' "
    "WHEN odds > -150 AND odds <= -101 THEN '-149..-101' WHEN odds >= 100 THEN 'plus' END"
)


@query("odds_bucket_roi", _PICKS + f"SELECT market, {_BUCKET} AS bucket, {roi_sql()} FROM picks GROUP BY 1, 2")
def q_odds_bucket_roi(spark, sf):
    return roi_stats(picks(spark, sf).withColumn("bucket", c.odds_bucket()), ["market", "bucket"])


def _case(value: str, edges, fmt: str = "[{},{})") -> str:
    whens = " ".join(f"WHEN {value} >= {lo} AND {value} < {hi} THEN '{fmt.format(lo, hi)}'" for lo, hi in edges)
    return f"CASE {whens} END"


_PRICE_EDGES = ((0, 0.3), (0.3, 0.4), (0.4, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 1.0))


@query(
    "range_bins",
    _PICKS + f"SELECT {_case(_implied('odds'), _PRICE_EDGES)} AS price_bin, {roi_sql()} FROM picks GROUP BY 1 "
    "HAVING count(*) >= 20",
)
def q_range_bins(spark, sf):
    binned = picks(spark, sf).withColumn("price_bin", c.half_open(implied_prob("odds"), _PRICE_EDGES))
    return roi_stats(binned, ["price_bin"]).where("n >= 20")


@query(
    "conf_calibration",
    _PICKS + "SELECT market, CAST(confidence // 10 * 10 AS INT) AS bucket_lo, "
    "CAST(confidence // 10 * 10 + 9 AS INT) AS bucket_hi, count(*) AS n, "
    "round(avg(CAST(win AS INT)) * 100, 1) AS actual_wr FROM picks WHERE confidence IS NOT NULL "
    "GROUP BY 1, 2, 3 HAVING count(*) >= 20",
)
def q_conf_calibration(spark, sf):
    low = F.expr("CAST(confidence DIV 10 * 10 AS INT)")
    return (
        picks(spark, sf)
        .where(F.col("confidence").isNotNull())
        .groupBy("market", low.alias("bucket_lo"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(F.col("win").cast("int")) * 100, 1).alias("actual_wr"),
        )
        .where("n >= 20")
        .withColumn("bucket_hi", F.col("bucket_lo") + 9)
    )


_GRID_SQL = (
    f"floors AS (SELECT unnest({list(c.CONFIDENCE_FLOORS)}) AS conf_floor), "
    "prices AS (SELECT unnest(['all', 'minus', 'minus_tight(-101..-200)', 'minus_heavy(<=-200)', 'plus']) "
    "AS price_filter), "
    "sides AS (SELECT unnest(['both', 'over', 'under']) AS side_filter), "
    "hits AS (SELECT p.*, 'conf>=' || conf_floor || ' ' || price_filter || ' ' || side_filter AS cut "
    "FROM picks p, floors, prices, sides WHERE (conf_floor = 0 OR confidence >= conf_floor) "
    "AND (side_filter = 'both' OR side = side_filter) AND CASE price_filter WHEN 'all' THEN true "
    "WHEN 'minus' THEN odds < 0 WHEN 'minus_tight(-101..-200)' THEN odds < 0 AND odds >= -200 "
    "WHEN 'minus_heavy(<=-200)' THEN odds <= -200 ELSE odds >= 0 END), "
    f"stats AS (SELECT market, cut, {roi_sql()} FROM hits GROUP BY 1, 2 HAVING count(*) >= 200), "
    f"judged AS (SELECT *, {gate_sql('strict')} AS passed FROM stats), "
    "split AS (SELECT market, cut, quantile_cont(epoch(game_date), 0.6) AS split_at FROM hits GROUP BY 1, 2), "
    f"wf AS (SELECT h.market, h.cut, {round_sql('(avg(profit) FILTER (WHERE epoch(game_date) < split_at) * 100)')} AS wf_train, "
    f"{round_sql('(avg(profit) FILTER (WHERE epoch(game_date) >= split_at) * 100)')} AS wf_test FROM hits h "
    "JOIN split s ON h.market = s.market AND h.cut = s.cut GROUP BY 1, 2)"
)


def grid_sweep(df: DataFrame, min_n: int = 200) -> DataFrame:
    """Every (confidence floor, price filter, side) cut per market, gate, and walk-forward on the passers.

    Rows are folded to (market, side, price class, confidence step) cells and the grid is
    spread over those; calendar days are folded in only for the passing cuts.
    """
    coords = ["market", "side", "price_class", "conf_step"]
    cells = c.grid_cells(df)
    spread = c.explode_grid(moments(cells, coords))
    stats = merge_moments(spread, ["market", "cut_no"]).select("market", "cut_no", *stats_from_moments())
    judged = stats.where(F.col("n") >= min_n).withColumn("passed", gate_pass("strict"))
    passing = judged.where("passed").select("market", "cut_no")
    members = spread.select(*coords, "cut_no").join(passing, ["market", "cut_no"])
    daily = moments(cells, [*coords, "game_date"], clv=None).join(members, coords)
    forward = walk_forward_cells(daily, ["market", "cut_no"], "game_date", 0.6).select(
        "market", "cut_no", F.col("roi_train").alias("wf_train"), F.col("roi_test").alias("wf_test")
    )
    judged = judged.join(forward, ["market", "cut_no"], "left").withColumn("cut", c.grid_label()).drop("cut_no")
    best = W.partitionBy("market", "passed").orderBy(F.desc("roi"), "cut")
    return (
        judged
        .withColumn("stable", F.coalesce((F.col("wf_train") > 0) & (F.col("wf_test") > 0), F.lit(False)))
        .withColumn("best_of_market", F.col("passed") & (F.row_number().over(best) == 1))
    )


@query(
    "sweep_grid",
    with_tables("picks", extra=_GRID_SQL)
    + "SELECT j.*, CASE WHEN passed THEN wf_train END AS wf_train, CASE WHEN passed THEN wf_test END AS wf_test, "
    "passed AND coalesce(wf_train > 0 AND wf_test > 0, false) AS stable, passed AND row_number() OVER "
    "(PARTITION BY j.market, passed ORDER BY roi DESC, j.cut) = 1 AS best_of_market "
    "FROM judged j JOIN wf ON j.market = wf.market AND j.cut = wf.cut",
)
def q_sweep_grid(spark, sf):
    return grid_sweep(picks(spark, sf))


@query(
    "fine_bins",
    _PICKS + f"SELECT market, {_case('odds', c.PLUS_BINS)} AS bin, {roi_sql()} FROM picks "
    "WHERE side = 'over' AND odds >= 100 GROUP BY 1, 2",
)
def q_fine_bins(spark, sf):
    over = picks(spark, sf).where("side = 'over' AND odds >= 100")
    return roi_stats(over.withColumn("bin", c.half_open(F.col("odds"), c.PLUS_BINS)), ["market", "bin"])


@query(
    "band_side_seasons",
    with_tables("picks", extra=f"b AS (SELECT *, {_BAND} AS band FROM picks), "
    f"s AS (SELECT market, side, band, season, {roi_sql()} FROM b WHERE band IS NOT NULL GROUP BY 1, 2, 3, 4), "
    "k AS (SELECT market, side, band, count(*) FILTER (WHERE n >= 200 AND roi > 0) AS positive_seasons, "
    "count(*) AS seasons FROM s GROUP BY 1, 2, 3), "
    f"p AS (SELECT market, side, band, {roi_sql()} FROM b WHERE band IS NOT NULL GROUP BY 1, 2, 3)")
    + f"SELECT p.*, positive_seasons, seasons, {gate_sql('strict')} AS passed FROM p "
    "JOIN k ON p.market = k.market AND p.side = k.side AND p.band = k.band",
)
def q_band_side_seasons(spark, sf):
    by = ["market", "side", "band"]
    banded = picks(spark, sf).withColumn("band", c.odds_band()).where(F.col("band").isNotNull())
    cells = moments(banded, [*by, "season"])
    roi = steady_round(F.col("s1") / F.col("n") * 100, 2)
    pooled = cells.groupBy(*by).agg(
        *sums_where(F.lit(True), ""),
        F.count_if((F.col("n") >= 200) & (roi > 0)).alias("positive_seasons"),
        F.count(F.lit(1)).alias("seasons"),
    )
    stats = pooled.select(*by, *stats_from_moments(), "positive_seasons", "seasons")
    return stats.withColumn("passed", gate_pass("strict"))


_LINE_BAND = (
    "CASE WHEN line > 0 AND line <= 0.5 THEN '<=0.5' WHEN line > 0.5 AND line <= 1.5 THEN '1-1.5' "
    "WHEN line > 1.5 AND line <= 20 THEN '>=2' END"
)


@query(
    "line_band_side",
    with_tables("picks", extra=f"s AS (SELECT side, {_LINE_BAND} AS line_band, {roi_sql()} FROM picks GROUP BY 1, 2)")
    + f"SELECT *, {gate_sql('strict')} AS passed FROM s",
)
def q_line_band_side(spark, sf):
    line = F.col("line")
    band = c.label_rules(
        [
            (label, (line > lo) & (line <= hi))
            for lo, hi, label in [(0, 0.5, "<=0.5"), (0.5, 1.5, "1-1.5"), (1.5, 20, ">=2")]
        ]
    )
    stats = roi_stats(picks(spark, sf).withColumn("line_band", band), ["side", "line_band"])
    return stats.withColumn("passed", gate_pass("strict"))


@query(
    "season_replication",
    with_tables("picks", extra=f"d AS (SELECT 'line' AS dim, CAST(line AS VARCHAR) AS value, * FROM picks "
    f"UNION ALL SELECT 'band', {_BAND}, * FROM picks), "
    f"m AS (SELECT market, dim, value, season, {roi_sql(clv=None)} FROM d WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4), "
    "l AS (SELECT c.*, p.n AS n_before, p.roi AS roi_before, p.roi_lo AS roi_lo_before FROM m c LEFT JOIN m p ON c.market = p.market "
    "AND c.dim = p.dim AND c.value = p.value AND c.season = p.season + 1)")
    + "SELECT market, dim, value, season, n, roi, n_before, roi_before, "
    "coalesce(n >= 500 AND roi_lo > 0 AND n_before >= 500 AND roi_lo_before > 0 AND roi > 0 AND roi_before > 0, false) AS replicated "
    "FROM l WHERE dim = 'band' OR n >= 200 OR n_before >= 200",
)
def q_season_replication(spark, sf):
    """Line and band matrices of every season beside the season before; replicated = both pass on their own."""
    cells = moments(
        picks(spark, sf).withColumn("band", c.odds_band()), ["market", "line", "band", "season"], clv=None
    )
    dims = F.array(
        F.struct(F.lit("line").alias("dim"), F.col("line").cast("string").alias("value")),
        F.struct(F.lit("band").alias("dim"), F.col("band").alias("value")),
    )
    long = cells.select("market", "season", F.inline(dims), *[x for x in ("n", "wins", "s1", "s2", "clv_sum", "clv_n")])
    by = ["market", "dim", "value", "season"]
    stats = merge_moments(long.where(F.col("value").isNotNull()), by).select(*by, *stats_from_moments(clv=False))
    # one row for each season, so a window of the seasons of one value is short
    seasons = W.partitionBy("market", "dim", "value").orderBy("season").rangeBetween(-1, -1)
    stats = stats.withColumns({f"{x}_before": F.first(x).over(seasons) for x in ("n", "roi", "roi_lo")})
    both = gate_pass("strict") & gate_pass("strict", "n_before", "roi_before", "roi_lo_before")
    positive = (F.col("roi") > 0) & (F.col("roi_before") > 0)
    return stats.where("dim = 'band' OR n >= 200 OR n_before >= 200").select(
        *by, "n", "roi", "n_before", "roi_before", F.coalesce(both & positive, F.lit(False)).alias("replicated")
    )


@query(
    "season_rollup",
    with_tables("picks", extra="s AS (SELECT market, CAST(season AS VARCHAR) AS season, "
    f"{roi_sql()} FROM picks WHERE odds <= -101 AND odds >= -249 GROUP BY 1, 2 "
    f"UNION ALL SELECT market, 'ALL', {roi_sql()} FROM picks WHERE odds <= -101 AND odds >= -249 GROUP BY 1)")
    + f"SELECT *, {gate_sql('strict')} AS passed FROM s",
)
def q_season_rollup(spark, sf):
    band = picks(spark, sf).where("odds <= -101 AND odds >= -249")
    stats = season_rollup(band, ["market"], "season")
    return stats.withColumn("passed", gate_pass("strict"))


def season_rollup(df: DataFrame, by: list[str], level: str, clv: str | None = "clv") -> DataFrame:
    """Statistics per level and over all levels; the total is merged from the level cells."""
    cells = moments(df, [*by, level], clv=clv).withColumn(level, F.col(level).cast("string"))
    both = cells.withColumn(level, F.explode(F.array(F.col(level), F.lit("ALL"))))
    return merge_moments(both, [*by, level]).select(*by, level, *stats_from_moments(clv=clv is not None))


# fixed values: labels of the strategies that follow a price move
_MOVE_LABELS = {
    ("ML", "home"): "ML: line moved toward home, bet home",
    ("ML", "away"): "ML: line moved toward away, bet away",
    ("Total", "over"): "Total: line moved up, bet over",
    ("Total", "under"): "Total: line moved down, bet under",
}


def _strategies_sql() -> str:
    """Every strategy as rows of (strategy, season, win, odds): sides of each market, sides by price, sides by move."""
    won = {
        ("ML", "home"): "hw", ("ML", "away"): "NOT hw", ("RL", "home"): "home_score + hrl > away_score",
        ("RL", "away"): "away_score + arl > home_score", ("Total", "over"): "tot > close_ou_line", ("Total", "under"): "tot < close_ou_line",
    }
    price = {"ML": "{}_close_ml", "RL": "{}_run_line_odds", "Total": "close_ou_odds"}
    moved = {"home": "home_close_ml < home_open_ml", "away": "away_close_ml < away_open_ml"}
    moved |= {"over": "close_ou_line > open_ou_line", "under": "close_ou_line < open_ou_line"}
    rows = [(f"{m}: always {side}", w, price[m].format(side), "true") for (m, side), w in won.items()]
    rows += [(label, won[key], price[key[0]].format(key[1]), moved[key[1]]) for key, label in _MOVE_LABELS.items()]
    for label, sign in (("favorite", "<"), ("underdog", ">")):
        home, away = f"home_close_ml {sign} away_close_ml", f"away_close_ml {sign} home_close_ml"
        rows.append((f"ML: always {label}", f"CASE WHEN {home} THEN hw WHEN {away} THEN NOT hw END", f"CASE WHEN {home} THEN home_close_ml ELSE away_close_ml END", "true"))
    return " UNION ALL ".join(
        f"SELECT '{label}' AS strategy, season, coalesce({w}, false) AS win, {odds} AS odds FROM g WHERE {when}" for label, w, odds, when in rows
    )


@query(
    "strategy_catalogue",
    with_tables("games", extra="g AS (SELECT *, home_score > away_score AS hw, home_score + away_score AS tot, "
    "TRY_CAST(replace(home_run_line, '+', '') AS DOUBLE) AS hrl, "
    f"TRY_CAST(replace(away_run_line, '+', '') AS DOUBLE) AS arl FROM games), b AS ({_strategies_sql()}), "
    "pr AS (SELECT *, CASE WHEN NOT win THEN -1e0 WHEN odds > 0 THEN odds / 100e0 ELSE 100e0 / abs(odds) END "
    "AS profit FROM b WHERE odds IS NOT NULL), "
    f"s AS (SELECT strategy, {roi_sql(clv=None)} FROM pr GROUP BY 1)")
    + f"SELECT *, {gate_sql('strict')} AS passed FROM s",
)
def q_strategy_catalogue(spark, sf):
    stats = roi_stats(strategy_bets(games(spark, sf)), ["strategy"], clv=None)
    return stats.withColumn("passed", gate_pass("strict"))


def strategy_bets(g: DataFrame) -> DataFrame:
    """One row per (game, eligible strategy): the whole catalogue in one pass over the games."""
    from stakelens.functions.typing import signed_number

    score = {s: F.col(f"{s}_score") for s in ("home", "away")}
    closed, opened = ({s: F.col(f"{s}_{w}_ml") for s in score} for w in ("close", "open"))
    total, line, ou = score["home"] + score["away"], F.col("close_ou_line"), F.col("close_ou_odds")
    home_win = score["home"] > score["away"]
    # (market, side) -> (won, price)
    bets = {("ML", "home"): (home_win, closed["home"]), ("ML", "away"): (~home_win, closed["away"])}
    for side, other in (("home", "away"), ("away", "home")):
        covered = score[side] + signed_number(f"{side}_run_line") > score[other]
        bets["RL", side] = (covered, F.col(f"{side}_run_line_odds"))
    bets |= {("Total", "over"): (total > line, ou), ("Total", "under"): (total < line, ou)}
    moved = {s: closed[s] < opened[s] for s in score}
    moved |= {"over": line > F.col("open_ou_line"), "under": line < F.col("open_ou_line")}
    catalogue = [(f"{m}: always {side}", F.lit(True), *bet) for (m, side), bet in bets.items()]
    catalogue += [(label, moved[key[1]], *bets[key]) for key, label in _MOVE_LABELS.items()]
    for label, is_home, is_away in (
        ("favorite", closed["home"] < closed["away"], closed["away"] < closed["home"]),
        ("underdog", closed["home"] > closed["away"], closed["away"] > closed["home"]),
    ):
        won = F.when(is_home, home_win).when(is_away, ~home_win)
        catalogue.append((f"ML: always {label}", F.lit(True), won, F.when(is_home, closed["home"]).otherwise(closed["away"])))
    return explode_bets(g, catalogue, ["season"])


def explode_bets(g: DataFrame, catalogue, keep: list[str]) -> DataFrame:
    """Rows of (label, eligible, win, odds) entries that are eligible and priced."""
    entries = F.array(
        *[
            F.struct(
                F.lit(label).alias("strategy"),
                F.coalesce(eligible, F.lit(False)).alias("eligible"),
                F.coalesce(win, F.lit(False)).alias("win"),
                price.cast("int").alias("odds"),
            )
            for label, eligible, win, price in catalogue
        ]
    )
    bets = g.select(*keep, F.inline(entries)).where(F.col("eligible") & F.col("odds").isNotNull())
    return bets.drop("eligible").withColumn("profit", unit_profit("win", "odds"))


@query(
    "favorite_accuracy_roi",
    _PICKS + f"SELECT market, {roi_sql()}, round(avg(CAST(win AS INT)), 4) AS accuracy, "
    f"round(avg({_implied('odds')}), 4) AS avg_price FROM picks WHERE {_implied('odds')} > 0.5 GROUP BY market",
)
def q_favorite_accuracy_roi(spark, sf):
    from stakelens.operators.stats import roi_columns

    favourites = picks(spark, sf).withColumn("price", implied_prob("odds")).where("price > 0.5")
    return favourites.groupBy("market").agg(
        *roi_columns(),
        F.round(F.avg(F.col("win").cast("int")), 4).alias("accuracy"),
        F.round(F.avg("price"), 4).alias("avg_price"),
    )


_EDGE_EDGES = ((-1, -0.15), (-0.15, -0.08), (-0.08, 0.08), (0.08, 0.15), (0.15, 1))


@query(
    "edge_bins",
    with_tables("picks", extra=f"e AS (SELECT *, {_implied('odds')} AS market_prob, "
    "1e0 / (1e0 + power(10e0, -(score_volume - 80e0) / 400e0)) AS model_prob FROM picks), "
    f"b AS (SELECT *, {_case('(model_prob - market_prob)', _EDGE_EDGES)} AS edge_bin FROM e)")
    + "SELECT market, edge_bin, count(*) AS n, round(avg(CAST(win AS INT)) * 100, 1) AS actual_wr, "
    "round(avg(market_prob), 4) AS avg_market_prob, round(avg(model_prob), 4) AS avg_model_prob, "
    "round(avg(odds), 0) AS avg_odds FROM b GROUP BY 1, 2 HAVING count(*) >= 20",
)
def q_edge_bins(spark, sf):
    rows = picks(spark, sf).withColumns(
        {"market_prob": implied_prob("odds"), "model_prob": rating_prob(F.col("score_volume") - 80.0)}
    )
    edge = F.col("model_prob") - F.col("market_prob")
    return (
        rows.withColumn("edge_bin", c.half_open(edge, _EDGE_EDGES))
        .groupBy("market", "edge_bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(F.col("win").cast("int")) * 100, 1).alias("actual_wr"),
            F.round(F.avg("market_prob"), 4).alias("avg_market_prob"),
            F.round(F.avg("model_prob"), 4).alias("avg_model_prob"),
            F.round(F.avg("odds"), 0).alias("avg_odds"),
        )
        .where("n >= 20")
    )


@query(
    "price_calibration",
    with_tables("picks", extra=f"b AS (SELECT *, {_BAND} AS band, {_implied('odds')} AS prob FROM picks)")
    + "SELECT market, side, band, count(*) AS n, round(avg(prob), 4) AS avg_prob, "
    "round(avg(CAST(win AS INT)), 4) AS win_rate, round(avg(CAST(win AS INT)) - avg(prob), 4) AS gap, "
    "quantile_cont(CAST(odds AS DOUBLE), 0.5) AS median_odds, "
    "count(*) FILTER (WHERE win) = 0 AS zero_hits FROM b GROUP BY 1, 2, 3",
)
def q_price_calibration(spark, sf):
    by = ["market", "side", "band"]
    rows = picks(spark, sf).withColumns({"band": c.odds_band(), "prob": implied_prob("odds")})
    win = F.avg(F.col("win").cast("int"))
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("prob"), 4).alias("avg_prob"),
        F.round(win, 4).alias("win_rate"),
        F.round(win - F.avg("prob"), 4).alias("gap"),
        (F.count_if("win") == 0).alias("zero_hits"),
    )
    medians = exact_quantiles(rows, by, "odds", {"median_odds": 0.5}, bounded=True)
    return stats.join(medians, by)
