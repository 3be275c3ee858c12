"""Temporal splits, replication, multiplicity, clustering and execution-price checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakelens.functions.names import name_keys
from stakelens.functions.odds import implied_prob, unit_profit
from stakelens.operators import cuts as c
from stakelens.operators import validation as v
from stakelens.operators.matching import in_islands, islands
from stakelens.operators.splits import index_split, stable_flag, walk_forward_cells
from stakelens.operators.stats import gate_pass, moments, roi_columns, stats_from_moments, steady_round, sums_where
from stakelens.plans.adapters import PICK_TIES, gate_sql, games, listed_games, picks, player_lines, quotes, roi_sql, round_sql, with_tables
from stakelens.plans.registry import ORACLES, query
from stakelens.plans.scalars import _implied
from stakelens.plans.sweeps import strategy_bets
from stakelens.session import stored

_PICKS = with_tables("picks")
_TIES = ", ".join(PICK_TIES)


def _split_roi(cond: str, tag: str) -> str:
    return roi_sql(clv=None, where=cond, tag=f"_{tag}")


@query(
    "walk_forward",
    with_tables("picks", extra="p AS (SELECT * FROM picks WHERE odds < 0 AND confidence >= 60), "
    "s AS (SELECT market, quantile_cont(epoch(game_date), 0.6) AS split_epoch FROM p GROUP BY 1 "
    "HAVING count(*) >= 20)")
    + "SELECT p.market, CAST(any_value(split_epoch) AS DOUBLE) AS split_epoch, "
    f"{_split_roi('epoch(game_date) < split_epoch', 'train')}, "
    f"{_split_roi('epoch(game_date) >= split_epoch', 'test')} FROM p JOIN s ON p.market = s.market GROUP BY 1",
)
def q_walk_forward(spark, sf):
    cut = picks(spark, sf).where("odds < 0 AND confidence >= 60")
    daily = moments(cut, ["market", "game_date"], clv=None)
    return walk_forward_cells(daily, ["market"], "game_date", 0.6).where("n_train + n_test >= 20")


def _index_sql(by: str, parts: str) -> str:
    return (
        with_tables("picks", extra="r AS (SELECT *, row_number() OVER (PARTITION BY "
        f"{by} ORDER BY game_date, {_TIES}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS size FROM picks), "
        f"t AS (SELECT *, {parts} AS part FROM r)")
        + f"SELECT market, part, min(game_date) AS first_day, max(game_date) AS last_day, {roi_sql()} "
        "FROM t GROUP BY 1, 2"
    )


def _parted(df: DataFrame, names: list[str]) -> DataFrame:
    label = c.label_rules([(name, F.col("part_no") == i) for i, name in enumerate(names)])
    return (
        df.withColumn("part", label)
        .groupBy("market", "part")
        .agg(F.min("game_date").alias("first_day"), F.max("game_date").alias("last_day"), *roi_columns())
    )


@query("index_split", _index_sql("market", "CASE WHEN i < floor(size * 0.6e0) THEN 'train' ELSE 'test' END"))
def q_index_split(spark, sf):
    return _parted(index_split(picks(spark, sf), ["market"], "game_date", PICK_TIES, [0.6]), ["train", "test"])


@query(
    "three_way_split",
    _index_sql(
        "market",
        "CASE WHEN i < floor(size * 0.5e0) THEN 'fit' WHEN i < floor(size * 0.7e0) THEN 'calibrate' ELSE 'test' END",
    ),
)
def q_three_way_split(spark, sf):
    parts = index_split(picks(spark, sf), ["market"], "game_date", PICK_TIES, [0.5, 0.7])
    return _parted(parts, ["fit", "calibrate", "test"])


@query(
    "per_year_split",
    _index_sql("market, season", "CASE WHEN i < floor(size * 0.75e0) THEN 'train' ELSE 'test' END"),
)
def q_per_year_split(spark, sf):
    parts = index_split(picks(spark, sf), ["market", "season"], "game_date", PICK_TIES, [0.75])
    return _parted(parts, ["train", "test"])


# the catalogue's bets again, judged on two season ranges
_BETS_CTE = ORACLES["strategy_catalogue"].split(", s AS (SELECT strategy")[0]


@query(
    "season_split_stable",
    _BETS_CTE
    + f", t AS (SELECT strategy, {_split_roi('season <= 1998', 'train')}, {_split_roi('season >= 1999', 'test')} "
    "FROM pr GROUP BY 1) SELECT *, coalesce(roi_train > 0 AND roi_test > 0, false) AS stable FROM t",
)
def q_season_split_stable(spark, sf):
    return season_split(strategy_bets(games(spark, sf)), ["strategy"], 1998)


def season_split(bets: DataFrame, by: list[str], last_train: int) -> DataFrame:
    cells = moments(bets, [*by, "season"], clv=None)
    train = F.col("season") <= last_train
    merged = cells.groupBy(*by).agg(*sums_where(train, "_train"), *sums_where(~train, "_test"))
    stats = merged.select(
        *by,
        *stats_from_moments("_train", clv=False, out_suffix="_train"),
        *stats_from_moments("_test", clv=False, out_suffix="_test"),
    )
    return stats.withColumn("stable", stable_flag())


@query(
    "cross_source_validate",
    with_tables("picks", extra="t AS (SELECT market, side, line, "
    f"{_split_roi('source = ' + chr(39) + 'backtest' + chr(39), 'a')}, "
    f"{_split_roi('source = ' + chr(39) + 'production' + chr(39), 'b')} FROM picks GROUP BY 1, 2, 3)")
    + "SELECT *, coalesce(roi_a > 0 AND roi_b > 0, false) AS confirmed FROM t",
)
def q_cross_source_validate(spark, sf):
    return v.side_by_side(picks(spark, sf), ["market", "side", "line"], "source", "backtest", "production")


# best market quotes: the whole quote table, each side at its own price, against the picks placed for the same bet
_OWN_NAME = (
    "CASE WHEN player_id % 3 = 0 THEN 'José Núñez ' WHEN player_id % 3 = 1 THEN 'Zoë Müller ' ELSE 'Sam Hill ' END "
    "|| CAST(player_id AS STRING)"
)
# fixed values: the quote table's name of each picked market
_QUOTED_AS = {
    "hits": "batter_hits", "total_bases": "batter_total_bases", "rbis": "batter_rbis", "home_runs": "batter_home_runs",
    "pitcher_strikeouts": "pitcher_strikeouts", "totals": "totals", "spreads": "spreads__away", "h2h": "h2h__away",
}
_MARKET_SQL = "CASE market_key " + " ".join(f"WHEN '{q}' THEN '{m}'" for m, q in _QUOTED_AS.items()) + " END"
_BOOK = [
    f"{_MARKET_SQL} AS market", "quote_date AS game_date", "player_name",
    "TRY_CAST(replace(line, '+', '') AS DOUBLE) AS line",
    "TRY_CAST(best_over_odds AS INT) AS over_odds", "TRY_CAST(best_under_odds AS INT) AS under_odds",
]
_EXEC_CTES = (
    f"book AS (SELECT {', '.join(_BOOK)} FROM quotes), "
    "offers AS (SELECT market, 'over' AS side, game_date, player_name, line, over_odds AS book_odds FROM book "
    "UNION ALL SELECT market, 'under', game_date, player_name, line, under_odds FROM book), "
    "best AS (SELECT market, side, line, game_date, lower(strip_accents(trim(player_name))) AS name_norm, "
    "max(book_odds) AS best_odds, count(*) AS quotes FROM offers WHERE line IS NOT NULL GROUP BY 1, 2, 3, 4, 5), "
    f"own AS (SELECT *, lower(strip_accents(trim({_OWN_NAME}))) AS name_norm FROM picks "
    "WHERE source = 'production'), "
    "days AS (SELECT DISTINCT market, side, game_date FROM offers WHERE line IS NOT NULL AND book_odds IS NOT NULL), "
    "runs AS (SELECT market, side, game_date - CAST(row_number() OVER (PARTITION BY market, side ORDER BY game_date) AS INT) AS run, "
    "game_date FROM days), "
    "spans AS (SELECT market, side, min(game_date) AS d0, max(game_date) AS d1 FROM runs GROUP BY market, side, run), "
    "m AS (SELECT o.*, best_odds, quotes, d0 IS NOT NULL AS in_window FROM own o "
    "LEFT JOIN spans s ON o.market = s.market AND o.side = s.side AND o.game_date BETWEEN d0 AND d1 "
    "LEFT JOIN best b ON o.market = b.market AND o.side = b.side AND o.line = b.line "
    "AND o.game_date = b.game_date AND o.name_norm = b.name_norm)"
)


def _matched(spark, sf) -> DataFrame:
    """Production picks with the best quote for the identical bet (left join keeps the misses) and whether quotes cover their day."""
    own = picks(spark, sf).where("source = 'production'").withColumn("_own", F.expr(_OWN_NAME))
    # built in a generator, as the raw picks are: the typed columns are computed once and then read
    book = quotes(spark, sf).selectExpr(f"inline(array(struct({', '.join(_BOOK)})))")
    sides = F.array(
        F.struct(F.lit("over").alias("side"), F.col("over_odds").alias("book_odds")),
        F.struct(F.lit("under").alias("side"), F.col("under_odds").alias("book_odds")),
    )
    # both sides of a quote share its bet, so they fold in one row
    bet = ["market", "line", "game_date", "name_norm"]
    named = name_keys(book.where("line IS NOT NULL"), "player_name")
    best = named.groupBy(*bet).agg(
        F.max("over_odds").alias("_over"), F.max("under_odds").alias("_under"), F.count(F.lit(1)).alias("_quotes")
    )
    offered = book.where("line IS NOT NULL").select("market", "game_date", F.inline(sides)).where("book_odds IS NOT NULL")
    covered = in_islands(name_keys(own, "_own"), islands(offered, ["market", "side"], "game_date"), ["market", "side"], "game_date")
    side = F.col("side")
    met = covered.join(best, bet, "left").withColumns(
        {
            "best_odds": F.when(side == "over", F.col("_over")).when(side == "under", F.col("_under")),
            "quotes": F.when(side.isin("over", "under"), F.col("_quotes")),
        }
    )
    return met.drop("_over", "_under", "_quotes")


@query(
    "match_rate",
    with_tables("picks", "quotes", extra=_EXEC_CTES)
    + "SELECT market, count(*) AS candidates, count(*) FILTER (WHERE in_window) AS in_window, "
    "count(quotes) AS matched, count(*) FILTER (WHERE quotes = 1) AS matched_once, count(best_odds) AS priced, "
    "count(*) FILTER (WHERE in_window AND quotes IS NULL) AS no_quote, "
    "count(*) FILTER (WHERE NOT coalesce(in_window, false)) AS outside_window, "
    "round(100e0 * count(quotes) / count(*), 1) AS match_pct FROM m GROUP BY market",
)
def q_match_rate(spark, sf):
    inside = F.coalesce("in_window", F.lit(False))
    return (
        _matched(spark, sf)
        .groupBy("market")
        .agg(
            F.count(F.lit(1)).alias("candidates"),
            F.count_if(inside).alias("in_window"),
            F.count("quotes").alias("matched"),
            F.count_if(F.col("quotes") == 1).alias("matched_once"),
            F.count("best_odds").alias("priced"),
            F.count_if(inside & F.col("quotes").isNull()).alias("no_quote"),
            F.count_if(~inside).alias("outside_window"),
            F.round(F.lit(100.0) * F.count("quotes") / F.count(F.lit(1)), 1).alias("match_pct"),
        )
    )


def _profit_sql(o: str) -> str:
    return f"(CASE WHEN NOT win THEN -1e0 WHEN {o} > 0 THEN {o} / 100e0 ELSE 100e0 / abs({o}) END)"


@query(
    "execution_gap",
    with_tables("picks", "quotes", extra=_EXEC_CTES
    + f", x AS (SELECT *, {_profit_sql('best_odds')} AS best_profit, {_implied('odds')} AS own_prob, "
    f"{_implied('best_odds')} AS best_prob FROM m WHERE best_odds IS NOT NULL)")
    + "SELECT market, count(*) AS n, round(avg(odds), 1) AS avg_odds, round(avg(best_odds), 1) AS avg_best, "
    "round(avg(own_prob), 4) AS own_prob, round(avg(best_prob), 4) AS best_prob, "
    f"{round_sql('(avg(profit) * 100)')} AS roi_own, {round_sql('(avg(best_profit) * 100)')} AS roi_best, "
    "count(*) FILTER (WHERE own_prob > best_prob) AS worse, count(*) FILTER (WHERE odds = best_odds) AS same, "
    "count(*) FILTER (WHERE own_prob < best_prob) AS better FROM x GROUP BY market",
)
def q_execution_gap(spark, sf):
    return (
        _priced(spark, sf)
        .groupBy("market")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg("odds"), 1).alias("avg_odds"),
            F.round(F.avg("best_odds"), 1).alias("avg_best"),
            F.round(F.avg("own_prob"), 4).alias("own_prob"),
            F.round(F.avg("best_prob"), 4).alias("best_prob"),
            steady_round(F.avg("profit") * 100, 2).alias("roi_own"),
            steady_round(F.avg("best_profit") * 100, 2).alias("roi_best"),
            F.count_if(F.col("own_prob") > F.col("best_prob")).alias("worse"),
            F.count_if(F.col("odds") == F.col("best_odds")).alias("same"),
            F.count_if(F.col("own_prob") < F.col("best_prob")).alias("better"),
        )
    )


def _priced(spark, sf) -> DataFrame:
    return (
        _matched(spark, sf)
        .where(F.col("best_odds").isNotNull())
        .withColumns(
            {
                "best_profit": unit_profit("win", "best_odds"),
                "own_prob": implied_prob("odds"),
                "best_prob": implied_prob("best_odds"),
            }
        )
    )


_TIER_SQL = "CASE WHEN confidence <= 50 THEN '<=50' WHEN confidence <= 60 THEN '50-60' " \
    "WHEN confidence <= 70 THEN '60-70' ELSE '70+' END"  # fmt: skip


@query(
    "selection_gap",
    with_tables("picks", "quotes", extra=_EXEC_CTES
    + f", x AS (SELECT *, {_TIER_SQL} AS tier, {_profit_sql('best_odds')} AS best_profit, "
    f"{_implied('odds')} - {_implied('best_odds')} AS gap FROM m WHERE best_odds IS NOT NULL), "
    f"t AS (SELECT market, tier, count(*) AS n, {round_sql('(avg(best_profit) * 100)')} AS roi_best, "
    "round(avg(gap), 4) AS avg_gap FROM x GROUP BY 1, 2), "
    "k AS (SELECT market, round(corr(confidence, CAST(win AS INT)), 4) AS corr_win, "
    "round(corr(confidence, best_profit), 4) AS corr_profit, round(corr(confidence, gap), 4) AS corr_gap "
    "FROM x GROUP BY 1)")
    + "SELECT t.*, corr_win, corr_profit, corr_gap FROM t JOIN k ON t.market = k.market",
)
def q_selection_gap(spark, sf):
    conf = F.col("confidence")
    rows = _priced(spark, sf).withColumns(
        {
            "tier": c.label_rules([("<=50", conf <= 50), ("50-60", conf <= 60), ("60-70", conf <= 70)], "70+"),
            "gap": F.col("own_prob") - F.col("best_prob"),
        }
    )
    rows = stored(rows.select("market", "tier", "confidence", "win", "best_profit", "gap"), "priced")
    tiers = rows.groupBy("market", "tier").agg(
        F.count(F.lit(1)).alias("n"),
        steady_round(F.avg("best_profit") * 100, 2).alias("roi_best"),
        F.round(F.avg("gap"), 4).alias("avg_gap"),
    )
    links = rows.groupBy("market").agg(
        F.round(F.corr("confidence", F.col("win").cast("int")), 4).alias("corr_win"),
        F.round(F.corr("confidence", "best_profit"), 4).alias("corr_profit"),
        F.round(F.corr("confidence", "gap"), 4).alias("corr_gap"),
    )
    return tiers.join(links, "market")


@query(
    "row_multiplicity",
    with_tables("picks", extra="u AS (SELECT market, event_id, count(*) AS k FROM picks GROUP BY 1, 2)")
    + "SELECT market, CAST(sum(k) AS BIGINT) AS n_rows, count(*) AS units, round(avg(k), 4) AS inflation, "
    "max(k) AS max_per_unit FROM u GROUP BY 1",
)
def q_row_multiplicity(spark, sf):
    return v.multiplicity(picks(spark, sf), ["market"], "event_id")


@query(
    "cluster_robust_ci",
    with_tables("picks", extra="b AS (SELECT *, avg(profit) OVER (PARTITION BY market) AS mu FROM picks), "
    "g AS (SELECT market, event_id, sum(profit - mu) AS u, count(*) AS k FROM b GROUP BY 1, 2), "
    "r AS (SELECT market, count(*) AS clusters, sqrt(sum(u * u)) / sum(k) AS se_r FROM g GROUP BY 1), "
    "s AS (SELECT market, count(*) AS n, avg(profit) AS mu, stddev_samp(profit) / sqrt(count(*)) AS se_n "
    "FROM picks GROUP BY 1)")
    + f"SELECT s.market, n, clusters, {round_sql('(mu * 100)')} AS roi, {round_sql('((mu - 1.96e0 * se_n) * 100)')} AS naive_lo, "
    f"{round_sql('((mu + 1.96e0 * se_n) * 100)')} AS naive_hi, {round_sql('((mu - 1.96e0 * se_r) * 100)')} AS robust_lo, "
    f"{round_sql('((mu + 1.96e0 * se_r) * 100)')} AS robust_hi, round(se_r / se_n, 4) AS se_ratio, "
    "round(n * power(se_n / se_r, 2), 0) AS effective_n FROM s JOIN r ON s.market = r.market",
)
def q_cluster_robust_ci(spark, sf):
    return v.cluster_robust(picks(spark, sf), ["market"], "event_id")


@query(
    "reconcile_two_ways",
    with_tables("team_runs", extra="a AS (SELECT game_pk, sum(team_runs) AS x FROM team_runs GROUP BY 1), "
    "b AS (SELECT game_pk, year(game_date) AS season, sum(runs_scored) FILTER (WHERE position_type <> 'Pitcher') "
    "AS y, sum(runs_scored) AS z FROM boxscore GROUP BY 1, 2)")
    + "SELECT CAST(season AS INT) AS season, count(*) AS games, count(*) FILTER (WHERE x <> y) AS mismatched, "
    "count(*) FILTER (WHERE x <> z) AS pitcher_runs_counted, count(*) FILTER (WHERE x IS NULL) AS unscored "
    "FROM b LEFT JOIN a ON a.game_pk = b.game_pk GROUP BY 1",
)
def q_reconcile_two_ways(spark, sf):
    """Runs of each game by way of its teams' batters and by all lines that are no pitcher's.

    A team whose runs are all unknown adds nothing, so the sum over teams is that over their batters: lines fold by game once, before the
    games are met.
    """
    from stakelens.operators.gamelog import BATTERS

    runs, kind = F.col("runs_scored"), F.col("position_type")
    folded = player_lines(spark, sf).groupBy("game_pk").agg(
        F.sum(F.when(kind.isin(*BATTERS), runs)).alias("x"), F.sum(F.when(kind != "Pitcher", runs)).alias("y"), F.sum(runs).alias("z")
    )
    days = listed_games(games(spark, sf).select("game_pk", F.year("game_date").alias("season")))
    direct = (
        days.join(folded, "game_pk")
        .groupBy("game_pk", "season")
        .agg(F.max(F.col("x") * F.col("listed")).alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z"))
    )
    return direct.groupBy("season").agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(F.col("x") != F.col("y")).alias("mismatched"),
        F.count_if(F.col("x") != F.col("z")).alias("pitcher_runs_counted"),
        F.count_if(F.col("x").isNull()).alias("unscored"),
    )


EDGE_THRESHOLDS = (0.0, 0.02, 0.03, 0.05, 0.08)
_EDGE_SQL = (
    f"e AS (SELECT *, (score_form - 2e0) * 0.0225e0 AS edge FROM picks), "
    f"th AS (SELECT unnest({list(EDGE_THRESHOLDS)})::DOUBLE AS threshold), "
    f"s AS (SELECT market, threshold, {roi_sql(clv=None)} FROM e, th WHERE odds < 0 AND edge > threshold "
    "GROUP BY 1, 2), "
    f"j AS (SELECT *, {gate_sql()} AS passed FROM s)"
)


def edge_sweep(df: DataFrame, by: list[str], thresholds=EDGE_THRESHOLDS) -> DataFrame:
    """Gate of every edge threshold on minus-money rows, from one pass."""
    bets = df.where(F.col("odds") < 0)
    cuts = [(str(t), F.col("edge") > t) for t in thresholds]
    stats = c.cut_stats(bets, by, cuts, name="threshold", clv=None)
    stats = stats.withColumn("threshold", F.col("threshold").cast("double"))
    return stats.withColumn("passed", gate_pass())


def _edges(spark, sf) -> DataFrame:
    return picks(spark, sf).withColumn("edge", (F.col("score_form") - 2.0) * 0.0225)


@query("edge_threshold_sweep", with_tables("picks", extra=_EDGE_SQL) + "SELECT * FROM j")
def q_edge_threshold_sweep(spark, sf):
    return edge_sweep(_edges(spark, sf), ["market"])


@query(
    "best_of_k_cut",
    with_tables("picks", extra=_EDGE_SQL
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY passed DESC, "
    "CASE WHEN passed THEN roi END DESC, threshold) AS k FROM j)")
    + "SELECT market, threshold, n, wr, roi, roi_lo, roi_hi, passed, "
    "(SELECT passed FROM j WHERE j.market = r.market AND threshold = 0) AS prespecified_passed FROM r WHERE k = 1",
)
def q_best_of_k_cut(spark, sf):
    swept = edge_sweep(_edges(spark, sf), ["market"])
    fixed = F.max(F.when(F.col("threshold") == 0, F.col("passed")))
    prespecified = swept.groupBy("market").agg(fixed.alias("prespecified_passed"))
    return v.best_passing(swept, ["market"], "threshold").join(prespecified, "market")
