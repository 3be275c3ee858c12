"""Point-in-time features and the strategies built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakelens.functions.odds import unit_profit
from stakelens.operators import cuts as c
from stakelens.operators import form as f
from stakelens.operators import gamelog as g
from stakelens.operators.asof import asof_strict
from stakelens.operators.grading import result_wins
from stakelens.operators.ordered import exact_quantiles
from stakelens.operators.ratings import elo_ratings
from stakelens.operators.splits import index_split
from stakelens.operators.stats import gate_pass, moments, roi_stats, stats_from_moments, sums_where
from stakelens.plans import adapters as a
from stakelens.plans.adapters import PICK_TIES, gate_sql, roi_sql, with_tables
from stakelens.plans.grading import _GAME, _PARKS, _PROPS, _TYPED, _profit, game_log, graded_props, parks, typed_quotes, venues
from stakelens.plans.registry import query
from stakelens.plans.sweeps import explode_bets, season_rollup
from stakelens.plans.validation import _split_roi
from stakelens.session import stored

_FORM = (
    "tr AS (SELECT game_pk, game_date, home_team AS team, true AS at_home, CAST(home_score > away_score AS INT) AS won "
    "FROM games UNION ALL SELECT game_pk, game_date, away_team, false, CAST(home_score <= away_score AS INT) FROM games), "
    "fr AS (SELECT *, CAST(sum(won) OVER w AS BIGINT) AS wins, count(won) OVER w AS played FROM tr "
    "WINDOW w AS (PARTITION BY team ORDER BY game_date, game_pk ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), "
    "form AS (SELECT h.game_pk, h.wins AS l10_home_wins, h.played AS l10_home_games, w.wins AS l10_away_wins, "
    "w.played AS l10_away_games FROM fr h JOIN fr w ON h.game_pk = w.game_pk AND h.at_home AND NOT w.at_home)"
)


@query("last_n_form", with_tables("games", extra=_FORM) + "SELECT * FROM form")
def q_last_n_form(spark, sf):
    return f.last_n_form(a.games(spark, sf))


_OUTS = (
    "(CAST(split_part(innings_pitched, '.', 1) AS INT) * 3 + CASE split_part(innings_pitched, '.', 2) "
    "WHEN '1' THEN 1 WHEN '2' THEN 2 ELSE 0 END)"
)


def _ra9(w: int) -> str:
    frame = f"(PARTITION BY player_id ORDER BY game_date, game_pk, slot, entry_key, entry_ref ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return (
        f"CASE WHEN count(outs) OVER {frame} = {w} AND sum(outs) OVER {frame} > 0 THEN "
        f"round(sum(earned) OVER {frame} * 27e0 / sum(outs) OVER {frame}, 3) END AS ra9_l{w}"
    )


_RATES = (
    f"st AS (SELECT player_id, game_pk, game_date, team_id, slot, entry_key, entry_ref, {_OUTS} AS outs, "
    "CAST(pitcher_earned_runs AS INT) AS earned FROM boxscore WHERE position_type = 'Pitcher' AND is_starter "
    "AND innings_pitched IS NOT NULL AND pitcher_earned_runs IS NOT NULL), "
    f"rates AS (SELECT *, {_ra9(3)}, {_ra9(5)}, {_ra9(8)} FROM st)"
)


@query(
    "rolling_rate_prior",
    with_tables("boxscore", extra=_RATES)
    + "SELECT player_id, game_pk, game_date, slot, entry_key, entry_ref, ra9_l3, ra9_l5, ra9_l8 FROM rates",
)
def q_rolling_rate_prior(spark, sf):
    rates = f.earned_run_rates(a.boxscore(spark, sf))
    return rates.select(
        "player_id", "game_pk", "game_date", "slot", "entry_key", "entry_ref", "ra9_l3", "ra9_l5", "ra9_l8"
    )


@query(
    "pitcher_matchup",
    with_tables("team_runs", extra=f"{_RATES}, op AS (SELECT game_pk, min(player_id) FILTER (WHERE is_home) AS hs, "
    "min(player_id) FILTER (WHERE NOT is_home) AS aw FROM boxscore WHERE position_type = 'Pitcher' AND is_starter "
    "GROUP BY 1), fs AS (SELECT * FROM rates QUALIFY row_number() OVER (PARTITION BY game_pk, player_id "
    "ORDER BY slot, entry_key, entry_ref) = 1)")
    + "SELECT o.game_pk, h.game_date, hs AS home_starter_id, aw AS away_starter_id, h.team_id AS home_team_id, "
    "w.team_id AS away_team_id, hr.team_runs AS home_score, ar.team_runs AS away_score, "
    "CAST(hr.team_runs > ar.team_runs AS INT) AS home_win, "
    + ", ".join(f"{s}.ra9_l{k} AS {n}_ra9_l{k}" for s, n in (("h", "home"), ("w", "away")) for k in (3, 5, 8))
    + " FROM op o JOIN fs h ON h.game_pk = o.game_pk AND h.player_id = hs JOIN fs w ON w.game_pk = o.game_pk "
    "AND w.player_id = aw JOIN team_runs hr ON hr.game_pk = o.game_pk AND hr.team_id = h.team_id "
    "JOIN team_runs ar ON ar.game_pk = o.game_pk AND ar.team_id = w.team_id",
)
def q_pitcher_matchup(spark, sf):
    box = a.boxscore(spark, sf)
    return f.pitcher_matchups(f.opposing_starters(box), f.earned_run_rates(box), g.team_runs(box))


_FATIGUE = (
    f"daily AS (SELECT team_id, game_date, CAST(sum({_OUTS}) AS BIGINT) AS outs FROM boxscore "
    "WHERE position_type = 'Pitcher' AND NOT is_starter AND innings_pitched IS NOT NULL GROUP BY 1, 2), "
    "fat AS (SELECT team_id, game_date, outs, CAST(coalesce(sum(outs) OVER (PARTITION BY team_id ORDER BY game_date "
    "RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING), 0) AS BIGINT) AS fatigue FROM daily)"
)


@query("trailing_days_sum", with_tables("boxscore", extra=_FATIGUE) + "SELECT * FROM fat")
def q_trailing_days_sum(spark, sf):
    return f.relief_workload(a.boxscore(spark, sf))


@query(
    "left_default",
    with_tables("games", "boxscore", extra=_FATIGUE)
    + "SELECT g.game_pk, coalesce(h.fatigue, 0) AS home_fatigue, coalesce(w.fatigue, 0) AS away_fatigue FROM games g "
    "LEFT JOIN fat h ON h.team_id = home_team AND h.game_date = g.game_date "
    "LEFT JOIN fat w ON w.team_id = away_team AND w.game_date = g.game_date",
)
def q_left_default(spark, sf):
    games = a.games(spark, sf).select("game_pk", "game_date", "home_team", "away_team")
    fatigue = f.with_fatigue(games, f.relief_workload(a.boxscore(spark, sf)), "home_team", "away_team")
    return fatigue.select("game_pk", "home_fatigue", "away_fatigue")


def _either(first: tuple[str, str, str], second: tuple[str, str, str]) -> tuple[str, str, str]:
    """(eligible, won, price) of a bet placed when one of two is; the first decides where both are."""
    (e1, w1, p1), (e2, w2, p2) = first, second
    won = f"({e1} AND {w1}) OR ({e2} AND {w2})"
    return f"({e1}) OR ({e2})", won, f"CASE WHEN {e1} THEN {p1} ELSE {p2} END"


def _streak_rules() -> dict[str, tuple[str, str, str]]:
    """Each side's form and price, betting against a hot underdog or with a cold favourite."""
    side = {"home": ("away", "hw", "NOT hw"), "away": ("home", "NOT hw", "hw")}

    def rule(who: str, form: str, price: str, backs_itself: bool) -> tuple[str, str, str]:
        other, wins, loses = side[who]
        backed, won = (who, wins) if backs_itself else (other, loses)
        return f"l10_{who}_wins {form} AND {who}_close_ml {price} 0", won, f"{backed}_close_ml"

    hot = {who: rule(who, ">= 7", ">", False) for who in side}
    cold = {who: rule(who, "<= 3", "<", True) for who in side}
    out = {f"{who} hot underdog, bet {side[who][0]}": r for who, r in hot.items()}
    out["combined fade hot underdog"] = _either(hot["home"], hot["away"])
    out |= {f"{who} cold favorite, bet {who}": r for who, r in cold.items()}
    out["combined cold favorite hold"] = _either(cold["home"], cold["away"])
    return out


_STREAKS = _streak_rules()
_STREAK_SQL = " UNION ALL ".join(
    f"SELECT '{label}' AS strategy, season, coalesce({won}, false) AS win, {price} AS odds FROM ff "
    f"WHERE ({elig}) AND ({price}) IS NOT NULL"
    for label, (elig, won, price) in _STREAKS.items()
)


@query(
    "streak_strategies",
    with_tables("games", extra=f"{_FORM}, ff AS (SELECT g.*, home_score > away_score AS hw, l10_home_wins, l10_away_wins "
    "FROM games g JOIN form ON form.game_pk = g.game_pk WHERE l10_home_games = 10 AND l10_away_games = 10), "
    f"bets AS ({_STREAK_SQL}), pr AS (SELECT *, {_profit('odds')} AS profit FROM bets), "
    f"t AS (SELECT strategy, {roi_sql(clv=None)}, {_split_roi('season <= 1998', 'train')}, "
    f"{_split_roi('season >= 1999', 'test')} FROM pr GROUP BY 1)")
    + f"SELECT *, {gate_sql('strict')} AS passed, coalesce(roi_train > 0 AND roi_test > 0, false) AS stable FROM t",
)
def q_streak_strategies(spark, sf):
    games = a.games(spark, sf)
    full = games.join(f.last_n_form(games), "game_pk").where("l10_home_games = 10 AND l10_away_games = 10")
    hot_home = (F.col("l10_home_wins") >= 7) & (F.col("home_close_ml") > 0)
    hot_away = (F.col("l10_away_wins") >= 7) & (F.col("away_close_ml") > 0)
    cold_home = (F.col("l10_home_wins") <= 3) & (F.col("home_close_ml") < 0)
    cold_away = (F.col("l10_away_wins") <= 3) & (F.col("away_close_ml") < 0)
    home_won = F.col("home_score") > F.col("away_score")
    home_ml, away_ml = F.col("home_close_ml"), F.col("away_close_ml")
    hot = [(hot_home, ~home_won, away_ml), (hot_away, home_won, home_ml)]
    cold = [(cold_home, home_won, home_ml), (cold_away, ~home_won, away_ml)]

    def either(parts):
        (e1, w1, p1), (e2, w2, p2) = parts
        return e1 | e2, (e1 & w1) | (e2 & w2), F.when(e1, p1).otherwise(p2)

    rules = [*hot, either(hot), *cold, either(cold)]
    catalogue = [(label, *rule) for label, rule in zip(_STREAKS, rules)]
    cells = moments(explode_bets(full, catalogue, ["season"]), ["strategy", "season"], clv=None)
    train = F.col("season") <= 1998
    merged = cells.groupBy("strategy").agg(
        *sums_where(F.lit(True), ""), *sums_where(train, "_train"), *sums_where(~train, "_test")
    )
    stats = merged.select(
        "strategy",
        *stats_from_moments(clv=False),
        *stats_from_moments("_train", clv=False, out_suffix="_train"),
        *stats_from_moments("_test", clv=False, out_suffix="_test"),
    )
    stable = F.coalesce((F.col("roi_train") > 0) & (F.col("roi_test") > 0), F.lit(False))
    return stats.withColumns({"passed": gate_pass("strict"), "stable": stable})


@query(
    "fatigue_strategy",
    with_tables("quotes", "event_games", "boxscore", "lineups", "team_runs", extra=f"{_TYPED}, {_GAME}, {_FATIGUE}, "
    "gm AS (SELECT l.game_pk, home_runs + away_runs AS total, coalesce(h.fatigue, 0) + coalesce(w.fatigue, 0) AS combined "
    "FROM log l LEFT JOIN fat h ON h.team_id = home_team_id AND h.game_date = l.game_date "
    "LEFT JOIN fat w ON w.team_id = away_team_id AND w.game_date = l.game_date), "
    "q AS (SELECT tq.season, line, best_over_odds AS odds, total, combined FROM tq JOIN gm ON tq.game_pk = gm.game_pk "
    "WHERE market_key = 'totals' AND line IS NOT NULL AND best_over_odds IS NOT NULL), "
    "th AS (SELECT quantile_cont(CAST(combined AS DOUBLE), 0.75) AS t FROM q), "
    f"b AS (SELECT *, total > line AS win FROM q, th WHERE combined >= t), p AS (SELECT *, {_profit('odds')} AS profit FROM b), "
    f"s AS (SELECT CAST(season AS VARCHAR) AS season, {roi_sql(clv=None)} FROM p GROUP BY 1 "
    f"UNION ALL SELECT 'ALL', {roi_sql(clv=None)} FROM p)")
    + f"SELECT *, {gate_sql('strict')} AS passed FROM s",
)
def q_fatigue_strategy(spark, sf):
    workload = f.relief_workload(a.boxscore(spark, sf))
    games = f.with_fatigue(game_log(spark, sf), workload, "home_team_id", "away_team_id").select(
        "game_pk",
        (F.col("home_runs") + F.col("away_runs")).alias("total"),
        (F.col("home_fatigue") + F.col("away_fatigue")).alias("combined"),
    )
    quoted = (
        typed_quotes(spark, sf)
        .where("market_key = 'totals' AND line IS NOT NULL AND best_over_odds IS NOT NULL")
        .join(games, "game_pk")
        .withColumn("pool", F.lit("all"))
    )
    edges = exact_quantiles(quoted, ["pool"], "combined", {"cutoff": 0.75}, bounded=True)
    tired = quoted.join(F.broadcast(edges), "pool").where("combined >= cutoff")
    bets = tired.select(
        "pool", "season", (F.col("total") > F.col("line")).alias("win"), F.col("best_over_odds").alias("odds")
    ).withColumn("profit", unit_profit("win", "odds"))
    return season_rollup(bets, ["pool"], "season", clv=None).drop("pool").withColumn("passed", gate_pass("strict"))


@query(
    "quartile_strategy",
    with_tables("quotes", "event_games", "boxscore", "games", extra=f"{_TYPED}, {_PROPS}, {_PARKS}, "
    "f AS (SELECT p.*, hr_factor AS factor FROM props p JOIN venues v ON v.game_pk = p.game_pk JOIN parks k "
    "ON k.park_name = v.venue_name WHERE market_key = 'batter_home_runs' AND stat IS NOT NULL), "
    "e AS (SELECT quantile_cont(factor, 0.25) AS q1, quantile_cont(factor, 0.75) AS q3 FROM f), "
    "b AS (SELECT 'over at high factor' AS rule, season, coalesce(stat > line, false) AS win, best_over_odds AS odds "
    "FROM f, e WHERE factor >= q3 UNION ALL SELECT 'under at low factor', season, coalesce(stat < line, false), "
    "best_under_odds FROM f, e WHERE factor <= q1), "
    f"p AS (SELECT *, {_profit('odds')} AS profit FROM b WHERE odds IS NOT NULL), "
    f"s AS (SELECT rule, CAST(season AS VARCHAR) AS season, {roi_sql(clv=None)} FROM p GROUP BY 1, 2 "
    f"UNION ALL SELECT rule, 'ALL', {roi_sql(clv=None)} FROM p GROUP BY 1)")
    + f"SELECT *, {gate_sql('strict')} AS passed FROM s",
)
def q_quartile_strategy(spark, sf):
    v, p = venues(spark, sf).select("game_pk", "venue_name"), parks(spark, sf)
    factors = v.join(p, v.venue_name == p.park_name).select("game_pk", F.col("hr_factor").alias("factor"))
    rows = (
        graded_props(spark, sf)
        .where("market_key = 'batter_home_runs'")
        .join(factors, "game_pk")
        .withColumn("pool", F.lit("all"))
    )
    edges = exact_quantiles(rows, ["pool"], "factor", {"q1": 0.25, "q3": 0.75}, bounded=True)
    placed = rows.join(F.broadcast(edges), "pool")
    over = result_wins(F.col("stat"), F.col("line"), F.lit("over"))
    under = result_wins(F.col("stat"), F.col("line"), F.lit("under"))
    catalogue = [
        ("over at high factor", F.col("factor") >= F.col("q3"), over, F.col("best_over_odds")),
        ("under at low factor", F.col("factor") <= F.col("q1"), under, F.col("best_under_odds")),
    ]
    bets = explode_bets(placed, catalogue, ["season"]).withColumnRenamed("strategy", "rule")
    return season_rollup(bets, ["rule"], "season", clv=None).withColumn("passed", gate_pass("strict"))


_WIND = ((0, 5), (5, 10), (10, 15), (15, 100))
_TEMP = ((0, 50), (50, 65), (65, 80), (80, 120))


def _bin_sql(col: str, edges) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {lo} AND {col} < {hi} THEN '[{lo},{hi})'" for lo, hi in edges) + " END"


@query(
    "weather_bins",
    with_tables("games", "boxscore", extra="t AS (SELECT game_pk, sum(runs_scored) AS total_runs, "
    "sum(home_runs) AS total_hr FROM boxscore WHERE position_type <> 'Pitcher' GROUP BY 1 "
    "HAVING sum(runs_scored) IS NOT NULL), "
    "w AS (SELECT wind_mph, temperature_f, total_runs, total_hr FROM games g JOIN t ON t.game_pk = g.game_pk "
    "WHERE NOT is_dome), "
    f"b AS (SELECT 'wind' AS kind, {_bin_sql('wind_mph', _WIND)} AS bin, * FROM w "
    f"UNION ALL SELECT 'temperature', {_bin_sql('temperature_f', _TEMP)}, * FROM w)")
    + "SELECT kind, bin, count(*) AS n, round(avg(total_runs), 2) AS avg_total, round(avg(total_hr), 2) AS avg_hr "
    "FROM b WHERE bin IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20",
)
def q_weather_bins(spark, sf):
    rows = weather_totals(spark, sf)
    bins = F.array(
        F.struct(F.lit("wind").alias("kind"), c.half_open(F.col("wind_mph"), _WIND).alias("bin")),
        F.struct(F.lit("temperature").alias("kind"), c.half_open(F.col("temperature_f"), _TEMP).alias("bin")),
    )
    cells = rows.groupBy("wind_mph", "temperature_f").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_runs").alias("runs"), F.sum("total_hr").alias("hr")
    )
    merged = (
        cells.select(F.inline(bins), "n", "runs", "hr")
        .where(F.col("bin").isNotNull())
        .groupBy("kind", "bin")
        .agg(F.sum("n").alias("n"), F.sum("runs").alias("runs"), F.sum("hr").alias("hr"))
    )
    return merged.where("n >= 20").select(
        "kind", "bin", "n",
        F.round(F.col("runs") / F.col("n"), 2).alias("avg_total"), F.round(F.col("hr") / F.col("n"), 2).alias("avg_hr"),
    )


def weather_totals(spark, sf) -> DataFrame:
    """Open-air games with their weather and batting totals."""
    totals = (
        g.batters(a.player_lines(spark, sf))
        .groupBy("game_pk")
        .agg(F.sum("runs_scored").alias("total_runs"), F.sum("home_runs").alias("total_hr"))
        .where("total_runs IS NOT NULL")
    )
    weather = a.games(spark, sf).select("game_pk", "wind_mph", "temperature_f", "is_dome")
    open_air = a.listed_games(weather).where(~F.col("is_dome")).drop("is_dome")
    joined = open_air.join(totals, "game_pk")
    return joined.withColumns({c: F.col(c) * F.col("listed") for c in ("total_runs", "total_hr")}).drop("listed")


# month-end player snapshots derived from the picks
_SNAPS = (
    "snaps AS (SELECT player_id, last_day(game_date) AS snapshot_date, round(avg(score_discount), 6) AS ba, "
    "round(avg(score_form) / 40e0, 6) AS est_ba FROM picks GROUP BY 1, 2)"
)


def player_snapshots(spark, sf) -> DataFrame:
    return (
        a.picks(spark, sf)
        .groupBy("player_id", F.last_day("game_date").alias("snapshot_date"))
        .agg(F.round(F.avg("score_discount"), 6).alias("ba"), F.round(F.avg("score_form") / 40.0, 6).alias("est_ba"))
    )


@query(
    "gap_quartile_strategy",
    with_tables("picks", extra=f"{_SNAPS}, m AS (SELECT p.*, ba - est_ba AS gap FROM picks p ASOF JOIN snaps s "
    "ON p.player_id = s.player_id AND p.game_date > s.snapshot_date), "
    f"r AS (SELECT *, row_number() OVER (ORDER BY game_date, {', '.join(PICK_TIES)}) - 1 AS i, "
    "count(*) OVER () AS size FROM m), "
    "t AS (SELECT *, CASE WHEN i < floor(size * 0.6e0) THEN 'train' ELSE 'test' END AS part FROM r), "
    "e AS (SELECT quantile_cont(gap, 0.25) AS q1, quantile_cont(gap, 0.75) AS q3 FROM t WHERE part = 'train'), "
    "b AS (SELECT t.* FROM t, e WHERE (gap >= q3 AND side = 'under') OR (gap <= q1 AND side = 'over')), "
    f"s AS (SELECT part, {roi_sql()} FROM b GROUP BY 1)")
    + f"SELECT *, {gate_sql('strict')} AS passed FROM s",
)
def q_gap_quartile_strategy(spark, sf):
    """Under on players running above expectation, over on those below; thresholds from the training part."""
    snaps = player_snapshots(spark, sf).withColumn("snap_no", F.lit(0))
    taken = a.picks(spark, sf).select("game_date", *PICK_TIES, "win", "profit", "clv")
    matched = asof_strict(
        taken, snaps, "player_id", "game_date", "snapshot_date", ["ba", "est_ba"], tie="snap_no", block="year", how="inner"
    )
    # the as-of join runs once: split, quantile passes and report each read what they take of its rows
    gaps = matched.select(*taken.columns, (F.col("ba") - F.col("est_ba")).alias("gap"))
    rows = stored(gaps, "gaps").withColumn("pool", F.lit("all"))
    parts = index_split(rows, ["pool"], "game_date", PICK_TIES, [0.6])
    edges = exact_quantiles(parts.where("part_no = 0"), ["pool"], "gap", {"q1": 0.25, "q3": 0.75})
    hot = (F.col("gap") >= F.col("q3")) & (F.col("side") == "under")
    cold = (F.col("gap") <= F.col("q1")) & (F.col("side") == "over")
    bets = parts.join(F.broadcast(edges), "pool").where(hot | cold)
    part = F.when(F.col("part_no") == 0, "train").otherwise("test")
    return roi_stats(bets.withColumn("part", part), ["part"]).withColumn("passed", gate_pass("strict"))


def _elo_sql(games: str = "games") -> str:
    """Ratings by recursion: step i plays game i of every league; six ratings per league in a list."""
    h, w = "(home_team - g.league * 6 + 1)", "(away_team - g.league * 6 + 1)"
    base = f"(CASE WHEN g.season <> s.season THEN [{', '.join(f'1500e0 + (s.r[{k}] - 1500e0) * 2e0 / 3e0' for k in range(1, 7))}] ELSE s.r END)"
    step = (
        f"(20e0 * (CAST(home_score > away_score AS INT) - 1e0 / (1e0 + power(10e0, (b[{w}] - b[{h}] - 24e0) / 400e0))))"
    )
    moved = ", ".join(f"b[{k}] + CASE WHEN {h} = {k} THEN {step} WHEN {w} = {k} THEN -{step} ELSE 0e0 END" for k in range(1, 7))
    return (
        f"ng AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY game_date, game_pk) AS i FROM {games}), "
        "st AS (SELECT league, CAST(0 AS BIGINT) AS i, season, CAST([1500, 1500, 1500, 1500, 1500, 1500] AS DOUBLE[]) AS r, "
        "CAST(NULL AS BIGINT) AS game_pk, CAST(NULL AS DOUBLE) AS elo_home_pre, CAST(NULL AS DOUBLE) AS elo_away_pre "
        "FROM ng WHERE i = 1 UNION ALL "
        f"SELECT g.league, g.i, g.season, [{moved}] AS r, g.game_pk, b[{h}], b[{w}] "
        f"FROM (SELECT g.*, {base} AS b FROM st s JOIN ng g ON g.league = s.league AND g.i = s.i + 1) g), "
        "elo AS (SELECT game_pk, elo_home_pre, elo_away_pre FROM st WHERE i > 0)"
    )


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "elo_ratings",
    _recursive(with_tables("games", extra=_elo_sql()))
    + "SELECT game_pk, round(elo_home_pre, 6) AS elo_home_pre, round(elo_away_pre, 6) AS elo_away_pre, "
    "round(elo_home_pre + 24e0 - elo_away_pre, 6) AS elo_diff FROM elo",
)
def q_elo_ratings(spark, sf):
    rated = elo_ratings(a.games(spark, sf))
    return rated.select("game_pk", *[F.round(x, 6).alias(x) for x in ("elo_home_pre", "elo_away_pre", "elo_diff")])


PARK_FACTORS = ("runs_factor", "hr_factor", "k_factor", "hits_factor")


def feature_table(spark, sf) -> DataFrame:
    """Per game: ratings, form, workload and park, all known before the game."""
    games = a.games(spark, sf)
    form = f.last_n_form(games, default=5)
    fatigue = f.with_fatigue(
        games.select("game_pk", "game_date", "home_team", "away_team"),
        f.relief_workload(a.boxscore(spark, sf)), "home_team", "away_team",
    ).select("game_pk", "home_fatigue", "away_fatigue")
    v, p = venues(spark, sf).select("game_pk", "venue_name"), parks(spark, sf)
    park = v.join(p, v.venue_name == p.park_name, "left").select("game_pk", *PARK_FACTORS)
    return (
        games.select("game_pk", "game_date", "season")
        .join(elo_ratings(games).drop("league"), "game_pk")
        .join(form, "game_pk")
        .join(fatigue, "game_pk")
        .join(park, "game_pk")
        .select(
            "game_pk", "game_date", "season", "elo_diff",
            (F.col("l10_home_wins") - F.col("l10_away_wins")).alias("l10_diff"),
            (F.col("home_fatigue") - F.col("away_fatigue")).alias("fatigue_diff"),
            *PARK_FACTORS,
        )
    )


@query(
    "feature_table",
    _recursive(with_tables("games", "boxscore", extra=f"{_elo_sql()}, {_FORM}, {_FATIGUE}, {_PARKS}"))
    + "SELECT g.game_pk, g.game_date, g.season, round(elo_home_pre + 24e0 - elo_away_pre, 6) AS elo_diff, "
    "coalesce(l10_home_wins, 5) - coalesce(l10_away_wins, 5) AS l10_diff, "
    "coalesce(h.fatigue, 0) - coalesce(w.fatigue, 0) AS fatigue_diff, runs_factor, hr_factor, k_factor, hits_factor FROM games g "
    "JOIN elo ON elo.game_pk = g.game_pk JOIN form ON form.game_pk = g.game_pk "
    "LEFT JOIN fat h ON h.team_id = home_team AND h.game_date = g.game_date "
    "LEFT JOIN fat w ON w.team_id = away_team AND w.game_date = g.game_date "
    "JOIN venues v ON v.game_pk = g.game_pk LEFT JOIN parks p ON p.park_name = v.venue_name",
)
def q_feature_table(spark, sf):
    return feature_table(spark, sf).withColumn("elo_diff", F.round("elo_diff", 6))
