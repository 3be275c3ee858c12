import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from stakelens.operators import factors, form, metrics, ratings
from stakelens.operators.asof import asof_strict
from stakelens.operators.cuts import cut_stats, gate_cuts
from stakelens.operators.matching import resolve, unordered_pair_join
from stakelens.operators.ordered import exact_quantiles, ranked, running_totals
from stakelens.operators.splits import index_split, walk_forward_cells
from stakelens.operators.stats import gate_pass, moments, roi_stats, stats_from_moments
from stakelens.operators.validation import best_passing, cluster_robust, multiplicity

DAY = dt.date(2024, 1, 1)


def picks(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        odds = rnd.choice([-150, -110, 120, 200])
        win = rnd.random() < 0.5
        profit = -1.0 if not win else (odds / 100 if odds > 0 else 100 / -odds)
        # one market holds most rows
        market = "hot" if rnd.random() < 0.8 else rnd.choice("ab")
        rows.append((i, market, odds, rnd.randint(40, 90), win, profit, rnd.random(), DAY + dt.timedelta(rnd.randint(0, 9))))
    return spark.createDataFrame(rows, "id long, market string, odds int, confidence int, win boolean, profit double, clv double, day date")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_gate_rules(spark):
    data = [(499, 5.0, 0.1), (499, 5.0, -0.1), (500, 0.01, -9.0), (500, 0.0, -9.0), (500, 5.0, 0.1), (1, 5.0, None)]
    df = spark.createDataFrame(data, "n long, roi double, roi_lo double")
    assert [r[0] for r in df.select(gate_pass()).collect()] == [True, False, True, False, True, False]
    assert [r[0] for r in df.select(gate_pass("strict")).collect()] == [False, False, False, False, True, False]


def test_cut_stats_equals_one_scan_per_cut(spark):
    df = picks(spark)
    one_pass = {(r["market"], r["cut"]): r for r in cut_stats(df, ["market"], gate_cuts()).collect()}
    for label, cond in gate_cuts():
        for r in roi_stats(df.where(cond), ["market"]).collect():
            got = one_pass.pop((r["market"], label))
            assert all(got[c] == pytest.approx(r[c]) for c in ("n", "wr", "roi", "roi_lo", "roi_hi", "clv"))
    assert not one_pass


def test_moments_single_row_has_no_interval(spark):
    one = picks(spark, 1)
    got = moments(one, ["market"]).select(*stats_from_moments()).first()
    assert got["n"] == 1 and got["roi_lo"] is None and got["roi_hi"] is None


def test_ranked_and_running_totals(spark):
    df = picks(spark)
    expect = {}
    for r in sorted(df.collect(), key=lambda r: (r["market"], r["day"], r["id"])):
        expect.setdefault(r["market"], []).append((r["id"], r["odds"]))
    got = {r["id"]: r["rank_no"] for r in ranked(df, ["market"], ["day", "id"]).collect()}
    cum = {r["id"]: r["c"] for r in running_totals(df, ["market"], ["day", "id"], {"c": "odds"}).collect()}
    for members in expect.values():
        total = 0
        for i, (key, odds) in enumerate(members, 1):
            total += odds
            assert got[key] == i and cum[key] == total


@pytest.mark.parametrize("bounded", [True, False])
def test_exact_quantiles(spark, bounded):
    df = picks(spark)
    got = {r["market"]: r for r in exact_quantiles(df, ["market"], "clv", {"a": 0.25, "b": 0.6}, bounded).collect()}
    for market in ("hot", "a", "b"):
        values = [r["clv"] for r in df.where(F.col("market") == market).collect()]
        assert got[market]["a"] == pytest.approx(np.quantile(values, 0.25))
        assert got[market]["b"] == pytest.approx(np.quantile(values, 0.6))


def test_index_split_matches_sorted_rows(spark):
    df = picks(spark)
    parts = {r["id"]: r["part_no"] for r in index_split(df, ["market"], "day", ["id"], [0.5, 0.7]).collect()}
    assert len(parts) == df.count()
    by = {}
    for r in sorted(df.collect(), key=lambda r: (r["day"], r["id"])):
        by.setdefault(r["market"], []).append(r["id"])
    for ids in by.values():
        a, b = int(len(ids) * 0.5), int(len(ids) * 0.7)
        assert [parts[i] for i in ids] == [0] * a + [1] * (b - a) + [2] * (len(ids) - b)


def test_index_split_one_day(spark):
    for n, want in ((5, 3), (10, 6)):
        df = spark.createDataFrame([(i, "m", DAY) for i in range(n)], "id long, market string, day date")
        split = index_split(df, ["market"], "day", ["id"], [0.6])
        assert split.where("part_no = 0").count() == want


def test_walk_forward_split(spark):
    df = picks(spark)
    got = {r["market"]: r for r in walk_forward_cells(moments(df, ["market", "day"], clv=None), ["market"], "day", 0.6).collect()}
    for market, r in got.items():
        own = df.where(F.col("market") == market).collect()
        at = np.quantile([(x["day"] - dt.date(1970, 1, 1)).days * 86400 for x in own], 0.6)
        train = [x for x in own if (x["day"] - dt.date(1970, 1, 1)).days * 86400 < at]
        assert r["n_train"] == len(train) and r["n_test"] == len(own) - len(train)


def games(spark, n=120, teams=4, leagues=2, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        league = rnd.randrange(leagues)
        h, a = rnd.sample(range(teams), 2)
        day = dt.date(2020 + i // 50, 1, 1) + dt.timedelta(i % 50)
        out.append((i, league, day, day.year, league * 10 + h, league * 10 + a, rnd.randint(0, 5), rnd.randint(0, 5)))
    return spark.createDataFrame(
        out, "game_pk long, league long, game_date date, season int, home_team long, away_team long, home_score int, away_score int"
    )


def plain_elo(data):
    state, season, out = {}, {}, {}
    for g in sorted(data, key=lambda g: (g["game_date"], g["game_pk"])):
        lg = g["league"]
        if lg in season and season[lg] != g["season"]:
            for k in [k for k in state if k[0] == lg]:
                state[k] += (1500 - state[k]) / 3
        season[lg] = g["season"]
        h, a = state.get((lg, g["home_team"]), 1500.0), state.get((lg, g["away_team"]), 1500.0)
        out[g["game_pk"]] = (h, a)
        d = 20 * ((g["home_score"] > g["away_score"]) - 1 / (1 + 10 ** ((a - h - 24) / 400)))
        state[lg, g["home_team"]], state[lg, g["away_team"]] = h + d, a - d
    return out


@pytest.mark.parametrize("method", [ratings.fold, ratings.relax])
def test_elo_both_ways(spark, method):
    g = games(spark)
    want = plain_elo(g.collect())
    got = {r["game_pk"]: (r["elo_home_pre"], r["elo_away_pre"]) for r in method(g).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_elo_mixed_sizes_and_no_leak(spark):
    g = games(spark, 60)
    base = {r["game_pk"]: r["elo_diff"] for r in ratings.elo_ratings(g).collect()}
    mixed = {r["game_pk"]: r["elo_diff"] for r in ratings.elo_ratings(g, max_fold_games=29).collect()}
    assert all(mixed[k] == pytest.approx(base[k], abs=1e-6) for k in base)
    early = g.where("game_pk < 40")
    assert all(r["elo_diff"] == pytest.approx(base[r["game_pk"]]) for r in ratings.elo_ratings(early).collect())


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_last_n_form_hot_and_whole_keys(spark, hot_rows):
    g = games(spark, 150)
    history, want = {}, {}
    for r in sorted(g.collect(), key=lambda r: (r["game_date"], r["game_pk"])):
        h, a = history.setdefault(r["home_team"], []), history.setdefault(r["away_team"], [])
        want[r["game_pk"]] = (sum(h[-10:]) if h else None, len(h[-10:]), sum(a[-10:]) if a else None, len(a[-10:]))
        won = int(r["home_score"] > r["away_score"])
        h.append(won)
        a.append(1 - won)
    got = {r[0]: tuple(r[1:]) for r in form.last_n_form(g, hot_rows=hot_rows).collect()}
    assert got == want


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_rolling_rate_needs_full_window(spark, hot_rows):
    data = [(1, i, DAY + dt.timedelta(20 * i), 7, 1, 1, 1.0, "Pitcher", True, "5.1", "2") for i in range(5)]
    box = spark.createDataFrame(
        data, "player_id long, game_pk long, game_date date, team_id long, slot int, entry_key long, entry_ref double, "
        "position_type string, is_starter boolean, innings_pitched string, pitcher_earned_runs string",
    )
    got = rows(form.earned_run_rates(box, hot_rows=hot_rows).select("game_pk", "ra9_l3", "ra9_l5"), "game_pk")
    rate = round(6 * 27 / 48, 3)
    assert got == [(0, None, None), (1, None, None), (2, None, None), (3, rate, None), (4, rate, None)]


def test_trailing_days(spark):
    days = [0, 1, 2, 5, 6, 8]
    daily = spark.createDataFrame([("t", DAY + dt.timedelta(d), 10 + d) for d in days], "team string, d date, outs long")
    got = [r[0] for r in form.trailing_days(daily, "team", "d", "outs", 2, "f").orderBy("d").select("f").collect()]
    assert got == [0, 10, 21, 0, 15, 16]


@pytest.mark.parametrize("block", ["day", "year"])
def test_asof_strict(spark, block):
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    snaps = [(k, base + dt.timedelta(hours=rnd.randint(0, 90)), i) for i, k in enumerate(rnd.choices([1, 1, 1, 2], k=60))]
    probes = [(i, k, base + dt.timedelta(hours=rnd.randint(0, 90))) for i, k in enumerate(rnd.choices([1, 1, 2, 3], k=80))]
    p = spark.createDataFrame(probes, "pid long, k long, ts timestamp")
    s = spark.createDataFrame(snaps, "k long, at timestamp, sid long")
    got = {r["pid"]: r["sid"] for r in asof_strict(p, s, "k", "ts", "at", ["sid"], tie="sid", block=block).collect()}
    for pid, k, ts in probes:
        prior = sorted((at, sid) for kk, at, sid in snaps if kk == k and at < ts)
        assert got[pid] == (prior[-1][1] if prior else None)
    inner = asof_strict(p, s, "k", "ts", "at", ["sid"], tie="sid", how="inner")
    assert inner.count() == sum(v is not None for v in got.values())


def test_auc_with_ties(spark):
    rnd = random.Random(9)
    data = [("m", rnd.randint(0, 5) / 5, rnd.random() < 0.5) for _ in range(120)]
    df = spark.createDataFrame(data, "g string, s double, y boolean")
    pos, neg = [s for _, s, y in data if y], [s for _, s, y in data if not y]
    want = statistics.mean((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert metrics.auc(df, ["g"], "s", "y").first()["auc"] == pytest.approx(want)


def test_imputed_correlation(spark):
    rnd = random.Random(2)
    data = [(rnd.random() if rnd.random() < 0.7 else None, 3.0, rnd.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame([("m", *r) for r in data], "g string, x double, flat double, y boolean")
    got = {r["factor"]: r["r"] for r in factors.imputed_correlations(df, ["g"], ["x", "flat"], "y").collect()}
    median = np.median([x for x, _, _ in data if x is not None])
    filled = [median if x is None else x for x, _, _ in data]
    assert got["x"] == pytest.approx(np.corrcoef(filled, [int(y) for _, _, y in data])[0, 1])
    assert got["flat"] is None


def test_cluster_and_multiplicity(spark):
    data = [("m", i // 3, 1.0 if i // 3 % 2 else -1.0) for i in range(30)]
    df = spark.createDataFrame(data, "g string, c long, profit double")
    r = cluster_robust(df, ["g"], "c").first()
    assert r["clusters"] == 10 and r["roi"] == 0.0 and r["se_ratio"] > 1.6
    m = multiplicity(df, ["g"], "c").first()
    assert (m["n_rows"], m["units"], m["inflation"], m["max_per_unit"]) == (30, 10, 3.0, 3)


def test_best_of_k(spark):
    data = [("a", 0.0, 1.0, False), ("a", 0.1, 3.0, True), ("a", 0.2, 2.0, True), ("b", 0.0, -1.0, False), ("b", 0.1, 9.0, False)]
    df = spark.createDataFrame(data, "m string, threshold double, roi double, passed boolean")
    got = rows(best_passing(df, ["m"], "threshold").select("m", "threshold"), "m")
    assert got == [("a", 0.1), ("b", 0.0)]


def test_unordered_pair_equals_or_form(spark):
    rnd = random.Random(4)
    left = spark.createDataFrame([(i, rnd.randint(0, 3), rnd.randint(0, 3)) for i in range(30)], "d int, h int, a int")
    left = left.withColumn("d", F.col("d") % 5)
    right = spark.createDataFrame([(i % 5, rnd.randint(0, 3), rnd.randint(0, 3), i) for i in range(40)], "d int, t int, o int, i int")
    fast = unordered_pair_join(left, right, ["d"], ("h", "a"), ("t", "o")).select("d", "h", "a", "t", "o", "i")
    either = ((right.t == left.h) & (right.o == left.a)) | ((right.t == left.a) & (right.o == left.h))
    slow = left.join(right, (left.d == right.d) & either).select(left.d, "h", "a", "t", "o", "i")
    cols = ["d", "h", "a", "t", "o", "i"]
    assert rows(fast, *cols) == rows(slow, *cols)


def test_resolve_latest_wins(spark):
    left = spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string")
    right = spark.createDataFrame([("a ", "x", 1), ("a", "y", 2)], "nm string, ev string, at int")
    keys = {"k": (F.lower("name"), F.trim("nm"))}
    got = rows(resolve(left, right, keys, F.col("at"), ["ev"]), "id")
    assert got == [(1, "A", "y", True), (2, "B", None, False)]




def test_more_cuts_than_one_word_holds(spark):
    from pyspark.sql import functions as F

    from stakelens.operators.cuts import cut_cells

    df = spark.range(200).selectExpr("id", "id % 2 = 0 AS win", "1.0D AS profit")
    cuts = [(f"cut {i}", F.col("id") >= i) for i in range(100)]
    got = {r["cut"]: r["n"] for r in cut_cells(df, [], cuts, clv=None).collect()}
    assert got == {f"cut {i}": 200 - i for i in range(100)}


def test_asof_left_keeps_probes_without_key_or_time(spark):
    import datetime as dt

    from stakelens.operators.asof import asof_strict

    d = lambda n: dt.date(2024, 1, n)
    probes = spark.createDataFrame([(1, "a", d(5)), (2, None, d(5)), (3, "a", None), (4, "z", d(2))], "id int, k string, t date")
    snaps = spark.createDataFrame([("a", d(1), 10, 0), ("a", d(5), 11, 0), (None, d(1), 12, 0)], "k string, s date, v int, tie int")
    got = asof_strict(probes, snaps, "k", "t", "s", ["v"], "tie").collect()
    assert sorted((r.id, r.v) for r in got if r.v is not None) == [(1, 10)] and sorted(r.id for r in got) == [1, 2, 3, 4]
    inner = asof_strict(probes, snaps, "k", "t", "s", ["v"], "tie", how="inner").collect()
    assert [r.id for r in inner] == [1]


def test_islands_and_the_days_within(spark):
    from datetime import date, timedelta

    from stakelens.operators.matching import in_islands, islands

    start = date(2024, 1, 30)
    days = {"a": [0, 1, 1, 2, 5, 6, 40], "b": [3], None: [1, 2]}
    rows = [(k, start + timedelta(d)) for k, ds in days.items() for d in ds] + [("c", None)]
    runs = islands(spark.createDataFrame(rows, "k string, day date"), ["k"], "day")
    got = {(r.k, (r.d0 - start).days, (r.d1 - start).days) for r in runs.collect()}
    assert got == {("a", 0, 2), ("a", 5, 6), ("a", 40, 40), ("b", 3, 3), (None, 1, 2)}
    asked = [(k, start + timedelta(d), d) for k in ("a", "b", "x", None) for d in range(-2, 45)] + [("a", None, -9)]
    flagged = in_islands(spark.createDataFrame(asked, "k string, day date, d int"), runs, ["k"], "day").collect()
    assert len(flagged) == len(asked)
    assert {(r.k, r.d) for r in flagged if r.in_window} == {(k, d) for k, ds in days.items() for d in ds}


def test_quantiles_by_selection_equal_sorted_ones(spark, monkeypatch):
    import numpy as np

    from stakelens.operators import ordered

    monkeypatch.setattr(ordered, "_IN_ORDER", 8)
    monkeypatch.setattr(ordered, "_BUCKETS", 16)
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(size=400), "tail": np.exp(rng.normal(size=300) * 20), "both": rng.normal(size=301) * 10.0 ** rng.integers(-9, 9, 301),
        "same": np.full(50, 2.5), "two": np.array([1.0, 3.0]), "one": np.array([-7.0]), "ties": rng.integers(0, 3, 500).astype(float), None: rng.normal(size=99),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), ("empty", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    probs = {"p0": 0.0, "p25": 0.25, "p5": 0.5, "p77": 0.77, "p1": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        for name, p in probs.items():
            assert math.isclose(got[g][name], float(np.quantile(xs, p)), rel_tol=1e-12, abs_tol=1e-300), (g, name)
    whole = exact_quantiles(df, [], "x", {"m": 0.5}).first().m
    assert math.isclose(whole, float(np.median(np.concatenate(list(groups.values())))), rel_tol=1e-12)
    assert exact_quantiles(df.where("false"), ["g"], "x", probs).count() == 0
