"""Queries that fold lines by game before they meet the games, on odd inputs and by their plans."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from check import TABLES, canon  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Orders that are listed twice (also in another year), that are missing, and lines without a key."""
    root = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for name in TABLES:
        rows = f"SELECT * FROM read_parquet('{SF}/{name}.parquet')"
        if name == "orders":
            rows = (
                f"WITH o AS ({rows}) SELECT * FROM o WHERE o_orderkey % 7 <> 0 UNION ALL "
                "SELECT * REPLACE (CAST(o_orderdate + INTERVAL 1 YEAR AS TIMESTAMP) AS o_orderdate, o_custkey + 1 AS o_custkey) "
                "FROM o WHERE o_orderkey % 5 = 0 UNION ALL SELECT * FROM o WHERE o_orderkey % 11 = 0"
            )
        if name == "lineitem":
            rows = f"SELECT * REPLACE (CASE WHEN l_partkey % 13 > 0 THEN l_orderkey END AS l_orderkey) FROM ({rows})"
        con.execute(f"COPY ({rows}) TO '{root}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return str(root), con


def same(spark, odd, name):
    sf, con = odd
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), cols)
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["reconcile_two_ways", "feature_corr", "weather_bins"])
def test_lines_fold_before_the_join(spark, odd, name):
    plan = same(spark, odd, name)
    assert plan.count("Join ") == 1 and "Aggregate" in plan[plan.index("Join ") :]
    assert sum("Relation" in line and "l_linenumber" in line for line in plan.splitlines()) == 1


def test_quotes_are_typed_before_they_move(spark, odd):
    """The join to the games carries numbers, and the pick of the main line no column twice."""
    plan = same(spark, odd, "main_line")
    quotes = plan[plan.index("Join Inner") :]
    assert "AS best_under_odds" in quotes and "CAST" in quotes.upper() and "min_by" not in plan


@pytest.mark.parametrize(
    "name", ["portfolio_blend", "policy_grading", "side_vote", "home_away_wide", "team_game_log", "grade_prop_market", "two_sided_expand"]
)
def test_folded_games_equal_sql(spark, odd, name):
    same(spark, odd, name)
