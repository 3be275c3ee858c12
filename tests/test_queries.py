"""Flagship queries against DuckDB on the smallest tables; tools/check.py runs them all."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

from stakelens.plans.registry import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
CORE = [
    "gate_cuts", "gate_verdict", "sweep_grid", "index_split", "policy_grading", "asof_strict_left", "last_n_form",
    "elo_ratings", "factor_corr_topk", "consensus_line", "stream_gate", "feature_table", "ml_pick_history_states",
    "ml_quote_market_states", "ml_seed_weights", "ordered_report", "report_manifest", "overwrite_table",
]


def test_register_is_complete():
    assert len(QUERIES) >= 124 and set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cur = check.connect(SF).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert check.canon([tuple(r) for r in df.collect()], df.columns) == check.canon(cur.fetchall(), columns)


@pytest.mark.parametrize("name", ["gap_quartile_strategy", "selection_gap"])
def test_long_joins_run_once(spark, name):
    """The report reads the stored rows of the join, not the given tables again."""
    read = entry.queries()[name](spark, SF).inputFiles()
    assert read and not [f for f in read if f.startswith(f"file://{SF}")]


def test_quotes_fold_once_for_both_sides(spark):
    plan = entry.queries()["match_rate"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    folds = [line for line in plan.splitlines() if "Aggregate [market" in line and "name_norm" in line]
    assert len(folds) == 1 and "side" not in folds[0].split("]")[0]


@pytest.mark.parametrize("name", ["match_rate", "execution_gap", "selection_gap"])
def test_best_quotes_equal_sql(spark, name):
    test_query_equals_sql(spark, name)
