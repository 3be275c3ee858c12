"""Fits: rounds of the market models, what a fold keeps, folders of stored rows."""

import math

from pyspark.sql import functions as F

from stakelens.operators import models as m
from stakelens.plans import models as pm


def _rows(spark, n=6000):
    return spark.range(n).selectExpr(
        "id % 2 AS part_no", "IF(id % 3 = 0, 'a', 'b') AS market", "CAST(id % 4 AS DOUBLE) AS x", "IF(id % 5 = 0, NULL, id % 7) AS y",
        "id * 1.0D AS z", "pmod(hash(id), 10) < 3 + 2 * (id % 4 > 1)::int + (id % 7 > 3)::int AS win", "-110 AS odds", "0.9D AS profit",
    )


def test_market_models_fit_a_full_study(spark, monkeypatch):
    """five rounds were a small part of the study's two hundred."""
    asked = []
    monkeypatch.setattr(m, "fit", lambda train, features, **more: asked.append(more))
    monkeypatch.setattr(m, "scored", lambda model, rows: rows.withColumn("model_prob", F.lit(0.5)))
    pm.q_ml_market_gbt(spark, "/root/testdata/sf0.001")
    assert len(asked) == 7 and all(more["rounds"] == 200 and more["step"] == 0.05 for more in asked)


def test_fold_keeps_every_row_by_weight(spark):
    rows = m.prepared(_rows(spark), ["x", "y", "z"])
    inputs, n = m.inputs_of(rows, ["x", "y", "z"], fold=True)
    assert n == 6000 and inputs.gaps == ("y",) and all(len(e) <= m.BINS for e in inputs.edges.values())
    cells = m.folded(rows, inputs).collect()
    assert sum(r.weight for r in cells) == 6000 and sum(r.weight for r in cells if r.label) == rows.where("win").count()
    assert len({(r.label, tuple(r.features)) for r in cells}) == len(cells) < 6000
    few = m.folded(rows.select("label", "x", F.lit(1.0).alias("y"), F.lit(0.0).alias("z")), inputs).collect()
    # few values each stay apart
    assert {r.features[0] for r in few} == {0.0, 1.0, 2.0, 3.0}


def test_folded_fit_tells_as_much(spark):
    rows = m.prepared(_rows(spark), ["x", "y"])
    kept = rows.select("label", "x", "y", "win", "odds")
    plain, folded = (m.scored(m.fit(rows, ["x", "y"], rounds=20, fold=f), kept) for f in (False, True))
    brier = [df.agg(F.avg(F.pow(F.col("model_prob") - F.col("label"), 2))).first()[0] for df in (plain, folded)]
    base = rows.agg(F.var_pop("label")).first()[0]
    assert max(brier) < base - 0.005 and abs(brier[0] - brier[1]) < 0.005
    assert [name for name, _ in m.importances(m.fit(rows, ["x", "y"], rounds=5))][0] in ("x", "y")


def test_gaps_and_values_that_are_no_number(spark):
    train = spark.createDataFrame([(float(i % 2), float(i), None if i % 9 == 0 else float(i % 3), 1.0) for i in range(200)], "label double, a double, b double, c double")
    model = m.fit(train, ["a", "b", "c"], rounds=2)
    assert model.inputs.gaps == ("b",) and model.inputs.medians["b"] == 1.0
    odd = spark.createDataFrame([(None, math.nan, None)], "a double, b double, c double")
    assert 0 < m.scored(model, odd).first().model_prob < 1


def test_a_fit_reads_its_own_rows_only(spark):
    rows = m.model_rows(_rows(spark), ["x", "y"], ["market"], apart=["market", "part_no"])
    some = rows.where("market = 'a' AND part_no = 1")
    assert some.count() == _rows(spark).where("market = 'a' AND part_no = 1").count()
    assert "PartitionFilters: [isnotnull(market" in some._jdf.queryExecution().toString()
    assert rows.schema["part_no"].dataType == _rows(spark).schema["part_no"].dataType


def test_main_lines_are_grouped_where_the_join_put_them(spark, monkeypatch):
    """market, game and name are grouped without another exchange of all quotes."""
    from stakelens.plans import market_models as mm

    kept, plain = [], mm.stored
    monkeypatch.setattr(mm, "stored", lambda df, *a, **more: kept.append(df) or plain(df, *a, **more))
    rows = mm.prop_sides(spark, "/root/testdata/sf0.001")
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(market_key" not in plan and rows.columns == list(mm._PIT_ROW)
    assert rows.groupBy("market", "game_pk", "tie", "side").count().where("count > 1").count() == 0


def test_shuffle_files_go_after_a_tidy_write(spark):
    """they stayed until the driver happened to collect its garbage."""
    import time
    from pathlib import Path

    from stakelens.session import _SHUFFLE_CLEANUP, stored

    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in folders for f in Path(d).rglob("shuffle_*")}

    before = files()
    rows = spark.range(50_000).groupBy((F.col("id") % 30_011).alias("k")).count()
    assert stored(rows, "tidy", tidy=True).count() == 30_011
    for _ in range(50):
        written = {f for f in files() - before if f.suffix == ".data" and f.stat().st_size > 50_000}
        if not written:
            break
        time.sleep(0.2)
    assert not written and spark.conf.get(_SHUFFLE_CLEANUP) == "false"
