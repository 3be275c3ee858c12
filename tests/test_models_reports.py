"""Market states, refits over seeds, and sinks whose order is read back."""

from pyspark.sql import functions as F

from stakelens.operators import models as m
from stakelens.plans import market_models as mm
from stakelens.sources import files

SF = "/root/testdata/sf0.001"


def _rows(spark, sizes):
    data = [(k, int(i >= train), bool(i % every == 0)) for k, (n, train, every) in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, "market string, part_no int, win boolean")


def test_market_states(spark):
    sizes = {"good": (600, 450, 2), "few": (499, 300, 2), "short": (600, 570, 2), "lost": (600, 450, 10_000)}
    rows = _rows(spark, sizes).withColumn("win", F.col("win") & (F.col("market") != "lost"))
    got = {r.market: r for r in m.market_states(rows, "market", mm.catalogue(spark, ["good", "absent"])).collect()}
    assert {k: r.state for k, r in got.items()} == {
        "good": "fitted", "few": "insufficient data", "short": "insufficient data after split",
        "lost": "one outcome only", "absent": "insufficient data",
    }
    assert got["absent"].n == 0 and (got["good"].n_train, got["good"].n_test, got["good"].wins_train) == (450, 150, 225)


def test_typed_history_leaves_out(spark):
    row = {"is_synthetic": None, "voided": "f", "hit": "T", "odds": "+120", "game_date": "1998-01-02", "prop_type": "hits", "score_a": "1.5"}
    odd = [{"voided": "T"}, {"is_synthetic": "1"}, {"hit": None}, {"odds": "abc"}, {"game_date": "unknown"}, {"score_a": "n/a"}]
    schema = ", ".join(f"{c} string" for c in row)
    raw = spark.createDataFrame([tuple({**row, **o}.values()) for o in [{}, *odd]], schema)
    got = mm.typed_history(raw).orderBy(F.desc("score_a")).collect()
    assert [(r.market, r.odds, r.win, r.profit, r.score_a) for r in got] == [("hits", 120, True, 1.2, 1.5), ("hits", 120, True, 1.2, None)]


def test_report_of_pick_history(spark):
    got = {r.market: r for r in mm.q_ml_pick_history(spark, SF).collect()}
    assert set(got) >= {"hits", "h2h", "pitcher_outs"}
    for r in got.values():
        if r.state == "fitted":
            assert 0 <= r.auc <= 1 and r.n_train + r.n_test == r.n and r.passed_no_filter is not None
        else:
            assert r.auc is None and r.n < 500


def test_refits_spread(spark):
    rows, _ = mm.seeded_rows(spark, SF)
    mean = rows.agg(*[F.avg(f"weight_{s}").alias(f"w{s}") for s in mm.SEEDS]).first()
    assert all(abs(w - 1) < 0.1 for w in mean)
    for r in mm.q_ml_seed_refits(spark, SF).collect():
        assert r.runs == len(mm.SEEDS) and r.min_auc <= r.avg_auc <= r.max_auc and r.min_roi <= r.max_roi
        assert r.split_verdict == (0 < r.passes < r.runs)


def test_ordered_files(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), F.concat(F.lit('a,"b" '), "id").alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        files.write_ordered(rows, path, [F.desc("k")])
        got = files.read_ordered(spark, path, rows.schema).collect()
        manifest = files.ordered_manifest(spark, path, rows.schema, [-F.col("k")]).orderBy("file").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(manifest) > 1 and all(r.in_order for r in manifest) and sum(r.n_rows for r in manifest) == 20_000
    assert sorted(r.place for r in got) == list(range(1, 20_001)) and all(r.k == 20_000 - r.place for r in got)
    assert {r.t for r in got} == {r.t for r in rows.collect()}
    files.write_ordered(rows.limit(0), path, ["k"])
    assert files.read_ordered(spark, path, rows.schema).count() == 0


def test_model_rows_are_stored_narrow_in_short_files(spark):
    """Only what a fit and its report take is kept, and no file holds so many rows that one task reads them all."""
    split = spark.range(0, 120_001, 1, 1).selectExpr(
        "'a' AS market", "id % 3 = 0 AS win", "-110 AS odds", "0.5D AS profit", "0 AS part_no", "IF(id % 5 = 0, NULL, id) AS x", "'wide' AS unused"
    )
    rows = m.model_rows(split, ["x"], ["market"])
    assert set(rows.columns) == {"market", "win", "odds", "profit", "part_no", "x", "x__gap", "label"}
    assert rows.count() == 120_001 and rows.where("x__gap = 1 AND x IS NULL").count() == 24_001
    assert len(rows.inputFiles()) == 3


def test_large_fits_run_one_after_another(spark):
    from threading import Lock
    from time import sleep

    lock, running, most = Lock(), [0], [0]

    def fit_one(key):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        sleep(0.2)
        with lock:
            running[0] -= 1
        return key * 2

    assert m.fit_all(spark, fit_one, [1, 2, 3], rows=30_000_000) == [2, 4, 6] and most[0] == 1
    assert m.fit_all(spark, fit_one, [1, 2, 3], rows=100) == [2, 4, 6] and most[0] > 1
    assert m.fit_all(spark, fit_one, [], rows=0) == []
