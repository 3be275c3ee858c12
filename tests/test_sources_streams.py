import datetime as dt
import json

from pyspark.sql import functions as F

from stakelens.operators import ratings
from stakelens.operators.stats import gate_pass, roi_stats
from stakelens.plans.ingest import silent_jobs
from stakelens.sources import files as fs
from stakelens.sources import nested as ns
from stakelens.streaming import jobs
from test_operators import games, picks


def test_quote_document(spark):
    def book(key, line, over, under):
        out = [{"name": "Over", "description": "P", "point": line, "price": over}]
        if under:
            out.append({"name": "Under", "description": "P", "point": line, "price": under})
        return {"key": key, "markets": [{"key": "outs", "outcomes": out}, {"key": "h2h", "outcomes": out}]}

    good = {"event_id": "e", "game_pk": 1, "response": {"data": {"bookmakers": [
        book("a", 1.5, 1.8, 2.0), book("b", 2.5, 2.1, None), book("c", 2.5, 2.2, 1.7), book("d", 1.5, 1.9, None)]}}}
    bad = {"event_id": "x", "response": {"error": "quota"}}
    empty = {"event_id": "y", "response": {"data": {"bookmakers": []}}}
    docs = spark.createDataFrame([(json.dumps(d),) for d in (good, bad, empty)], "doc string")
    flat = ns.flatten_quotes(ns.parse(docs, "doc", ns.QUOTE_DOC), "outs")
    assert flat.count() == 6
    # three quotes at each line: the lower line is the consensus
    assert tuple(ns.consensus(flat, ["event_id"]).first()) == ("e", 1.5, 1.9, 2.0)


def test_boxscore_document(spark):
    def player(i, order, batting, pitching):
        return {"person": {"id": i, "fullName": f"N{i}"}, "position": {"type": "Hitter"}, "battingOrder": order,
                "stats": {"batting": batting, "pitching": pitching}}

    home = {"team": {"id": 7}, "players": {
        "ID1": player(1, "300", {"hits": 2}, None), "ID2": player(2, "301", {"hits": 1}, None),
        "ID3": player(3, None, None, {"gamesStarted": 1, "numberOfPitches": 0, "pitchesThrown": 88}),
        "ID4": player(4, None, None, None)}}
    doc = {"game_pk": 5, "game_date": "2024-05-01", "teams": {"home": home, "away": {"team": {"id": 8}, "players": {}}}}
    docs = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    got = ns.flatten_boxscores(ns.parse(docs, "doc", ns.BOX_DOC)).orderBy("player_id").collect()
    assert [(r["player_id"], r["is_starter"], r["batting_order_slot"], r["pitches_thrown"]) for r in got] == [
        (1, True, 3, None), (2, False, 3, None), (3, True, None, 88),
    ]


def test_sectioned_csv_headers_change_inside_and_between_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'section,event_id,odds\npicks,e1,100\nsummary,9\nsection,event_id,note,odds\npicks,e2,"x, ""y""",120\n'
    )
    (tmp_path / "b.csv").write_text("section,event_id,odds,line\npicks,e3,130,1.5\n")
    got = fs.read_sectioned(spark, str(tmp_path), ["event_id", "odds", "note", "line"]).drop("file")
    assert [tuple(r) for r in got.orderBy("event_id").collect()] == [
        ("e1", "100", None, None), ("e2", "120", 'x, "y"', None), ("e3", "130", None, "1.5"),
    ]


def test_keyset_and_append(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "t int, id int")
    fresh = fs.keyset_after(df, ["t", "id"], [F.lit(1), F.lit(2)])
    assert sorted(tuple(r) for r in fresh.collect()) == [(2, 1), (2, 2)]
    path = str(tmp_path / "t")
    df.where("t = 1").write.parquet(path)
    fs.append_new(df.where("id = 2"), path, ["t", "id"])
    assert spark.read.parquet(path).count() == 3


def test_heartbeat_rule(spark):
    now = dt.datetime(2024, 1, 1, 12)
    beats = [
        ("ok", now - dt.timedelta(minutes=10), 1800), ("late", now - dt.timedelta(hours=5), 1800),
        ("free", now - dt.timedelta(days=3), None),
    ]
    df = spark.createDataFrame(beats, "job string, fired_at timestamp, interval_s int")
    assert {r["job"]: r["silent"] for r in silent_jobs(df, now).collect()} == {"ok": False, "late": True, "free": False}


def test_ratings_stream_over_batches_equals_batch(spark, tmp_path):
    g = games(spark, 90)
    feed = tmp_path / "feed"
    # three files, taken one per batch in date order
    for i in range(3):
        part = g.where(f"game_pk >= {i * 30} AND game_pk < {(i + 1) * 30}").coalesce(1)
        part.write.mode("append").parquet(str(feed))
        import time

        time.sleep(1.1)
    stream = spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(str(feed))
    jobs.ratings_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r["game_pk"]: r["elo_home_pre"] for r in jobs.rated_games(spark, str(tmp_path / "out")).collect()}
    want = {r["game_pk"]: r["elo_home_pre"] for r in ratings.fold(g).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_gate_stream_equals_batch(spark, tmp_path):
    df = picks(spark)
    df.repartition(3).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    jobs.running_gate(stream, ["market"], str(tmp_path / "out"), str(tmp_path / "state"))
    got = jobs.newest_batch(spark, str(tmp_path / "out")).orderBy("market").collect()
    want = roi_stats(df, ["market"], clv=None).withColumn("passed", gate_pass()).orderBy("market").collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want]


def test_sectioned_csv_of_any_width(spark, tmp_path):
    wide = [f"f{i}" for i in range(100)]
    lines = ["section," + ",".join(wide), "picks," + ",".join(f"v{i}" for i in range(100)), 'picks,"a,""b""",,"",' + ",".join(["x"] * 96) + ",last"]
    lines[0] = "section,event_id," + ",".join(wide[1:])
    (tmp_path / "wide.csv").write_text("\n".join(lines))
    got = fs.read_sectioned(spark, str(tmp_path / "wide.csv"), ["event_id", "f1", "f2", "f99"]).collect()
    assert sorted((r.event_id, r.f1, r.f2, r.f99) for r in got) == [('a,"b"', None, "", "last"), ("v0", "v1", "v2", "v99")]


def test_dedup_keeps_late_keys(spark, tmp_path):
    import time

    rows = [[(1, "2024-05-05")], [(2, "2020-01-01"), (1, "2020-01-01")], [(3, "2019-01-01")]]
    for part in rows:
        spark.createDataFrame(part, "id int, day string").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        time.sleep(1.1)
    stream = spark.readStream.schema("id int, day string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    jobs.dedup_ingest(stream, "id", str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_beats_stream_and_report(spark, tmp_path):
    beats = spark.createDataFrame([("a", 1, 60), ("a", 5, 60), ("b", 2, 90)], "job string, fired_at int, interval_s int")
    beats.write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(beats.schema).parquet(str(tmp_path / "feed"))
    jobs.last_beats(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    last = jobs.newest_batch(spark, str(tmp_path / "out"))
    assert sorted((r.job, r.fired_at) for r in last.collect()) == [("a", 5), ("b", 2)]
    fs.write_report(last, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2
    fs.write_table(last, str(tmp_path / "table"))
    fs.write_table(last, str(tmp_path / "table"), "append")
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4


def fed(spark, tmp_path, parts, schema):
    """A stream that takes one part per batch, in the given order."""
    import time

    for part in parts:
        frame = part if hasattr(part, "columns") else spark.createDataFrame(part, schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))


def test_ratings_stream_rewinds_for_late_games(spark, tmp_path):
    g = games(spark, 120)
    cuts = [g.where("game_pk % 3 = 0"), g.where("game_pk % 3 = 1 AND game_pk > 40"), g.where("game_pk % 3 = 2 OR (game_pk % 3 = 1 AND game_pk <= 40)")]
    stream = fed(spark, tmp_path, cuts, g.schema)
    jobs.ratings_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    rated = jobs.rated_games(spark, str(tmp_path / "out"))
    got = {r["game_pk"]: (r["elo_home_pre"], r["elo_away_pre"]) for r in rated.collect()}
    want = {r["game_pk"]: (r["elo_home_pre"], r["elo_away_pre"]) for r in ratings.fold(g).collect()}
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))


def test_silences_are_told_once(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)

    def beat(job, minutes, interval):
        return job, start + dt.timedelta(minutes=minutes), interval

    parts = [
        [beat("ok", m, 1800) for m in range(0, 300, 40)] + [beat("late", 0, 1800), beat("free", 0, None), beat("gap", 0, 600), beat("gap", 21, 600), beat("gap", 41, 600)],
        [beat("ok", m, 1800) for m in range(320, 601, 40)] + [beat("gap", 310, 600), beat("free", 330, None)],
        [beat("ok", 640, 1800), beat("late", 641, 1800)],
    ]
    stream = fed(spark, tmp_path, parts, "job string, fired_at timestamp, interval_s int")
    jobs.silence_alerts(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = [(r.job, (r.fired_at - start).seconds // 60, (r.due_at - r.fired_at).seconds // 60) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("gap", 0, 20), ("gap", 41, 20), ("gap", 310, 20), ("late", 0, 60)]


def test_json_lines_are_written_compressed(spark, tmp_path, monkeypatch):
    from stakelens.plans import ingest

    path = str(tmp_path / "jsonl")
    monkeypatch.setattr(ingest, "work_path", lambda spark, label: path)
    rows = ingest.q_src_jsonl_docs(spark, "/root/testdata/sf0.001").collect()
    assert rows and sum(r.docs for r in rows) > 0
    files = [f.name for f in (tmp_path / "jsonl").iterdir() if f.name.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)


def test_silences_without_a_task_per_job(spark, tmp_path, monkeypatch):
    """Late, repeated and unlimited beats; no grouping in Python, whose cost grows with the number of jobs."""
    start = dt.datetime(2024, 1, 1)
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandasWithState", None)

    def beat(job, minutes, interval):
        return job, None if minutes is None else start + dt.timedelta(minutes=minutes), interval

    parts = [
        [beat("a", 0, 600), beat("b", 100, 600), beat("c", 90, None), beat("d", 95, 600), beat("d", None, 600)],
        [beat("a", 0, 600), beat("b", 50, 600), beat("b", 100, 600), beat("c", 400, 600), beat("d", 100, 600), beat("d", 120, None)],
        [beat("a", 500, 600), beat("d", 510, 600), beat("c", 420, 600)],
    ]
    stream = fed(spark, tmp_path, parts, "job string, fired_at timestamp, interval_s int")
    jobs.silence_alerts(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = [(r.batch, r.job, (r.fired_at - start).seconds // 60) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [(0, "a", 0), (1, "b", 100), (2, "c", 420)]
