"""Held-out accuracy, and defined results for odd rows."""

from stakelens.llm.queries import QUERIES
from stakelens.llm.toxicity import drop_toxic, fit_toxicity, score_documents, windows

SF = "/root/testdata/sf0.1"


def test_windows_cover_the_text():
    for text in ("", "a", "É " * 700, "x" * 1000, "word " * 500):
        assert b"".join(windows(text)) == text.lower().encode()
        assert all(len(w) <= 128 for w in windows(text))


def test_held_out_rows(spark):
    got = QUERIES["op10_compression_toxicity"](spark, SF)
    seen = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in seen if r.toxic]
    clean = [r for r in seen if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in seen)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "s"), (None, "x " * 90_000, "s"), (4, "you idiot", "s"), (4, "you idiot", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.p < 1e-9 for r in score_documents(docs, fit_toxicity(docs, none), score="p").collect())
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (4, 1), (4, 0), (2, 0)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    scored = score_documents(docs, model, score="p").collect()
    assert len(scored) == 5 and len({r.p for r in scored if r.text == "you idiot"}) == 1
    assert drop_toxic(docs, model, 2.0).columns == docs.columns
    assert drop_toxic(docs.limit(0), model).count() == 0
