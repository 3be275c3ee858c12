"""Every stage on its own input: what it keeps, and that the columns stay."""

import corpus_pipeline as p
from test_sentence_dedup import plain as plain_spans
from test_near_copies import plain_kept

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before.collect(), docs.collect()
        if name != "tokens":
            assert docs.columns == before.columns and docs.schema["n_chars"] == before.schema["n_chars"]
    before, after = seen["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(gone - toxic) <= 0.1 * len(before)
    before, after = seen["near_copies"]
    want, got = plain_kept({r.doc_id: r.text for r in before}), {r.doc_id for r in after}
    assert want <= got and len(got) == len(after) and len(got - want) <= 0.05 * (len(before) - len(want))
    before, after = seen["repeated_passages"]
    assert {(r.doc_id, r.text, r.n_chars) for r in after} == {(k, t, len(t)) for k, t, _, _ in plain_spans([(r.doc_id, r.text) for r in before])}
    before, after = seen["mixing"]
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before} and len(after) > 0.3 * len(before)
    before, after = seen["tokens"]
    assert len(after) == len(before) and all(r.round_trip and r.n_tokens == len(r.ids) for r in after)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0
