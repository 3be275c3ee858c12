"""Removal held against a plain loop over all spans."""

from collections import defaultdict

from stakelens.llm.queries import QUERIES
from stakelens.llm.sentence_dedup import LEAST_WORDS, SPAN, drop_repeated_sentences, repeated_spans, sentences


def test_sentences_cover_the_text():
    for text in ("", " ", "One. Two! Three?\nFour", "a.b c", "x " * 500, "\n\n.\n", "Ä… «b.» c\n"):
        parts = sentences(text)
        assert "".join(text[a:b] for a, b, _ in parts) == text
        assert [w for p in parts for w in p[2]] == text.lower().split()


def test_passage_without_stops_in_other_surroundings(spark):
    words = [f"passage{i}" for i in range(60)]
    docs = [(1, "own beginning here " + " ".join(words) + " own end of the first"), (2, "another start. Then " + " ".join(words) + " quite different tail words")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_repeated_sentences(frame).collect()}
    assert got[1] == docs[0][1]
    assert sum(w in got[2] for w in words) <= 15 and got[2].startswith("another start. Then") and got[2].endswith("different tail words")


def test_odd_rows(spark):
    run = "First sentence of some words. Second sentence of more words. Third sentence to make ten. "
    rows = [(2, run, "x"), (2, run, "x"), (1, "Intro. " + run, "y"), (None, run + "End.", None), (3, None, "x"), (4, "", "x"), (5, "Short. Short. Short. Short.", "x"), (6, "w " * 50_000, "x"), (2, "other text under the same id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    out = drop_repeated_sentences(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.mark) for r in out.collect()), key=str)
    assert [t for k, t, _ in got if k == 2] == ["", "", "other text under the same id"]
    assert [t for k, t, _ in got if k in (1, None)] == ["Intro. " + run, "End."]
    assert {k: t for k, t, _ in got if k in (3, 4, 5)} == {3: None, 4: "", 5: "Short. Short. Short. Short."}
    assert drop_repeated_sentences(docs.limit(0)).count() == 0


def plain(docs):
    """Each span is grown until it has both SPAN sentences and LEAST_WORDS words."""
    seen, parts_of = defaultdict(list), {k: sentences(text or "") for k, text in docs}
    for k, parts in parts_of.items():
        for i in range(len(parts)):
            end = next((j for j in range(i + SPAN, len(parts) + 1) if sum(len(p[2]) for p in parts[i:j]) >= LEAST_WORDS), None)
            if end:
                seen[str([p[2] for p in parts[i:end]])].append((k, i, end))
    gone = defaultdict(set)
    for places in seen.values():
        for k, i, end in sorted(places)[1:]:
            gone[k].update(range(i, end))
    for k, text in docs:
        parts = parts_of[k]
        yield k, text if not gone[k] else "".join(text[a:b] for j, (a, b, _) in enumerate(parts) if j not in gone[k]), len(parts), len(gone[k])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op5_sentence_spans"](spark, sf).collect()
    assert sorted((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got) == sorted(plain(docs))


def test_repeated_passage_of_short_lines(spark):
    lines = "".join(f"line{i} of verse\n" for i in range(20))
    han = "".join(f"{chr(0x4e00 + 7 * i)}{chr(0x5e00 + 5 * i)}{chr(0x6e00 + 3 * i)}。" for i in range(12))
    docs = [(1, "own start here\n" + lines + "own end"), (2, "other beginning\n" + lines + "other tail"), (3, "甲乙。" + han + "丙丁。"), (4, "戊己。" + han + "庚辛。")]
    got = {r.doc_id: r.text for r in drop_repeated_sentences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "other beginning\nother tail", 3: docs[2][1], 4: "戊己。庚辛。"}


def test_hot_spans_are_dealt_out_without_change(spark):
    passage = "The very same words. Stand in most documents. They are ten or more. "
    docs = [(i if i % 7 else None, f"Own start {i} here. " * 3 + passage + f"Own end {i} there. Nothing else. ") for i in range(1500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    some = {(r.doc_id, r.mark, r.at) for r in repeated_spans(frame, deal=2).collect()}
    whole = {(r.doc_id, r.mark, r.at) for r in repeated_spans(frame, deal=2, most_hot=1).collect()}
    assert some == whole and len({r[:2] for r in some}) == 1499
