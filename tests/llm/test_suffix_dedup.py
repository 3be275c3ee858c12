"""Removal held against a plain count of all windows; the sort against plain sorting."""

import hashlib
import random
from collections import Counter

from stakelens.llm.queries import QUERIES
from stakelens.llm.suffix_dedup import LENGTH, common_prefixes, drop_repeated_bytes, runs, suffix_array


def plain(rows):
    data = [(k, (t or "").encode()) for k, t in rows]
    count = Counter(d[i : i + LENGTH] for _, d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for k, d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - LENGTH + 1):
            if count[d[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\x01" * LENGTH
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((k, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_array():
    rng = random.Random(1)
    cases = [[], [0], [1, 1], [0] * 50, [1, 0] * 30, [0, 1] * 30, list(b"mississippi"), list(b"abracadabra" * 9)]
    cases += [[rng.randrange(a) for _ in range(rng.randrange(2, 120))] for a in (2, 3, 5, 200) for _ in range(150)]
    for s in cases:
        order = suffix_array(s, 256)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        prefix = common_prefixes(s, order, 7)
        for a, b in zip(order, order[1:]):
            n = 0
            while n < 7 and a + n < len(s) and b + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert prefix[b] == n


def made(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    out = drop_repeated_bytes(docs, **more)
    assert out.columns[:3] == docs.columns
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()], key=str)


def test_planted_and_odd_rows(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh äé") for _ in range(n))
    base, passage = text(1500), text(420)
    rows = [
        (1, base, "x"), (2, base, "x"), (3, base[:700] + "#" + base[701:], "x"), (4, text(300) + passage + text(300), "x"), (5, text(90) + passage, None),
        (6, passage[:399] + text(200), "x"), (7, "of " * 400, "x"), (8, "z" * 401, "x"), (9, "y" * 400, "x"), (10, None, "x"), (None, "", "x"),
        (11, text(380), "x"), (11, text(20_000), "x"), (12, "ab" * 300 + passage[10:], "x"), (13, base[200:1300], "x"),
    ]
    want = plain([r[:2] for r in rows])
    assert made(spark, rows) == want
    assert made(spark, rows, most_pieces=1) == want
    assert made(spark, rows[:1]) == plain([rows[0][:2]])
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    assert drop_repeated_bytes(docs.limit(0)).count() == 0


def test_long_repetitive_texts_by_pieces(spark):
    data = ("Nd, " * 5000 + "x" * 9000 + "end").encode()
    whole, cut = runs(data), runs(data, block=1000)
    for first, last in ((whole[1], whole[2]), (cut[1], cut[2])):
        assert first[0] == 0 and last[-1] == len(data) - LENGTH and (first[1:] == last[:-1] + 1).all() and (last - first).max() < 4096
    assert set(cut[0]) == set(whole[0])
    rows = [(1, "Nd, " * 3000 + "x" * 6000, "x"), (2, "u" * 50 + "x" * 4700 + "v", "x"), (3, "d, N" * 150, "x"), (4, "q" * 4600, None)]
    want = plain([r[:2] for r in rows])
    assert made(spark, rows) == want
    assert made(spark, rows, most_pieces=1) == want


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a" * 500, "p", "q", "r", "s")], "doc_id long, text string, _k1 string, _done string, kept string, Found string")
    row = drop_repeated_bytes(docs).collect()[0]
    assert (row._k1, row._done, row.Found) == ("p", "q", "s") and bytes(row.kept) == b"" and row.n_removed == 500


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op8_suffix_arrays"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_what_stands_alone_does_not_travel(spark):
    """Of texts that share nothing, neither the bytes nor the runs go through a shuffle; the few that share still lose their passage."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(n))
    passage = text(900)
    rows = [(i, text(4000), "x") for i in range(120)] + [(1000 + i, text(300) + passage + text(300), "x") for i in range(4)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = made(spark, rows)
    assert written() - before < sum(len(t) for _, t, _ in rows) // 2
    assert got == plain([r[:2] for r in rows]) and sum(r[2] for r in got) == 4 * 900


def test_key_filter_loses_no_key(spark):
    from pyspark.sql import functions as F

    from stakelens.llm.common import key_filter

    keys = spark.range(5000).select(F.xxhash64("id").alias("v"))
    others = spark.range(5000, 30_000).select(F.xxhash64("id").alias("v"))
    for most_bits, share in ((29, 0.06), (12, 1.0)):  # a full filter lets others pass and still loses none
        may = key_filter(keys, most_bits)
        assert keys.where(may(F.col("v"))).count() == 5000
        assert others.where(may(F.col("v"))).count() <= share * 25_000
    edges = spark.createDataFrame([(0,), (-1,), (-(1 << 63),), ((1 << 63) - 1,)], "v long")
    assert edges.where(key_filter(edges)(F.col("v"))).count() == 4
    assert edges.where(key_filter(edges.limit(0))(F.col("v"))).count() == 0
