"""Fingerprints and components held against plain loops."""

import random

import numpy as np
import xxhash

from stakelens.llm.components import components
from stakelens.llm.queries import QUERIES
from stakelens.llm.simhash import VantageTree, _Groups, drop_near_copies, fingerprint, link_within, near_links


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in ids}


def test_fingerprint():
    for text in ("", " \n", "One", "One two", "A b C d e\tf\x0bg", "Äß É x y z " * 50):
        assert fingerprint(text) == plain_print(text)


def test_query_against_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: plain_print(t) for k, t in docs.items()}
    want = plain_components(prints)
    got = QUERIES["op7_vantage_simhash"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_links_of_close_fingerprints(spark):
    rng = random.Random(1)
    points = {rng.getrandbits(64) for _ in range(500)}
    for p in list(points)[:200]:
        q = p
        for _ in range(rng.randint(1, 6)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                q ^= 1 << b
            points.add(q)
    want = plain_components({p: p for p in points})
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(signed(p),) for p in points] + [(None,)], "bits long")
    roots = {r.node: r.root for r in components(near_links(frame, shard_rows=40), "a", "b").collect()}
    groups = {}
    for p in points:
        groups.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
    expected = {}
    for p, r in want.items():
        expected.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_dense_and_equal_points():
    base = np.uint64(0x123456789ABCDEF0)
    points = np.array([base ^ np.uint64((1 << i) | (1 << j)) for i in range(64) for j in range(i)] * 2, np.uint64)
    groups = _Groups(len(points))
    link_within(points, len(points), 3, groups)
    assert (groups.of == 0).all()
    tree = VantageTree(np.full(9, base, np.uint64), 4)
    assert tree.visits(points, 3)[2].sum() == len(points)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(300)] + [(rng.randint(500, 700), rng.randint(500, 700)) for _ in range(150)] + [(1, None), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(frame, "a", "b").collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(frame.limit(0), "a", "b").count() == 0


def test_odd_rows(spark):
    long = "lorem ipsum dolor " * 30_000
    rows = [(5, None, "x"), (3, "", "x"), (None, " ", "y"), (9, long, "x"), (8, long, None), (7, "alone in here", "x"), (7, "alone in here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string")
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, ""), (7, "alone in here"), (8, long)]
    assert drop_near_copies(docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    apart = ["the cat sat here today", "a stone bridge over water", "seven green bottles fell down", "ships sail out at dawn"]
    rows = [(None, t, "x") for t in apart] + [(None, apart[0], "y")]  # a copy without id goes
    rows += [(1, "first text under this id", "x"), (1, "quite other words and numbers", "x")]  # unlike texts, both first of their group
    rows += [(2, "twice the same words", "x"), (2, "Twice the same WORDS", "x"), (3, "twice the same words", "x")]  # near copies under one id
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string")
    kept = [(r.doc_id, r.text) for r in drop_near_copies(docs).collect()]
    assert sorted(t for k, t in kept if k is None) == sorted(apart)
    assert sorted(t for k, t in kept if k == 1) == ["first text under this id", "quite other words and numbers"]
    assert [k for k, t in kept if t.lower() == "twice the same words"] == [2] and len(kept) == 7
