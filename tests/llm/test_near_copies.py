"""Near copies by likeness against plain sets."""

import random

from stakelens.llm.near_copies import Signer, drop_near_copies, likeness


def _sets(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _alike(a, b):
    x, y = _sets(a), _sets(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def _edited(words, k, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), k):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def plain_kept(texts):
    """Smallest ids of the components of all pairs with a likeness of 0.8 or more or fingerprints within three bits."""
    ids = sorted(texts)
    bits = {i: Signer()(texts[i] or "")[0] for i in ids}
    sets, root, holders = {i: _sets(texts[i]) for i in ids}, {i: i for i in ids}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def link(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    for n, b in enumerate(ids):
        shared = {}
        for x in sets[b]:
            for a in holders.setdefault(x, []):
                shared[a] = shared.get(a, 0) + 1
            holders[x].append(b)
        for a, k in shared.items():
            if k >= 0.8 * (len(sets[a]) + len(sets[b]) - k):
                link(a, b)
        for a in ids[:n]:
            if (bits[a] ^ bits[b]).bit_count() <= 3:
                link(a, b)
    return {find(i) for i in ids}


def test_likeness_is_exact():
    rng = random.Random(1)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    for k in (0, 1, 5, 20, 100):
        other = _edited(base, k, rng)
        assert abs(likeness(" ".join(base), other) - _alike(" ".join(base), other)) < 1e-12
    assert likeness("", "  ") == 1.0 and likeness("", "a") == 0.0 and likeness("A b", "a  B") == 1.0


def test_long_text_signed_in_parts():
    words = [f"x{i}" for i in range(20_000)]
    one = Signer()(" ".join(words))
    assert one == Signer()(" ".join(words).upper().replace("X", "x")) and len(one[1]) == 10
    assert Signer()("") == (0, [])


def test_pairs_of_copies(spark):
    rng = random.Random(7)
    rows, alike, apart = [], [], []
    for i in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        text = " ".join(base)
        other = _edited(base, rng.choice((1, 2, 3, 4, 12, 30)), rng)
        rows += [(2 * i, text, "a"), (2 * i + 1, other, "a")]
        (alike if _alike(text, other) >= 0.8 else apart).append(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string").repartition(7)
    kept = {r.doc_id for r in drop_near_copies(docs).collect()}
    assert all(2 * i in kept for i in range(120)) and all(2 * i + 1 in kept for i in apart)
    assert sum(2 * i + 1 not in kept for i in alike) >= 0.95 * len(alike) > 40


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [
        (5, long), (None, long + " end"), (None, "one text"), (None, "another text altogether"), (None, None), (9, ""),
        (3, "same"), (3, "same"), (3, "other words here"),
    ]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _mark string")
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    want = [(5, long), (None, "one text"), (None, "another text altogether"), (9, ""), (3, "same"), (3, "other words here")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    assert drop_near_copies(docs.limit(0)).count() == 0
