"""Edited texts held against a plain loop, fingerprints by what they must tell apart."""

import hashlib
from collections import Counter

import numpy as np

from stakelens.llm.imatch import Fingerprinter, as_text, document_frequencies, edited, fingerprint_documents, likeness, lexicon
from stakelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain(rows):
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    for i, (k, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        yield k, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op1_imatch"](spark, SF).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(plain(rows))
    prints = {}
    texts = dict(rows)
    for r in got:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in got if r.n_chars > 300 and r.fingerprint != r.edited_fingerprint]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95
    assert np.mean([r.near_edited for r in long]) > 0.2 > 0.1 > np.median([r.near_next for r in long])


def test_frequencies(spark):
    docs = spark.createDataFrame([("a b b",), ("B c",), (None,), ("",)], "text string")
    counts = document_frequencies(docs, bucket_bits=20)
    assert sorted(r.n for r in counts.collect()) == [1, 1, 2]
    bits = np.unpackbits(np.frombuffer(lexicon(counts, 4, 20, 2, 0.5), np.uint8))
    assert bits.sum() == 1 and len(bits) == 1 << 20


def test_likeness():
    maker = Fingerprinter(b"\xff" * 128)
    text = " ".join(f"w{i}" for i in range(400))
    a = maker.of(text)
    assert likeness(a, a) == 1.0 and as_text(a) == as_text(maker.of(text + " w7 w9"))
    near = likeness(a, maker.of(edited(text, " ".join(f"v{i}" for i in range(400)))))
    assert 0.05 < near < 0.7
    assert likeness(a, maker.of(" ".join(f"z{i}" for i in range(400)))) < 0.05
    assert as_text(maker.of("")) == "0" * len(as_text(a)) and likeness(maker.of(""), maker.of(" ")) == 1.0
    assert likeness(maker.of(""), a) == 0.0


def test_odd_rows(spark):
    long = "lorem ipsum dolor sit " * 40_000
    rows = [(1, None, "x"), (2, "", "x"), (None, "null id", "x"), (4, "äöü🙂 b c d", "x"), (4, "same id", "x"), (6, long, None), (6, long, None), (9, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = fingerprint_documents(docs, bucket_bits=16).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(plain([r[:2] for r in rows]))
    one = fingerprint_documents(docs.where("doc_id = 9"), bucket_bits=16).collect()
    assert [(r.n_chars, r.near_next, r.edited_sha256) for r in one] == [(3, 1.0, hashlib.sha256(b"ono").hexdigest())]
    assert fingerprint_documents(docs.limit(0), bucket_bits=16).count() == 0


def test_very_long_texts():
    maker = Fingerprinter(b"\xff" * 128)
    words = [f"w{i}" for i in range(200_000)]
    a = maker.of(" ".join(words))
    near = likeness(a, maker.of(" ".join(words[10_000:] + [f"v{i}" for i in range(10_000)])))
    half = likeness(a, maker.of(" ".join(words[100_000:] + [f"v{i}" for i in range(100_000)])))
    assert near > 0.7 and 0.05 < half < near
    assert likeness(a, maker.of(" ".join(f"z{i}" for i in range(200_000)))) < 0.05


def test_terms_of_one_bucket_keep_their_counts(spark):
    docs = spark.createDataFrame([(" ".join(f"once{d}x{i}" for i in range(400)) + " shared",) for d in range(40)], "text string")
    counts = document_frequencies(docs, bucket_bits=12)
    assert counts.count() == 16_001 and counts.where("n > 1").count() == 1
    assert np.unpackbits(np.frombuffer(lexicon(counts, 40, 12, 2, 1.0), np.uint8)).sum() == 1
    wide = lexicon(counts, 40, 12, 1, 1.0)  # 16,001 terms get a filter of their size
    assert 8 * len(wide) >= 64 * 16_001


def test_terms_travel_packed():
    """Sorted hashes take with their counts under eight bytes each on their way, and come back exactly."""
    from stakelens.llm.imatch import _packed, _unpacked

    rng = np.random.default_rng(3)
    for size, most in ((1, 2), (200, 3), (5000, 70_000)):
        term = np.unique(rng.integers(1 << 60, (1 << 60) + (1 << 53), size, dtype=np.uint64))
        n = rng.integers(1, most, len(term))
        back, counts = _unpacked(_packed(term, n))
        assert (back == term).all() and (counts == n).all()
    assert len(_packed(term, np.ones(len(term), int))) < 8 * len(term)
    edge = np.array([0, (1 << 64) - 1], np.uint64)
    assert (_unpacked(_packed(edge, np.array([1, 2])))[0] == edge).all()


def test_many_texts_at_once():
    """Fingerprints made together equal a plain loop over levels and subsets, and cost little beside the hashing of the words."""
    import time

    import xxhash

    from stakelens.llm import imatch

    def loop(text, band):
        out = np.zeros((imatch.LEVELS, imatch.COPIES), int)
        terms = imatch._hashes(text)
        kept = sorted([t for t in terms.tolist() if band(t)] or terms.tolist())
        for level in range(imatch.LEVELS):
            for copy in range(imatch.COPIES):
                drawn = [(t * int(imatch._MIX[copy])) % (1 << 64) for t in kept]
                drawn = [((x ^ (x >> 32)) * 0x9E3779B97F4A7C15) % (1 << 64) for x in drawn]
                some = [t for t, x in zip(kept, drawn) if x < 1 << (63 - level)]
                if len(kept) >> (level + 1) > imatch.DENSE and level < imatch.LEVELS - 1:
                    out[level, copy] = 0xFFF
                elif some:
                    out[level, copy] = xxhash.xxh32_intdigest(np.array(some, np.uint64).tobytes()) % 0xFFE + 1
        return out

    rng = np.random.default_rng(5)
    texts = ["", "one", " ", *[" ".join(f"w{i}" for i in rng.integers(0, 9000, n)) for n in (2, 9, 10, 40, 300, 2000)], "one"]
    for bits, band in ((b"\xff" * 128, lambda t: True), (b"\x00" * 128, lambda t: False), (b"\xaa" * 128, lambda t: t % 2 == 0)):
        prints = Fingerprinter(bits).of_all(texts)
        assert all((p == loop(t, band)).all() for t, p in zip(texts, prints))
        assert imatch.as_texts(prints) == ["".join(f"{v:03x}" for v in p.ravel().tolist()) for p in prints]
        plainly = [[likeness(a, b) for b in prints] for a in prints]
        assert (np.array(plainly) == [imatch.likenesses(np.repeat(a[None], len(prints), 0), prints) for a in prints]).all()

    many, maker = [" ".join(f"w{i}" for i in rng.integers(0, 90_000, 400)) for _ in range(150)], Fingerprinter(b"\xff" * 128)

    def cost(work):
        took = []
        for _ in range(5):
            began = time.thread_time()
            work()
            took.append(time.thread_time() - began)
        return min(took)

    assert cost(lambda: imatch.as_texts(maker.of_all(many))) < 3.5 * cost(lambda: [imatch._hashes(t) for t in many])


def test_batches_carry_the_last_text(spark, monkeypatch):
    """Cut into batches or not, the rows are the same."""
    from stakelens.llm import imatch

    rows = [(i if i % 7 else None, f"word{i % 5} " * (i % 11) + f"tail{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = Counter(map(tuple, fingerprint_documents(docs, bucket_bits=16).collect()))
    monkeypatch.setattr(imatch, "_BATCH_CHARS", 1)
    walk = fingerprint_documents(docs, bucket_bits=16)
    assert Counter(map(tuple, walk.collect())) == whole
    assert Counter((k, n, sha) for k, n, sha, *_ in whole.elements()) == Counter(plain(rows))
