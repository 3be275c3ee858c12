"""Encoding held against the tiktoken library, decoding against the texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row

from stakelens.llm.bpe import Encoder, StreamDecoder, TokenBytes, decode_text_column, encode_documents, read_ranks, stream_text
from stakelens.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
HARD = [
    None, "", " ", "  ", "a", "\n\n a  b\t", "don't we'll 'tis", "½x ٣ ²", "naïve Ωmega Йод абв", "中文 テスト 🙂🙂", "a" * 5000,
    "ab" * 3000, "x\x1c\x85\xa0y", "!!?...,,", "tail  \n ", "the " * 2000, "<|endoftext|>", "ñ'sé!»", "eé ñЖx",
]


@pytest.fixture(scope="module")
def both():
    ranks = read_ranks(None, PATH)
    own = Encoder(ranks, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, lib


def test_hard_and_random_texts(both):
    own, lib = both
    rng = random.Random(3)
    signs = "ab'sreTé \t\n\r\x0b\x1c\x85\xa0  12٣½_-.!,中文🙂ß́'ll've  Жd"
    texts = [t or "" for t in HARD] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("abtheing") for _ in range(rng.randint(200, 1500))) for _ in range(60)]
    for text in texts:
        assert own.encode(text).tolist() == lib.encode_ordinary(text), repr(text)


def test_pairs_fit_as_plain_merging_says(both):
    machine, rng = both[0]._machine, random.Random(5)
    tokens = sorted(machine.bytes_of)
    for _ in range(4000):
        a, b = rng.choice(tokens), rng.choice(tokens[:3000])
        plain = machine.merged(machine.bytes_of[a] + machine.bytes_of[b])
        assert machine.pair_fits(a, b) == (plain == [machine.bytes_of[a], machine.bytes_of[b]])


def test_stream_decoder_waits_for_whole_characters(both):
    own, _ = both
    text = "naïve 中文🙂 end"
    bytes_of = own._machine.bytes_of
    single = {bytes_of[i]: i for i in bytes_of if len(bytes_of[i]) == 1}
    stream = StreamDecoder(TokenBytes(own._machine.ranks))
    out = [stream.feed(np.array([single[bytes((b,))]])) for b in text.encode()]
    assert "".join(out) + stream.close() == text and "�" not in "".join(out)


def test_columns_and_query(spark, both, tmp_path):
    lib = both[1]
    rows = [Row(doc_id=i, text=t, ids="other", lang=None) for i, t in enumerate(HARD + HARD[:3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string, lang string")
    ranks = read_ranks(spark, PATH)
    out = encode_documents(docs, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "note", "lang", "ids", "decoded"]
    texts = out.withColumn("again", decode_text_column(spark, out.ids, ranks)).collect()
    for r in texts:
        assert r.ids == lib.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "") == r.again
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op9_byte_bpe"](spark, str(tmp_path)).collect()}
    for r in rows:
        ids = lib.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert QUERIES["op9_byte_bpe"](spark, str(tmp_path)).where("false").count() == 0


def test_ids_outside_the_vocabulary(spark):
    ranks = read_ranks(spark, PATH)
    frame = spark.createDataFrame([([-1, 70000, 40],), ([None, 40],), (None,), ([],)], "ids array<int>")
    got = [r.d for r in frame.select(decode_text_column(spark, frame.ids, ranks).alias("d")).collect()]
    one = {v: k for k, v in ranks.items()}[40].decode()
    assert got == [one, one, "", ""]


def test_any_ids_decode_to_their_bytes(both):
    own, rng = both[0], random.Random(7)
    table, bytes_of = TokenBytes(own._machine.ranks), own._machine.bytes_of
    for n in (0, 1, 50, 40_000):  # random ids are seldom UTF-8, and the long row is decoded in pieces
        ids = np.array([rng.randrange(len(bytes_of)) for _ in range(n)], np.int32)
        want = b"".join(bytes_of[i] for i in ids.tolist())
        assert stream_text(table, ids, "surrogateescape").encode("utf-8", "surrogateescape") == want
        assert stream_text(table, ids) == want.decode("utf-8", "replace")


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y")], "doc_id long, text string, IDS string, decoded string")
    out = encode_documents(docs, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "IDS", "decoded", "_ids", "_decoded"]
    row = out.first()
    assert (row.IDS, row.decoded, bytes(row._decoded)) == ("x", "y", b"a") and len(row._ids) == 1
