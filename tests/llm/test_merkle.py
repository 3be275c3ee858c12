import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from stakelens.llm.merkle import FIELDS, tampered, verified_manifest
from stakelens.llm.queries import QUERIES
from stakelens.llm.reference_sql import OP13_SQL

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, at, fanout):
    for nodes in tree[:-1]:
        first = at // fanout * fanout
        yield nodes[first:at], nodes[at + 1 : first + fanout]
        at //= fanout


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, changed, fanout=16):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = [levels([leaf(r, r[4]) for r in by[name]], fanout) for name in names]
    top = levels([t[-1][0] for t in trees], fanout)
    for j, name in enumerate(names):
        for i, row in enumerate(by[name]):
            path = [*siblings(trees[j], i, fanout), *siblings(top, j, fanout)]
            node = leaf(row, lower(row[4]) if changed(row) else row[4])
            for a, b in path:
                node = digest(*a, node, *b)
            proof = digest(*[x for a, b in path for x in (*a, *b)])
            yield trees[j][0][i], trees[j][-1][0], top[-1][0], proof, node, node == top[-1][0]


def check(got, rows, changed):
    assert sorted(tuple(r)[1:] for r in got) == sorted(plain(rows, changed))


def test_query_against_sql_and_loops(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_merkle_manifest"](spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.sql(OP13_SQL).fetchall())
    import zlib

    rows = [tuple(r[c] for c in FIELDS) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(got, rows, lambda r: zlib.crc32(str(r[0]).encode()) % 5 == 0)
    assert {r[0] for r in got if not r[6]} <= {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}


ODD = [
    *[(i, "hot", "en", i, f"Text {i}") for i in range(300)],  # three levels
    *[(i, "sixteen", "en", 1, "A") for i in range(16)],
    *[(i, "seventeen", "en", 1, "A") for i in range(17)],
    (7, "lone", None, None, None),
    (None, None, "fr", 3, ""),
    (None, None, "fr", 3, "Né À Z"),
    (5, None, "fr", 3, "X" * 20000),
    (5, "", "de", 0, ""),
    (9, "twice", "de", 1, "Same"),
    (9, "twice", "de", 1, "Same"),
    (9, "twice", "de", 1, "Other"),
    (1, "zé", "de", 1, "one"),
    (1, "z~", "de", 1, "one"),
]


def test_odd_rows_and_clashing_columns(spark):
    frame = spark.createDataFrame([(*r, "x", 1) for r in ODD], f"{SCHEMA}, pos string, s0 int").repartition(5)
    got = verified_manifest(frame, tampered(F.col("doc_id") == 5)).collect()
    check(got, ODD, lambda r: r[0] == 5)
    by = {r.leaf: r.verified for r in got}
    assert not by[leaf((5, None, "fr", 3), "X" * 20000)] and by[leaf((5, "", "de", 0), "")]


def test_few_rows(spark):
    for rows in ([], [(1, "a", "en", 2, "Ab")], [(1, "a", "en", 2, "Ab"), (1, "b", "en", 2, "Ab")]):
        frame = spark.createDataFrame(rows, SCHEMA)
        check(verified_manifest(frame, tampered(F.lit(True))).collect(), rows, lambda r: True)


@pytest.mark.parametrize("fanout", [2, 3])
def test_other_fanouts(spark, fanout):
    from stakelens.llm.merkle import manifest, proof_of

    frame = spark.createDataFrame(ODD, SCHEMA).withColumn("now", F.lit(""))
    got = sorted((r.leaf, r.subroot, r.root, r.proof) for r in manifest(frame, fanout=fanout).withColumn("proof", proof_of("path")).collect())
    assert got == sorted(r[:4] for r in plain(ODD, lambda r: False, fanout))
