from itertools import permutations

import duckdb

from stakelens.llm.filter_audit import Diagram, adjacent_swaps, audit_documents, audit_steps
from stakelens.llm.queries import QUERIES
from stakelens.llm.reference_sql import OP12_SQL


def words_of(text):
    out = [""]
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def plain(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    rows = []
    for doc_id, source, text in docs:
        text = text or ""
        words = words_of(text)
        again = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, _, t in docs)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": again,
        }
        rows.append((source or "", fails, doc_id in good and doc_id is not None, doc_id in toxic and doc_id is not None))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                mine = [r for r in rows if r[0] == part and r[1][f]]
                unique = sum(sum(r[1].values()) == 1 for r in mine)
                shapley[part, f] = shapley.get((part, f), 0) + len(hit)
                out.append([part, "".join(order), step, len(left), len(hit), sum(r[1][f] for r in gone), unique, sum(r[2] for r in hit), sum(r[3] for r in hit)])
                gone += hit
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_swaps_visit_every_order():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in adjacent_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_swap_keeps_the_counted_masks_and_shares_nodes():
    cells = {0b000: (5, 0, 0), 0b101: (2, 1, 0), 0b110: (2, 1, 0), 0b011: (3, 0, 1)}
    diagram = Diagram("ABC", cells, 3)

    def read():
        out = {}
        for mask in range(8):
            bits = {n: mask >> (2 - i) & 1 for i, n in enumerate("ABC")}
            node = 0
            for level, name in enumerate(diagram.order):
                node = diagram.nodes[level][node][bits[name]]
            out[mask] = diagram.weights[-1][node]
        return out

    want = read()
    assert all(want[m] == cells.get(m, (0, 0, 0)) for m in range(8)) and diagram.weights[0] == [(12, 2, 1)]
    for at in [*adjacent_swaps(3), 0, 1, 0]:
        diagram.swap(at)
        assert read() == want and diagram.weights[0] == [(12, 2, 1)]
        assert all(len(set(level)) == len(level) for level in diagram.nodes[1:])
    assert len(Diagram("ABCDE", {0: (1, 0, 0)}, 3).nodes[4]) == 2  # one with the row, one without any


def test_no_cells():
    assert all(row[2:] == (0,) * 7 for row in audit_steps("ABCDE", {})) and len(audit_steps("ABCDE", {})) == 600


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op12_filter_diagrams"](spark, sf)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = con.sql(OP12_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


long = " ".join(f"w{i}" for i in range(60))
DOCS = [
    *[(100 + i, "hot", long) for i in range(40)],
    (1, "hot", long), (1, "hot", long), (1, "cold", long), (None, "hot", long), (None, None, long),
    (2, None, None), (3, "", ""), (4, "x", "A" * 3000), (5, "x", "a b " * 5000), (6, "x", "$ 5"), (7, "x", "  "),
    (8, "y", "É" * 10 + " \x0b\x0c\t"), (9, "y", " ".join(["A"] + ["b%d" % i for i in range(49)])),
]
LABELS = [(1, 1, 0), (1, 0, 1), (105, 1, 1), (4, None, 1), (None, 1, 1), (999, 1, 1), (5, 0, 0)]


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*d, 1, "m") for d in DOCS], "doc_id long, source string, text string, n int, mask string").repartition(4)
    labels = spark.createDataFrame([(*r, 9) for r in LABELS], "doc_id long, quality int, toxic int, n int")
    assert sorted(map(tuple, audit_documents(docs, labels).collect())) == plain(DOCS, LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_documents(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "b")], docs.schema)
    assert sorted(map(tuple, audit_documents(one, labels).collect())) == plain([(1, "a", "b")], [])
