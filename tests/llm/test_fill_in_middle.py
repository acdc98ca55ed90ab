"""Operator 11 against a brute-force version in plain Python, over chunks of every size."""

import hashlib

import pytest

from tests.llm.helpers import DOCS, as_rows, documents, edge_docs, edge_rows, empty_docs
from glenfare.llm import fill_in_middle as M

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text):
    """From the statement of the operator, whole strings only; the output as well."""
    text = text or ""
    hexed = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(hexed[8 * k:8 * k + 8], 16) for k in range(4)]
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return (doc_id, len(text), "plain", None, None, sha(text), sha(text)), text
    c = [h[0] % (len(text) + 1), h[1] % (len(text) + 1)]
    a, b = min(c), max(c)
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(text), form, a, b - a, sha(out), sha(text)), out


@pytest.mark.parametrize("size", [1, 3, 1000, M.CHUNK])
def test_edge_rows(spark, size):
    tricky = [(100 + k, t, None, None, None) for k, t in enumerate(
        ["<P>", "a<S>b", "<" * 50, "<P" * 30, "<M<S<P" * 9, "x>" * 40, "😀é" * 20, "a", "\x00b", "<S" + "x" * 30, "P><" * 20] * 3)]
    rows = [r for r in edge_rows() + tricky if size > 1 or len(r[1] or "") < 5000]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = as_rows(M.transform(df, size), *COLUMNS)
    assert got == sorted([brute(r[0], r[1])[0] for r in rows], key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_pieces_make_the_output(spark):
    """The chunks by place are the output itself; none is longer than asked for."""
    rows = [r for r in edge_rows()]
    out = {}
    for r in M.emit_pieces(spark.createDataFrame(rows, DOCS).repartition(2), 7).collect():
        out.setdefault((r["task"], r["row"]), []).append((r["place"], r["chunk"], r["doc_id"]))
    texts = sorted("".join(c for _, c, _ in sorted(v, key=lambda x: x[0]) if c) for v in out.values())
    assert texts == sorted(brute(r[0], r[1])[1] for r in rows)
    assert max(len(c or "") for v in out.values() for _, c, _ in v) <= 7 + 3


def test_restoring_needs_the_output_alone():
    """Any split of the output into chunks is taken apart alike."""
    for form, out, want in (("psm", "<P>ab<<S>cd<M<M>ef<S>", [(0, "ab<"), (2, "cd<M"), (1, "ef<S>")]),
                            ("spm", "<S><P><M>", []), ("spm", "<S>x<P><P<M>", [(2, "x"), (0, "<P")]), ("plain", "<P>a", [(0, "<P>a")])):
        for size in range(1, len(out) + 1):
            t, got = M.Taker(form), {}
            parts = [x for k in range(0, len(out), size) for x in t.feed(out[k:k + size])] + list(t.end())
            for section, text in parts:
                got[section] = got.get(section, "") + text
            assert got == dict(want), (form, size)


def test_clashing_columns_and_empty_table(spark):
    assert M.transform(edge_docs(spark)).count() == len(edge_rows())
    e = M.transform(empty_docs(spark))
    assert e.count() == 0 and e.columns == COLUMNS


def test_query_matches_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(M.SQL["op11_fill_in_middle"]).fetchall()
    got = as_rows(M.op11_fill_in_middle(spark, sf), *COLUMNS)
    assert got == sorted(want, key=repr)
    assert len(got) == documents(spark).count()
