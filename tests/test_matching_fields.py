from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.functions import words
from folioscope.operators import fields as X, hybrid as H, matching as M, retrieval as R
from folioscope.sources import index, reports

CELLS = "doc_key string, page int, table_index int, row_idx int, col_idx int, cell_id bigint, text string"


def cells(spark, tables):
    """``{table: [[texts of a row]]}`` as cells, on one page."""
    rows, n = [], 0
    for t, grid in tables.items():
        for r, line in enumerate(grid):
            for c, text in enumerate(line):
                n += 1
                rows.append(("d", 1, t, r, c, n, text))
    return spark.createDataFrame(rows, CELLS)


def events(spark, a, b):
    return {(r.event, r.at_a, r.at_b, r.old, r.new) for r in M.diff_tables(cells(spark, a), cells(spark, b)).collect()}


BASE = [["Item", "Qty", "Unit price"], ["valve AB-12", "3", "9.50"], ["hose CD-7", "14", "2.25"], ["pump EF-9", "1", "120.00"]]


def test_equal_tables(spark):
    assert events(spark, {0: BASE}, {0: BASE}) == set()


def test_moved_and_renamed_columns(spark):
    other = [[r[0], r[2], r[1]] for r in BASE]
    other[0] = ["Item", "Unit prices", "Qty"]
    got = events(spark, {0: BASE}, {0: other})
    assert got == {("col_moved", 1, 2, "qty", "qty"), ("col_moved", 2, 1, "unit price", "unit prices"), ("header_renamed", 2, 1, "unit price", "unit prices")}


def test_rows_by_id_and_cells(spark):
    other = [BASE[0], ["pump EF-9", "2", "120.00"], BASE[1], ["gasket XY-1", "7", "0.10"]]
    got = events(spark, {0: BASE}, {0: other})
    assert ("cell_updated", 3, 1, "1", "2") in got and ("row_removed", 2, None, "hose CD-7 14 2.25", None) in got and ("row_added", None, 3, None, "gasket XY-1 7 0.10") in got
    assert len(got) == 3


def test_tables_by_headers(spark):
    third = [["Date", "Place"], ["2024-01-01", "bay"]]
    got = events(spark, {0: BASE, 1: third}, {0: third, 1: BASE, 2: [["Name"], ["x"]]})
    assert got == {("table_added", None, None, None, None)}


def test_empty_sides(spark):
    a = cells(spark, {0: BASE})
    assert {r.event for r in M.diff_tables(a, a.limit(0)).collect()} == {"table_removed"}
    assert M.diff_tables(a.limit(0), a.limit(0)).count() == 0


def test_headings(spark):
    text = "Intro\n=====\n\n## Scope ##x\r\nplain\nClause 7: more\n第3条 目的\nSub\n---\n"
    got = {(r.line, r.heading, r.level) for r in X.heading_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text").collect()}
    assert got == {(0, "Intro", 1), (3, "Scope ##x", 2), (5, "Clause 7: more", 2), (6, "第3条 目的", 2), (7, "Sub", 2)}


@pytest.mark.parametrize(("text", "want"), [("(1,234.5)", -1234.5), ("¥12k", 12000), ("-3.5bn", -3.5e9), ("２万", None), ("5 億", 5e8), ("12 kg", 12), (None, None), ("", None), ("none", None)])
def test_money(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(X.money(F.col("t")).alias("v")).first().v
    assert got == want


def test_nearest_by_order(spark):
    left = spark.createDataFrame([("g", 0, 1), ("g", 5, 2), ("g", 9, 3), ("h", 1, 4)], "g string, o int, id bigint")
    right = spark.createDataFrame([("g", 4, 11), ("g", 6, 12), ("g", 9, 14), ("g", 9, 13)], "g string, o int, id bigint")
    got = {(r.id, r.nearest, r.gap) for r in X.nearest_by_order(left, right, ["g"], "o", "id").collect()}
    assert got == {(1, 11, 4), (2, 11, 1), (3, 13, 0)}


def test_hash_and_types(spark):
    df = spark.createDataFrame([([1.0, -1.0, 2.0],)], "v array<double>")
    r = df.select(H.hash_bits(F.col("v")).alias("b"), H.hash_similarity(F.lit(5).cast("bigint"), F.lit(4).cast("bigint")).alias("s"), H.hash_similarity(F.lit(None).cast("bigint"), F.lit(4).cast("bigint")).alias("n")).first()
    assert (r.b, r.s, r.n) == (5, 1 - 1 / 64, 0.0)


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red valve and red hose"), (2, "blue valve"), (3, None), (4, "green pump valve valve")], "id bigint, text string")
    t = words.plain_tokens(F.col("text"))
    path = str(tmp_path / "ix")
    index.write_index(docs, "id", t, path, buckets=4)
    want = [tuple(r) for r in R.top(R.bm25(docs, "id", t, ["valve", "red"]), "id", 3).collect()]
    assert [tuple(r) for r in index.search(spark, path, ["valve", "red"], 3).collect()] == want
    assert index.search(spark, path, ["nothing"], 3).count() == 0


def test_reports_and_graph(spark, tmp_path):
    e = spark.createDataFrame([("cell_updated", "a|b", "<x>"), ("row_added", None, "y")], "event string, old string, new string")
    columns = ["event", "old", "new"]
    for form, want in (("markdown", "| cell_updated | a\\|b | <x> |"), ("html", "<tr><td>cell_updated</td><td>a|b</td><td>&lt;x&gt;</td></tr>"), ("json", '{"event":"cell_updated","old":"a|b","new":"<x>"}')):
        reports.write_report(e, columns, str(tmp_path / form), form)
        assert want in {r.value for r in spark.read.text(str(tmp_path / form)).collect()}
    edges = spark.createDataFrame([("d:1", "has", "t:1"), ("d:1", "has", "t:2"), ("t:1", "next", "t:2")], "source string, relation string, target string")
    reports.write_graph(edges, str(tmp_path / "g"))
    assert {tuple(r) for r in reports.read_graph(spark, str(tmp_path / "g")).collect()} == {tuple(r) for r in edges.collect()}
