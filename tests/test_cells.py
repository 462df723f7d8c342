"""Ids of tables, rows and cells, and what findings in cells do with them."""

from pyspark.sql import functions as F
from test_docx import p, package
from test_docx_audit import audited, table

from docaudit.operators import cells
from docaudit.plans.docx_audit import audit_units
from docaudit.sources import docx

SCHEMA = "doc_id long, ord int, row_index int, column_index int, text string"


def hashed(text):
    h = 2166136261
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = (h ^ int.from_bytes(units[i : i + 2], "little")) * 16777619 & 0xFFFFFFFF
    digits = ""
    while h:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return "t-" + digits.rjust(7, "0")


def ids_of(tables):
    """By force, for the tables of one document in order: (table, row, cell) ids by place."""
    out, seen, seen_rows = {}, {}, {}
    for o, t in tables:
        content = "table|" + "|".join("|".join(r) for r in t)
        n = seen[content] = seen.get(content, 0) + 1
        table_id = hashed(content if n == 1 else f"{content}|#{n}")
        for i, r in enumerate(t):
            line = f"{table_id}|row|" + "|".join(r)
            n = seen_rows[line] = seen_rows.get(line, 0) + 1
            row_id = hashed(line if n == 1 else f"{line}|#{n}")
            for k, c in enumerate(r):
                out[o, i, k] = (table_id, row_id, hashed(f"{row_id}|cell|{c}|{k}"))
    return out


def rows_of(doc, tables):
    return [(doc, o, i, k, c) for o, t in tables for i, r in enumerate(t) for k, c in enumerate(r)]


def test_ids_as_by_force_and_stable(spark):
    one = [["a", "b"], ["a", "b"], ["ž\U0001F600", ""]]
    tables = [(3, one), (9, [["x"]]), (12, one)]
    moved = [(1, [["put in before"]]), (30, one), (90, [["x"]]), (91, one)]
    x = spark.createDataFrame(rows_of(1, tables) + rows_of(2, moved), SCHEMA).withColumn("_n", F.lit(1)).drop("_n")
    got = {(r.doc_id, r.ord, r.row_index, r.column_index): (r.table_id, r.row_id, r.cell_id) for r in cells.identified(x).collect()}
    for doc, t in ((1, tables), (2, moved)):
        assert {k[1:]: v for k, v in got.items() if k[0] == doc} == ids_of(t)
    assert got[1, 3, 0, 0] == got[2, 30, 0, 0] and got[1, 12, 2, 1] == got[2, 91, 2, 1] and len({v[2] for k, v in got.items() if k[0] == 1}) == 13
    assert cells.identified(x.limit(0)).count() == 0


def test_pipe_tables(spark):
    text = "head\n| a | b |\n|---|---|\n|| c\n\ntext\nx | y"
    got = [(r.ord, r.row_index, r.column_index, r.text) for r in cells.pipe_cells(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()]
    assert sorted(got) == [(2, 0, 0, "a"), (2, 0, 1, "b"), (2, 1, 0, "---"), (2, 1, 1, "---"), (2, 2, 0, ""), (2, 2, 1, "c"), (7, 0, 0, "x"), (7, 0, 1, "y")]


def test_equal_cells_keep_their_findings(spark):
    a = audited(spark, {"spacing"}, d=package(p("x") + table(("alpha  beta", "alpha  beta"), ("ok", "alpha  beta"))))
    got = [(r.row_index, r.column_index, r.original) for r in a.verified.orderBy("seq").collect()]
    assert got == [(0, 0, "alpha  beta"), (0, 1, "alpha  beta"), (1, 1, "alpha  beta")]
    assert len({r.cell_id for r in a.verified.collect()}) == 3 and len({r.row_id for r in a.verified.collect()}) == 2 and len({r.table_id for r in a.verified.collect()}) == 1


def test_tall_and_wide_tables(spark):
    units = docx.units(spark.createDataFrame([("d", bytearray(package(p("x") + table(("a  b",)))))], "path string, content binary"))
    places = [(r, c) for r in (0, 21_501, 3_000_000) for c in (0, 999, 1000, 5000)]
    many = units.where("unit = 'cell'").drop("row_index", "column_index").crossJoin(spark.createDataFrame(places, "row_index int, column_index int")).select(*units.columns)
    a = audit_units(units.where("unit <> 'cell'").unionByName(many), {"spacing"})
    assert [(r.row_index, r.column_index) for r in a.verified.where("cell_id is not null").orderBy("seq").collect()] == places
