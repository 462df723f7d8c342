"""Ids of tables, rows and cells that follow from their content, not from their place in the document.

A table's id is a hash of its cells' texts, a row's of its table's id and its texts, a cell's of its row's id, its text and its
column. Equal tables of a document, and equal rows of a table, are told apart by a count; so text put in elsewhere
changes no id. Everything follows one shuffle by document; a table is gathered as its rows' texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.text import trimmed, unit_hash
from docaudit.sources import paragraphs as P


def named(h: Column) -> Column:
    return F.concat(F.lit("t-"), F.lpad(F.lower(F.conv(h.cast("string"), 10, 36)), 7, "0"))


def counted(rows: DataFrame, text: Column, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds an id of text; the second and later equal ones within by, in order, get their number into it."""
    rows = rows.withColumn("_h", unit_hash(text))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_h").orderBy(*order)))
    again = unit_hash(F.concat(F.lit("|#"), F.col("_n").cast("string")), F.col("_h"))
    return rows.withColumn(name, named(F.when(F.col("_n") > 1, again).otherwise(F.col("_h")))).drop("_h", "_n")


def identified(cells: DataFrame, doc: str = "doc_id", table: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Cells (doc, the columns of table, row_index, column_index, text) with table_id, row_id, cell_id. Null texts count as
    empty; cells of one place, which no table has, are kept in the order of their texts."""
    key = [doc, *table]
    cells = cells.repartition(doc)
    text = F.coalesce("text", F.lit(""))
    line = F.array_sort(F.collect_list(F.struct("column_index", text.alias("text"))))
    rows = cells.groupBy(*key, "row_index").agg(F.array_join(line["text"], "|").alias("_line"))
    tables = rows.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("row_index", "_line")))["_line"], "|").alias("_all"))
    tables = counted(tables, F.concat(F.lit("table|"), F.col("_all")), [doc], list(table), "table_id").drop("_all")
    rows = counted(rows.join(tables, key), F.concat("table_id", F.lit("|row|"), "_line"), [doc, "table_id"], [*table, "row_index"], "row_id").drop("_line")
    cell = unit_hash(F.concat("row_id", F.lit("|cell|"), text, F.lit("|"), F.col("column_index").cast("string")))
    return cells.join(rows, [*key, "row_index"]).withColumn("cell_id", named(cell))


def pipe_cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Cells of plain-text tables: each run of lines that hold a | is a table (ord: its first line), each line a row, cut at
    the signs; outer ones don't make cells."""
    x = P.paragraphs(docs, text_col).where(F.contains("text", F.lit("|")))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    x = x.withColumn("_run", F.col("line") - nth)
    first = F.min("line").over(Window.partitionBy("doc_id", "_run"))
    body = F.regexp_replace(F.regexp_replace(trimmed(F.col("text")), r"^\|", ""), r"\|\z", "")
    x = x.select("doc_id", first.alias("ord"), (F.col("line") - first).alias("row_index"), F.posexplode(F.split(body, r"\|", -1)).alias("column_index", "text"))
    return x.withColumn("text", trimmed(F.col("text")))
