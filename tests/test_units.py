import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docaudit.operators import review
from docaudit.operators.units import direct_quote, unit_findings
from docaudit.sources import labels, workbook
from docaudit.streaming.audit import arriving, latest_status, local_findings

UNIT = "path string, unit string, ord int, text string, row_index int, column_index int, note_id string"


def test_rules_over_units(spark):
    rows = [
        ("a", "cell", 1, "two  spaces (open", 0, 1, None), ("a", "cell", 1, "„quoted  text“", 0, 2, None), ("a", "footnote", 0, "", None, None, "4"), ("a", "footnote", 1, 'je je "x', None, None, "5"),
        ("a", "header", 0, "MВ head  er", None, None, None), ("a", "body", 0, "not  here", None, None, None), ("a", "cell", 1, None, 1, 1, None),
    ]
    x = spark.createDataFrame(rows, UNIT)
    got = {(r["unit"], r["rule_id"], r["priority"]) for r in unit_findings(x, review.FULL).collect()}
    assert got == {
        ("cell", "spacing_table_cell", "OBAVEZNO"), ("cell", "unbalanced_brackets_table_cell", "OBAVEZNO"), ("cell", "spacing_table_cell", "PROVERITI"), ("footnote", "empty_note", "OBAVEZNO"),
        ("footnote", "duplicate_words_note", "OBAVEZNO"), ("footnote", "quotes_note", "OBAVEZNO"), ("header", "script_mixing_header_footer", "OBAVEZNO"), ("header", "spacing_header_footer", "OBAVEZNO"),
    }
    basic = {(r["unit"], r["rule_id"]) for r in unit_findings(x, review.BASIC).collect()}
    assert ("footnote", "empty_note") in basic and not any(u == "header" or r == "duplicate_words_note" for u, r in basic)


def test_direct_quotes(spark):
    x = spark.createDataFrame([("„a“", None, False), ("«a»", None, False), ("— a", None, False), ("a", "BlockQuote", False), ("τὸν Κάδμον", None, False), ("plain", None, True)], "t string, s string, i boolean")
    assert [r[0] for r in x.select(direct_quote(F.col("t"), F.col("s"), F.col("i"))).collect()] == [0.95, 0.90, 0.80, 0.90, 0.85, None]


def test_label_file(spark, tmp_path):
    head = ",".join(labels.COLUMNS)
    (tmp_path / "good.csv").write_text(f'{head}\nd,v,r,f,"l, ""q""",0.95,1,1.0,me,\nd,v,r,g,l,0.75,0,1.0,me,"two\nlines"\n')
    got = labels.checked(labels.read(spark, str(tmp_path / "good.csv"))).collect()
    assert [(r["label"], r["confidence"]) for r in got] == [(1, 0.95), (0, 0.75)]
    (tmp_path / "bad.csv").write_text(f"{head}\nd,v,r,f,l,0.9abc,2,1.0,me,\n,v,r,f,l,1.5,1,1.0,me,\n")
    with pytest.raises(ValueError, match="line 2: label.*line 2: predicted_confidence.*line 3: document_id.*line 3: predicted_confidence"):
        labels.checked(labels.read(spark, str(tmp_path / "bad.csv")).orderBy("line"))


def test_workbook_guards_formulas(spark):
    f = spark.createDataFrame([(1, 1, "=1+1"), (2, 1, "other")], "doc_id long, seq int, original string")
    data = workbook.export(workbook.sheets(f, f, f, 1))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = z.read("xl/worksheets/sheet2.xml").decode()
    assert "'=1+1" in sheet and "other" not in sheet


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "two  spaces"), (2, "clean")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    q = local_findings(arriving(spark, f"{tmp_path}/in"), review.FULL).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["doc_id"], r["rule_id"]) for r in spark.table("found").collect()] == [(1, "spacing_body")]
    e = spark.createDataFrame([(1, "F-1", "OPEN", 10), (1, "F-1", "DONE", 20)], "doc_id long, finding_id string, status string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert latest_status(e).first()["status"] == "DONE"
