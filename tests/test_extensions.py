"""Rules of a user's own in the one pass, the whole report, and record numbers of label files."""

from pyspark.sql import functions as F

from docaudit.functions.text import at_hits
from docaudit.operators import review, rules
from docaudit.plans.audit import audit
from docaudit.sources import labels


def shouts(text):
    return at_hits(text, "!{2,}", lambda t, x: rules.finding("own_shouts", "Uzvici", rules.MUST, 0.9, x["m"], "!", "Više uzvičnika.", 100, pos=x["pos"], fix=True))


OWN = rules.Rule("shouts", "Uzvici", "Uzvičnici", shouts)


def test_a_rule_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "Calm text.\nOh no!!! Really!! yes"), (2, "Calm  text.")], "doc_id long, text string")
    a = audit(docs, {"spacing", "shouts"}, "txt", extra=(OWN,))
    got = [(r.doc_id, r.finding_id, r.category, r.original) for r in a.verified.orderBy("doc_id", "seq").collect()]
    assert got == [(1, "F-0001", "Uzvici", "!!!"), (1, "F-0002", "Uzvici", "!!"), (2, "F-0001", "Razmaci", "Calm  text.")]
    assert sorted((r.doc_id, r.area, r["count"]) for r in a.passed().collect()) == [(1, "Razmaci i interpunkcija", 2), (2, "Uzvičnici", 1)]
    assert audit(docs, {"spacing"}, "txt", extra=(OWN,)).verified.count() == 1
    lines = {r.part: r.lines for r in a.report().where("doc_id = 2").collect() if r.part in (1, 2, 4)}
    assert "- Ukupno nalaza: **1**" in lines[1] and "- Provere bez grešaka: **1**" in lines[1] and "- Obavezno: **1**/1" in lines[1]
    assert lines[2].startswith("### 1. [\\(početak dokumenta\\)] Razmaci (OBAVEZNO)\n- **Original:**\n```\nCalm  text.\n```") and "(pouzdanost: 99%, rule_id: spacing_body)" in lines[2]
    assert "## Završna procena" in lines[4]
    a.done()


def test_escaping(spark):
    text = "a*b_[c](d)#1.\nx|y<z>~`\\"
    got = spark.createDataFrame([(text,)], "t string").select(review.escaped(F.col("t")).alias("e")).first().e
    assert got == "".join("\\" + c if c in "\\`*_{}[]()#+-.!|<>~" else c for c in text.replace("\n", " "))


def test_record_numbers(spark, tmp_path):
    head = ",".join(labels.COLUMNS)
    for k, n in enumerate((3, 0, 4)):
        rows = [f'd,v,r{i},f,l,0.5,1,1,me,"a ""note""\nof two lines"' for i in range(n)]
        (tmp_path / f"{k}.csv").write_text("\n".join([head, *rows]) + "\n")
    got = labels.read(spark, tmp_path.as_uri()).collect()
    assert sorted(r.line for r in got) == list(range(2, 9)) and labels.checked(labels.read(spark, tmp_path.as_uri())).count() == 7
    by = sorted((r.line, r.rule_id) for r in got)
    assert [r for _, r in by] in (["r0", "r1", "r2", "r0", "r1", "r2", "r3"], ["r0", "r1", "r2", "r3", "r0", "r1", "r2"])
