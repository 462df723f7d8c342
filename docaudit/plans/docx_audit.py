"""The audit of DOCX files as one plan: units -> findings of body, notes, cells, headers, footers and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.operators import cells, review, rules
from docaudit.operators import units as U
from docaudit.plans.audit import Audit
from docaudit.sources import paragraphs as P
from docaudit.sources.shared import persisted

# Fixed value: the category of what an audit doesn't cover.
COVERAGE = "Pokrivenost"
CELL = {"table_id": "string", "row_id": "string", "cell_id": "string", "row_index": "int", "column_index": "int"}
COLUMNS = [*rules.PLACE, *[x.split(":")[0] for x in rules.FINDING[len("array<struct<"):-2].split(",")], "stands", *CELL]


def body(units: DataFrame) -> DataFrame:
    """Elements of bodies with ids and sections. The text of a table isn't audited as a paragraph: its cells are
    units of their own; its words in capitals still count as listed."""
    x = units.where("unit = 'body'").withColumnRenamed("path", "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    x = P.identified(P.sections(x.drop("unit", "error")))
    table = F.col("type") == "table"
    x = x.withColumns({"table_text": F.col("text"), "text": F.when(table, "").otherwise(F.col("text"))})
    listed = F.col("number").isNotNull() & ~F.coalesce("num_fmt", F.lit("none")).isin("bullet", "none")
    key = F.when(listed, F.coalesce("list_id", F.concat_ws("-", "num_id", F.coalesce("num_level", F.lit(0)).cast("string"))))
    before = F.lag(F.struct("number", "label")).over(Window.partitionBy("doc_id", key).orderBy("ord"))
    return x.withColumn("list_before", F.when(listed, before))


def located(units: DataFrame) -> DataFrame:
    """Units whose cells have ids of their table, row and own; nested tables of one depth count as one."""
    cell = F.col("unit") == "cell"
    return cells.identified(units.where(cell), "path", ("ord", "depth")).unionByName(units.where(~cell), allowMissingColumns=True)


def elsewhere(found: DataFrame) -> DataFrame:
    """Findings that no cell has, with the columns of cells."""
    return found.withColumns({"sub_ord": F.col("sub_ord").cast("long"), **{c: F.lit(None).cast(kind) for c, kind in CELL.items()}}).select(*COLUMNS)


def beside(units: DataFrame, elements: DataFrame, options: set[str]) -> DataFrame:
    """Findings in cells, notes, headers and footers with their place; a cell has the section and id of its table."""
    found = U.unit_findings(located(units), options)
    if found is None:
        return None
    tables = elements.where("type = 'table'").select(F.col("doc_id").alias("path"), "ord", F.col("section").alias("t_section"), F.col("paragraph_id").alias("t_id"))
    x = found.join(tables.withColumn("unit", F.lit("cell")), ["path", "ord", "unit"], "left")
    unit, note = F.col("unit"), F.coalesce("note_id", F.lit(""))
    named = lambda **k: F.coalesce(*[F.when(unit == u, c) for u, c in k.items()])
    section = named(cell=F.col("t_section"), footnote=rules.quoted("(fusnota ", note, ")"), endnote=rules.quoted("(endnota ", note, ")"), header=F.lit("(zaglavlje)"), footer=F.lit("(podnožje)"))
    place = F.col("ord").cast("string")
    ids = named(cell=F.col("t_id"), footnote=F.concat(F.lit("fn-"), note), endnote=F.concat(F.lit("en-"), note), header=F.concat(F.lit("hdr-"), place), footer=F.concat(F.lit("ftr-"), place))
    check = F.when(unit == "cell", review.CELL_CHECK).when(unit.isin("header", "footer"), review.MARGIN_CHECK).otherwise(review.NOTE_CHECK)
    # places within cells go before those within a text: rows, then columns (under a million of them), then checks
    at = F.coalesce("row_index", F.lit(0)).cast("long") * 2**20 + F.coalesce("column_index", F.lit(0))
    x = x.withColumns({"doc_id": F.col("path"), "section": section, "paragraph_id": ids, "sub_ord": at * 128 + F.col("check_ord")})
    return x.withColumn("check_ord", check).select(*COLUMNS)


def uncovered(units: DataFrame, options: set[str]) -> DataFrame:
    """One finding for each document that holds what the audit covers in part or not at all."""
    done = {"headersFooters": ("headers", "footers"), "footnotes": ("footnotes", "endnotes")}
    skip = [name for k, names in done.items() if k in options for name in names]
    x = units.where("unit = 'coverage'").where(~F.col("text").isin(skip)).groupBy(F.col("path").alias("doc_id")).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("type") == k, F.struct("ord", "text")))).alias(k) for k in ("partial", "unsupported")]
    )
    names = lambda k, head: F.when(F.size(k) > 0, F.concat(F.lit(head), F.array_join(F.col(k)["text"], ", ")))
    original = F.concat_ws(". ", names("partial", "Delimično: "), names("unsupported", "Nije obrađeno: "))
    made = rules.finding(
        "processing_coverage", COVERAGE, rules.CHECK, 1.0, original, "[proveriti navedene delove dokumenta ručno]",
        "Dokument sadrži elemente koji nisu potpuno obrađeni. Rezultat audita može biti nepotpun.", review.COVERAGE_CHECK)
    place = {"ord": F.lit(-1), "section": F.lit("(pokrivenost)"), "paragraph_id": F.lit("doc-coverage"), "is_direct_quote": F.lit(False), "f": made}
    return x.withColumns(place).select(*rules.PLACE, "f.*", F.lit(True).alias("stands"))


def audit_units(units: DataFrame, options: set[str] | None = None) -> Audit:
    """units: rows of sources.docx. Packages are parsed once; units and marked elements go to the shared folder."""
    options = review.FULL if options is None else options
    units = persisted(units, "units")
    marked = persisted(rules.marked(body(units), options, "docx"), "marked")
    found = elsewhere(U.demoted(rules.candidates(marked, options), F.col("is_direct_quote")))
    side = beside(units, marked, options)
    found = (found if side is None else found.unionByName(side)).unionByName(elsewhere(uncovered(units, options)))
    found = review.numbered(found)
    docs = units.where("error is null").select(F.col("path").alias("doc_id")).distinct()
    notes = units.where("unit in ('footnote', 'endnote')").select(F.col("path").alias("doc_id"))
    return Audit(marked, found, review.verified(found), docs, frozenset(options), notes)
