"""Plain text and Markdown as ordered elements: doc_id, ord, line, type, level, text, section, id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.text import WS, trimmed, unit_hash

# Fixed value: the section of what stands before the first heading.
FIRST_SECTION = "(početak dokumenta)"
HEADING = f"^(#{{1,6}}){WS}+(.*)\\z"


def lines(text: Column) -> Column:
    """Non-blank lines of a text with their numbers, as array<struct<line, text>>; order is document order."""
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    return F.filter(numbered, lambda x: trimmed(x["text"]) != "")


def paragraphs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each non-blank line. Positions come from the array, so nothing is shuffled."""
    return docs.select("doc_id", F.posexplode(lines(F.col(text_col))).alias("ord", "x")).select(
        "doc_id", "ord", F.col("x.line").alias("line"), F.col("x.text").alias("text")
    )


def elements(docs: DataFrame, kind: str = "markdown", text_col: str = "text") -> DataFrame:
    """Elements of texts; in Markdown, lines led by # signs are headings."""
    rows = paragraphs(docs, text_col)
    if kind != "markdown":
        return rows.withColumns({"type": F.lit("paragraph"), "level": F.lit(None).cast("int")})
    found = F.col("text").rlike(HEADING)
    return rows.withColumns({
        "type": F.when(found, "heading").otherwise("paragraph"),
        "level": F.when(found, F.length(F.regexp_extract("text", HEADING, 1))),
        "text": F.when(found, F.regexp_extract("text", HEADING, 2)).otherwise(F.col("text")),
    })


def in_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("ord")


def sections(rows: DataFrame) -> DataFrame:
    """Adds the text of the last heading that isn't blank, itself included."""
    title = F.when((F.col("type") == "heading") & (trimmed(F.col("text")) != ""), trimmed(F.col("text")))
    last = F.last(title, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("section", F.coalesce(last, F.lit(FIRST_SECTION)))


def identified(rows: DataFrame) -> DataFrame:
    """Adds an id that depends on the element and its neighbours' first 30 characters, not on its place."""
    w = in_order()
    near = lambda c: F.coalesce(F.substring(c, 1, 30), F.lit(""))
    style = F.when(F.col("type") == "heading", F.concat(F.lit("Heading"), F.col("level").cast("string"))).otherwise("Normal")
    style = F.coalesce("style", style) if "style" in rows.columns else style
    key = F.concat_ws("|", "type", style, "text", near(F.lag("text").over(w)), near(F.lead("text").over(w)))
    letter = F.when(F.col("type") == "heading", "h-").when(F.col("type") == "table", "t-").otherwise("p-")
    named = lambda h: F.concat(letter, F.lpad(F.lower(F.conv(h.cast("string"), 10, 36)), 7, "0"))
    rows = rows.withColumn("_h", unit_hash(key))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "type", "_h").orderBy("ord")))
    again = unit_hash(F.concat(F.lit("|#"), F.col("_n").cast("string")), F.col("_h"))
    return rows.withColumn("id", named(F.when(F.col("_n") > 1, again).otherwise(F.col("_h")))).drop("_h", "_n")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{WS}+", -1), lambda x: x != "")).cast("long")


def language(text: Column) -> Column:
    """Script dominance in the first 5000 characters: sr-Cyrl, sr-Latn, or sr where neither is double."""
    head = F.substring(text, 1, 5000)
    cyrillic = F.regexp_count(head, F.lit(r"[\x{0400}-\x{04FF}]"))
    latin = F.regexp_count(head, F.lit(r"[a-zA-Z\x{00C0}-\x{024F}]"))
    return F.when(cyrillic > 2 * latin, "sr-Cyrl").when(latin > 2 * cyrillic, "sr-Latn").otherwise("sr")
