"""The local rules over table cells, notes, headers and footers (units of a DOCX source).

They are the body's columns under other rule ids, fewer kinds of them, and wording that names the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import count_of, cut, let
from docaudit.operators import rules as R
from docaudit.operators.rules import direct_quote as direct_quote

# Places in findings' wording, and the kinds of spacing and Markdown that each place is checked for.
PLACES = {"cell": "ćeliji", "footnote": "fusnota", "endnote": "endnota", "header": "zaglavlju", "footer": "podnožju"}
NAMES = {"footnote": "Fusnota", "endnote": "Endnota"}
SUFFIX = {"cell": "table_cell", "footnote": "note", "endnote": "note", "header": "header_footer", "footer": "header_footer"}
SPACES = {"cell": (1, 2, 5), "footnote": (1, 2, 3, 5), "endnote": (1, 2, 3, 5), "header": (1,), "footer": (1,)}
FEW_MARKS = [R.MARKDOWN_PATTERNS[i] for i in (0, 1, 7, 8)]
QUOTED = r"^(\x{201E}[\s\S]*\x{201C}|\x{00AB}[\s\S]*\x{00BB})\z"


def placed(found: Column, place: str) -> Column:
    """Wording with the place before the final full stop."""
    return F.transform(found, lambda f: f.withField("rationale", F.concat(F.regexp_replace(F.regexp_replace(f["rationale"], " u blizini", ""), r"\.\z", ""), F.lit(f" u {place}."))))


def bracket_findings(text: Column, rule: str, place: str) -> Column:
    def made(e: Column) -> Column:
        why = (
            F.when(e["kind"] == "crossed", R.quoted("Ukrštene zagrade: ", e["open"], "...", e["close"], "."))
            .when(e["kind"] == "orphan_close", R.quoted("Zatvorena ", e["close"], " bez otvorene.")).otherwise(R.quoted("Otvorena ", e["open"], " bez zatvorene."))
        )
        return R.finding(rule, R.BRACKETS, R.MUST, 0.95, F.substring(text, 1, 50), f"[neuparene/ukrštene zagrade u {place}]", why, 0, pos=e["pos"])

    return F.transform(R.bracket_errors(text), made)


def straight(text: Column, rule: str, place: str) -> Column:
    n = count_of(text, '"').cast("string")
    one = R.finding(rule, R.QUOTES, R.MUST, 0.95, R.quoted("[", n, f" ravnih navodnika u {place}]"), "[zameniti tipografskim]", R.quoted(n, " ravnih navodnika."), 1, fix=True)
    return F.when(text.contains('"'), F.array(one)).otherwise(F.lit(None).cast(R.FINDING))


def unit_rules(unit: str, options: set[str]) -> list[Column]:
    """Columns of array<finding> for one kind of unit."""
    t, place, s = F.col("text"), PLACES[unit], SUFFIX[unit]
    note = s == "note"
    if (note and "noteContentChecks" not in options) or (s == "header_footer" and "headersFooters" not in options):
        return []
    made = {
        "spacing": lambda: R.spacing(t, f"spacing_{s}", SPACES[unit], radius=20), "brackets": lambda: bracket_findings(t, f"unbalanced_brackets_{s}", place),
        "scriptMix": lambda: R.script_mix(t, f"script_mixing_{s}"), "duplicates": lambda: R.duplicate_words(t, f"duplicate_words_{s}"),
        "urls": lambda: F.filter(R.urls(t, f"urls_{s}", long=False), lambda f: f["confidence"] == 0.80),
    }
    if unit != "cell":
        made["quotes"] = lambda: straight(t, f"quotes_{s}", place)
    if not note:
        made |= {"greek": lambda: R.greek(t, f"greek_{s}"), "markdown": lambda: R.markdown_left(t, f"markdown_{s}", FEW_MARKS)}
    return [placed(F.coalesce(f(), F.expr(f"cast(array() as {R.FINDING})")), place) for k, f in made.items() if k in options]


def demoted(found: DataFrame, quote: Column) -> DataFrame:
    """Findings in direct quotes are to be checked, not fixed."""
    return found.withColumns({
        "is_direct_quote": quote, "priority": F.when(quote, R.CHECK).otherwise(F.col("priority")), "auto_fixable": F.col("auto_fixable") & ~quote,
        "requires_source_verification": F.col("requires_source_verification") | quote,
    })


def unit_findings(units: DataFrame, options: set[str]) -> DataFrame:
    """units (path, unit, ord, text, row_index, column_index, note_id, and ids of cells if there are any) -> findings
    with their place and whether they stand in their text, which only cells are asked for. Notes without text are findings
    themselves; quotes in cells and notes are demoted."""
    out = None
    keys = ["path", "unit", "ord", "row_index", "column_index", "note_id", *[c for c in ("table_id", "row_id", "cell_id") if c in units.columns]]
    for unit in PLACES:
        own = units.where((F.col("unit") == unit) & F.col("text").isNotNull())
        parts = unit_rules(unit, options)
        if SUFFIX[unit] == "note" and "emptyNotes" in options and "footnotes" in options:
            name, low = NAMES[unit], NAMES[unit].lower()
            original = R.quoted(f"[{name} ", F.coalesce("note_id", F.lit("")), " - prazna]")
            empty = R.finding("empty_note", R.NOTES, R.MUST, 0.99, original, "[dodati sadržaj]", f"Prazna {low}.", 11)
            parts = [*parts, F.when(R.trimmed(F.col("text")) == "", F.array(empty)).otherwise(F.expr(f"cast(array() as {R.FINDING})"))]
        if not parts:
            continue
        form = R.trimmed(F.col("text")).rlike(QUOTED) if unit in ("cell", "footnote", "endnote") else F.lit(False)
        if unit == "cell":
            form = form | R.trimmed(F.col("text")).rlike(r"^[\x{2014}\x{2015}]\s")
        stands = (lambda t: lambda f: R.stands_in(F.col("text"), f, t)) if unit == "cell" else (lambda t: lambda f: F.lit(True))
        told = let(cut(F.col("text")), lambda t: F.transform(F.concat(*parts), lambda f: f.withField("stands", stands(t)(f))))
        found = own.select(*keys, form.alias("_q"), F.explode(told).alias("f")).select(*keys, "_q", "f.*")
        found = demoted(found, F.col("_q")).drop("_q")
        out = found if out is None else out.unionByName(found)
    return out
