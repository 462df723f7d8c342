"""What follows the rules: order, verification, summary, gate, patterns, review and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.operators import rules as R

# Options by preset, and the check's name, its option and its category.
BASIC = {"brackets", "spacing", "scriptMix", "duplicates", "quotes", "emptyNotes", "footnotes"}
FULL = BASIC | {
    "noteContentChecks", "toc", "bibliography", "capsWords", "numbering", "greek", "markdown", "urls", "emptyHeadings", "repetition", "headersFooters",
}
CHECKS = [
    ("brackets", R.BRACKETS, "Nebalansirane zagrade"), ("quotes", R.QUOTES, "Navodnici"), ("markdown", R.MARKDOWN, "Markdown artefakti"),
    ("spacing", R.SPACING, "Razmaci i interpunkcija"), ("scriptMix", R.SCRIPT, "Mešanje ćirilice/latinice"), ("greek", R.GREEK, "Grčki citati bez prevoda"),
    ("duplicates", R.DOUBLED, "Duple reči"), ("toc", R.TOC, "TOC vs naslovi"), ("numbering", R.NUMBERING, "Numeracija lista"),
    ("bibliography", R.BIBLIOGRAPHY, "Bibliografija"), ("urls", R.URL, "URL-ovi"), ("repetition", R.REPETITION, "Ponovljeni pasusi"),
    ("capsWords", R.CAPITALS, "ALL-CAPS reči"), ("emptyHeadings", R.STRUCTURE, "Prazni naslovi"),
]
# What an audit must have covered to be final, and the words for it.
REQUIRED = ("grammar", "visual_layout", "style")
COVERED = {"proofreading": "determinističke provere", "grammar": "gramatička analiza", "style": "stilska analiza", "visual_layout": "vizuelni pregled"}
LACKING = {"grammar": "gramatika", "style": "stil", "visual_layout": "vizuelni prelom"}
LEAST_CONFIDENCE = 0.60
#: Places of the checks of notes, cells, headers and footers, and coverage in the order of findings.
NOTE_CHECK, CELL_CHECK, MARGIN_CHECK, COVERAGE_CHECK = 11, 20, 21, 22


def numbered(found: DataFrame) -> DataFrame:
    """Findings in the order of their checks and places, with seq and finding_id."""
    order = Window.partitionBy("doc_id").orderBy("check_ord", "ord", "sub_ord", "match_pos", "original", "replacement")
    x = found.withColumn("seq", F.row_number().over(order))
    return x.withColumns({"finding_id": F.format_string("F-%04d", "seq"), "status": F.lit("OPEN")})


def verified(found: DataFrame) -> DataFrame:
    """Drops findings that change nothing, repeat an earlier one of their element or cell, are too uncertain, or
    whose text doesn't stand in their element. The window's key begins with that of numbered(), so nothing is
    shuffled again."""
    x = found.where(~F.col("original").eqNullSafe(F.col("replacement")))
    cell = ["cell_id"] if "cell_id" in found.columns else []
    key = Window.partitionBy("doc_id", "paragraph_id", *cell, "category", "original", "replacement").orderBy("seq")
    x = x.withColumn("_n", F.row_number().over(key)).where((F.col("_n") == 1) & (F.col("confidence") >= LEAST_CONFIDENCE))
    return x.where("stands").drop("_n", "stands")


def scanned(rows: DataFrame, checks=CHECKS) -> DataFrame:
    """Marked elements -> doc_id, check, count: the elements each check looks at."""
    bits = [F.sum(F.shiftright("seen", i).bitwiseAND(F.lit(1)).cast("long")).alias(f"_{i}") for i in range(len(checks))]
    each = F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"_{i}").alias("count")) for i, (k, *_) in enumerate(checks)])
    return rows.groupBy("doc_id").agg(*bits).select("doc_id", F.inline(each))


def passed_checks(found: DataFrame, rows: DataFrame, options: set[str], notes: DataFrame | None = None, extra: tuple[R.Rule, ...] = ()) -> DataFrame:
    """Checks that are on and have no finding of their category, before verification. notes (doc_id, one row for
    each note) adds the check of notes, which any finding in a note fails."""
    checks = [*CHECKS, *[(r.option, r.category, r.area) for r in extra]]
    named = lambda i: F.element_at(F.create_map(*[F.lit(y) for x in checks for y in (x[0], x[i])]), F.col("check"))
    counts = scanned(rows, checks).where(F.col("check").isin(sorted(options))).withColumns({"category": named(1), "area": named(2)})
    some = found.select("doc_id", "category").distinct()
    passed = counts.join(some, ["doc_id", "category"], "left_anti").select("doc_id", "area", "count")
    if notes is not None and "footnotes" in options:
        each = rows.select("doc_id").distinct().join(notes.groupBy("doc_id").agg(F.count("*").alias("count")), "doc_id", "left").fillna(0, ["count"])
        failed = found.where(F.col("check_ord") == NOTE_CHECK).select("doc_id").distinct()
        passed = passed.unionByName(each.join(failed, "doc_id", "left_anti").select("doc_id", F.lit("Fusnote").alias("area"), "count"))
    return passed.select("doc_id", "area", F.lit("Bez grešaka").alias("result"), "count")


def scope(options: set[str], preset: str = "full") -> dict:
    """What an audit with these options covers, and a note that says so."""
    on = {
        "preset": preset, "proofreading": bool(set(options) & {*(k for k, *_ in CHECKS), "footnotes"}), "grammar": "grammar" in options, "style": "style" in options,
        "bibliography": "bibliography" in options, "visual_layout": "visualLayout" in options, "fact_checking": False, "web_research": False,
    }
    done, not_done = ", ".join(v for k, v in COVERED.items() if on[k]), lacking(on)
    return on | {"note": f"Izvršeno: {done or 'ništa'}." + (f" Nije izvršeno: {not_done}." if not_done else "")}


def lacking(on: dict) -> str:
    return ", ".join(v for k, v in LACKING.items() if not on[k])


def summary(found: DataFrame, docs: DataFrame, options: set[str] = FULL, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Counts of each document by priority and status, also of documents without findings; the gate: all that is
    required was covered, and no blocker, mandatory or verification finding is open."""
    count = lambda c: F.count_if(c).cast("long")
    p, is_open = F.col("priority"), F.col("status") == "OPEN"
    sums = found.groupBy("doc_id").agg(
        F.count("*").alias("total"), count(p == "BLOCKER").alias("blocker"), count(p == R.MUST).alias("mandatory"), count(p == R.CHECK).alias("verify"),
        count(p == R.SHOULD).alias("recommended"), count(is_open).alias("open"), count(F.col("status") == "DONE").alias("done"),
        count(F.col("status") == "REJECTED").alias("rejected"), count(is_open & (p == "BLOCKER")).alias("open_blocker"),
        count(is_open & (p == R.MUST)).alias("open_mandatory"), count(is_open & (p == R.CHECK)).alias("open_verify"),
        count(is_open & (p == R.SHOULD)).alias("open_recommended"), F.count_distinct("category").alias("categories"),
    )
    x = docs.select("doc_id").distinct().join(sums, "doc_id", "left").fillna(0)
    on = scope(options)
    none_open = (F.col("open_blocker") == 0) & (F.col("open_mandatory") == 0) & (F.col("open_verify") == 0)
    x = x.withColumn("gate", none_open & F.lit(all(on.get(c) is True for c in required)))
    return x.withColumns({"status": F.when(F.col("gate"), "POTPUN").otherwise("DELIMIČAN"), "assessment": assessment(none_open, on)})


def assessment(none_open: Column, on: dict) -> Column:
    # The wording of the four outcomes.
    final, some = F.col("gate"), F.col("open_recommended") > 0
    return (
        F.when(final & ~some, "Audit je završen. Sve provere su prošle bez nalaza.")
        .when(final, F.format_string("Nema otvorenih blokirajućih, obaveznih ni nalaza za proveru. Postoji %d preporuka.", "open_recommended"))
        .when(none_open, f"Determinističke provere su završene. Nedostaje: {lacking(on) or 'ništa'}.")
        .otherwise(F.format_string(
            "Dokument ima %d obaveznih, %d blokirajućih i %d za proveru. Nije spreman za objavljivanje.", "open_mandatory", "open_blocker", "open_verify"))
    )


def global_patterns(found: DataFrame, least: int = 3) -> DataFrame:
    """Category and rationale that a document's findings repeat, the most frequent first."""
    x = found.groupBy("doc_id", "category", "rationale").agg(F.count("*").alias("count"), F.min("seq").alias("first_seq")).where(F.col("count") >= least)
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("count"), "first_seq")).cast("long"))


def with_status(found: DataFrame, events: DataFrame) -> DataFrame:
    """Findings with the latest status of events (doc_id, finding_id, status, ts)."""
    last = events.groupBy("doc_id", "finding_id").agg(F.max_by("status", "ts").alias("_s"))
    return found.join(last, ["doc_id", "finding_id"], "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def exported(found: DataFrame, which: str = "all") -> DataFrame:
    return found.where("status = 'OPEN'") if which == "open" else found


def filtered(found: DataFrame, priority: str = "all", category: str = "all", section: str = "all", auto_only: bool = False, status: str = "all") -> DataFrame:
    """Findings that pass each filter that is set; status is open, done or rejected."""
    for name, want in (("priority", priority), ("category", category), ("section", section), ("status", status.upper() if status != "all" else status)):
        found = found if want == "all" else found.where(F.col(name) == want)
    return found.where("auto_fixable") if auto_only else found


def choices(found: DataFrame) -> DataFrame:
    """doc_id, field, value, shown, nth: the distinct categories and sections of a document's findings in order, as a filter
    offers them; long ones are shown cut."""
    x = found.select("doc_id", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("category", "section")]))).distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id", "field").orderBy("value"))
    shown = F.when((F.col("field") == "section") & (F.length("value") > 40), F.concat(F.substring("value", 1, 40), F.lit("..."))).otherwise(F.col("value"))
    return x.select("doc_id", "field", "value", shown.alias("shown"), nth.alias("nth"))


CUBE = ("priority", "category", "section")


def cube(found: DataFrame, by: tuple[str, ...] = CUBE) -> DataFrame:
    """Counts over all combinations of by at once: level (bit set: summed over that column), the columns, findings, open ones,
    mean confidence. One pass; sums by combination are taken before the shuffle."""
    x = found.cube(*by).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("findings"), F.count_if(F.col("status") == "OPEN").alias("open"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return x.select("level", *by, "findings", "open", "confidence")


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(c.rlike(r"^[ \x{00A0}]*[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def confidence_class(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.75, "medium").otherwise("low")


def audit_json(found: DataFrame, docs: DataFrame, passed: DataFrame, options: set[str] = FULL, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """doc_id, json: scope, status, summary, findings, passed checks and patterns of each document. What is
    exported is summed anew, so a filtered export has the summary of its own findings."""
    fields = [
        "finding_id", "section", "paragraph_id", "category", "rule_id", "priority", "confidence", "original", "replacement", "rationale", "status",
        "auto_fixable", "requires_source_verification", "is_direct_quote", "global_pattern",
    ]

    def lists(x: DataFrame, name: str, order: str, columns: list[str]) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("x"))))
        return x.groupBy("doc_id").agg(rows["x"].alias(name))

    on = scope(options)
    s = summary(found, docs, options, required)
    rank = F.array_position(F.array(*[F.lit(name) for *_, name in CHECKS], F.lit("Fusnote")), F.col("area"))
    parts = [
        lists(found, "findings", "seq", fields), lists(passed.withColumn("rank", rank), "passed_checks", "rank", ["area", "result", "count"]),
        lists(global_patterns(found), "global_patterns", "rank", ["category", "rationale", "count"]),
    ]
    x = s
    for part in parts:
        x = x.join(part, "doc_id", "left")
    names = [p.columns[1] for p in parts]
    x = x.withColumns({n: F.coalesce(n, F.array().cast(dict(p.dtypes)[n])) for n, p in zip(names, parts)})
    done = lambda k, yes: F.lit(yes if on[k] else "NIJE " + yes)
    status = F.struct(
        "status", done("grammar", "IZVRŠENA").alias("linguistic_analysis"), done("style", "IZVRŠENA").alias("style_analysis"), done("visual_layout", "IZVRŠEN").alias("visual_review")
    )
    sums = [c for c in s.columns if c not in ("doc_id", "status")]
    whole = F.struct(
        F.struct(*[F.lit(v).alias(k) for k, v in on.items()]).alias("scope"), status.alias("audit_status"),
        F.struct(*sums, F.size("passed_checks").alias("passed_checks")).alias("summary"), *names, F.array(*[F.lit(c) for c in required]).alias("required_capabilities"),
    )
    return x.select("doc_id", F.to_json(whole).alias("json"))


def fence(c: Column) -> Column:
    """A run of back-ticks longer than any in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def escaped(c: Column) -> Column:
    """Text whose signs of Markdown mean nothing, on one line."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"([\\`*_{}\[\]()#+\-.!|<>~])", r"\\$1"), "\n", " "), "\r", "")


def report_lines(found: DataFrame, docs: DataFrame, passed: DataFrame, options: set[str] = FULL, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The report of each document as rows (doc_id, part, nth, lines) in the order of part and nth: head and status (0), summary
    (1), findings (2, nth is their number), passed checks (3), assessment (4). Rows are written as they are sorted; no
    document is gathered in one value."""
    on = scope(options)
    s = summary(found, docs, options, required).join(passed.groupBy("doc_id").agg(F.count("*").alias("passed")), "doc_id", "left").fillna(0, ["passed"])
    done = lambda k, yes: yes if on[k] else "NIJE " + yes
    bold = lambda c: F.concat(F.lit("**"), F.col(c).cast("string"), F.lit("**"))
    of = lambda name, c, total: F.concat(F.lit(f"{name}: "), bold(c), F.lit("/"), F.col(total).cast("string"))
    head = F.concat_ws(
        "\n", F.concat(F.lit("# Lektorsko-korektorski audit - "), escaped(F.col("doc_id").cast("string"))), F.lit(""), F.lit(f"**Preset:** {on['preset']}"), F.lit(""),
        F.lit("## Status audita"), F.lit(""), F.concat(F.lit("- Status: "), bold("status")), F.lit(f"- Jezička analiza: **{done('grammar', 'IZVRŠENA')}**"),
        F.lit(f"- Stilska analiza: **{done('style', 'IZVRŠENA')}**"), F.lit(f"- Vizuelni pregled: **{done('visual_layout', 'IZVRŠEN')}**"), F.lit(""), F.lit(f"> {on['note']}"), F.lit(""))
    sums = F.concat_ws(
        "\n", F.lit("## Sažetak"), F.lit(""), F.concat(F.lit("- Ukupno nalaza: "), bold("total")),
        F.concat(F.lit("- Obavezne: "), bold("mandatory"), F.lit(" | Proveriti: "), bold("verify"), F.lit(" | Preporuke: "), bold("recommended"), F.lit(" | Blocker: "), bold("blocker")),
        F.concat(F.lit("- Provere bez grešaka: "), bold("passed")),
        F.concat(F.lit("- Otvoreno: "), bold("open"), F.lit(" | Rešeno: "), bold("done"), F.lit(" | Nije greška: "), bold("rejected")),
        F.concat(F.lit("- "), of("Obavezno", "open_mandatory", "mandatory"), F.lit(" | "), of("Blocker", "open_blocker", "blocker"), F.lit(" | "), of("Proveriti", "open_verify", "verify"), F.lit(" *(otvoreno/ukupno)*")),
        F.concat(F.lit("- Finalan: "), F.when(F.col("gate"), "**DA**").otherwise("**NE**")), F.lit(""), F.lit("## Nalazi"), F.lit(""))
    end = F.concat_ws("\n", F.lit(""), F.lit("## Završna procena"), F.lit(""), F.col("assessment"), F.lit(""), F.lit("---"), F.lit(f"*{on['note']}*"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    fenced = lambda c: F.concat_ws("\n", fence(F.col(c)), F.col(c), fence(F.col(c)))
    cell = F.lit(None).cast("string")
    if "cell_id" in found.columns:
        cell = F.concat(F.lit("> Tabela: "), F.col("table_id"), F.lit(" | Red: "), (F.col("row_index") + 1).cast("string"), F.lit(" | Kolona: "), (F.col("column_index") + 1).cast("string"), F.lit(" | Cell ID: "), F.col("cell_id"))
    title = F.concat(F.lit("### "), F.col("nth").cast("string"), F.lit(". ["), escaped(F.col("section")), F.lit("] "), escaped(F.col("category")), F.lit(" ("), F.col("priority"), F.lit(")"))
    why = F.concat(F.lit("- "), escaped(F.col("rationale")), F.lit(" (pouzdanost: "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%, rule_id: "), F.coalesce("rule_id", F.lit("unknown")), F.lit(")"))
    each = found.withColumn("nth", nth)
    each = each.select("doc_id", F.lit(2).alias("part"), "nth", F.concat_ws("\n", title, cell, F.lit("- **Original:**"), fenced("original"), F.lit("- **Ispravka:**"), fenced("replacement"), why, F.lit("")).alias("lines"))
    rank = F.array_position(F.array(*[F.lit(name) for *_, name in CHECKS], F.lit("Fusnote")), F.col("area")).cast("int")
    checks = passed.select("doc_id", F.lit(3).alias("part"), rank.alias("nth"), F.concat(F.lit("- "), F.col("area"), F.lit(" ("), F.col("count").cast("string"), F.lit(")")).alias("lines"))
    whole = [(0, 0, head), (1, 0, sums), (3, -1, F.lit("## Provere bez grešaka\n")), (4, 0, end)]
    fixed = s.select("doc_id", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(k).alias("nth"), c.alias("lines")) for p, k, c in whole])))
    return fixed.unionByName(each).unionByName(checks)


def markdown_report(found: DataFrame) -> DataFrame:
    """doc_id, report: one block for each finding in order, texts in fences that they can't close."""
    block = F.concat_ws(
        "\n", F.concat(F.lit("## "), F.col("finding_id"), F.lit(" · "), F.col("category"), F.lit(" · "), F.col("priority")), F.concat(F.lit("Odeljak: "), F.col("section")),
        fence(F.col("original")), F.col("original"), fence(F.col("original")), F.lit("→"), fence(F.col("replacement")), F.col("replacement"), fence(F.col("replacement")), F.col("rationale"), F.lit(""),
    )
    x = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", block.alias("b")))).alias("x"))
    return x.select("doc_id", F.array_join(F.col("x.b"), "\n").alias("report"))
