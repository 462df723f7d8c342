"""Queries over the driver's tables, and the same results in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions.text import count_of, trimmed
from docaudit.operators import evaluation as E
from docaudit.operators import resampling as S
from docaudit.operators import cells, review, rules
from docaudit.plans import evaluation_sql, findings_sql
from docaudit.plans.audit import INJECTED, audit, injected
from docaudit.sources import paragraphs as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(docs(spark, sf_dir))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.identified(P.sections(P.elements(made(spark, sf_dir))))


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements without ids, for rules that don't use them."""
    return P.elements(made(spark, sf_dir))


def exploded(x: DataFrame, column) -> DataFrame:
    return x.select("doc_id", "ord", F.explode(column).alias("f")).select("doc_id", "ord", "f.match_pos", "f.original", "f.replacement", "f.rationale")


SPACING_SQL = {
    1: ("  +", "true", "o25", "regexp_replace(o25, '  +', ' ', 'g')", "'Višestruki razmak.'"),
    2: (" +[,.:;!?]", "NOT regexp_matches(substr(t, greatest(0, pos - 5) + 1, least(5, pos)), 'https?:$') AND NOT (right(m, 1) = '.' AND substr(t, pos + "
        "length(m) + 1, 2) = '..')", "o20", "left(o20, lp) || right(m, 1) || substr(o20, lp + length(m) + 1)", "'Razmak pre „' || right(m, 1) || '“.'"),
    3: (" +[)\\]}»“]", "true", "o20", "left(o20, lp) || right(m, 1) || substr(o20, lp + length(m) + 1)", "'Razmak pre zatvorene zagrade.'"),
    4: ("[(\\[{«„] +", "true", "o20", "left(o20, lp) || left(m, 1) || substr(o20, lp + length(m) + 1)", "'Razmak posle otvorene zagrade.'"),
    5: ("[,;:][^\\s\\d\"''“”„’)\\]]", f"NOT regexp_matches(near, 'https?:|[A-Za-z0-9_]:\\\\|[0-9a-fA-F]{{2}}:[0-9a-fA-F]') AND NOT regexp_matches(near, "
        f"'(?i)({rules.PREFIXES}):')", "o20", "left(o20, lp) || left(m, 1) || ' ' || right(m, 1) || substr(o20, lp + 3)", "'Nedostaje razmak posle „' || left(m, 1) || '“.'"),
}

MADE = f"made AS (SELECT doc_id, {INJECTED} AS text FROM documents)"
LINES = """numbered AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {src}),
lines AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INT) AS ord, CAST(line AS INT) AS line, raw FROM numbered WHERE regexp_replace(raw, '^\\s+|\\s+$', '', 'g') <> '')"""
ELEMENTS = "WITH " + MADE + ", " + LINES.format(src="made") + """, els AS (SELECT doc_id, ord, line, CASE WHEN regexp_matches(raw, '^#{1,6}\\s+') THEN 'heading' ELSE 'paragraph' END AS type,
 CASE WHEN regexp_matches(raw, '^#{1,6}\\s+') THEN CAST(length(regexp_extract(raw, '^(#{1,6})\\s', 1)) AS INT) END AS level,
 CASE WHEN regexp_matches(raw, '^#{1,6}\\s+') THEN regexp_extract(raw, '^#{1,6}\\s+(.*)$', 1) ELSE raw END AS text FROM lines)"""
COUNT = "len(regexp_extract_all({t}, '{p}'))"
#: Matches with their positions from 0: text cut at marks around every match.
MATCHES = """, cut AS (SELECT doc_id, ord, text AS t, string_split(regexp_replace(text, '{p}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM els),
places AS (SELECT doc_id, ord, t, parts, unnest(range(2, len(parts) + 1, 2)) AS i FROM cut),
hit AS (SELECT doc_id, ord, t, parts[i] AS m, CAST(length(array_to_string(parts[1:i - 1], '')) AS INT) AS pos FROM places)"""
CONTEXT = """CASE WHEN pos > {r} THEN '...' ELSE '' END || substr(t, greatest(0, pos - {r}) + 1, least(length(t), pos + {r}) - greatest(0, pos - {r})) || CASE WHEN pos + {r} < length(t) THEN '...' ELSE '' END"""
TRIM = "regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
FLAT = "lower(regexp_replace({t}, '\\s+', ' ', 'g'))"


def spacing_sql(k: int) -> str:
    p, keep, original, replacement, why = SPACING_SQL[k]
    return ELEMENTS + MATCHES.format(p=p) + f""", ctx AS (SELECT *, {CONTEXT.format(r=25)} AS o25, {CONTEXT.format(r=20)} AS o20,
 least(pos, 20) + CASE WHEN pos > 20 THEN 3 ELSE 0 END AS lp, substr(t, greatest(0, pos - 10) + 1, pos + 10 - greatest(0, pos - 10)) AS near FROM hit)
SELECT doc_id, ord, pos AS match_pos, {original} AS original, {replacement} AS replacement, {why} AS rationale FROM ctx WHERE {keep}"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents as labels of rules: the source is the rule, quality the label."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("source").alias("rule_id"), F.col("quality").alias("label"), ((F.col("doc_id") * 37 % 101) / 100.0).alias("confidence"), "doc_id", "lang", "n_chars", "toxic",
    )


LABELS = "WITH lab AS (SELECT d.source AS rule_id, l.quality AS label, ((d.doc_id * 37) % 101) / 100.0 AS confidence, d.doc_id, d.lang, d.n_chars, l.toxic FROM labels l JOIN documents d USING (doc_id))"
PHI = "(0.5 * (1 + (1 - (((((1.061405429 * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u) * exp(-x * x / 2))))"


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = labels(spark, sf_dir).select(F.col("rule_id"), F.col("label").alias("before"), F.col("toxic").alias("after"))
    return E.mcnemar(x, "rule_id")


MCNEMAR = LABELS + f""", bc AS (SELECT rule_id, count(*) FILTER (WHERE label = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE label = 0 AND toxic = 1) AS c FROM lab GROUP BY 1),
chi AS (SELECT *, CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1.0, 2) / (b + c) END AS v FROM bc),
phi AS (SELECT *, sqrt(v) AS x, 1 / (1 + 0.3275911 * sqrt(v) / sqrt(2.0)) AS u FROM chi),
test AS (SELECT rule_id, b, c, round(v, 6) AS chi2, round(CASE WHEN b + c = 0 THEN 1.0 ELSE 2 * (1 - {PHI}) END, 6) AS p FROM phi)"""

PARAMS = [(p, e, level, design, per) for p in (0.5, 0.8) for e in (0.05, 0.1) for level in (0.90, 0.95, 0.99) for design, per in ((1.0, 1.0), (2.0, 5.0))]


def params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARAMS, "p double, e double, level double, design double, per_doc double")


def full(spark: SparkSession, sf_dir: str, options: set[str] | None = None):
    return audit(made(spark, sf_dir), options)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(spark, sf_dir).select("doc_id", "ord", rules.toc_entry().alias("entry"), rules.heading_title().alias("title"))


def statuses(found: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of documents labelled low quality are rejected, of toxic ones done."""
    l = table(spark, sf_dir, "labels").where("quality = 0 or toxic = 1").select("doc_id", F.when(F.col("quality") == 0, "REJECTED").otherwise("DONE").alias("status"))
    return l.join(found.select("doc_id", "finding_id"), "doc_id").withColumn("ts", F.lit(1))


def interval(numerator: str, denominator: str | None = None):
    """A query of the BCa interval of a mean, or of a ratio of sums, by rule."""
    whole = lambda: S.ratio(F.expr(numerator), None if denominator is None else F.expr(denominator))
    return lambda s, d: S.rounded(S.bootstrap(labels(s, d), "rule_id", "doc_id", *whole()))


BRIER_GAIN = "pow(confidence - label, 2) - pow(0.5 - label, 2)"
FINDING_COLUMNS = ["doc_id", "finding_id", "seq", "section", "paragraph_id", "category", "rule_id", "priority", "confidence", "original", "replacement", "rationale", "status"]

QUERIES = {
    "paragraphs": lambda s, d: P.paragraphs(docs(s, d)),
    "word_count": lambda s, d: docs(s, d).select("doc_id", P.word_count(F.col("text")).alias("words")),
    "language": lambda s, d: made(s, d).select("doc_id", P.language(F.col("text")).alias("language")),
    "markdown_elements": lambda s, d: plain(s, d).select("doc_id", "ord", "line", "type", "level", "text"),
    "section_fill": lambda s, d: P.sections(plain(s, d)).select("doc_id", "ord", "section"),
    "element_ids": lambda s, d: rows(s, d).select("doc_id", "ord", "id"),
    "dup_words": lambda s, d: P.paragraphs(docs(s, d)).select("doc_id", F.size(rules.duplicate_words(F.col("text"))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("findings")).where("findings > 0"),
    "repeated_paragraphs": lambda s, d: rules.in_context(P.elements(docs(s, d), "txt")).where("earlier is not null").select("doc_id", "ord", F.col("earlier").cast("int").alias("first_ord")),
    **{f"spacing_{k}": (lambda s, d, k=k: exploded(plain(s, d), rules.spacing(F.col("text"), kinds=(k,)))) for k in SPACING_SQL},
    "quote_balance": lambda s, d: rules.quote_totals(plain(s, d)),
    "bracket_balance": lambda s, d: plain(s, d).groupBy("doc_id").agg(*[F.sum(count_of(F.col("text"), p)).alias(n) for p, n in ((r"\(", "round_open"), (r"\)", "round_close"), (r"\[", "square_open"), (r"\]", "square_close"))]),
    "brackets": lambda s, d: exploded(rules.in_context(plain(s, d)), rules.IN_CONTEXT["brackets"]()).select("doc_id", "ord", "match_pos", "original", "rationale"),
    "markdown_links": lambda s, d: exploded(plain(s, d), rules.markdown_left(F.col("text"), patterns=rules.MARKDOWN_PATTERNS[7:9])).drop("match_pos"),
    "markdown_artifacts": lambda s, d: exploded(plain(s, d), rules.markdown_left(F.col("text"))).drop("match_pos"),
    "script_mix": lambda s, d: exploded(plain(s, d), rules.script_mix(F.col("text"))).drop("match_pos"),
    "greek": lambda s, d: exploded(plain(s, d), rules.greek(F.col("text"))),
    "all_caps": lambda s, d: rules.unlisted_capitals(rules.in_context(plain(s, d)).select("doc_id", "ord", "type", rules.capital_words().alias("capitals"))).select("doc_id", "ord", "nth", "word"),
    "urls": lambda s, d: exploded(plain(s, d), rules.urls(F.col("text"))).drop("match_pos"),
    "toc_match": lambda s, d: rules.toc_pairs(titled(s, d))[0].select("doc_id", "ord", F.col("entry").alias("title"), "same", "near"),
    "heading_not_in_toc": lambda s, d: rules.toc_pairs(titled(s, d))[1].where("not met").select("doc_id", "ord", "title"),
    "numbering_gaps": lambda s, d: rules.in_context(plain(s, d)).where(rules.skips()).select("doc_id", "ord", "num", "before"),
    "heading_sequence": lambda s, d: rules.in_context(plain(s, d)).select("doc_id", "ord", F.explode(rules.headings()).alias("f")).select("doc_id", "ord", "f.priority", "f.original"),
    "bibliography_entries": lambda s, d: rules.in_context(plain(s, d)).where(rules.bibliography_entry()).select("doc_id", "ord", *[c.alias(n) for c, n in zip(rules.bibliography_lacks(trimmed(F.col("text"))), ("no_year", "no_publisher"))]),
    "bibliography_crossref": lambda s, d: full(s, d, {"bibliography"}).candidates.where("rule_id = 'bibliography_cross_reference'").select("doc_id", "ord", "original"),
    "findings": lambda s, d: full(s, d).candidates.select(*FINDING_COLUMNS),
    "findings_verified": lambda s, d: full(s, d).verified.select(*FINDING_COLUMNS),
    "passed_checks": lambda s, d: full(s, d).passed(),
    "summary": lambda s, d: full(s, d).summary(),
    "global_patterns": lambda s, d: full(s, d).patterns(),
    "export_open": lambda s, d: review.exported(review.with_status((v := full(s, d).verified), statuses(v, s, d)), "open").select(*FINDING_COLUMNS),
    "status_overlay": lambda s, d: review.summary(review.with_status((v := full(s, d).verified), statuses(v, s, d)), docs(s, d)),
    "audit_json": lambda s, d: review.audit_json((a := full(s, d)).verified, docs(s, d), a.passed()),
    "markdown_report": lambda s, d: review.markdown_report(full(s, d).verified),
    "eval_per_rule": lambda s, d: E.per_rule(labels(s, d)),
    "eval_reliability": lambda s, d: E.reliability(labels(s, d)),
    "mcnemar": tests,
    "bh_fdr": lambda s, d: E.benjamini_hochberg(tests(s, d), "rule_id"),
    "cliffs_delta": lambda s, d: E.cliffs_delta(labels(s, d).select("lang", F.col("label").alias("side"), F.col("n_chars").alias("x")), "lang"),
    "sample_size": lambda s, d: E.sample_size(params(s)),
    "bootstrap_bca": lambda s, d: E.bootstrap_bca(labels(s, d)),
    "bootstrap_mean": interval("label"),
    "bootstrap_ratio": interval("n_chars * label", "n_chars"),
    "bootstrap_brier": interval(BRIER_GAIN),
    "eval_versions": lambda s, d: S.rounded(E.rule_report(labels(s, d), version="lang")),
    "eval_overall": lambda s, d: S.rounded(E.overall(labels(s, d))),
    "eval_report": lambda s, d: E.report(labels(s, d), version="lang"),
    "findings_cube": lambda s, d: review.cube(full(s, d).verified),
    "cell_ids": lambda s, d: cells.identified(cells.pipe_cells(docs(s, d))),
    "filter_choices": lambda s, d: review.choices(full(s, d).verified),
    "filtered_findings": lambda s, d: review.filtered(full(s, d).verified, priority=rules.MUST, category=rules.SPACING, auto_only=True, status="open").select(*FINDING_COLUMNS),
}

CLEAN_WORD = "[\\p{L}\\p{M}]+"
HEADS = ", h AS (SELECT doc_id, ord, " + TRIM.format(t="text") + " AS title FROM els WHERE type = 'heading' AND " + TRIM.format(t="text") + " <> ''), e AS (SELECT doc_id, ord, " + TRIM.format(t="regexp_extract(text, '^(.+?)(?:\\.{3,}|\\t)\\s*\\d+\\s*$', 1)") + " AS title FROM els WHERE type = 'paragraph' AND regexp_matches(text, '^(.+?)(?:\\.{3,}|\\t)\\s*\\d+\\s*$'))"
BIB = ", b AS (SELECT doc_id, ord AS b_ord, level AS b_level FROM els WHERE type = 'heading' AND regexp_matches(" + TRIM.format(t="text") + ", '(?i)^(" + rules.BIBLIOGRAPHY_TITLES + ")$')), spans AS (SELECT b.*, (SELECT min(ord) FROM els n WHERE n.doc_id = b.doc_id AND n.type = 'heading' AND n.ord > b.b_ord AND n.level <= b.b_level) AS e_ord FROM b), entries AS (SELECT DISTINCT x.doc_id, x.ord, " + TRIM.format(t="x.text") + " AS text FROM els x JOIN spans s ON x.doc_id = s.doc_id AND x.ord > s.b_ord AND x.ord < coalesce(s.e_ord, 2147483647) WHERE x.type = 'paragraph' AND length(" + TRIM.format(t="x.text") + ") > 10)"

ORACLE_SQL = {
    "paragraphs": "WITH " + LINES.format(src="documents") + " SELECT doc_id, ord, line, raw AS text FROM lines",
    "word_count": "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents",
    "language": "WITH " + MADE + ", n AS (SELECT doc_id, len(regexp_extract_all(left(text, 5000), '[\\x{0400}-\\x{04FF}]')) AS c, len(regexp_extract_all(left(text, "
        "5000), '[a-zA-Z\\x{00C0}-\\x{024F}]')) AS l FROM made) SELECT doc_id, CASE WHEN c > 2 * l THEN 'sr-Cyrl' WHEN l > 2 * c THEN "
        "'sr-Latn' ELSE 'sr' END AS language FROM n",
    "markdown_elements": ELEMENTS + " SELECT doc_id, ord, line, type, level, text FROM els",
    "section_fill": ELEMENTS + ", t AS (SELECT doc_id, ord, CASE WHEN type = 'heading' AND " + TRIM.format(t="text") + " <> '' THEN " + TRIM.format(t="text") + " END AS title FROM els) SELECT doc_id, ord, coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS "
        "UNBOUNDED PRECEDING), '" + P.FIRST_SECTION + "') AS section FROM t",
    # a run of k equal words in a row has k // 2 pairs; a word ends a pair even if marks follow it
    "dup_words": "WITH " + LINES.format(src="documents") + """, w AS (SELECT doc_id, ord, unnest(regexp_split_to_array(raw, '\\s+')) AS w, generate_subscripts(regexp_split_to_array(raw, '\\s+'), 1) AS i FROM lines),
 x AS (SELECT doc_id, ord, i, lower(w) AS a, regexp_matches(w, '^\\p{L}+$') AS pure, lower(regexp_extract(w, '^(\\p{L}+)(?:[,.:;!?)\\]}].*)?$', 1)) AS head FROM w),
 l AS (SELECT *, lag(a) OVER o AS before, lag(pure) OVER o AS before_pure FROM x WINDOW o AS (PARTITION BY doc_id, ord ORDER BY i)),
 r AS (SELECT *, sum(CASE WHEN before_pure AND before = head THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, ord ORDER BY i) AS run FROM l),
 k AS (SELECT doc_id, ord, run, any_value(head) AS word, count(*) // 2 AS n FROM r GROUP BY ALL)
 SELECT doc_id, CAST(sum(n) AS BIGINT) AS findings FROM k WHERE n > 0 AND length(word) >= 2 AND word NOT IN (""" + ", ".join(f"'{w}'" for w in rules.MAY_REPEAT) + ") GROUP BY doc_id",
    "repeated_paragraphs": "WITH " + LINES.format(src="documents") + ", n AS (SELECT doc_id, ord, " + FLAT.format(t=TRIM.format(t="raw")) + " AS norm FROM lines WHERE length(" + TRIM.format(t="raw") + ") >= 50), r AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, norm) AS first_ord FROM n) SELECT doc_id, ord, first_ord FROM r "
        "WHERE ord > first_ord",
    **{f"spacing_{k}": spacing_sql(k) for k in SPACING_SQL},
    "quote_balance": ELEMENTS + " SELECT doc_id, " + ", ".join(f"CAST(sum({COUNT.format(t='text', p=p)}) AS BIGINT) AS {n}" for p, n in (('"', "straight"), ("„", "opened"), ("“", "closed"))) + " FROM els GROUP BY 1",
    "bracket_balance": ELEMENTS + " SELECT doc_id, " + ", ".join(f"CAST(sum({COUNT.format(t='text', p=p)}) AS BIGINT) AS {n}" for p, n in (("\\(", "round_open"), ("\\)", "round_close"), ("\\[", "square_open"), ("\\]", "square_close"))) + " FROM els GROUP BY 1",
    "markdown_links": ELEMENTS + ", m AS (SELECT doc_id, ord, unnest(regexp_extract_all(text, '\\[([^\\]]+)\\]\\([^)]+\\)')) AS m, '[link](url)' AS kind FROM els "
        "UNION ALL SELECT doc_id, ord, unnest(regexp_extract_all(text, '```')), '```' FROM els) SELECT doc_id, ord, " + TRIM.format(t="m") + " AS original, '[ukloniti markdown]' AS replacement, 'Ostatak ' || kind || '.' AS rationale FROM m",
    "script_mix": ELEMENTS + f", w AS (SELECT doc_id, ord, unnest(regexp_extract_all(text, '{CLEAN_WORD}')) AS w FROM els), c AS (SELECT *, "
        f"len(regexp_extract_all(w, '[\\x{{0400}}-\\x{{04FF}}]')) AS c, len(regexp_extract_all(w, '[a-zA-Z\\x{{00C0}}-\\x{{024F}}]')) AS l "
        "FROM w) SELECT doc_id, ord, w AS original, '[prebaciti na ' || CASE WHEN c > l THEN 'ćirilica' ELSE 'latinica' END || ']' AS "
        "replacement, 'Reč „' || w || '“: ' || c || ' ćir. + ' || l || ' lat.' AS rationale FROM c WHERE length(w) >= 2 AND c > 0 AND l > 0",
    "all_caps": ELEMENTS + f""", fh AS (SELECT doc_id, min(ord) AS fh FROM els WHERE type = 'heading' GROUP BY 1),
 body AS (SELECT e.* FROM els e LEFT JOIN fh USING (doc_id) WHERE type = 'paragraph' AND (fh IS NULL OR ord >= fh) AND NOT regexp_matches(text, '\\.{{3,}}') AND NOT (text = upper(text) AND text <> lower(text))),
 w AS (SELECT doc_id, ord, unnest(list_filter(regexp_extract_all(text, '{CLEAN_WORD}'), lambda w: length(w) >= 3 AND w = upper(w) AND w <> lower(w))) AS word, generate_subscripts(list_filter(regexp_extract_all(text, '{CLEAN_WORD}'), lambda w: length(w) >= 3 AND w = upper(w) AND w <> lower(w)), 1) - 1 AS nth FROM body),
 hw AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{CLEAN_WORD}')) AS word FROM els WHERE type = 'heading')
 SELECT doc_id, ord, CAST(nth AS INT) AS nth, word FROM w WHERE word NOT IN ({", ".join(f"'{a}'" for a in rules.ACRONYMS)}) AND NOT regexp_matches(word, '^[IVXLCDM]+$') AND NOT EXISTS (SELECT 1 FROM hw WHERE hw.doc_id = w.doc_id AND hw.word = w.word AND length(hw.word) >= 3 AND hw.word = upper(hw.word))""",
    "urls": ELEMENTS + r""", u AS (SELECT doc_id, ord, unnest(regexp_extract_all(text, 'https?://[^\s<>"{}|\\^`\[\]]+')) AS u FROM els), c AS (SELECT *, regexp_matches(u, '[,.;]+$') AS ends, len(regexp_extract_all(u, '\(')) AS o, len(regexp_extract_all(u, '\)')) AS c FROM u)
 SELECT doc_id, ord, u AS original, regexp_replace(u, '[,.;]+$', '') AS replacement, 'URL završen interpunkcijom.' AS rationale FROM c WHERE ends
 UNION ALL SELECT doc_id, ord, u, left(u, length(u) - 1), 'Zatvorena zagrada verovatno nije deo URL-a.' FROM c WHERE NOT ends AND right(u, 1) = ')' AND c > o
 UNION ALL SELECT doc_id, ord, left(u, 50) || '...', '[proveriti]', 'Veoma dugačak URL.' FROM c WHERE length(u) > 100""",
    "toc_match": ELEMENTS + HEADS + " SELECT e.doc_id, e.ord, e.title, coalesce(bool_or(" + FLAT.format(t="h.title") + " = " + FLAT.format(t="e.title") + "), false) AS same, arg_min(h.title, h.ord) FILTER (WHERE levenshtein(lower(h.title), " + FLAT.format(t="e.title") + ") <= 3) AS near FROM e LEFT JOIN h USING (doc_id) GROUP BY e.doc_id, e.ord, e.title",
    "heading_not_in_toc": ELEMENTS + HEADS + " SELECT h.doc_id, h.ord, h.title FROM h JOIN e USING (doc_id) GROUP BY ALL HAVING NOT bool_or(" + FLAT.format(t="e.title") + " = " + FLAT.format(t="h.title") + " OR levenshtein(lower(e.title), " + FLAT.format(t="h.title") + ") <= 3)",
    "numbering_gaps": ELEMENTS + ", n AS (SELECT doc_id, ord, TRY_CAST(nullif(regexp_extract(text, '^\\s*(\\d+)[.)]\\s', 1), '') AS BIGINT) AS num FROM els), r AS "
        "(SELECT *, sum(CASE WHEN num IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM n), l AS (SELECT "
        "doc_id, ord, num, lag(num) OVER (PARTITION BY doc_id, run ORDER BY ord) AS before FROM r WHERE num IS NOT NULL) SELECT doc_id, "
        "ord, num, before FROM l WHERE before IS NOT NULL AND num <> 1 AND num <> before + 1",
    "heading_sequence": ELEMENTS + ", n AS (SELECT *, lead(type) OVER (PARTITION BY doc_id ORDER BY ord) AS nt, lead(level) OVER (PARTITION BY doc_id ORDER BY ord) "
        "AS nl FROM els) SELECT doc_id, ord, 'OBAVEZNO' AS priority, '[Prazan naslov nivoa ' || level || ']' AS original FROM n WHERE type "
        "= 'heading' AND " + TRIM.format(t="text") + " = '' UNION ALL SELECT doc_id, ord, 'PREPORUKA', CASE WHEN text = '' THEN '[prazan]' ELSE text END FROM n WHERE type = 'heading' "
        "AND nt = 'heading' AND nl <= level",
    "bibliography_entries": ELEMENTS + BIB + f", m AS (SELECT doc_id, ord, text, NOT (regexp_matches(text, '(?i)\\b({rules.ANCIENT})\\b') OR regexp_matches(text, 'https?://') "
        f"OR regexp_matches(text, '(?i)\\b({rules.RELIGIOUS})\\b')) AS modern FROM entries) SELECT doc_id, ord, modern AND NOT "
        f"regexp_matches(text, '\\b(1[5-9]\\d{{2}}|20\\d{{2}})\\b') AS no_year, modern AND NOT (regexp_matches(text, "
        f"':\\s*[A-Z\\x{{0400}}-\\x{{04FF}}]') OR regexp_matches(text, '(?i)University|Press|Verlag|izdava') OR regexp_matches(text, "
        f"'[„\"“«»]') OR regexp_matches(text, '(?i)\\b({rules.PERIODICALS})\\b')) AS no_publisher FROM m",
    "bibliography_crossref": ELEMENTS + BIB + r", f AS (SELECT doc_id, min(b_ord) AS first FROM b GROUP BY 1), c AS (SELECT DISTINCT e.doc_id, f.first, "
        r"unnest(list_concat(regexp_extract_all(e.text, '\((\p{Lu}\p{Ll}{2,}),?\s*\d{4}\)', 1), regexp_extract_all(e.text, "
        r"'(\p{Lu}\p{Ll}{2,})\s*\(\d{4}\)', 1))) AS author FROM els e JOIN f USING (doc_id) WHERE e.ord < f.first) SELECT doc_id, first AS "
        r"ord, 'Citiran: „' || author || '“' AS original FROM c WHERE EXISTS (SELECT 1 FROM entries x WHERE x.doc_id = c.doc_id) AND NOT "
        r"EXISTS (SELECT 1 FROM entries x WHERE x.doc_id = c.doc_id AND contains(x.text, c.author)) AND author NOT IN (" + ", ".join(f"'{a}'" for a in rules.NOT_AUTHORS) + ")",
    "eval_per_rule": LABELS + """, g AS (SELECT rule_id, count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label = 0) AS fp, count(*) AS n, avg(label) AS p, avg(pow(confidence - label, 2)) AS brier FROM lab GROUP BY 1),
 w AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS c, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) AS h FROM g)
 SELECT rule_id, tp, fp, n, round(p, 6) AS precision, round(greatest(0.0, c - h), 6) AS lower, round(least(1.0, c + h), 6) AS upper, round(c, 6) AS centre, round(brier, 6) AS brier, CASE WHEN n < 10 THEN 'very small sample' WHEN n < 30 THEN 'small sample' ELSE '' END AS warning FROM w""",
    "eval_reliability": LABELS + ", g AS (SELECT CAST(least(9, floor(confidence * 10)) AS BIGINT) AS bin, count(*) AS n, avg(confidence) AS p, avg(label) AS o FROM "
        "lab GROUP BY 1) SELECT bin, n, round(p, 6) AS predicted, round(o, 6) AS observed, round(abs(p - o), 6) AS difference, round(abs(p "
        "- o) * n / sum(n) OVER (), 6) AS contribution FROM g",
    "mcnemar": MCNEMAR + " SELECT * FROM test",
    "bh_fdr": MCNEMAR + ", r AS (SELECT rule_id, p, row_number() OVER (ORDER BY p, rule_id) AS rank, count(*) OVER () AS m FROM test), k AS (SELECT *, "
        "rank / m * 0.05 AS critical FROM r) SELECT rule_id, p, rank, round(critical, 6) AS critical, coalesce(rank <= max(CASE WHEN p <= "
        "critical THEN rank END) OVER (), false) AS significant FROM k",
    "cliffs_delta": LABELS + ", a AS (SELECT lang, n_chars AS x FROM lab WHERE label = 1), b AS (SELECT lang, n_chars AS y FROM lab WHERE label = 0), d AS "
        "(SELECT lang, sum(sign(x - y)) AS s, count(*) AS pairs FROM a JOIN b USING (lang) GROUP BY 1), n AS (SELECT lang, count(*) FILTER "
        "(WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM lab GROUP BY 1), q AS (SELECT n.*, CASE WHEN pairs > 0 THEN "
        "CAST(s AS DOUBLE) / pairs ELSE 0.0 END AS v FROM n LEFT JOIN d USING (lang)) SELECT lang, n1, n0, round(v, 6) AS delta, CASE WHEN "
        "abs(v) < 0.147 THEN 'negligible' WHEN abs(v) < 0.33 THEN 'small' WHEN abs(v) < 0.474 THEN 'medium' ELSE 'large' END AS effect "
        "FROM q",
    "sample_size": "WITH p AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"CAST({x} AS DOUBLE)" for x in row) + ")" for row in PARAMS) + ") t(p, e, level, design, per_doc)), n AS (SELECT *, CASE level WHEN 0.9 THEN 1.645 WHEN 0.95 THEN 1.96 ELSE 2.576 END AS z FROM "
        "p) SELECT p, e, level, design, per_doc, CAST(ceil(CAST(z AS DOUBLE) * z * p * (1 - p) / (e * e)) AS BIGINT) AS n, "
        "CAST(ceil(ceil(CAST(z AS DOUBLE) * z * p * (1 - p) / (e * e)) * design) AS BIGINT) AS findings, CAST(ceil(ceil(ceil(CAST(z AS "
        "DOUBLE) * z * p * (1 - p) / (e * e)) * design) / per_doc) AS BIGINT) AS documents FROM n",
}

ORACLE_SQL |= findings_sql.oracle(ELEMENTS, {k: spacing_sql(k) for k in SPACING_SQL}, ORACLE_SQL, FINDING_COLUMNS)

# the wording of rows of a Markdown table, with C's number formats
_RULES = """, g AS (SELECT rule_id, count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label = 0) AS fp, count(*) AS n, avg(label) AS p, avg(pow(confidence - label, 2)) AS brier,
 array_to_string(list_sort(list(DISTINCT lang)), ', ') AS versions FROM lab GROUP BY 1),
 w AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS c, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) AS h FROM g),
 r AS (SELECT *, greatest(0.0, c - h) AS lower, least(1.0, c + h) AS upper, CASE WHEN n < 10 THEN '""" + E.FEW + "' WHEN n < 30 THEN '" + E.SOME + "' ELSE '-' END AS warning FROM w)"
_BINS = """, b0 AS (SELECT CAST(least(9, floor(confidence * 10)) AS BIGINT) AS bin, count(*) AS n, avg(confidence) AS p, avg(label) AS o, sum(pow(confidence - label, 2)) AS sq FROM lab GROUP BY 1),
 b AS (SELECT *, o - p AS d, sq / sum(n) OVER () AS contribution FROM b0)"""
_FIXED = [(0, "", "# Confidence Evaluation Report"), *[(1, k, f"> {note}") for k, note in enumerate(E.REPORT_NOTES)], (3, 0, "## Per-rule results"), *[(3, k + 1, h) for k, h in enumerate(E.RULE_HEAD)], (5, 0, "## Reliability diagram"), *[(5, k + 1, h) for k, h in enumerate(E.BIN_HEAD)]]
_VERIFIED = "WITH f AS (" + ORACLE_SQL["findings_verified"] + ") "
_CUT = "CASE WHEN field = 'section' AND length(value) > 40 THEN left(value, 40) || '...' ELSE value END"

_NAMED = "'t-' || lpad(lower(to_base({}, 36)), 7, '0')"
_AGAIN = "CASE WHEN n > 1 THEN " + findings_sql.fnv("h", "'|#' || n") + " ELSE h END"

ORACLE_SQL |= {
    "cell_ids": "WITH " + LINES.format(src="documents") + ", l AS (SELECT doc_id, line, raw FROM lines WHERE contains(raw, '|')), r AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM l),\n"
        " f AS (SELECT *, min(line) OVER (PARTITION BY doc_id, run) AS ord, string_split(regexp_replace(regexp_replace(" + TRIM.format(t="raw") + ", '^\\|', ''), '\\|$', ''), '|') AS c FROM r),\n"
        " c0 AS (SELECT doc_id, ord, line - ord AS row_index, unnest(c) AS raw, unnest(range(len(c))) AS column_index FROM f), c AS (SELECT doc_id, ord, CAST(row_index AS INT) AS row_index, CAST(column_index AS INT) AS column_index, " + TRIM.format(t="raw") + " AS text FROM c0),\n"
        " rw AS (SELECT doc_id, ord, row_index, string_agg(text, '|' ORDER BY column_index) AS l FROM c GROUP BY ALL), t AS (SELECT doc_id, ord, string_agg(l, '|' ORDER BY row_index) AS a FROM rw GROUP BY ALL),\n"
        " t1 AS (SELECT doc_id, ord, " + findings_sql.fnv("2166136261", "'table|' || a") + " AS h FROM t), t2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY ord) AS n FROM t1), t3 AS (SELECT doc_id, ord, " + _NAMED.format(_AGAIN) + " AS table_id FROM t2),\n"
        " r1 AS (SELECT doc_id, ord, row_index, table_id, " + findings_sql.fnv("2166136261", "table_id || '|row|' || l") + " AS h FROM rw JOIN t3 USING (doc_id, ord)), r2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_id, h ORDER BY row_index) AS n FROM r1),\n"
        " r3 AS (SELECT doc_id, ord, row_index, table_id, " + _NAMED.format(_AGAIN) + " AS row_id FROM r2), k AS (SELECT *, " + findings_sql.fnv("2166136261", "row_id || '|cell|' || text || '|' || column_index") + " AS h FROM c JOIN r3 USING (doc_id, ord, row_index))\n"
        " SELECT doc_id, ord, row_index, column_index, text, table_id, row_id, " + _NAMED.format("h") + " AS cell_id FROM k",
    "bootstrap_mean": evaluation_sql.bootstrap(LABELS, "rule_id", "doc_id", "label"),
    "bootstrap_ratio": evaluation_sql.bootstrap(LABELS, "rule_id", "doc_id", "n_chars * label", "n_chars"),
    "bootstrap_brier": evaluation_sql.bootstrap(LABELS, "rule_id", "doc_id", BRIER_GAIN),
    "eval_versions": LABELS + _RULES + " SELECT rule_id, tp, fp, n, round(p, 6) AS precision, round(brier, 6) AS brier, versions, round(lower, 6) AS lower, round(upper, 6) AS upper, round(upper - lower, 6) AS width, warning FROM r",
    "eval_overall": LABELS + " SELECT count(*) AS samples, round(avg(pow(confidence - label, 2)), 6) AS brier FROM lab",
    "eval_report": LABELS + _RULES + _BINS + " SELECT * FROM (VALUES " + ", ".join(f"({k}, '{key}', '{line}')" for k, key, line in _FIXED) + """) t(section, key, line)
 UNION ALL SELECT 2, '0', '**Ukupno obeleženih uzoraka:** ' || count(*) FROM lab UNION ALL SELECT 2, '1', printf('**Ukupni Brier score:** %.4f', round(avg(pow(confidence - label, 2)), 4)) FROM lab
 UNION ALL SELECT 4, rule_id, printf('| %s | %d | %d | %d | %.1f%% | [%.3f, %.3f] | %.3f | %.4f | %s | %s |', rule_id, tp, fp, n, round(p * 100, 1), round(lower, 3), round(upper, 3), round(upper - lower, 3), round(brier, 4), versions, warning) FROM r
 UNION ALL SELECT 6, printf('%02d', bin), printf('| [0.%d,%s | %d | %.3f | %.3f | %.3f | %.4f |', bin, CASE WHEN bin = 9 THEN '1.0]' ELSE '0.' || (bin + 1) || ')' END, n, round(p, 3), round(o, 3), round(d, 3), round(contribution, 4)) FROM b""",
    "findings_cube": _VERIFIED + "SELECT GROUPING_ID(priority, category, section) AS level, priority, category, section, count(*) AS findings, count(*) FILTER (WHERE status = 'OPEN') AS open, round(avg(confidence), 6) AS confidence FROM f GROUP BY CUBE (priority, category, section)",
    "filter_choices": _VERIFIED + f", c AS (SELECT DISTINCT doc_id, 'category' AS field, category AS value FROM f UNION SELECT DISTINCT doc_id, 'section', section FROM f) SELECT doc_id, field, value, {_CUT} AS shown, CAST(row_number() OVER (PARTITION BY doc_id, field ORDER BY value) AS INT) AS nth FROM c",
    # spacing findings that must be fixed are all fixable; those in direct quotes have another priority
    "filtered_findings": _VERIFIED + f"SELECT * FROM f WHERE priority = '{rules.MUST}' AND category = '{rules.SPACING}' AND status = 'OPEN'",
}
