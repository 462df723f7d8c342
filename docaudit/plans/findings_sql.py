"""The whole audit as DuckDB SQL: elements with ids and sections, findings of every rule, and what follows from them."""

from __future__ import annotations

from docaudit.operators import review
from docaudit.operators import rules as R
from docaudit.sources import paragraphs as P

ROMAN = "(?i)^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"
LETTERS = "\\x{0400}-\\x{04FF}a-zA-Z"


def trim(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def flat(t: str) -> str:
    return f"lower(regexp_replace({t}, '\\s+', ' ', 'g'))"


def fnv(start: str, text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT))"
    return f"list_reduce(list_prepend(CAST({start} AS BIGINT), {codes}), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"


def around(r: int, text: str = "text", pos: str = "pos") -> str:
    return (
        f"CASE WHEN {pos} > {r} THEN '...' ELSE '' END || substr({text}, greatest(0, {pos} - {r}) + 1, least(length({text}), {pos} + {r}) - greatest(0, {pos} - {r}))"
        f" || CASE WHEN {pos} + {r} < length({text}) THEN '...' ELSE '' END"
    )


QUOTE = f"""(type <> 'heading' AND (regexp_matches(t, '^„[\\s\\S]*“$') OR regexp_matches(t, '^«[\\s\\S]*»$') OR regexp_matches(t, '^[—―]\\s')
 OR regexp_matches(t, '^[\\x{{0370}}-\\x{{03FF}}\\x{{1F00}}-\\x{{1FFF}}\\s,.;·''"]+$')))"""

ELEMENT = f"""
n1 AS (SELECT *, {trim('text')} AS t, lag(text) OVER w AS prev, lead(text) OVER w AS nxt FROM els WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
n2 AS (SELECT *, {fnv('2166136261', "concat_ws('|', type, CASE WHEN type = 'heading' THEN 'Heading' || level ELSE 'Normal' END, text, substr(coalesce(prev, ''), 1, 30), substr(coalesce(nxt, ''), 1, 30))")} AS h,
  last_value(CASE WHEN type = 'heading' AND t <> '' THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS title FROM n1),
n3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, h ORDER BY ord) AS n FROM n2),
el AS MATERIALIZED (SELECT doc_id, ord, type, level, text, t, CASE WHEN type = 'heading' THEN 'h-' ELSE 'p-' END || lpad(lower(to_base(CASE WHEN n > 1 THEN {fnv('h', "'|#' || n")} ELSE h END, 36)), 7, '0') AS id,
  CASE WHEN type <> 'heading' THEN coalesce(title, '{P.FIRST_SECTION}') WHEN text <> '' THEN text ELSE '(bez naslova)' END AS section, {QUOTE} AS q FROM n3)"""

CODE = f"""(regexp_matches(text, '(?i)^\\s*({R.CODE_WORDS})([^A-Za-z0-9_]|$)') OR regexp_matches(text, '^\\s*[{{}}();]+\\s*$') OR regexp_matches(text, '^\\s*(//|#|/\\*)')
 OR regexp_matches(text, '\\$\\([^)\\r\\n]*\\)\\.|=>|->|\\.then\\(|\\.catch\\(|require\\(|import\\s+\\{{') OR (regexp_matches(text, '[{{;]\\s*$') AND regexp_matches(text, '[=<>!&|+\\-*/%]')))"""
STACK, ERRORS = "CAST([] AS STRUCT(p INT, c VARCHAR)[])", "CAST([] AS STRUCT(kind VARCHAR, pos INT, cl VARCHAR, op VARCHAR, op_pos INT)[])"


def token(p: str) -> str:
    return trim(f"substr(text, 1, {p})")


def state(s: str, e: str) -> str:
    return f"{{'s': {s}, 'e': {e}, 'p': x.p, 'c': x.c}}"


def error(kind: str, cl: str, op: str, at: str) -> str:
    return f"{{'kind': '{kind}', 'pos': x.p, 'cl': {cl}, 'op': {op}, 'op_pos': {at}}}"


OPENER = "translate(x.c, ')]}', '([{')"
DEEP = f"(len(a.s) + 1 - list_position(list_reverse(list_transform(a.s, lambda z: z.c)), {OPENER}))"
LISTED = f"(regexp_matches({token('x.p')}, '^\\d+$') OR regexp_matches({token('x.p')}, '^\\p{{L}}\\p{{M}}*$') OR ({token('x.p')} <> '' AND regexp_matches({token('x.p')}, '{ROMAN}')))"
STEP = f"""CASE WHEN x.c IN ('(', '[', '{{') THEN {state("list_append(a.s, {'p': x.p, 'c': x.c})", 'a.e')}
  WHEN len(a.s) = 0 AND ((code AND x.c = '}}') OR (x.c = ')' AND {LISTED})) THEN {state('a.s', 'a.e')}
  WHEN len(a.s) > 0 AND a.s[len(a.s)].c = {OPENER} THEN {state('a.s[1:len(a.s) - 1]', 'a.e')}
  WHEN list_contains(list_transform(a.s, lambda z: z.c), {OPENER})
   THEN {state(f'list_concat(a.s[1:{DEEP} - 1], a.s[{DEEP} + 1:len(a.s)])', f"list_append(a.e, {error('crossed', 'x.c', f'a.s[{DEEP}].c', f'a.s[{DEEP}].p')})")}
  ELSE {state('a.s', f"list_append(a.e, {error('orphan_close', 'x.c', 'CAST(NULL AS VARCHAR)', 'CAST(NULL AS INT)')})")} END"""


def signs(*some: str) -> str:
    """The text's characters that are among these, as states of a fold."""
    places = "list_transform(string_split(text, ''), lambda c, i: {'p': CAST(i - 1 AS INT), 'c': c})"
    kept = f"list_filter({places}, lambda x: x.c IN ({', '.join(repr(c) for c in some)}))"
    return f"list_transform({kept}, lambda x: {{'s': {STACK}, 'e': {ERRORS}, 'p': x.p, 'c': x.c}})"


FIRST = f"{{'s': {STACK}, 'e': {ERRORS}, 'p': -1, 'c': ''}}"
COUNT = lambda sign: f"sum(length(text) - length(replace(text, '{sign}', ''))) OVER (PARTITION BY doc_id)"
LEVEL = lambda o, c: f"({COUNT(o)} + {COUNT(c)} >= 10 AND abs({COUNT(o)} - {COUNT(c)}) <= 2)"
BRACKETS = f"""
b0 AS (SELECT *, {LEVEL('(', ')')} AS k0, {LEVEL('[', ']')} AS k1, {LEVEL('{', '}')} AS k2, {CODE} AS code FROM el),
b1 AS (SELECT *, list_reduce(list_prepend({FIRST}, {signs(*'([{)]}')}), lambda a, x: {STEP}) AS r FROM b0 WHERE regexp_matches(text, '[()\\[\\]{{}}]')),
b2 AS (SELECT *, unnest(list_concat(r.e, list_transform(list_filter(r.s, lambda z: NOT (code AND z.c = '{{')),
  lambda z: {{'kind': 'unclosed_open', 'pos': z.p, 'cl': translate(z.c, '([{{', ')]}}'), 'op': z.c, 'op_pos': z.p}}))) AS e FROM b1),
b3 AS (SELECT *, e.pos AS pos, coalesce(e.op, translate(e.cl, ')]}}', '([{{')) AS kind FROM b2),
brackets AS (SELECT doc_id, ord, pos AS match_pos, {around(40)} AS original,
  CASE e.kind WHEN 'crossed' THEN '[ukrštene zagrade: ' || e.op || '...' || e.cl || ']' WHEN 'orphan_close' THEN '[ukloniti višak „' || e.cl || '“]' ELSE '[dodati „' || e.cl || '“]' END AS replacement,
  CASE e.kind WHEN 'crossed' THEN 'Ukrštene zagrade: ' || e.op || ' na poziciji ' || e.op_pos || ' zatvorena sa ' || e.cl || ' na poziciji ' || pos || '.'
   WHEN 'orphan_close' THEN 'Zatvorena zagrada ' || e.cl || ' bez odgovarajuće otvorene.'
   ELSE 'Otvorena ' || CASE kind WHEN '(' THEN 'obla' WHEN '[' THEN 'uglasta' ELSE 'vitičasta' END || ' zagrada bez zatvorene.' END AS rationale,
  CASE e.kind WHEN 'crossed' THEN 0.95 ELSE 0.98 END AS confidence
  FROM b3 WHERE e.kind = 'crossed' OR NOT CASE kind WHEN '(' THEN k0 WHEN '[' THEN k1 ELSE k2 END),
s1 AS (SELECT *, list_reduce(list_prepend({FIRST}, {signs(*'();')}), lambda a, x: CASE WHEN x.c = '(' THEN {state("list_append(a.s, {'p': -1, 'c': ''})", 'a.e')}
  WHEN x.c = ')' THEN {state('a.s[1:len(a.s) - 1]', 'a.e')} WHEN len(a.s) > 0 AND a.s[len(a.s)].p = -1 THEN {state("list_append(a.s[1:len(a.s) - 1], {'p': x.p, 'c': ''})", 'a.e')}
  ELSE {state('a.s', 'a.e')} END) AS r FROM el WHERE contains(text, '(') AND contains(text, ';')),
s2 AS (SELECT *, unnest(list_filter(list_transform(r.s, lambda z: z.p), lambda p: p >= 0)) AS pos FROM s1),
semicolons AS (SELECT doc_id, ord, pos AS match_pos, {around(50)} AS original FROM s2)"""

GREEK = "[\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}](?:[\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF},;·.''\"\\x{0300}-\\x{036F}\\x{1DC0}-\\x{1DFF}]|\\s){2,}"
NEAR = f"[(„‚\"][^)\"“]*[{LETTERS}\\x{{00C0}}-\\x{{024F}}]{{5,}}[^)\"“]*[)\"“]"
GREEKS = f"""
g1 AS (SELECT doc_id, ord, text, string_split(regexp_replace(text, '{GREEK}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM el WHERE regexp_matches(text, '{GREEK}')),
g2 AS (SELECT *, unnest(range(2, len(parts) + 1, 2)) AS i FROM g1),
g3 AS (SELECT *, parts[i] AS m, CAST(length(array_to_string(parts[1:i - 1], '')) AS INT) AS pos FROM g2),
g4 AS (SELECT *, substr(text, pos + length(m) + 1, 150) AS aft, substr(text, greatest(0, pos - 100) + 1, pos - greatest(0, pos - 100)) AS bef FROM g3),
greek AS (SELECT doc_id, ord, pos AS match_pos, CASE WHEN length(m) > 40 THEN substr(m, 1, 40) || '...' ELSE m END AS original FROM g4
  WHERE NOT regexp_matches(aft, '{NEAR}') AND NOT regexp_matches(bef, '[(„‚].*[{LETTERS}]{{5,}}.*[)“"]') AND NOT (regexp_matches(bef, '\\(\\s*$') AND regexp_matches(aft, '^\\s*\\)')))"""

# a run of k equal words in a row has k // 2 pairs; a word ends a pair even if marks follow it
DOUBLED = """
d1 AS (SELECT doc_id, ord, regexp_split_to_array(text, '\\s+') AS ws, regexp_extract_all(text, '\\s+') AS gaps FROM el),
d2 AS (SELECT doc_id, ord, gaps, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d1),
d3 AS (SELECT *, lower(w) AS a, regexp_matches(w, '^\\p{L}+$') AS pure, regexp_extract(w, '^(\\p{L}+)(?:[,.:;!?)\\]}].*)?$', 1) AS head FROM d2),
d4 AS (SELECT *, lag(a) OVER o AS before, lag(pure) OVER o AS before_pure, lag(w) OVER o AS before_w FROM d3 WINDOW o AS (PARTITION BY doc_id, ord ORDER BY i)),
d5 AS (SELECT *, sum(CASE WHEN before_pure AND before = lower(head) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, ord ORDER BY i) AS run FROM d4),
d6 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord, run ORDER BY i) AS nth FROM d5),
doubled AS (SELECT doc_id, ord, before_w || gaps[i - 1] || head AS original, before_w AS word FROM d6 WHERE nth % 2 = 0 AND length(before_w) >= 2
  AND lower(before_w) NOT IN (""" + ", ".join(f"'{w}'" for w in R.MAY_REPEAT) + "))"

REPEATED = f"""
r1 AS (SELECT *, {flat('t')} AS norm FROM el WHERE type = 'paragraph' AND length(t) >= 50),
r2 AS (SELECT *, first_value(id) OVER o AS earlier, row_number() OVER o AS nth FROM r1 WINDOW o AS (PARTITION BY doc_id, norm ORDER BY ord)),
repeated AS (SELECT doc_id, ord, substr(text, 1, 80) || '...' AS original, 'Ponovljen pasus (' || earlier || ').' AS rationale FROM r2 WHERE nth > 1)"""


def found_sql(elements: str, spacing: dict[int, str], known: dict[str, str]) -> str:
    """CTEs up to `checked`: all findings with their seq and whether they stand in their text. known: SQL of single
    rules by query name."""
    def rows(source: str, rule: str, category: str, priority: str, confidence, original: str, replacement: str, rationale: str, check: int, sub: int = 0, pos: str = "0", where: str = "true") -> str:
        return (
            f"SELECT e.doc_id, e.ord, e.section, e.id AS paragraph_id, e.q, '{rule}' AS rule_id, '{category}' AS category, '{priority}' AS "
                f"priority, CAST({confidence} AS DOUBLE) AS confidence, "
            f"{original} AS original, {replacement} AS replacement, {rationale} AS rationale, {check} AS check_ord, {sub} AS sub_ord, "
                f"CAST({pos} AS INT) AS match_pos, e.text AS body "
            f"FROM {source} x JOIN el e USING (doc_id, ord) WHERE {where}"
        )

    def whole(rule: str, confidence: float, original: str, replacement: str, rationale: str, sub: int, where: str) -> str:
        return (
            f"SELECT doc_id, -1, '(ceo dokument)', 'doc-global', false, '{rule}', '{R.QUOTES}', '{R.MUST}', {confidence}, {original}, "
                f"'{replacement}', {rationale}, 1, {sub}, 0, '' "
            f"FROM quote_balance WHERE {where}"
        )

    lits = lambda s: f"'{s}'"
    snip = "substr(e.t, 1, 60) || CASE WHEN length(e.t) > 60 THEN '...' ELSE '' END"
    surer = {1: (R.MUST, 0.99), 2: (R.MUST, 0.97), 3: (R.SHOULD, 0.90), 4: (R.SHOULD, 0.90), 5: (R.MUST, 0.85)}
    parts = [
        rows("brackets", "unbalanced_brackets_body", R.BRACKETS, R.MUST, "x.confidence", "x.original", "x.replacement", "x.rationale", 0, 0, "x.match_pos"),
        rows("semicolons", "unbalanced_brackets_body", R.BRACKETS, R.CHECK, 0.75, "x.original", lits("[proveriti da li „;“ treba da bude „)“]"), lits("Tačka-zarez unutar nezatvorene zagrade."), 0, 1, "x.match_pos"),
        *[rows(f"spacing_{k}", "spacing_body", R.SPACING, *surer[k], "x.original", "x.replacement", "x.rationale", 3, k, "x.match_pos") for k in spacing],
        rows("script_mix", "script_mixing_body", R.SCRIPT, R.MUST, 0.96, "x.original", "x.replacement", "x.rationale", 4),
        rows("greek", "greek_body", R.GREEK, R.CHECK, 0.75, "x.original", lits("[dodati prevod]"), lits("Grčki bez prevoda u blizini."), 5, 0, "x.match_pos"),
        rows("doubled", "duplicate_words_body", R.DOUBLED, R.MUST, 0.95, "x.original", "x.word", "'Ponovljena reč „' || x.word || '“.'", 6),
        rows("toc_match", "toc_mismatch", R.TOC, R.MUST, 0.88, "'TOC: „' || x.title || '“'", "'Uskladiti: „' || x.near || '“'", lits("Razlika TOC i naslova."), 7, 0, "0", "NOT x.same AND x.near IS NOT NULL"),
        rows("toc_match", "toc_mismatch", R.TOC, R.CHECK, 0.70, "'TOC: „' || x.title || '“'", lits("[proveriti]"), lits("TOC stavka bez odgovarajućeg naslova."), 7, 0, "0", "NOT x.same AND x.near IS NULL"),
        rows("heading_not_in_toc", "toc_mismatch", R.TOC, R.CHECK, 0.70, "'Naslov: „' || x.title || '“'", lits("[dodati u sadržaj]"), lits("Naslov postoji u dokumentu ali nije u sadržaju."), 7, 1),
        rows("numbering_gaps", "numbering_skip", R.NUMBERING, R.MUST, 0.85, "'Stavka ' || x.num || ' (prethodno: ' || x.before || ')'", "'Očekivano: ' || (x.before + 1)", "'Numeracija preskače sa ' || x.before || ' na ' || x.num || '.'", 8),
        rows("bibliography_entries", "bibliography_missing_year", R.BIBLIOGRAPHY, R.CHECK, 0.75, snip, lits("[dodati godinu]"), lits("Bez godine izdanja."), 9, 0, "0", "x.no_year"),
        rows("bibliography_entries", "bibliography_missing_publisher", R.BIBLIOGRAPHY, R.CHECK, 0.60, snip, lits("[proveriti izdavača]"), lits("Moguć nedostatak izdavača."), 9, 1, "0", "x.no_publisher"),
        rows("bibliography_crossref", "bibliography_cross_reference", R.BIBLIOGRAPHY, R.CHECK, 0.70, "x.original", lits("[dodati u bibliografiju]"), "substr(x.original, 10) || ' citiran ali nije u bibliografiji.'", 9, 2),
        *[rows("urls", "urls_body", R.URL, p, c, "x.original", "x.replacement", "x.rationale", 10, sub, "0", f"x.rationale = '{why}'") for why, p, c, sub in (
            ("URL završen interpunkcijom.", R.CHECK, 0.80, 0), ("Zatvorena zagrada verovatno nije deo URL-a.", R.CHECK, 0.70, 0), ("Veoma dugačak URL.", R.SHOULD, 0.65, 1))],
        rows("repeated", "repeated_paragraph", R.REPETITION, R.MUST, 0.98, "x.original", lits("[ukloniti]"), "x.rationale", 12),
        rows("all_caps", "all_caps_body", R.CAPITALS, R.SHOULD, 0.70, "x.word", lits("[normalizovati ako nije skraćenica]"), "'„' || x.word || '“ ALL-CAPS u telu teksta.'", 13, 0, "x.nth"),
        rows("heading_sequence", "empty_heading", R.STRUCTURE, R.MUST, 0.99, "x.original", lits("[dodati tekst]"), lits("Naslov bez sadržaja."), 14, 0, "0", f"x.priority = '{R.MUST}'"),
        rows("heading_sequence", "empty_heading", R.STRUCTURE, R.SHOULD, 0.75, "x.original", lits("[dodati sadržaj ispod]"), lits("Naslov bez sadržaja pre naslova istog/višeg nivoa."), 14, 1, "0", f"x.priority = '{R.SHOULD}'"),
        whole("quotes_body", 0.95, "'[' || straight || ' ravnih navodnika u dokumentu]'", "[zameniti tipografskim: „...“]", "'Ukupno ' || straight || ' ravnih navodnika. Standard: „...“.'", 0, "straight > 0"),
        whole("unmatched_quotes_body", 0.88, "'[' || opened || '× „ vs ' || closed || '× “ u celom dokumentu]'", "[upariti navodnike]", "'Neupareni tipografski navodnici kroz ceo dokument (moguć višepasusni citat).'", 1, "opened <> closed"),
    ]
    names = ["script_mix", "toc_match", "heading_not_in_toc", "numbering_gaps", "bibliography_entries", "bibliography_crossref", "urls", "all_caps", "heading_sequence", "quote_balance"]
    own = [f"{n} AS ({known[n]})" for n in names] + [f"spacing_{k} AS ({sql})" for k, sql in spacing.items()]
    clean = "regexp_replace(regexp_replace(original, '^\\.\\.\\.', ''), '\\.\\.\\.$', '')"
    exempt = " OR ".join(f"starts_with(original, '{h}')" for h in R.EXEMPT)
    return elements + "," + ",".join([ELEMENT, BRACKETS, GREEKS, DOUBLED, REPEATED, *own]) + f""",
raw AS ({" UNION ALL ".join(parts)}),
demoted AS (SELECT * REPLACE (CASE WHEN q THEN '{R.CHECK}' ELSE priority END AS priority) FROM raw),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY check_ord, ord, sub_ord, match_pos, original, replacement) AS INT) AS seq FROM demoted),
found AS (SELECT *, 'F-' || CASE WHEN seq < 10000 THEN lpad(CAST(seq AS VARCHAR), 4, '0') ELSE CAST(seq AS VARCHAR) END AS finding_id, 'OPEN' AS status,
  check_ord = 1 OR {exempt} OR body = '' OR length({clean}) <= 3 OR contains(body, {clean}) AS stands FROM ranked),
once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, paragraph_id, category, original, replacement ORDER BY seq) AS nth FROM found WHERE original IS DISTINCT FROM replacement),
verified AS (SELECT * FROM once WHERE nth = 1 AND confidence >= {review.LEAST_CONFIDENCE} AND stands)"""


STATUSES = """
given AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'REJECTED' ELSE 'DONE' END AS given FROM labels WHERE quality = 0 OR toxic = 1),
reviewed AS (SELECT v.* REPLACE (coalesce(g.given, status) AS status) FROM verified v LEFT JOIN given g USING (doc_id))"""


def summary_sql(found: str) -> str:
    count = lambda c: f"count(*) FILTER (WHERE {c})"
    p, is_open = "priority = '{}'", "status = 'OPEN'"
    columns = {
        "total": "count(*)", "blocker": count(p.format("BLOCKER")), "mandatory": count(p.format(R.MUST)), "verify": count(p.format(R.CHECK)), "recommended": count(p.format(R.SHOULD)),
        "open": count(is_open), "done": count("status = 'DONE'"), "rejected": count("status = 'REJECTED'"), "open_blocker": count(is_open + " AND " + p.format("BLOCKER")),
        "open_mandatory": count(is_open + " AND " + p.format(R.MUST)), "open_verify": count(is_open + " AND " + p.format(R.CHECK)), "open_recommended": count(is_open + " AND " + p.format(R.SHOULD)),
        "categories": "count(DISTINCT category)",
    }
    sums = ", ".join(f"{c} AS {k}" for k, c in columns.items())
    every = ", ".join(f"coalesce({k}, 0) AS {k}" for k in columns)
    lacking = review.lacking(review.scope(review.FULL))
    return f""", sums AS (SELECT doc_id, {sums} FROM {found} GROUP BY doc_id), summed AS (SELECT doc_id, {every} FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN sums USING (doc_id))
SELECT *, false AS gate, 'DELIMIČAN' AS status, CASE WHEN open_blocker + open_mandatory + open_verify = 0 THEN 'Determinističke provere su završene. Nedostaje: {lacking}.'
 ELSE 'Dokument ima ' || open_mandatory || ' obaveznih, ' || open_blocker || ' blokirajućih i ' || open_verify || ' za proveru. Nije spreman za objavljivanje.' END AS assessment FROM summed"""


SEEN = {
    "brackets": "t <> ''", "quotes": "text <> ''", "markdown": "false", "spacing": "text <> ''", "scriptMix": "text <> ''", "greek": "text <> ''", "duplicates": "text <> ''",
    "toc": "type = 'paragraph' AND regexp_matches(text, '^(.+?)(?:\\.{3,}|\\t)\\s*\\d+\\s*$')", "numbering": "regexp_matches(text, '^\\s*(\\d+)[.)]\\s')", "bibliography": "entry",
    "urls": "text <> ''", "repetition": "type = 'paragraph' AND length(t) >= 50",
    "capsWords": "text <> '' AND type = 'paragraph' AND (fh IS NULL OR ord >= fh) AND NOT regexp_matches(text, '\\.{3,}') AND NOT (t = upper(t) AND t <> lower(t))",
    "emptyHeadings": "type = 'heading'",
}


def passed_sql() -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in SEEN.items())
    each = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS area, '{category}' AS category, {k} AS count FROM counted" for k, category, name in review.CHECKS)
    return f""", looked AS (SELECT el.*, x.doc_id IS NOT NULL AS entry, min(CASE WHEN type = 'heading' THEN ord END) OVER (PARTITION BY el.doc_id) AS fh FROM el LEFT JOIN bibliography_entries x USING (doc_id, ord)),
counted AS (SELECT doc_id, {counts} FROM looked GROUP BY doc_id), every AS ({each})
SELECT doc_id, area, 'Bez grešaka' AS result, count FROM every WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = every.doc_id AND f.category = every.category)"""


def oracle(elements: str, spacing: dict[int, str], known: dict[str, str], columns: list[str]) -> dict[str, str]:
    found, names = found_sql(elements, spacing, known), ", ".join(columns)
    block = """'## ' || finding_id || ' · ' || category || ' · ' || priority || chr(10) || 'Odeljak: ' || section || chr(10) || {fo} || chr(10) || original || chr(10) || {fo} || chr(10) || '→'
 || chr(10) || {fr} || chr(10) || replacement || chr(10) || {fr} || chr(10) || rationale || chr(10)"""
    fence = lambda c: f"repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all({c}, '`+'), lambda r: length(r))), 0)))"
    block = block.format(fo=fence("original"), fr=fence("replacement"))
    return {
        "element_ids": elements + "," + ELEMENT + " SELECT doc_id, ord, id FROM el",
        "brackets": elements + "," + ELEMENT + "," + BRACKETS + " SELECT doc_id, ord, match_pos, original, rationale FROM brackets",
        "greek": elements + "," + ELEMENT + "," + GREEKS + " SELECT doc_id, ord, match_pos, original, '[dodati prevod]' AS replacement, 'Grčki bez prevoda u blizini.' AS rationale FROM greek",
        "findings": found + f" SELECT {names} FROM found",
        "findings_verified": found + f" SELECT {names} FROM verified",
        "passed_checks": found + passed_sql(),
        "summary": found + summary_sql("verified"),
        "global_patterns": found + """, g AS (SELECT doc_id, category, rationale, count(*) AS count, min(seq) AS first_seq FROM verified GROUP BY ALL HAVING count(*) >= 3)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first_seq) AS rank FROM g""",
        "export_open": found + "," + STATUSES + f" SELECT {names} FROM reviewed WHERE status = 'OPEN'",
        "status_overlay": found + "," + STATUSES + summary_sql("reviewed"),
        "markdown_report": found + f" SELECT doc_id, string_agg({block}, chr(10) ORDER BY seq) AS report FROM verified GROUP BY doc_id",
    }
