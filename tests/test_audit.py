import json

import duckdb
import pytest
from pyspark.sql import functions as F

from docaudit.functions.text import unit_hash
from docaudit.operators import evaluation as E
from docaudit.operators import review, rules
from docaudit.plans import queries as Q
from docaudit.plans.audit import audit
from docaudit.sources import paragraphs as P

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "pages", "benchmark", "conversations")


def plain(x):
    if x is None or x != x:
        return None
    return round(float(x), 5) if isinstance(x, float) else x


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = Q.QUERIES[name](spark, DATA)
    want = con.sql(Q.ORACLE_SQL[name])
    got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1] and got == as_rows(want.columns, want.fetchall())


def found(spark, text, kind="markdown", options=None):
    a = audit(spark.createDataFrame([(1, text)], "doc_id long, text string"), options, kind)
    return a, a.candidates.select("rule_id", "priority", "original", "replacement", "rationale").collect()


def errors(spark, text, **k):
    x = spark.createDataFrame([(text,)], "t string").select(rules.bracket_errors(F.col("t"), **k).alias("e")).first()["e"]
    return [(e["kind"], e["pos"]) for e in x]


@pytest.mark.parametrize("text,want", [
    ("([)]", [("crossed", 2)]), ("([])", []), ("({]}", [("orphan_close", 2), ("unclosed_open", 0)]), (")(", [("orphan_close", 0), ("unclosed_open", 1)]),
    ("1) one", []), ("iv) four", []), ("word) x", [("orphan_close", 4)]), ("(unclosed", [("unclosed_open", 0)]),
])
def test_brackets(spark, text, want):
    assert sorted(errors(spark, text)) == sorted(want)


def test_code_like_text_may_leave_braces_open(spark):
    x = spark.createDataFrame([("interface User {",), ("Just prose {",)], "t string").select(rules.code_like(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in x] == [True, False]


@pytest.mark.parametrize("text,rule", [
    ("two  spaces", "spacing_body"), ("word ,next", "spacing_body"), ("Madmo и Мadmo", "script_mixing_body"), ("je je tako", "duplicate_words_body"), ("је је тако", "duplicate_words_body"),
    ("„open only", "unmatched_quotes_body"), ('a "b" c', "quotes_body"), ("1. a\n3. b", "numbering_skip"), ("## A\n## B\nx", "empty_heading"), ("see http://a.b/c.", "urls_body"),
    ("# A\nOVO JE tekst sa VELIKIM slovima", "all_caps_body"), ("# Bibliografija\nMarkov, Ana. Knjiga bez ičega", "bibliography_missing_year"), ("τὸν Κάδμον ἐλθεῖν", "greek_body"),
    ("Opening....3\n# Openings\nx", "toc_mismatch"), ("x" * 60 + "\n" + "x" * 60, "repeated_paragraph"),
])
def test_rule_fires(spark, text, rule):
    assert rule in {r["rule_id"] for r in found(spark, text)[1]}


@pytest.mark.parametrize("text", ["1. a\n2. b\n1. c\n2. d", "# A\n## B\nx", "2 * 3 = 6", "da da", "plain text, with marks; and (brackets)."])
def test_clean_text_has_no_findings(spark, text):
    assert found(spark, text, "txt" if "*" in text else "markdown")[1] == []


def test_markdown_left_in_plain_text(spark):
    assert {r["rationale"] for r in found(spark, "x **bold** y", "txt")[1] if r["rule_id"] == "markdown_body"} == {"Ostatak **bold**."}


def test_basic_preset_leaves_rules_out_of_the_plan(spark):
    assert found(spark, "1. a\n3. b", options=review.BASIC)[1] == []


def test_verified_is_unique_and_stands_in_its_element(spark):
    a, _ = found(spark, "a  b  a  b\n# Title\n# Title\njoš  još\n" + "y" * 60 + "\n" + "y" * 60)
    rows = a.verified.collect()
    keys = [(r["paragraph_id"], r["category"], r["original"], r["replacement"]) for r in rows]
    assert rows and len(keys) == len(set(keys))
    s = a.summary().first()
    assert s["total"] == len(rows) == s["open"] and s["mandatory"] + s["verify"] + s["recommended"] + s["blocker"] == s["total"] and not s["gate"]


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "doc_id long, text string")
    a = audit(docs)
    assert a.verified.count() == 0
    assert {(r["doc_id"], r["total"], r["gate"], r["status"]) for r in a.summary().collect()} == {(i, 0, False, "DELIMIČAN") for i in (1, 2, 3)}


def test_gate_asks_for_what_was_covered(spark):
    docs = spark.createDataFrame([(1, "čist tekst"), (2, "a  b"), (3, "x ( a ) y")], "doc_id long, text string")
    for extra, final in ((set(), False), ({"grammar", "visualLayout"}, False), ({"grammar", "visualLayout", "style"}, True)):
        s = {r["doc_id"]: r for r in audit(docs, review.FULL | extra).summary().collect()}
        assert s[1]["gate"] == s[3]["gate"] == final and not s[2]["gate"]
        assert s[1]["assessment"] == ("Audit je završen. Sve provere su prošle bez nalaza." if final else "Determinističke provere su završene. Nedostaje: " + {
            0: "gramatika, stil, vizuelni prelom", 2: "stil"}[len(extra)] + ".")
        assert s[2]["assessment"] == "Dokument ima 1 obaveznih, 0 blokirajućih i 0 za proveru. Nije spreman za objavljivanje."
        assert not final or s[3]["assessment"].endswith("Postoji 2 preporuka.")
    assert review.scope(review.BASIC)["note"] == "Izvršeno: determinističke provere. Nije izvršeno: gramatika, stil, vizuelni prelom."
    assert review.scope({"grammar", "style", "visualLayout"})["note"] == "Izvršeno: gramatička analiza, stilska analiza, vizuelni pregled."
    assert audit(docs).summary().count() == 3 and review.summary(audit(docs).verified, docs, review.FULL, ()).where("doc_id = 1").first()["gate"]


def test_finding_ids_stay_unique_beyond_9999(spark):
    a = audit(spark.createDataFrame([(1, "\n".join(f"w{i}  x{i}" for i in range(12000)))], "doc_id long, text string"), {"spacing"})
    ids = [r["finding_id"] for r in a.candidates.select("finding_id").collect()]
    assert len(ids) == len(set(ids)) == 12000 and {"F-0001", "F-12000"} < set(ids)


def test_bibliography_spans(spark):
    text = "# Izvori\n# Literatura\nprvi unos bez\n## Dodatak\ndrugi unos bez\n# Kraj\ntreći unos bez\n## References\nčetvrti unos\n## X\npeti unos bez"
    rows = rules.in_context(P.elements(spark.createDataFrame([(1, text)], "doc_id long, text string"))).where(rules.bibliography_entry())
    assert sorted(r["text"].split()[0] for r in rows.collect()) == ["drugi", "prvi", "četvrti"]


def test_findings_in_direct_quotes_are_to_be_verified(spark):
    quoted = ["„Reč  i ) reč“", "«Reč  i ) reč»", "— Reč  i ) reč", "― Reč  i ) reč", "λόγος  λόγος"]
    texts = list(enumerate([*quoted, "Reč  i ) reč", "# „Reč  i ) reč“"]))
    got = audit(spark.createDataFrame(texts, "doc_id long, text string"), {"spacing", "brackets"}).candidates.collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in texts}
    for r in got:
        assert r["is_direct_quote"] == (r["doc_id"] < len(quoted))
        if r["is_direct_quote"]:
            assert (r["priority"], r["auto_fixable"], r["requires_source_verification"]) == (rules.CHECK, False, True)
    assert any(r["priority"] != rules.CHECK for r in got if r["doc_id"] == 5)


def test_export_open_only(spark):
    a, _ = found(spark, "a  b\nc  d")
    first = a.verified.orderBy("seq").first()["finding_id"]
    ev = spark.createDataFrame([(1, first, "OPEN", 1), (1, first, "DONE", 2)], "doc_id long, finding_id string, status string, ts int")
    x = review.with_status(a.verified, ev)
    assert review.exported(x, "open").count() == a.verified.count() - 1


def test_json_of_an_audit_and_of_what_is_open(spark):
    a, _ = found(spark, "a  b\nc  d\ne  f", options={"spacing", "brackets"})
    first = a.verified.orderBy("seq").first()["finding_id"]
    ev = spark.createDataFrame([(1, first, "DONE", 1)], "doc_id long, finding_id string, status string, ts int")
    for x, left in ((a.verified, 3), (review.exported(review.with_status(a.verified, ev), "open"), 2)):
        got = json.loads(review.audit_json(x, a.docs, a.passed(), {"spacing", "brackets"}).first()["json"])
        assert got["summary"]["total"] == got["summary"]["open_mandatory"] == len(got["findings"]) == left and got["audit_status"]["status"] == "DELIMIČAN"
        assert [p["area"] for p in got["passed_checks"]] == ["Nebalansirane zagrade"] and got["summary"]["passed_checks"] == 1 and got["scope"]["proofreading"]
        assert [p["count"] for p in got["global_patterns"]] == ([3] if left == 3 else [])


def test_formula_guard_and_fence(spark):
    x = spark.createDataFrame([("=1+1", "a `` b"), (" @x", "no"), ("ok", "````")], "a string, b string").select(review.safe_cell(F.col("a")).alias("a"), review.fence(F.col("b")).alias("b"))
    assert [tuple(r) for r in x.collect()] == [("'=1+1", "```"), ("' @x", "```"), ("ok", "`````")]


def test_unit_hash(spark):
    def fnv(s):
        h = 0x811C9DC5
        b = s.encode("utf-16-be")
        for i in range(0, len(b), 2):
            h = ((h ^ int.from_bytes(b[i : i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
        return h

    texts = ["", "a", "šđ|x", "😀(a"]
    x = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unit_hash(F.col("t")).alias("h"))
    assert {r["t"]: r["h"] for r in x.collect()} == {t: fnv(t) for t in texts}


def test_wilson_and_sample_size(spark):
    x = spark.createDataFrame([("a", 1, 0.9)] * 4 + [("a", 0, 0.9)], "rule_id string, label int, confidence double")
    r = E.per_rule(x).first()
    assert (r["lower"], r["upper"]) == (0.375528, 0.963777)
    n = E.sample_size(spark.createDataFrame([(0.5, 0.05, 0.95, 2.0, 5.0)], "p double, e double, level double, design double, per_doc double")).first()
    assert (n["n"], n["findings"], n["documents"]) == (385, 770, 154)


def test_mcnemar_and_step_up(spark):
    x = spark.createDataFrame([("a", 0, 1)] * 20 + [("a", 1, 0)] * 2 + [("a", 1, 1)] * 78, "g string, before int, after int")
    r = E.mcnemar(x, "g").first()
    assert r["chi2"] == 13.136364 and r["p"] < 0.05
    t = spark.createDataFrame([(str(i), p) for i, p in enumerate([0.001, 0.01, 0.04, 0.06, 0.5])], "k string, p double")
    assert [r["significant"] for r in E.benjamini_hochberg(t, "k").orderBy("k").collect()] == [True, True, False, False, False]


def test_cliff_and_bootstrap(spark):
    x = spark.createDataFrame([("a", 1, v) for v in range(10, 15)] + [("a", 0, v) for v in range(1, 6)], "g string, side int, x int")
    r = E.cliffs_delta(x, "g").first()
    assert (r["delta"], r["effect"]) == (1.0, "large")
    b = E.bootstrap_bca(spark.createDataFrame([("a", 1)] * 8 + [("a", 0)] * 2, "rule_id string, label int")).first()
    assert 0.1 <= b["lower"] <= 0.8 <= b["upper"] <= 1.0


def test_bootstrap_draws_as_often_as_the_reference(spark):
    x = spark.createDataFrame([(f"r{k}", int(i < k)) for k in range(90, 200, 7) for i in range(997)], "rule_id string, label int")
    got, ten, two = (sorted(map(tuple, E.bootstrap_bca(x, **k).collect())) for k in ({}, {"resamples": 10000}, {"resamples": 2000}))
    assert got == ten != two
