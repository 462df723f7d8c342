from test_docx import NS, NUMBERING, numbered, p, package

from docaudit.operators import review
from docaudit.plans.docx_audit import audit_units
from docaudit.sources import docx, files


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def notes(*texts):
    return f"<w:footnotes {NS}>" + "".join(f'<w:footnote w:id="{i + 1}">{p(t)}</w:footnote>' for i, t in enumerate(texts)) + "</w:footnotes>"


def audited(spark, options=None, **packages):
    return audit_units(docx.units(spark.createDataFrame([(k, bytearray(v)) for k, v in packages.items()], "path string, content binary")), options)


def test_one_plan_from_units_to_findings(spark):
    start = NUMBERING.replace('<w:num w:numId="5">', '<w:num w:numId="6"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="4"/></w:lvlOverride></w:num><w:num w:numId="5">')
    body = p("Naslov", '<w:pStyle w:val="Heading1"/>') + p("dve  reči i VELIKA SLOVA") + table(("SLOVA", "a  b"), ("„c  d“", "ok")) + p("jedan", numbered(5)) + p("dva", numbered(5))
    docs = {
        "a": package(body, word__numbering_DOT_xml=start, word__footnotes_DOT_xml=notes("je je", "")),
        "b": package(p("čisto")), "c": b"junk", "d": package(p("x") + "<w:r><m:oMath xmlns:m='urn:m'/></w:r>"),
    }
    a = audited(spark, **docs)
    got = [(r["doc_id"], r["rule_id"], r["priority"], r["section"]) for r in a.verified.orderBy("doc_id", "seq").collect()]
    assert got == [
        ("a", "spacing_body", "OBAVEZNO", "Naslov"), ("a", "duplicate_words_note", "OBAVEZNO", "(fusnota 1)"), ("a", "empty_note", "OBAVEZNO", "(fusnota 2)"),
        ("a", "all_caps_body", "PREPORUKA", "Naslov"), ("a", "spacing_table_cell", "OBAVEZNO", "Naslov"), ("a", "spacing_table_cell", "PROVERITI", "Naslov"),
        ("d", "processing_coverage", "PROVERITI", "(pokrivenost)"),
    ]
    assert {r["original"] for r in a.verified.where("rule_id = 'empty_note' or rule_id = 'processing_coverage'").collect()} == {"[Fusnota 2 - prazna]", "Nije obrađeno: equations"}
    passed = {(r["doc_id"], r["area"]): r["count"] for r in a.passed().collect()}
    assert ("a", "Fusnote") not in passed and passed[("b", "Fusnote")] == 0 and ("a", "Razmaci i interpunkcija") not in passed and ("a", "Duple reči") not in passed
    assert {r["doc_id"]: r["total"] for r in a.summary().collect()} == {"a": 6, "b": 0, "d": 1}


def test_list_numbers_that_skip(spark):
    levels = NUMBERING.replace('<w:start w:val="1"/><w:numFmt w:val="lowerLetter"/>', '<w:start w:val="3"/><w:numFmt w:val="lowerLetter"/>')
    body = p("a", numbered(5)) + p("b", numbered(5)) + p("c", numbered(5, 1)) + p("d", numbered(5, 1)) + p("e", numbered(5)) + p("f", numbered(5, 1))
    got = audited(spark, {"numbering"}, a=package(body, word__numbering_DOT_xml=levels)).candidates.collect()
    labels = [(x["number"], x["label"], x["list_id"]) for x in docx.parsed(package(body, word__numbering_DOT_xml=levels))]
    want = [(x, y) for x, y in zip(labels[2:4] + labels[5:], labels[3:4] + labels[5:]) if x[2] == y[2] and y[0] != x[0] + 1]
    assert [(r["original"], r["confidence"]) for r in got] == [(f"Stavka {y[1]} (prethodno: {x[1]})", 0.92) for x, y in want]


def test_coverage_follows_the_options(spark):
    one = package(p("x"), word__footnotes_DOT_xml=notes("y"))
    assert [r["original"] for r in audited(spark, {"spacing"}, a=one).candidates.collect()] == ["Delimično: footnotes"]
    assert audited(spark, review.FULL, a=one).candidates.count() == 0


def test_files_are_dispatched_by_extension(spark, tmp_path, monkeypatch):
    (tmp_path / "a.md").write_bytes("\ufeff# T\r\nx".encode())
    (tmp_path / "b.TXT").write_text("y")
    (tmp_path / "c.docm").write_bytes(b"z")
    (tmp_path / "d.pdf").write_bytes(b"z")
    (tmp_path / "e.docx").write_bytes(package(p("w")))
    (tmp_path / "f.docx").write_bytes(b"z" * 5000)
    good, bad = files.texts(spark, tmp_path.as_uri())
    assert sorted((r["kind"], r["text"]) for r in good.collect()) == [("markdown", "# T\nx"), ("txt", "y")]
    assert sorted(r["extension"] for r in bad.collect()) == ["docm", "pdf"]
    monkeypatch.setattr(docx, "MAX_UPLOAD", 4000)
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in docx.read(spark, tmp_path.as_uri()).collect()}
    assert got["e.docx"] is None and "macros" in got["c.docm"] and "5000 bytes" in got["f.docx"] and set(got) == {"c.docm", "e.docx", "f.docx"}
