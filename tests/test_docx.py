import io
import zipfile

from docaudit.sources import docx

NS = ('xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
      'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"')


def package(body="", **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return out.getvalue()


def p(text, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def numbered(n, level=0):
    return f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr>'


NUMBERING = f"""<w:numbering {NS}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>
<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>"""


def test_headings_lists_and_interruption():
    body = p("T", '<w:pStyle w:val="Heading2"/>') + p("a", numbered(5)) + p("x", numbered(5, 1)) + p("y", numbered(5, 1)) + p("b", numbered(5)) + p("z", numbered(5, 1)) + p("plain") + p("c", numbered(5))
    got = docx.parsed(package(body, word__numbering_DOT_xml=NUMBERING))
    assert (got[0]["type"], got[0]["level"]) == ("heading", 2)
    assert [g["label"] for g in got[1:]] == ["1.", "1.a)", "1.b)", "2.", "2.a)", None, "1."]
    assert got[7]["list_id"] != got[4]["list_id"]


def test_numbers():
    assert [docx.letters(n) for n in (1, 26, 27, 28, 53)] == ["a", "z", "aa", "ab", "ba"] and docx.roman(1994) == "MCMXCIV" and docx.shown(4, "lowerRoman") == "iv"


def test_tracked_changes_and_alternatives():
    body = '<w:p><w:r><w:t>a</w:t></w:r><w:del><w:r><w:delText>b</w:delText></w:r></w:del><w:ins><w:r><w:t>c</w:t><w:tab/></w:r></w:ins></w:p>' + (
        f'<mc:AlternateContent><mc:Choice Requires="zz">{p("no")}</mc:Choice><mc:Fallback>{p("yes")}</mc:Fallback></mc:AlternateContent>')
    assert [x["text"] for x in docx.parsed(package(body))] == ["ac\t", "yes"]
    assert docx.parsed(package(body), "show_deleted")[0]["text"] == "abc\t"


def test_cells_merge_and_nest():
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{text}</w:tc>"
    inner = f"<w:tbl><w:tr>{cell(p('in'))}</w:tr></w:tbl>"
    body = f"<w:tbl><w:tr>{cell(p('a'), '<w:vMerge w:val=\"restart\"/>')}{cell(p('b') + inner, '<w:gridSpan w:val=\"2\"/>')}{cell(p('c'))}</w:tr><w:tr>{cell(p(''), '<w:vMerge/>')}{cell(p('d'))}</w:tr></w:tbl>"
    got = [x for x in docx.parsed(package(body)) if x["unit"] == "cell"]
    assert [(x["text"], x["depth"], x["row_index"], x["column_index"]) for x in got] == [("a", 0, 0, 0), ("b", 0, 0, 1), ("in", 1, 0, 0), ("c", 0, 0, 3), ("", 0, 1, 0), ("d", 0, 1, 1)]
    assert got[4]["merge_row"] == 0


def test_notes_and_linked_headers():
    notes = f'<w:footnotes {NS}><w:footnote w:type="separator" w:id="0">{p("")}</w:footnote><w:footnote w:id="2">{p("note")}</w:footnote></w:footnotes>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="header1.xml"/><Relationship Id="r2" Target="header2.xml"/></Relationships>'
    body = p("x") + '<w:sectPr><w:headerReference r:id="r1"/></w:sectPr>'
    got = docx.parsed(package(body, word__footnotes_DOT_xml=notes, **{"word___rels__document_DOT_xml_DOT_rels": rels}, word__header1_DOT_xml=f"<w:hdr {NS}>{p('head')}</w:hdr>", word__header2_DOT_xml=f"<w:hdr {NS}>{p('unused')}</w:hdr>"))
    assert [(x["unit"], x["text"]) for x in got[1:]] == [("footnote", "note"), ("header", "head")]


def test_unsafe_packages_give_an_error_row(spark, tmp_path):
    files = {"ok.docx": package(p("fine")), "vba.docx": package(word__vbaProject_DOT_bin="x"), "junk.docx": b"junk", "emb.docx": package(word__embeddings__a_DOT_bin="x"), "skip.txt": b"no"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in docx.read(spark, tmp_path.as_uri()).collect()}
    assert set(got) == set(files) - {"skip.txt"} and got["ok.docx"]["text"] == "fine" and got["ok.docx"]["error"] is None
    assert all(got[n]["error"] for n in ("vba.docx", "junk.docx", "emb.docx"))
