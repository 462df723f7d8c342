"""Spreadsheets of findings: a small OOXML writer with inline strings, and its three sheets as frames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.operators.review import safe_cell

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Characters that XML can't hold.
_BAD = {i: None for i in range(32) if i not in (9, 10, 13)}


def sheets(findings: DataFrame, summary: DataFrame, passed: DataFrame, doc_id: int) -> dict[str, DataFrame]:
    """The sheets of one document; text that a spreadsheet would compute is guarded."""
    guard = lambda df: df.select(*[safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    own = lambda df: df.where(F.col("doc_id") == doc_id)
    return {"Summary": guard(own(summary)), "Findings": guard(own(findings).orderBy("seq")), "Passed": guard(own(passed))}


def workbook(tables: dict[str, tuple[list[str], Iterable[tuple]]]) -> bytes:
    """A package with a sheet for each (names, rows)."""
    def cell(x) -> str:
        if x is None:
            return "<c/>"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f"<c><v>{x}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x).translate(_BAD))}</t></is></c>'

    out = io.BytesIO()
    n = range(1, len(tables) + 1)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="r{i}"/>' for i, name in zip(n, tables)) + "</sheets></workbook>")
        for i, (names, rows) in zip(n, tables.values()):
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [names, *rows])
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def export(frames: dict[str, DataFrame]) -> bytes:
    """A workbook of one document's frames, whose rows come to the driver as that document's report."""
    return workbook({k: (df.columns, [tuple(r) for r in df.collect()]) for k, df in frames.items()})
