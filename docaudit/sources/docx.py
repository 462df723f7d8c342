"""DOCX files as rows of units: body elements, table cells, notes, headers and footers.

A package is opened with the standard library in a Python worker, one file at a time; one that is unsafe
or broken gives a row with its error and nothing else. Files over the admitted size are turned away by
their metadata, before they are read. Parts never unpack to more than the size their entry declares, so the
limits on declared sizes and ratios hold for actual ones.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.sources import files

# Limits of a package and namespaces of its parts.
MAX_UPLOAD, MAX_ENTRIES, MAX_TOTAL, MAX_PART, MAX_RATIO = 20 * 2**20, 500, 100 * 2**20, 50 * 2**20, 200
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
KNOWN = {"w", "w14", "w15", "wps", "wp", "wp14", "r", "mc"}
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
MODES = ("accept", "show_deleted", "ignore_deleted")

UNITS = (
    "path string, error string, unit string, ord int, type string, level int, text string, style string, para_id string, num_id string, num_level int, num_pattern string, "
    "number int, label string, list_id string, num_fmt string, all_italic boolean, table_ord int, depth int, row_index int, column_index int, grid_span int, "
    "v_merge string, merge_row int, note_id string"
)
_EMPTY = dict.fromkeys(x.split()[0] for x in UNITS.split(", "))


class Unsafe(ValueError):
    pass


def checked(data: bytes) -> zipfile.ZipFile:
    """The package, if it is one and within every limit."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Unsafe("not a ZIP package") from e
    infos = z.infolist()
    if len(infos) > MAX_ENTRIES:
        raise Unsafe(f"{len(infos)} entries")
    names = {i.filename for i in infos}
    if "word/vbaProject.bin" in names:
        raise Unsafe("macros")
    if any(n.startswith("word/embeddings/") for n in names):
        raise Unsafe("embedded objects")
    total = 0
    for i in infos:
        if i.is_dir():
            continue
        if i.compress_size and i.file_size / i.compress_size > MAX_RATIO:
            raise Unsafe(f"compression ratio of {i.filename}")
        total += i.file_size
        if total > MAX_TOTAL:
            raise Unsafe("unpacked size")
    types = part(z, "[Content_Types].xml")
    if types is None or part(z, "word/document.xml") is None:
        raise Unsafe("no document part")
    if "vbaProject" in types or "macroEnabled" in types:
        raise Unsafe("macros")
    return z


def part(z: zipfile.ZipFile, name: str) -> str | None:
    """Text of a part by its byte-order mark. The declared size can lie, so reading stops at the limit."""
    if name not in z.namelist():
        return None
    with z.open(name) as f:
        raw = f.read(MAX_PART + 1)
    if len(raw) > MAX_PART:
        raise Unsafe(f"size of {name}")
    for mark, kind in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark):].decode(kind, "replace")
    return raw.decode("utf-8", "replace")


def tree(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    text = part(z, name)
    if text is None:
        return None
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise Unsafe(f"entities in {name}")
    try:
        return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))
    except ET.ParseError as e:
        raise Unsafe(f"XML of {name}") from e


def value(node: ET.Element | None, child: str | None = None, default=None):
    """w:val of a node or of its child."""
    node = node.find(W + child) if node is not None and child else node
    return default if node is None else node.get(W + "val", default)


def whole(x, default=None):
    try:
        return int(x)
    except (TypeError, ValueError):
        return default


def branch(node: ET.Element) -> ET.Element | None:
    """The first choice all of whose required prefixes are known, else the fallback."""
    for choice in node.findall(MC + "Choice"):
        if set((choice.get("Requires") or "").split()) <= KNOWN:
            return choice
    return node.find(MC + "Fallback")


def visible(node: ET.Element, mode: str) -> str:
    """Text that a reader sees: tabs, breaks and symbols in place, deletions only where the mode shows them."""
    out = []
    for x in node:
        tag = x.tag
        if tag == W + "t" or (tag == W + "delText" and mode == "show_deleted"):
            out.append(x.text or "")
        elif tag == W + "tab":
            out.append("\t")
        elif tag in (W + "br", W + "cr"):
            out.append("\n")
        elif tag == W + "sym":
            out.append("□")
        elif tag == MC + "AlternateContent":
            if (b := branch(x)) is not None:
                out.append(visible(b, mode))
        elif tag in (W + "del", W + "moveFrom"):
            if mode == "show_deleted":
                out.append(visible(x, mode))
        elif tag not in (W + "pPr", W + "rPr", W + "instrText", W + "sdtPr"):
            out.append(visible(x, mode))
    return "".join(out)


def blocks(parent: ET.Element, mode: str) -> Iterator[ET.Element]:
    """Paragraphs and tables in order, also those in content controls, insertions and alternatives."""
    for x in parent:
        if x.tag in (W + "p", W + "tbl"):
            yield x
        elif x.tag == W + "sdt":
            if (c := x.find(W + "sdtContent")) is not None:
                yield from blocks(c, mode)
        elif x.tag in (W + "customXml", W + "ins") or (x.tag == W + "del" and mode == "show_deleted"):
            yield from blocks(x, mode)
        elif x.tag == MC + "AlternateContent" and (b := branch(x)) is not None:
            yield from blocks(b, mode)


class Styles:
    """Outline levels and numbering of styles, inherited along their bases."""

    def __init__(self, root: ET.Element | None):
        self.own = {}
        for s in [] if root is None else root.findall(W + "style"):
            p = s.find(W + "pPr")
            num = None if p is None else p.find(W + "numPr")
            self.own[s.get(W + "styleId")] = (value(s, "basedOn"), whole(value(p, "outlineLvl")), None if num is None else (value(num, "numId"), whole(value(num, "ilvl"), 0)))

    def inherited(self, style: str | None, which: int):
        seen = set()
        while style in self.own and style not in seen:
            seen.add(style)
            if self.own[style][which] is not None:
                return self.own[style][which]
            style = self.own[style][0]
        return None


def letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def roman(n: int) -> str:
    out = "" if n > 0 else str(n)
    for v, s in ROMAN:
        while n >= v:
            out, n = out + s, n - v
    return out


def shown(n: int, kind: str | None) -> str:
    made = {
        "decimalZero": lambda: f"{n:02d}", "lowerLetter": lambda: letters(n), "upperLetter": lambda: letters(n).upper(), "lowerRoman": lambda: roman(n).lower(),
        "upperRoman": lambda: roman(n), "ordinal": lambda: f"{n}.",
    }
    return made.get(kind or "decimal", lambda: str(n))()


class Numbering:
    """Numbers and labels of list items, as the document runs. A list begins anew when its number stands
    after something else; deeper levels restart as their definitions say."""

    def __init__(self, root: ET.Element | None):
        self.levels, self.nums = {}, {}
        self.lists: dict[str, tuple[int, dict[int, int]]] = {}
        self.made = 0
        for a in [] if root is None else root.findall(W + "abstractNum"):
            self.levels[a.get(W + "abstractNumId")] = {whole(x.get(W + "ilvl"), 0): self._level(x) for x in a.findall(W + "lvl")}
        for n in [] if root is None else root.findall(W + "num"):
            over = {}
            for o in n.findall(W + "lvlOverride"):
                lvl = o.find(W + "lvl")
                over[whole(o.get(W + "ilvl"), 0)] = (whole(value(o, "startOverride")), None if lvl is None else self._level(lvl))
            self.nums[n.get(W + "numId")] = (value(n, "abstractNumId"), over)

    @staticmethod
    def _level(x: ET.Element) -> dict:
        return {"start": whole(value(x, "start")), "fmt": value(x, "numFmt", "decimal"), "text": value(x, "lvlText", "%1."), "restart": whole(value(x, "lvlRestart"))}

    def definition(self, num_id: str, level: int) -> dict | None:
        abstract, over = self.nums.get(num_id, (None, {}))
        base = self.levels.get(abstract, {}).get(level)
        if base is None:
            return None
        start, full = over.get(level, (None, None))
        merged = base | {k: v for k, v in (full or {}).items()}
        return merged | ({"start": start} if start is not None else {})

    def item(self, num_id: str, level: int, before: dict | None) -> tuple | None:
        """(number, label, list id, format, pattern) of an item; before: the row ahead of it."""
        d = self.definition(num_id, level)
        if d is None:
            return None
        if d["fmt"] in ("bullet", "none"):
            return None, None, None, d["fmt"], d["text"]
        same = before is not None and before["num_id"] == num_id
        if num_id not in self.lists or (before is not None and not same):
            self.made += 1
            self.lists[num_id] = (self.made, {})
        seq, counters = self.lists[num_id]
        if same and before["num_level"] is not None and before["num_level"] < level:
            for deep in range(level, 10):
                own = self.levels.get(self.nums[num_id][0], {}).get(deep)
                if own is None or own["restart"] == 0:
                    continue
                at = own["restart"] - 1 if own["restart"] is not None else (deep - 1 if deep else None)
                if at is not None and before["num_level"] <= at:
                    over = self.nums[num_id][1].get(deep, (None, None))[0]
                    counters[deep] = (over if over is not None else own["start"] if own["start"] is not None else 1) - 1
        counters[level] = counters.get(level, (d["start"] if d["start"] is not None else 1) - 1) + 1
        return counters[level], self.label(num_id, d["text"], counters), f"{num_id}-{seq}-{level}", d["fmt"], d["text"]

    def label(self, num_id: str, pattern: str, counters: dict[int, int]) -> str:
        def one(m: re.Match) -> str:
            level = int(m[0][1]) - 1
            d = self.definition(num_id, level) or {"start": 1, "fmt": "decimal"}
            return shown(counters.get(level) or d["start"] or 1, d["fmt"])

        return re.sub("%[1-9]", one, pattern or "")

    def interrupt(self) -> None:
        self.lists = {}


def paragraph(p: ET.Element, mode: str, styles: Styles, numbering: Numbering, before: dict | None) -> dict:
    props = p.find(W + "pPr")
    style = value(props, "pStyle", "Normal")
    outline = whole(value(props, "outlineLvl"))
    num = None if props is None else props.find(W + "numPr")
    num_id, num_level = value(num, "numId"), whole(value(num, "ilvl"))
    if num_id is None and (own := styles.inherited(style, 2)) is not None:
        num_id, num_level = own
    named = re.fullmatch(r"(?:Heading|Naslov)(\d+)", style)
    if not named and outline is None:
        outline = styles.inherited(style, 1)
    heading = bool(named) or (outline is not None and outline >= 0)
    digits = re.search(r"(\d+)$", style)
    text = visible(p, mode)
    runs = [r for r in p.iter(W + "r") if visible(r, mode)]
    row = _EMPTY | {
        "unit": "body", "type": "heading" if heading else "paragraph", "level": (int(digits[1]) if digits else outline + 1) if heading else None, "text": text, "style": style,
        "para_id": p.get(W14 + "paraId"), "num_id": num_id, "num_level": num_level,
        "all_italic": bool(runs) and all(r.find(f"{W}rPr/{W}i") is not None for r in runs),
    }
    item = numbering.item(num_id, num_level or 0, before) if num_id else None
    if item:
        row["number"], row["label"], row["list_id"], row["num_fmt"], row["num_pattern"] = item
    elif not num_id:
        numbering.interrupt()
    return row


def cells(tbl: ET.Element, mode: str, table_ord: int, depth: int = 0) -> tuple[list[dict], str]:
    """Cells of a table and of those nested in it, with grid columns and the row that a vertical merge began in;
    and the table's text."""
    rows, texts, open_ = [], [], {}
    for r, tr in enumerate(tbl.findall(W + "tr")):
        props = tr.find(W + "trPr")
        column, line = whole(value(props, "gridBefore"), 0), []
        for tc in tr.findall(W + "tc"):
            p = tc.find(W + "tcPr")
            span = whole(value(p, "gridSpan"), 1) or 1
            merge = None if p is None or p.find(W + "vMerge") is None else value(p, "vMerge") or "continue"
            direct, full, nested = [], [], []
            for b in blocks(tc, mode):
                if b.tag == W + "p":
                    t = visible(b, mode)
                    direct.append(t), full.append(t)
                else:
                    inner, t = cells(b, mode, table_ord, depth + 1)
                    nested += inner
                    full.append(t)
            for k in range(column, column + span):
                if merge == "restart":
                    open_[k] = r
                elif merge is None:
                    open_.pop(k, None)
            rows.append(_EMPTY | {
                "unit": "cell", "type": "cell", "text": " ".join(direct).strip(), "table_ord": table_ord, "depth": depth, "row_index": r, "column_index": column, "grid_span": span,
                "v_merge": merge, "merge_row": open_.get(column) if merge == "continue" else None,
            })
            rows += nested
            line.append(" ".join(full).strip())
            column += span
        texts.append(" | ".join(line))
    return rows, "\n".join(texts)


def parsed(data: bytes, mode: str = "accept") -> list[dict]:
    """All units of a package in order; ord counts body elements, tables included."""
    z = checked(data)
    styles, numbering = Styles(tree(z, "word/styles.xml")), Numbering(tree(z, "word/numbering.xml"))
    document = tree(z, "word/document.xml")
    out, body = [], []
    for b in blocks(document.find(W + "body"), mode):
        if b.tag == W + "p":
            body.append(paragraph(b, mode, styles, numbering, body[-1] if body else None))
        else:
            inside, text = cells(b, mode, len(body))
            numbering.interrupt()
            body.append(_EMPTY | {"unit": "body", "type": "table", "text": text, "style": "Table"})
            out += [c | {"ord": len(body) - 1} for c in inside]
    out = [x | {"ord": i} for i, x in enumerate(body)] + out
    for kind in ("footnote", "endnote"):
        root = tree(z, f"word/{kind}s.xml")
        notes = [] if root is None else [n for n in root.findall(W + kind) if n.get(W + "type") not in ("separator", "continuationSeparator", "continuationNotice")]
        out += [_EMPTY | {"unit": kind, "type": "note", "ord": i, "note_id": n.get(W + "id"), "text": " ".join(visible(p, mode) for p in n.iter(W + "p")).strip()} for i, n in enumerate(notes)]
    rels = tree(z, "word/_rels/document.xml.rels")
    targets = {} if rels is None else {r.get("Id"): r.get("Target") for r in rels.findall(REL + "Relationship") if r.get("TargetMode") != "External"}
    for kind in ("header", "footer"):
        names = dict.fromkeys(targets[x.get(R + "id")] for x in document.iter(W + kind + "Reference") if x.get(R + "id") in targets)
        n = 0
        for name in names:
            path = name.lstrip("/") if name.startswith("/") else posixpath.normpath(f"word/{name}")
            root = None if path.startswith("..") else tree(z, path)
            for p in [] if root is None else root.iter(W + "p"):
                if (t := visible(p, mode)).strip():
                    out.append(_EMPTY | {"unit": kind, "type": kind, "ord": n, "text": t})
                    n += 1
    return out


# What an audit covers in part or not at all, by what the document part holds.
PROBES = (
    ("partial", "textboxes", ("w:txbxContent", "wps:txbx")), ("partial", "drawings_shapes", ("mc:AlternateContent", "w:drawing")),
    ("unsupported", "equations", ("m:oMath",)), ("unsupported", "charts", ("c:chart",)), ("unsupported", "altChunk", ("w:altChunk",)),
    ("unsupported", "ole_objects", ("w:object", "o:OLEObject")),
)
SIDE_PARTS = (("footnote", "footnotes"), ("endnote", "endnotes"), ("header", "headers"), ("footer", "footers"))


def coverage(data: bytes, found: list[dict]) -> list[dict]:
    """Units of the kind coverage: names of what is covered in part or not at all, in order."""
    text, there = part(checked(data), "word/document.xml") or "", {x["unit"] for x in found}
    names = [("partial", name) for unit, name in SIDE_PARTS if unit in there] + [(kind, name) for kind, name, signs in PROBES if any(x in text for x in signs)]
    return [_EMPTY | {"unit": "coverage", "type": kind, "text": name, "ord": i} for i, (kind, name) in enumerate(names)]


def units(packages: DataFrame, mode: str = "accept") -> DataFrame:
    """packages (path, content) -> UNITS."""
    if mode not in MODES:
        raise ValueError(mode)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    found = parsed(bytes(data), mode)
                    rows = [x | {"path": path} for x in found + coverage(bytes(data), found)]
                except (Unsafe, zipfile.BadZipFile, zipfile.LargeZipFile, RuntimeError, EOFError, OSError) as e:
                    rows = [_EMPTY | {"path": path, "error": str(e) or type(e).__name__}]
                if rows:
                    yield pd.DataFrame(rows, columns=list(_EMPTY)).astype(object).where(lambda x: x.notna(), None)

    return packages.select("path", "content").mapInPandas(run, UNITS)


def read(spark: SparkSession, path: str, mode: str = "accept") -> DataFrame:
    """Units of every .docx file below a path; one above the admitted size gives a row with its error."""
    admitted, rejected = files.admitted(spark, path, ("docx",), MAX_UPLOAD)
    errors = rejected.where("extension in ('docx', 'docm')").select(*[
        F.col(k).alias(k) if k in ("path", "error") else F.lit(None).cast(kind).alias(k) for k, kind in (x.split() for x in UNITS.split(", "))
    ])
    return units(admitted, mode).unionByName(errors)
