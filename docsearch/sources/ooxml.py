"""Readers of .xlsx and .docx packages with the standard library: zip archives of XML parts."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from io import BytesIO
from xml.etree import ElementTree

from docsearch.errors import EmptyDocumentError, EncryptedDocumentError, ParserError
from docsearch.sources.files import OLE_SIGNATURE

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Built-in number formats of percentages, dates and times.
PERCENT_IDS, DATE_IDS = {9: "0%", 10: "0.00%"}, {*range(14, 23), 45, 46, 47}
_HEADING = re.compile(r"^(?:heading|제목)\s*(\d)$", re.I)


def open_package(content: bytes) -> zipfile.ZipFile:
    if content[:8].hex().upper() == OLE_SIGNATURE:
        raise EncryptedDocumentError("an OLE container: encrypted, or of an old kind")
    try:
        return zipfile.ZipFile(BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ParserError(f"not a package: {e}") from e


def _xml(package: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(package.read(name)) if name in package.namelist() else None


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref.replace("$", "")).groups()
    column = 0
    for x in letters:
        column = column * 26 + ord(x) - 64
    return int(digits) - 1, column - 1


def _formats(package: zipfile.ZipFile) -> list[str]:
    """The number format of each cell style."""
    root = _xml(package, "xl/styles.xml")
    if root is None:
        return []
    own = {int(x.get("numFmtId")): x.get("formatCode") for x in root.iter(f"{_MAIN}numFmt")}
    styles = root.find(f"{_MAIN}cellXfs")
    known = lambda n: own.get(n) or PERCENT_IDS.get(n) or ("yyyy-mm-dd hh:mm" if n in DATE_IDS else "General")
    return [known(int(x.get("numFmtId", 0))) for x in (styles if styles is not None else [])]


def _is_date(fmt: str) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt)
    return fmt != "General" and bool(re.search(r"[ymdhs]", bare, re.I))


def workbook(content: bytes) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(sheets, cells, merges): (number, name, hidden), (name, r, c, kind, text, number, moment, format), (name, r1, c1, r2, c2).

    Values of formulas are those that were saved with them.
    """
    package = open_package(content)
    book = _xml(package, "xl/workbook.xml")
    if book is None:
        raise ParserError("no workbook in the package")
    rels = {x.get("Id"): x.get("Target") for x in _xml(package, "xl/_rels/workbook.xml.rels") or []}
    shared_root = _xml(package, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in (shared_root if shared_root is not None else [])]
    formats = _formats(package)
    epoch = dt.datetime(1904, 1, 1) if (p := book.find(f"{_MAIN}workbookPr")) is not None and p.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
    sheets, cells, merges = [], [], []
    for number, s in enumerate(book.iter(f"{_MAIN}sheet")):
        name = s.get("name")
        sheets.append((number, name, s.get("state", "visible") != "visible"))
        target = rels.get(s.get(f"{_REL}id"), "")
        root = _xml(package, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        if root is None:
            continue
        for x in root.iter(f"{_MAIN}c"):
            kind, value = x.get("t", "n"), x.findtext(f"{_MAIN}v")
            fmt = formats[int(x.get("s", 0))] if int(x.get("s", 0)) < len(formats) else "General"
            cell: tuple | None = None
            if kind == "inlineStr":
                cell = ("string", "".join(t.text or "" for t in x.iter(f"{_MAIN}t")), None, None)
            elif value is None:
                continue
            elif kind == "s":
                cell = ("string", shared[int(value)], None, None)
            elif kind == "b":
                cell = ("bool", None, float(value), None)
            elif kind in ("str", "e"):
                cell = ("string", value, None, None)
            elif kind == "d":
                cell = ("datetime", None, None, dt.datetime.fromisoformat(value))
            elif _is_date(fmt):
                moment = epoch + dt.timedelta(days=float(value))
                moment = (moment + dt.timedelta(microseconds=500)).replace(microsecond=0)
                cell = ("time" if float(value) < 1 else "datetime", None, None, moment)
            else:
                cell = ("number", None, float(value), None)
            cells.append((name, *_place(x.get("r")), *cell, fmt))
        for x in root.iter(f"{_MAIN}mergeCell"):
            a, _, b = x.get("ref").partition(":")
            merges.append((name, *_place(a), *_place(b or a)))
    return sheets, cells, merges


def heading_level(style: str | None, outline: int | None) -> int | None:
    """From a style's name, else from the outline level (0 to 8)."""
    name = (style or "").strip()
    if name.lower() == "title" or name == "제목":
        return 1
    if m := _HEADING.match(name):
        return int(m[1])
    return outline + 1 if outline is not None and 0 <= outline <= 8 else None


def document(content: bytes) -> str:
    """The body of a .docx as Markdown, paragraphs and tables in their order."""
    package = open_package(content)
    root = _xml(package, "word/document.xml")
    if root is None:
        raise ParserError("no document in the package")
    styles_root = _xml(package, "word/styles.xml")
    names, lists = {}, set()
    for s in styles_root.iter(f"{_W}style") if styles_root is not None else []:
        n = s.find(f"{_W}name")
        names[s.get(f"{_W}styleId")] = n.get(f"{_W}val") if n is not None else s.get(f"{_W}styleId")
        if s.find(f".//{_W}numPr") is not None:
            lists.add(s.get(f"{_W}styleId"))
    body = root.find(f"{_W}body")
    parts = [x for e in (body if body is not None else []) for x in ([_paragraph(e, names, lists)] if e.tag == f"{_W}p" else [_table(e)] if e.tag == f"{_W}tbl" else [])]
    out = "\n\n".join(filter(None, parts))
    if not out:
        raise EmptyDocumentError("no text in the document")
    return out


def _text(e: ElementTree.Element) -> str:
    runs = [{f"{_W}t": x.text or "", f"{_W}tab": " ", f"{_W}br": " ", f"{_W}cr": " "}.get(x.tag, "") for x in e.iter()]
    return " ".join("".join(runs).split())


def _paragraph(p: ElementTree.Element, names: dict, lists: set) -> str:
    text = _text(p)
    if not text:
        return ""
    style = p.find(f"{_W}pPr/{_W}pStyle")
    sid = style.get(f"{_W}val") if style is not None else None
    outline = p.find(f"{_W}pPr/{_W}outlineLvl")
    level = heading_level(names.get(sid, sid), int(outline.get(f"{_W}val")) if outline is not None else None)
    if level:
        return f"{'#' * min(level, 6)} {text}"
    listed = p.find(f"{_W}pPr/{_W}numPr") is not None or sid in lists or (names.get(sid) or "").lower().startswith("list")
    return f"- {text}" if listed else text


def _cell(x: str) -> str:
    return x.replace("|", "\\|")


def _grid(t: ElementTree.Element) -> list[list[str]]:
    """The cells of a table's own rows; a merged cell's text is in every place that it covers, a table inside a cell is not read."""
    rows: list[list[str]] = []
    for r in t.findall(f"{_W}tr"):
        row: list[str] = []
        for c in r.findall(f"{_W}tc"):
            down, wide = c.find(f"{_W}tcPr/{_W}vMerge"), c.find(f"{_W}tcPr/{_W}gridSpan")
            goes_on = down is not None and down.get(f"{_W}val", "continue") == "continue" and rows and len(row) < len(rows[-1])
            text = rows[-1][len(row)] if goes_on else " ".join(filter(None, map(_text, c.findall(f"{_W}p"))))
            row += [text] * (int(wide.get(f"{_W}val", "1")) if wide is not None else 1)
        rows.append(row)
    return rows


def table_text(rows: list[list[str]]) -> str:
    """Rows with a value as text: one column as paragraphs, one row as a line, else a table as wide as its first row."""
    rows = [r for r in rows if any(r)]
    width = max(map(len, rows), default=0)
    if width <= 1:
        return "\n\n".join(r[0] for r in rows)
    if len(rows) == 1:
        return " | ".join(filter(None, rows[0]))
    n = len(rows[0])
    line = lambda r: "| " + " | ".join(_cell(x) for x in [*r, *[""] * (n - len(r))][:n]) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * n, *map(line, rows[1:])])


def _table(t: ElementTree.Element) -> str:
    return table_text(_grid(t))
