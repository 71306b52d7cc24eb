"""Small .xlsx and .docx packages, written by hand."""

from __future__ import annotations

import io
import zipfile

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _ref(r: int, c: int) -> str:
    return f"{chr(65 + c)}{r + 1}"


def xlsx(sheets: list[tuple[str, list[list], list[str], bool]]) -> bytes:
    """sheets: (name, rows of str, int, float, bool or (number, style), merged ranges, hidden); style 1 is 0%, 2 a date."""
    names, rels, parts = [], [], {}
    for k, (name, rows, merges, hidden) in enumerate(sheets, 1):
        body = []
        for r, row in enumerate(rows):
            cells = []
            for c, v in enumerate(row):
                style = 0
                if isinstance(v, tuple):
                    v, style = v
                if v is None:
                    continue
                if isinstance(v, bool):
                    cells.append(f'<c r="{_ref(r, c)}" t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, str):
                    cells.append(f'<c r="{_ref(r, c)}" t="inlineStr"><is><t>{v}</t></is></c>')
                else:
                    cells.append(f'<c r="{_ref(r, c)}" s="{style}"><v>{v}</v></c>')
            body.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
        merged = f"<mergeCells>{''.join(f'<mergeCell ref="{m}"/>' for m in merges)}</mergeCells>" if merges else ""
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {_NS}><sheetData>{''.join(body)}</sheetData>{merged}</worksheet>"
        names.append(f'<sheet name="{name}" sheetId="{k}" r:id="rId{k}"{" state=" + chr(34) + "hidden" + chr(34) if hidden else ""}/>')
        rels.append(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>')
    parts["xl/workbook.xml"] = f"<workbook {_NS}><sheets>{''.join(names)}</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{''.join(rels)}</Relationships>"
    parts["xl/styles.xml"] = f'<styleSheet {_NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="9"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    return _zip(parts)


def docx(items: list) -> bytes:
    """items: (style, text) for a paragraph, a list of rows for a table."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda s, t: f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = "".join(
        para(*x) if isinstance(x, tuple) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para('', t)}</w:tc>" for t in row) + "</w:tr>" for row in x) + "</w:tbl>"
        for x in items
    )
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("H2", "Heading 2"), ("T", "Title"), ("L", "List Bullet")))
    return _zip({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {w}>{styles}</w:styles>"})
