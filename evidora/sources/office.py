"""DOCX and XLSX to text with nodes, by the standard library. Archives are bounded in members, size and expansion."""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET

from .markup import Writer

MOST_MEMBERS, MOST_BYTES, MOST_RATIO = 10_000, 256 << 20, 200
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Archive:
    """Members of a zip file, within limits."""

    def __init__(self, data: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ValueError("the file is no archive") from e
        infos = self.zip.infolist()
        if len(infos) > MOST_MEMBERS or sum(i.file_size for i in infos) > MOST_BYTES:
            raise ValueError("the archive is too large")
        if any(i.file_size > MOST_RATIO * max(1, i.compress_size) + 100_000 for i in infos):
            raise ValueError("a member expands too far")

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.zip.namelist():
            return None
        raw = self.zip.read(name)
        if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
            raise ValueError("a member declares entities")
        return ET.fromstring(raw)


def docx(data: bytes) -> tuple[str, list[dict]]:
    """Paragraphs, headings, list items and tables of a document; hidden runs are left out."""
    archive = Archive(data)
    root = archive.xml("word/document.xml")
    if root is None:
        raise ValueError("the archive holds no document")
    styles = {}
    found = archive.xml("word/styles.xml")
    for s in found.iter(f"{_W}style") if found is not None else ():
        name = s.find(f"{_W}name")
        styles[s.get(f"{_W}styleId")] = (name.get(f"{_W}val") if name is not None else "") or ""
    w = Writer()

    def runs(p: ET.Element) -> None:
        for r in p.iter(f"{_W}r"):
            pr = r.find(f"{_W}rPr")
            if pr is not None and pr.find(f"{_W}vanish") is not None and pr.find(f"{_W}vanish").get(f"{_W}val") not in ("0", "false"):
                continue
            align = pr.find(f"{_W}vertAlign") if pr is not None else None
            if align is not None and align.get(f"{_W}val") in ("superscript", "subscript"):
                w.mark("^" if align.get(f"{_W}val") == "superscript" else "_")
            for c in r:
                if c.tag == f"{_W}t":
                    w.text(c.text or "")
                elif c.tag in (f"{_W}tab",):
                    w.text(" ")
                elif c.tag == f"{_W}br":
                    w.line()

    def paragraph(p: ET.Element) -> None:
        pr = p.find(f"{_W}pPr")
        style = pr.find(f"{_W}pStyle") if pr is not None else None
        name = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val") or "") if style is not None else ""
        level = re.match(r"(?i)heading ?([1-6])$", name)
        listed = pr is not None and pr.find(f"{_W}numPr") is not None
        w.begin("heading" if level else "item" if listed else "paragraph", int(level[1]) if level else None)
        runs(p)
        w.end()

    def block(e: ET.Element) -> None:
        for c in e:
            if c.tag == f"{_W}p":
                paragraph(c)
            elif c.tag == f"{_W}tbl":
                w.begin("table")
                for i, row in enumerate(c.findall(f"{_W}tr")):
                    w.begin("row")
                    for cell in row.findall(f"{_W}tc"):
                        span = cell.find(f"{_W}tcPr/{_W}gridSpan")
                        n = int(span.get(f"{_W}val")) if span is not None and (span.get(f"{_W}val") or "").isdigit() else 1
                        w.begin("cell", None, i == 0 and row.find(f"{_W}trPr/{_W}tblHeader") is not None, (1, n))
                        for k, p in enumerate(cell.iter(f"{_W}p")):
                            if k:
                                w.text(" ")
                            runs(p)
                        w.end()
                    w.end()
                w.end()
            elif c.tag in (f"{_W}sdt", f"{_W}sdtContent"):
                block(c)

    body = root.find(f"{_W}body")
    if body is not None:
        block(body)
    return w.result()


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(data: bytes) -> tuple[str, list[dict]]:
    """A table for each visible sheet under its name; hidden rows and columns are left out, merged cells keep their first."""
    archive = Archive(data)
    book = archive.xml("xl/workbook.xml")
    if book is None:
        raise ValueError("the archive holds no workbook")
    strings = []
    found = archive.xml("xl/sharedStrings.xml")
    for si in found.findall(f"{_S}si") if found is not None else ():
        strings.append("".join(t.text or "" for t in si.iter(f"{_S}t") if t is not None))
    links = archive.xml("xl/_rels/workbook.xml.rels")
    target = {r.get("Id"): r.get("Target") for r in (links if links is not None else ())}
    w = Writer()
    for sheet in book.iter(f"{_S}sheet"):
        if sheet.get("state") in ("hidden", "veryHidden"):
            continue
        path = target.get(sheet.get(f"{_R}id"), "")
        page = archive.xml(path.lstrip("/") if path.startswith("/") else f"xl/{path}")
        if page is None:
            continue
        hidden = {i for c in page.iter(f"{_S}col") if c.get("hidden") in ("1", "true") for i in range(int(c.get("min")) - 1, min(int(c.get("max")), 16_384))}
        w.begin("heading", 1)
        w.text(sheet.get("name") or "")
        w.end()
        w.begin("table")
        for row in page.iter(f"{_S}row"):
            if row.get("hidden") in ("1", "true"):
                continue
            cells = {}
            for c in row.findall(f"{_S}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                v = c.find(f"{_S}v")
                if c.get("t") == "s":
                    shown = strings[int(v.text)] if v is not None and v.text else ""
                elif c.get("t") == "inlineStr":
                    shown = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                else:
                    shown = v.text if v is not None and v.text else ""
                if at not in hidden:
                    cells[at] = shown
            w.begin("row")
            for at in range(max(cells, default=-1) + 1):
                if at not in hidden:
                    w.begin("cell")
                    w.text(cells.get(at, ""))
                    w.end()
            w.end()
        w.end()
    return w.result()
