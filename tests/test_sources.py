import io
import zipfile

import pytest
from pyspark.sql import functions as F

from evidora.sources import files, markup, office
from evidora.sources.store import StaleHead, Store


def test_html():
    text, nodes = markup.html("<html><head><title>x</title><style>p{}</style></head><body><h2>Head</h2><p>One <b>two</b> m<sup>2</sup><script>no()</script></p><div hidden>gone</div><ul><li>a<li>b</ul></body></html>")
    assert text == "Head\nOne two m^2\na\nb"
    assert [(n["kind"], text[n["start"] : n["end"]]) for n in nodes if n["kind"] != "list"] == [("heading", "Head"), ("paragraph", "One two m^2"), ("item", "a"), ("item", "b")]
    assert next(n["level"] for n in nodes if n["kind"] == "heading") == 2


def test_html_tables():
    text, nodes = markup.html("<table><tr><th>k<th>2024<th>2025</tr><tr><td rowspan=2>sales<td>1<td>2</tr><tr><td>3<td>4</tr></table>")
    assert text.split("\n")[0] == "k\t2024\t2025"
    cells = {(n["row"], n["column"]): text[n["start"] : n["end"]] for n in nodes if n["kind"] == "cell"}
    assert cells == {(0, 0): "k", (0, 1): "2024", (0, 2): "2025", (1, 0): "sales", (1, 1): "1", (1, 2): "2", (2, 1): "3", (2, 2): "4"}


def test_odd_html():
    for source in ("", "<", "<td>a</td>", "</p></p>", "a<br><br>b", "<p>" * 50 + "x"):
        markup.html(source)


def test_xml():
    text, _ = markup.xml("<d xmlns='u'><title>T</title><section><paragraph>One</paragraph><table><tr><td>a</td><td>b</td></tr></table></section></d>")
    assert text == "T\nOne\na\tb"
    with pytest.raises(ValueError, match="entities"):
        markup.xml("<!DOCTYPE d [<!ENTITY a 'b'>]><d>&a;</d>")


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = archive(word__document_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>One</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>gone</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = archive(
    xl__workbook_xml=f'<workbook {S}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" state="hidden" r:id="r1"/></sheets></workbook>',
    **{"xl___rels__workbook_xml.rels": '<R><Relationship Id="r1" Target="s.xml"/></R>'},
    xl__sharedStrings_xml=f"<sst {S}><si><t>k</t></si></sst>",
    xl__s_xml=f'<worksheet {S}><cols><col min="2" max="2" hidden="1"/></cols><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>9</v></c><c r="C1"><v>5</v></c></row><row hidden="1"><c r="A2"><v>1</v></c></row></sheetData></worksheet>',
)


def test_office():
    text, nodes = office.docx(DOCX)
    assert text == "Head\nOne\na\tb" and nodes[0]["kind"] == "heading" and nodes[0]["level"] == 1
    assert office.xlsx(XLSX)[0] == "One\nk\t5"
    for bad in (b"", b"x", archive(a="b")):
        with pytest.raises(ValueError):
            office.docx(bad)


def test_read_files(spark, tmp_path):
    for name, body in {"a.txt": "﻿x\r\ny".encode(), "b.html": b"<p>hi</p>", "c.docx": DOCX, "d.pdf": b"%PDF", "e.xlsx": XLSX, "f.txt": b" ", "g.docx": b"junk"}.items():
        (tmp_path / name).write_bytes(body)
    rows = {r["path"].rpartition("/")[2]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"]["text"] == "x\ny" and rows["b.html"]["text"] == "hi" and rows["f.txt"]["completeness"] == "no_text"
    assert sum(r["error"] is not None for r in rows.values()) == 2 and rows["d.pdf"]["error"]


def test_labelled_cells(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>k<th>2024</tr><tr><td>sales<td>7</tr></table>"), (2, None), (3, "")], "page_id long, html string")
    out = markup.read_markup(pages, "page_id", "html")
    assert out.count() == 3
    cells = markup.labelled_cells(markup.node_rows(out, "page_id"), "page_id")
    assert [(r["label"], r["header"], r["value"]) for r in cells.collect()] == [("sales", "2024", "7")]
    places = spark.createDataFrame([(1, 0), (1, 13)], "page_id long, at int")
    assert markup.innermost(out.select("page_id", F.inline("nodes")), places, "page_id", "at").count() == 2


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    put = lambda *xs: s.put(spark.createDataFrame([("doc", bytearray(x)) for x in xs], "kind string, bytes binary"))
    put(b"a", b"a", b"b")
    put(b"b", b"c")
    assert s.objects("doc").count() == 3 and s.check().count() == 0
    key = s.objects("doc").filter(F.col("bytes") == F.lit(bytearray(b"a"))).first()["key"]
    s.forget(spark.createDataFrame([("doc", key)], "kind string, key string"), "2025-01-01")
    assert s.objects("doc").count() == 2
    s.compact()
    assert s.objects("doc").count() == 2
    head = s.append("answers", ["1", "2"])
    with pytest.raises(StaleHead):
        s.append("answers", ["3"], (0, None))
    assert s.append("answers", ["3"], head)[0] == 3 and s.check().count() == 0
    named = spark.createDataFrame([("doc", "nowhere")], "kind string, key string")
    assert sorted(r["problem"] for r in s.orphans(named).collect()) == ["missing", "orphan", "orphan"]


def test_of_several_writers_one_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from evidora.tables import put_if_absent

    path = str(tmp_path / "folder" / "v1")
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: put_if_absent(spark, path, f"writer {i}"), range(16)))
    assert sum(made) == 1 and (tmp_path / "folder" / "v1").read_text() == f"writer {made.index(True)}"
    assert [p.name for p in (tmp_path / "folder").iterdir() if not p.name.endswith(".crc")] == ["v1"]
    s = Store(spark, str(tmp_path / "s"))
    head = s.append("log", ["first"])

    def add(i):
        try:
            return s.append("log", [f"by {i}"], head)
        except StaleHead:
            return None

    with ThreadPoolExecutor(4) as pool:
        assert sum(x is not None for x in pool.map(add, range(4))) == 1
    assert s.log("log").count() == 2 and s.check().count() == 0


def test_compaction_goes_by_generations(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = lambda *xs: spark.createDataFrame([("doc", bytearray(x)) for x in xs], "kind string, bytes binary")
    s.put(rows(b"a", b"b"))
    s.compact()
    s.put(rows(b"b", b"c"))
    assert s.generation() == 1 and s.objects().count() == 3
    s.compact()
    assert s.generation() == 2 and s.objects().count() == 3
