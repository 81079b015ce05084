import pytest
from pyspark.sql import functions as F

from evidora.kernel.profile import Profile
from evidora.kernel.schema import PacketError
from evidora.operators import gate
from evidora.sources import adapters, layout, report


def word(text, x, y, width=10):
    return {"text": text, "x0": x, "x1": x + width, "top": y, "bottom": y + 8}


def test_tables_by_gaps():
    page = [word("Title", 0, 0), word("Item", 0, 20), word("2024", 60, 20), word("2025", 100, 20), word("Net", 0, 30), word("sales", 12, 30, 20), word("1", 60, 31), word("2", 100, 30), word("Other", 0, 40), word("3", 100, 40), word("Prose", 0, 60), word("ends", 14, 60)]
    assert layout.table_rows(page) == [[["Item", "2024", "2025"], ["Net sales", "1", "2"], ["Other", "", "3"]]]


def test_grids():
    cells = layout.grid_cells([(0, 0, 20), (10, 0, 10), (10, 10, 20), (20, 0, 20)], [(0, 0, 20), (10, 0, 20), (20, 0, 20)])
    assert [(r, c) for r, c, _ in cells] == [(0, 0), (0, 1), (1, 0), (1, 1)] and cells[3][2] == (10, 10, 20, 20)
    assert layout.grid_cells([], []) == []


def test_places(spark):
    rows = [("d", 0, 4, 1, 0.125, 1.0, 2.0, 3.0), ("d", 2, 6, 1, 0.0, 1.0, 2.0, 3.0), ("d", 6, 7, 1, 0.135, 1.0, 2.0, 3.0), ("d", 8, 8, 1, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "doc string, start int, end int, page int, x0 double, top double, x1 double, bottom double")
    assert [(r["start"], r["x0"]) for r in layout.places(df, ["doc"]).orderBy("start").collect()] == [(0, 12), (6, 14)]


def test_ocr_words(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    (tmp_path / "o.tsv").write_text("\n".join([head, "5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t96.5\thi", "4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t", "5\t1\t1\t1\t1\t2\t50\t20\t5\t8\t-1\tx"]))
    assert [(r["text"], r["x1"], r["confidence"]) for r in layout.ocr_words(spark, str(tmp_path / "o.tsv")).collect()] == [("hi", 40.0, 0.965)]


def test_profile():
    p = {"profile": 1, "id": "fees", "version": "1.0.0", "schema": {"fields": {"f": {}}}, "routes": [{"field": "f", "route": "key", "status": "measured", "bound": "0.0312", "date": "2025-01-01"}]}
    assert Profile.of(p).audit_rate(30) == "0.02" and Profile.of(p).audit_rate(3) == "0.1"
    for bad in ({**p, "x": 1}, {**p, "routes": [{"field": "g", "route": "r", "status": "draft"}]}, {**p, "routes": [{"field": "f", "route": "r", "status": "measured"}]}, {**p, "version": "1"}):
        with pytest.raises(PacketError):
            Profile.of(bad)


def test_adapter_and_report(spark):
    docs = spark.createDataFrame([("a", "é Fee $5.", [("fee", "$5", 6, 8), ("other", "x", None, None)]), ("b", "none", [])], "doc_id string, text string, found array<struct<class:string,text:string,start:int,end:int>>")
    p = adapters.annotated(docs, "doc_id", "text", "found", {"fee": "quote"})
    rows = gate.admit(p, {"fields": {"quote": {"type": "string"}}})
    r = [x.asDict() for x in rows.collect()]
    assert [(x["doc_id"], x["outcome"], x["start"]) for x in r] == [("a", "admitted", 7)]
    assert "<mark>$5</mark>" in report.report(r, "é Fee $5.") and report.escape("\x00<") == "\\x00&lt;"
    assert report.packet_objects(p, gate.receipts(rows, {"fields": {}})).groupBy("kind").agg(F.count("*").alias("n")).count() == 3
