import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from evidora.kernel.schema import PacketError, Schema
from evidora.operators import calibration, chunks, extract, gate, quotes, review, sets, spans, windows

SCHEMA = {
    "fields": {
        "total": {"unit": "USD", "required": True},
        "a": {"unit": "USD"},
        "b": {"unit": "USD"},
        "name": {"type": "string"},
    },
    "relations": [{"id": "sum", "total": "total", "parts": [{"field": "a"}, {"field": "b"}]}],
}


def packet(doc, text, *candidates):
    return doc, text, [json.dumps(c) for c in candidates]


def usd(field, value, quote, **more):
    return {"field": field, "value": value, "unit": "USD", "evidence": [{"text": quote}], **more}


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_gate_cross_checks(spark):
    text = "Total $10, first $4, second $6, third $9."
    packets = spark.createDataFrame(
        [
            packet("holds", text, usd("total", "10", "$10"), usd("a", "4", "$4"), usd("b", "6", "$6")),
            packet("fails", text, usd("total", "10", "$10"), usd("a", "4", "$4"), usd("b", "9", "$9")),
            packet("conflict", text, usd("total", "10", "$10"), usd("a", "4", "$4"), usd("a", "6", "$6"), usd("b", "6", "$6")),
            packet("none", text),
            packet("bad", None, usd("total", "10", "$10")),
        ],
        "doc_id string, text string, candidates array<string>",
    )
    out = gate.admit(packets, SCHEMA).cache()
    got = {(r["doc_id"], r["pos"]): (r["outcome"], list(r["codes"] or [])) for r in out.collect()}
    assert got["holds", 0] == ("admitted", []) == got["holds", 2]
    assert {got["fails", i][1][0] for i in range(3)} == {"RELATION_FAILED"}
    assert got["conflict", 1] == got["conflict", 2] == ("needs_verification", ["CONFLICTING_CANDIDATES"])
    assert got["conflict", 0] == ("admitted", [])
    assert got["bad", 0][0] is None
    assert rows_of(gate.coverage(packets, out, SCHEMA), "doc_id", "field") == [("none", "total")]
    sealed = gate.receipts(out, SCHEMA)
    again = gate.receipts(gate.admit(packets.repartition(3), SCHEMA), SCHEMA)
    assert {r["status"] for r in gate.verify(sealed, again).collect()} == {"same"}
    assert gate.facts(out).count() == 5


def test_gate_agreement(spark):
    text = "The fee is $5. A fee of $5."
    policy = {"proposers": {"m": "corroborate"}}
    c = lambda start, who: {"field": "a", "value": "5", "unit": "USD", "proposer": who, "evidence": [{"start": start, "end": start + 2}]}
    packets = spark.createDataFrame(
        [packet("alone", text, c(11, "m")), packet("agree", text, c(11, "m"), c(11, "n")), packet("apart", text, c(11, "m"), c(24, "n")), packet("same", text, c(11, "m"), c(11, "m"))],
        "doc_id string, text string, candidates array<string>",
    )
    got = {(r["doc_id"], r["pos"]): list(r["codes"]) for r in gate.admit(packets, SCHEMA, policy).collect()}
    assert got == {("alone", 0): ["NOT_CORROBORATED"], ("agree", 0): [], ("agree", 1): [], ("apart", 0): ["NOT_CORROBORATED", "OTHER_SPAN"], ("apart", 1): ["OTHER_SPAN"], ("same", 0): ["NOT_CORROBORATED"], ("same", 1): ["NOT_CORROBORATED"]}


def test_gate_records(spark):
    schema = {"fields": {"items": {"type": "record", "members": {"code": {"type": "string", "required": True}, "price": {"unit": "USD"}}}}}
    text = "A1 costs $5, B2 costs $6."
    code = lambda v, r: {"field": "items.code", "value": v, "record": r, "evidence": [{"text": v}]}
    packets = spark.createDataFrame([packet("d", text, code("A1", "1"), usd("items.price", "5", "$5", record="1"), usd("items.price", "6", "$6", record="2"), code("B2", None))], "doc_id string, text string, candidates array<string>")
    got = {r["pos"]: (r["outcome"], list(r["codes"])) for r in gate.admit(packets, schema).collect()}
    assert got == {0: ("admitted", []), 1: ("admitted", []), 2: ("needs_verification", ["RECORD_NOT_ADMITTED"]), 3: ("rejected", ["RECORD_INVALID"])}


def test_order_and_slices_do_not_change_decisions(spark, monkeypatch):
    monkeypatch.setattr(gate, "SLICE", 2)
    text = "Total $10, first $4, second $6."
    cs = [usd("total", "10", "$10"), usd("a", "4", "$4"), usd("b", "6", "$6"), usd("a", "6", "$6"), usd("a", "9", "$9")]
    packets = spark.createDataFrame([packet("x", text, *cs), packet("y", text, *reversed(cs))], "doc_id string, text string, candidates array<string>")
    out = gate.admit(packets, SCHEMA)
    by = lambda d: rows_of(out.filter(F.col("doc_id") == d), "candidate_sha256", "outcome", F.concat_ws(",", "codes"))
    assert by("x") == by("y") and len(by("x")) == 5


def test_overlaps_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(3), r.choice("pqr"), s := r.randrange(30), s + r.randrange(0, 8)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, k int, who string, s int, e int")
    got = {x["id"]: (x["agrees"], x["elsewhere"]) for x in sets.overlaps(df, ["k"], "who", "s", "e", ["p", "q", "r"], "id").collect()}
    for i, k, who, s, e in rows:
        others = [(a, b) for _, kk, w, a, b in rows if kk == k and w != who and a < b] if s < e else []
        assert got[i] == (any(a < e and s < b for a, b in others), any(not (a < e and s < b) for a, b in others)), (i, k, who, s, e)


def test_conflicts_nulls_and_ties(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), ("y", None), ("z", None)], "k string, v int")
    assert rows_of(sets.conflicts(df, ["k"], ["v"]).groupBy("k").agg(F.max("conflict").alias("c")), "k", "c") == [("x", False), ("y", True), ("z", False)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, s int, e int, who string, v double")
    assert sets.conflicts(empty, ["k"], ["v"]).count() == 0
    assert windows.merge_windows(empty, ["k"], "s", "e").count() == 0
    assert windows.latest(empty, ["k"], ["s"]).count() == 0
    assert spans.overlap_semi(empty, empty.withColumnsRenamed({"s": "a", "e": "b"}), ["k"], "s", "e", "a", "b").count() == 0
    assert calibration.threshold_sweep(empty.withColumn("ok", F.lit(True)), "v", "ok", (0.5,)).collect()[0]["cleared"] == 0


def test_merge_windows(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 5, 7), (1, 9, 10), (2, 0, 1)], "k int, s int, e int")
    assert rows_of(windows.merge_windows(df, ["k"], "s", "e"), "k", "s", "e", "n") == [(1, 0, 7, 3), (1, 9, 10, 1), (2, 0, 1, 1)]


def test_section_end_against_stack(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(1, 5)) for i in range(40)]
    df = spark.createDataFrame([(0, i, level) for i, level in rows], "k int, i int, level int")
    got = dict([(x["i"], x["section_end"]) for x in windows.section_end(df, ["k"], "i", "level", 4).collect()])
    for i, level in rows:
        assert got[i] == next((j for j, m in rows if j > i and m <= level), None)


def test_chain(spark):
    df = spark.createDataFrame([("l", 1, "a", None), ("l", 2, "b", "a"), ("l", 4, "c", "b"), ("m", 1, "x", "y")], "log string, n int, h string, p string")
    assert rows_of(windows.chain_check(df, ["log"], "n", "h", "p"), "log", "n", "linked") == [("l", 1, True), ("l", 2, True), ("l", 4, False), ("m", 1, False)]


def test_band_pairs(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), i, r.uniform(0, 50)) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    brute = {(k, a, b) for (k, a, x), (kk, b, y) in itertools.permutations(rows, 2) if k == kk and a < b and abs(x - y) <= 3}
    assert set(rows_of(spans.band_pairs(df, ["k"], "i", "v", 3.0), "k", "a", "b")) == brute


def test_upper_95():
    assert calibration.upper_95(0, 0) == 1 and calibration.upper_95(5, 5) == 1
    assert calibration.upper_95(0, 10) == pytest.approx(0.2589, abs=1e-4)
    assert calibration.upper_95(8, 117) == pytest.approx(0.1197, abs=1e-3)
    n, k = 50, 3
    from math import comb

    p = calibration.upper_95(k, n)
    assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(0.05, abs=1e-3)


def test_sampling_is_exact(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    import hashlib

    brute = {str(i) for i in range(2000) if int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:8], "big") * 100 < 25 * 2**64}
    assert {r["k"] for r in df.filter(calibration.picked_at(F.col("k"), "0.25")).collect()} == brute


def test_audit_pick_matches_a_plain_loop(spark):
    rows = [(p, i, f"d{i}", i % 7, "0.5" if i == 40 else None) for i in range(100) for p in "xy"]
    df = spark.createDataFrame(rows, "p string, i int, d string, n int, r string")
    brute = []
    for p in "xy":
        pick = calibration.AuditPick("s", p)
        for _, i, d, n, r in sorted(x for x in rows if x[0] == p):
            if r:
                pick.rate = r
            elif pick.offer(d, n):
                brute.append((p, i))
    assert rows_of(calibration.audit_pick(df, "p", "i", "d", "n", "s", "r"), "profile", "ord") == sorted(brute)


def test_settlement(spark):
    rows = [("t1", "a", 1, "x"), ("t1", "a", 2, "y"), ("t1", "b", 1, "y"), ("t2", "a", 1, "x"), ("t2", "b", 1, "y"), ("t3", "a", 1, "x"), ("t4", "a", 1, "x"), ("t4", "lead", 1, "z")]
    df = spark.createDataFrame(rows, "task string, who string, n int, target string")
    out = review.settle(df, "task", "who", ["n"], F.col("target"), agree=2, lead=F.col("who") == "lead")
    assert rows_of(out, "task", "status") == [("t1", "agreed"), ("t2", "disputed"), ("t3", "open"), ("t4", "agreed")]


def test_quotes_and_windows(spark):
    docs = spark.createDataFrame([(1, "aaaa b"), (2, None), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "aa"), (8, "b"), (9, ""), (10, None)], "qid long, q string")
    assert rows_of(quotes.quote_hits(docs, q, "qid", "q"), "doc_id", "qid", "n") == [(1, 7, 2), (1, 8, 1)]
    assert list(chunks.windows_of("ab\ncdefghij", 6, 2)) == [(0, 6), (4, 10), (8, 11)]
    assert list(chunks.windows_of("abcde\nfghij", 8, 2)) == [(0, 6), (4, 11)]


def test_contained_names(spark):
    df = spark.createDataFrame([("net sales",), ("total net sales",), ("sales",), ("sale",), (None,)], "n string")
    assert rows_of(spans.contained_names(df, "n"), "inner", "outer") == [("net sales", "total net sales"), ("sales", "net sales"), ("sales", "total net sales")]


def test_judgments(spark):
    schema = {"fields": {"dose": {"unit": "mg", "keys": ["adults", "children"], "multiple": True}}}
    policy = {"judge": {"id": "j", "digest": "1", "clear": {"KEY_NOT_AT_VALUE": 0.9}, "doubt": {"field_match": 0.2}}}
    c = lambda i: {"id": i, "field": "dose", "value": "5", "unit": "mg", "key": "children", "evidence": [{"text": "5 mg"}]}
    docs = [packet(d, "Adults take 5 mg.", c("c")) for d in "abcdef"] + [packet("g", "Adults take 5 mg.", c("c"), c("c"))]
    said = [("a", "c", "key", "j", "1", "children", 0.95), ("b", "c", "key", "j", "1", "adults", 0.95), ("c", "c", "key", "j", "1", "children", 0.5), ("d", "c", "key", "k", "1", "children", 1.0), ("e", "c", "field_match", "j", "1", None, 0.1), ("f", "x", "key", "j", "1", None, 1.0), ("g", "c", "key", "j", "1", "children", 1.0)]
    judgments = spark.createDataFrame(said, "doc_id string, candidate_id string, question string, judge_id string, judge_digest string, answer string, p double")
    packets = spark.createDataFrame(docs, "doc_id string, text string, candidates array<string>")
    got = {r["doc_id"]: (r["outcome"], list(r["codes"]), r["packet_error"] is None) for r in gate.admit(packets, schema, policy, judgments).collect()}
    assert got["a"] == ("admitted", ["MODEL_CLEARED"], True)
    assert got["b"] == ("needs_verification", ["KEY_NOT_AT_VALUE", "MODEL_DOUBT"], True)
    assert got["c"][1] == got["d"][1] == ["KEY_NOT_AT_VALUE"]
    assert got["e"][1] == ["KEY_NOT_AT_VALUE", "MODEL_DOUBT"]
    assert not got["f"][2] and not got["g"][2]


def test_without_rounded_against_all_pairs(spark):
    from decimal import Decimal

    r = random.Random(5)
    rows = [(r.randrange(3), Decimal(r.randrange(-40, 400) * p), Decimal(p)) for p in (r.choice((1, 10, 100)) for _ in range(200))]
    got = extract.without_rounded(spark.createDataFrame(rows, "k int, v decimal(18,0), p decimal(18,0)"), ["k"], "v", "p")
    want = [(k, v, p) for k, v, p in rows if not any(kk == k and q < p and w != v and abs(w - v) * 2 <= p for kk, w, q in rows)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(want) < len(rows)


def test_schema_checks_are_read():
    record = {"type": "record", "members": {"code": {"type": "string", "required": True}, "price": {"unit": "USD"}}}
    make = lambda *checks: Schema.of({"fields": {"items": record}, "checks": list(checks)})
    good = {"id": "a", "check": "agree", "field": "items", "member": "code", "compare": ["price"]}
    assert make(good).checks[0].compare == ("price",)
    bad = [{**good, "check": "same"}, {**good, "field": "other"}, {**good, "member": "price"}, {**good, "compare": ["code"]}, {**good, "compare": []}, {**good, "check": "unique"}, {**good, "more": 1}]
    for checks in ([good, good], *([b] for b in bad)):
        with pytest.raises(PacketError):
            make(*checks)


def test_packet_is_checked(spark):
    bad = [
        {"references": [{"id": "r", "text": "a"}, {"id": "r", "text": "b"}]}, {"references": [{"id": "r", "text": "a", "set": 0}]}, {"places": [[0, 2, 1], [1, 3, 1]]},
        {"places": [[1, 2, 1]]}, {"missing_pages": [1]}, {"doubt": [{"start": 2, "end": 1, "confidence": 0.5}]}, {"references": [{"id": "r"}]},
    ]
    rows = [(str(i), "ü is $5.", [json.dumps(usd("a", "5", "$5"))], json.dumps(x)) for i, x in enumerate([*bad, {"places": [[0, 2, 1], [2, 4, 2]]}])]
    packets = spark.createDataFrame(rows, "doc_id string, text string, candidates array<string>, extras string")
    got = {r["doc_id"]: r["packet_error"] for r in gate.admit(packets, SCHEMA, extras_col="extras").collect()}
    assert [i for i, e in got.items() if e is None] == [str(len(bad))] and len(got) == len(rows)
