"""Queries that run the whole gate over packets with one planted case each; every order gets the case of its number."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernel.schema import Schema
from ..operators import gate
from ..session import ship
from ..tables import deal
from .registry import query, table

_RECORD = {"type": "record", "members": {"code": {"type": "string", "required": True}, "price": {"unit": "USD"}}}
SCHEMA: dict[str, Any] = {
    "fields": {
        "amount": {"unit": "USD", "minimum": "0", "maximum": "5000000", "aliases": ["fee"]},
        "result": {"unit": "USD"},
        "count": {"type": "integer", "minimum": "1", "maximum": "500"},
        "day": {"type": "date", "formats": ["YYYY-MM-DD", "D/M/YYYY", "M/D/YYYY"], "minimum": "2000-01-01"},
        "level": {"type": "string", "options": ["high", "low"]},
        "dose": {"unit": "mg", "keys": ["adults", "children"], "multiple": True},
        "clause": {"type": "passage"},
        "gross": {"unit": "USD"}, "net": {"unit": "USD"}, "tax": {"unit": "USD"},
        "stock": {"columns": ["closing"]},
        "seats": {"type": "integer", "markers": ["seats"]}, "rooms": {"type": "integer", "markers": ["rooms"]},
        "items": _RECORD, "lines": _RECORD,
    },
    "relations": [{"id": "sum", "total": "gross", "parts": [{"field": "net"}, {"field": "tax"}]}],
    "checks": [
        {"id": "newer", "check": "replace", "field": "items", "member": "code"},
        {"id": "once", "check": "unique", "field": "items", "member": "code"},
        {"id": "alike", "check": "agree", "field": "lines", "member": "code", "compare": ["price"]},
    ],
}
POLICY: dict[str, Any] = {
    "min_confidence": 0.5, "min_read_confidence": 0.9, "proposers": {"careful": "corroborate", "wary": "corroborate", "plain": "admit"},
    "sources": {"external": {"allow": ["https://known.example/"], "other": "review"}, "knowledge": "reject"},
    "judge": {"id": "reader", "digest": "d1", "clear": {"KEY_NOT_AT_VALUE": 0.5}, "doubt": {"field_match": 0.3}},
}

_FEE = "The yearly fee is $73."
_TWO = "A fee of $73 is due. Later a fee of $73 falls due."
_ADULTS = "Adults get 8 mg a day."
_TERMS = "Scope\nIt covers each garden tool.\n\nNotice\nThree weeks ahead.\n"
_SCOPE = _TERMS.index("\n\n")
_LATER = _TERMS.index("Notice")
_OUTLINE = {"outline": [{"start": 0, "end": 5, "level": 1}, {"start": _LATER, "end": _LATER + 6, "level": 1}]}


def _c(field: str, value: Any, *items: Any, unit: str | None = None, **more: Any) -> dict[str, Any]:
    """A candidate; an item is a quote, a (start, end) or an object."""
    made = [{"text": i} if isinstance(i, str) else {"start": i[0], "end": i[1]} if isinstance(i, tuple) else i for i in items]
    return {"field": field, "value": value, "evidence": made, **({"unit": unit} if unit else {}), **more}


def _usd(field: str, value: Any, *items: Any, **more: Any) -> dict[str, Any]:
    return _c(field, value, *items, unit="USD", **more)


def _role(role: str, text: str) -> dict[str, str]:
    return {"role": role, "text": text}


def _dose(key: str, *items: Any, **more: Any) -> dict[str, Any]:
    return _c("dose", "8", *(items or ("8 mg",)), unit="mg", key=key, **more)


def _passage(label: str, start: int, end: int) -> dict[str, Any]:
    return _c("clause", label, (start, end))


def _at(text: str, what: str, n: int = 0) -> tuple[int, int]:
    at = -1
    for _ in range(n + 1):
        at = text.index(what, at + 1)
    return at, at + len(what)


OK, LOOK, NO = "admitted", "needs_verification", "rejected"
#: (name, text, candidates, extras, what each candidate gets)
CASES: list[tuple[str, str, list[dict[str, Any]], dict[str, Any], list[tuple[str, str]]]] = [
    ("clean", _FEE, [_usd("amount", "73", "$73")], {}, [(OK, "")]),
    ("wrong shape", _FEE, [_usd("amount", True, "$73")], {}, [(NO, "CANDIDATE_INVALID")]),
    ("no such field", _FEE, [_usd("price", "73", "$73")], {}, [(NO, "FIELD_UNKNOWN")]),
    ("null as a word", _FEE, [_usd("amount", "N/A", "$73")], {}, [(NO, "NULL_STRING_LITERAL")]),
    ("no number", _FEE, [_usd("amount", "lots", "$73")], {}, [(NO, "TYPE_INVALID")]),
    ("over the bound", "A set of 501 pieces.", [_c("count", "501", "501")], {}, [(NO, "RANGE_INVALID")]),
    ("too early", "Signed on 1998-11-02.", [_c("day", "1998-11-02", "1998-11-02")], {}, [(NO, "DATE_OUT_OF_RANGE")]),
    ("no option", "A medium risk.", [_c("level", "medium", "medium")], {}, [(NO, "OPTION_INVALID")]),
    ("other unit", _FEE, [_c("amount", "73", "$73", unit="GBP")], {}, [(NO, "UNIT_INVALID")]),
    ("no such key", _ADULTS, [_dose("infants")], {}, [(NO, "KEY_INVALID")]),
    ("member without record", "Item K7.", [_c("items.code", "K7", "K7")], {}, [(NO, "RECORD_INVALID")]),
    ("no evidence", _FEE, [_usd("amount", "73")], {}, [(NO, "NO_EVIDENCE")]),
    ("span beyond the text", _FEE, [_usd("amount", "73", (4, 9_000))], {}, [(NO, "SPAN_INVALID")]),
    ("quote in unread text", _FEE, [_usd("amount", "12", "$12")], {"read_complete": False}, [(NO, "SOURCE_NOT_READ")]),
    ("quote not there", _FEE, [_usd("amount", "12", "$12")], {}, [(NO, "QUOTE_NOT_FOUND")]),
    ("other value", _FEE, [_usd("amount", "74", "$73")], {}, [(NO, "VALUE_NOT_IN_EVIDENCE")]),
    ("undeclared format", "Signed on 17.5.2021.", [_c("day", "2021-05-17", "17.5.2021")], {}, [(NO, "DATE_FORMAT_UNDECLARED")]),
    ("euros", "The yearly fee is €73.", [_usd("amount", "73", "€73")], {}, [(NO, "UNIT_NOT_IN_EVIDENCE")]),
    ("known by heart", _FEE, [_usd("amount", "73", {"source": "knowledge", "text": "It is $73."})], {}, [(NO, "SOURCE_REJECTED")]),
    ("passage", _TERMS, [_passage("Scope", 0, _SCOPE)], _OUTLINE, [(OK, "")]),
    ("passage without heading", _TERMS, [_passage("Scope", 6, _SCOPE)], _OUTLINE, [(NO, "PASSAGE_NOT_AT_HEADING")]),
    ("passage of another label", _TERMS, [_passage("Notice", 0, _SCOPE)], _OUTLINE, [(NO, "PASSAGE_LABEL_MISMATCH")]),
    ("passage cut", _TERMS, [_passage("Scope", 0, _SCOPE - 4)], _OUTLINE, [(NO, "PASSAGE_CUT_SHORT")]),
    ("passage too long", _TERMS, [_passage("Scope", 0, _LATER + 3)], _OUTLINE, [(NO, "PASSAGE_OVERRUN")]),
    ("passage with a page unread", _TERMS, [_passage("Scope", 0, _SCOPE)], {**_OUTLINE, "read_complete": False, "missing_pages": [2]}, [(LOOK, "PASSAGE_NOT_READ")]),
    ("other words at the span", _FEE, [_usd("amount", "73", {"start": 18, "end": 21, "text": "USD 73"})], {}, [(LOOK, "NON_VERBATIM_EVIDENCE")]),
    ("qualified", "The yearly fee is more than $73.", [_usd("amount", "73", "$73")], {}, [(LOOK, "QUALIFIED_VALUE")]),
    ("scale word", "The yearly fee is $73 million.", [_usd("amount", "73", "$73")], {}, [(LOOK, "SCALE_WORD")]),
    ("two readings of a date", "Signed on 6/2/2021.", [_c("day", "2021-02-06", "6/2/2021")], {}, [(LOOK, "DATE_AMBIGUOUS")]),
    ("scale not cited", _FEE, [_usd("amount", "73000", "$73")], {}, [(LOOK, "PART_MISSING")]),
    ("sign dropped", "It ended at -73 dollars then.", [_usd("result", "73", "-73 dollars")], {}, [(LOOK, "SIGN_DROPPED")]),
    ("idle sign item", _FEE, [_usd("amount", "73", "$73", _role("sign", "yearly"))], {}, [(LOOK, "SIGN_CITATION_INVALID")]),
    ("idle scale item", _FEE, [_usd("amount", "73", "$73", _role("scale", "yearly"))], {}, [(LOOK, "SCALE_CITATION_INVALID")]),
    ("idle unit item", _FEE, [_usd("amount", "73", "$73", _role("unit", "yearly"))], {}, [(LOOK, "UNIT_CITATION_INVALID")]),
    ("idle field item", _FEE, [_usd("amount", "73", "$73", _role("field", "yearly"))], {}, [(LOOK, "FIELD_CITATION_INVALID")]),
    ("field item", _FEE, [_usd("amount", "73", "$73", _role("field", "fee"))], {}, [(OK, "")]),
    ("idle key item", _ADULTS, [_dose("adults", "8 mg", _role("key", "day"))], {}, [(LOOK, "KEY_CITATION_INVALID")]),
    ("key", _ADULTS, [_dose("adults")], {}, [(OK, "")]),
    ("other key", _ADULTS, [_dose("children")], {}, [(LOOK, "KEY_NOT_AT_VALUE")]),
    ("no column", "The stock is 73 units.", [_c("stock", "73", "73")], {}, [(LOOK, "COLUMN_NOT_AT_VALUE")]),
    ("marker of another field", "A hall of 73 rooms.", [_c("seats", "73", "73"), _c("rooms", "73", "73")], {}, [(LOOK, "MARKER_OTHER_FIELD"), (OK, "")]),
    ("badly read", _FEE, [_usd("amount", "73", "$73")], {"doubt": [{"start": 19, "end": 20, "confidence": 0.4}]}, [(LOOK, "READ_DOUBT")]),
    ("quoted from outside", "No sum here.", [_usd("amount", "73", {"source": "external", "text": _FEE, "url": "https://other.example/a", "retrieved": "2024-01-01"})], {}, [(LOOK, "EVIDENCE_QUOTED")]),
    ("outside and allowed", "No sum here.", [_usd("amount", "73", {"source": "external", "text": _FEE, "url": "https://known.example/a", "retrieved": "2024-01-01"})], {}, [(OK, "ADMITTED_BY_POLICY")]),
    ("unsure", _FEE, [_usd("amount", "73", "$73", confidence=0.25)], {}, [(LOOK, "LOW_CONFIDENCE")]),
    ("two values", "A fee of $73 or a fee of $59.", [_usd("amount", "73", "$73"), _usd("amount", "59", "$59")], {}, [(LOOK, "CONFLICTING_CANDIDATES")] * 2),
    ("alone", _FEE, [_usd("amount", "73", "$73", proposer="careful")], {}, [(LOOK, "NOT_CORROBORATED")]),
    ("agreed", _FEE, [_usd("amount", "73", "$73", proposer="careful"), _usd("amount", "73", "fee is $73", proposer="plain")], {}, [(OK, ""), (OK, "")]),
    ("agreed by two that must be", _FEE, [_usd("amount", "73", "$73", proposer="careful"), _usd("amount", "73", "$73", proposer="wary")], {}, [(OK, ""), (OK, "")]),
    ("said twice by one", _FEE, [_usd("amount", "73", "$73", proposer="careful")] * 2, {}, [(LOOK, "NOT_CORROBORATED")] * 2),
    ("at two places", _TWO, [_usd("amount", "73", _at(_TWO, "$73"), proposer="careful"), _usd("amount", "73", _at(_TWO, "$73", 1))], {}, [(LOOK, "NOT_CORROBORATED,OTHER_SPAN"), (LOOK, "OTHER_SPAN")]),
    ("at two places by others", _TWO, [_usd("amount", "73", _at(_TWO, "$73"), proposer="plain"), _usd("amount", "73", _at(_TWO, "$73", 1))], {}, [(OK, ""), (OK, "")]),
    ("in two texts", _FEE, [_usd("amount", "73", "$73", proposer="careful"), _usd("amount", "73", {"source": "reference", "ref": "r", "text": "$73"}, proposer="plain")], {"references": [{"id": "r", "text": "So a fee of $73."}]}, [(LOOK, "NOT_CORROBORATED"), (OK, "")]),
    ("a multiple field at two places", "Adults get 8 mg; adults get 8 mg again.", [_dose("adults", _at("Adults get 8 mg; adults get 8 mg again.", "8 mg"), proposer="careful"), _dose("adults", _at("Adults get 8 mg; adults get 8 mg again.", "8 mg", 1), proposer="plain")], {}, [(LOOK, "NOT_CORROBORATED"), (OK, "")]),
    ("sums up", "In all $90, of it $80 net and $10 tax.", [_usd("gross", "90", "$90"), _usd("net", "80", "$80"), _usd("tax", "10", "$10")], {}, [(OK, "")] * 3),
    ("sums up within half a place", "In all $90, of it $80.4 net and $10.1 tax.", [_usd("gross", "90", "$90"), _usd("net", "80.4", "$80.4"), _usd("tax", "10.1", "$10.1")], {}, [(OK, "")] * 3),
    ("does not sum up", "In all $90, of it $80 net and $3 tax.", [_usd("gross", "90", "$90"), _usd("net", "80", "$80"), _usd("tax", "3", "$3")], {}, [(LOOK, "RELATION_FAILED")] * 3),
    ("off by a small part of long numbers", "In all $80.00000000000000000000000000009, of it $80.00000000000000000000000000001 net and $0.00000000000000000000000000001 tax.", [_usd("gross", "80.00000000000000000000000000009", "$80.00000000000000000000000000009"), _usd("net", "80.00000000000000000000000000001", "$80.00000000000000000000000000001"), _usd("tax", "0.00000000000000000000000000001", "$0.00000000000000000000000000001")], {}, [(LOOK, "RELATION_FAILED")] * 3),
    ("judged another field", _FEE, [_usd("amount", "73", "$73", id="doubted")], {}, [(LOOK, "MODEL_DOUBT")]),
    ("judged the key", _ADULTS, [_dose("children", id="cleared")], {}, [(OK, "MODEL_CLEARED")]),
    ("found elsewhere", _FEE, [_usd("amount", "73", {"start": 4, "end": 10, "text": "$73"})], {}, [(OK, "EVIDENCE_REANCHORED")]),
    ("scale cited", "Sums in thousands of dollars. The yearly fee is $73.", [_usd("amount", "73000", "$73", _role("scale", "in thousands of dollars"))], {}, [(OK, "VALUE_DERIVED")]),
    ("record", "Item K7 costs $73.", [_c("items.code", "K7", "K7", record="1"), _usd("items.price", "73", "$73", record="1")], {}, [(OK, "")] * 2),
    ("record without a code", "An item costs $73.", [_usd("items.price", "73", "$73", record="1")], {}, [(LOOK, "RECORD_NOT_ADMITTED")]),
    ("record with two prices", "Item K7 costs $73, or $59.", [_c("items.code", "K7", "K7", record="1"), _usd("items.price", "73", "$73", record="1"), _usd("items.price", "59", "$59", record="1")], {}, [(LOOK, "RECORD_NOT_ADMITTED")] * 3),
    ("record from two texts", "Item K7.", [_c("items.code", "K7", "K7", record="1"), _usd("items.price", "73", {"source": "reference", "ref": "r", "text": "$73"}, record="1")], {"references": [{"id": "r", "text": "It costs $73."}]}, [(LOOK, "RECORD_NOT_ADMITTED")] * 2),
    ("replaced", "Item K7 costs $73.", [_c("items.code", "K7", "K7", record="old"), _c("items.code", "K7", {"source": "reference", "ref": "r", "text": "K7"}, record="new")], {"references": [{"id": "r", "text": "Item K7 costs $59.", "set": 1}]}, [(OK, "")] * 2),
    ("replaces nothing", "Item K7 costs $73.", [_c("items.code", "K7", "K7", record="old"), _c("items.code", "M4", {"source": "reference", "ref": "r", "text": "M4"}, record="new")], {"references": [{"id": "r", "text": "Item M4 costs $59.", "set": 1}]}, [(OK, ""), (LOOK, "RECORD_NOT_ADMITTED")]),
    ("twice the same code", "Item K7, then item K7.", [_c("items.code", "K7", "K7", record="a"), _c("items.code", "K7", "K7", record="b")], {}, [(LOOK, "RECORD_NOT_ADMITTED")] * 2),
    ("other price in the set", "Item K7 costs $73.", [_c("lines.code", "K7", "K7", record="a"), _usd("lines.price", "73", "$73", record="a"), _c("lines.code", "K7", {"source": "reference", "ref": "r", "text": "K7"}, record="b"), _usd("lines.price", "59", {"source": "reference", "ref": "r", "text": "$59"}, record="b")], {"references": [{"id": "r", "text": "Item K7 costs $59.", "set": 1}]}, [(LOOK, "RECORD_NOT_ADMITTED")] * 4),
    ("same price in the set", "Item K7 costs $73.", [_c("lines.code", "K7", "K7", record="a"), _usd("lines.price", "73", "$73", record="a"), _c("lines.code", "K7", {"source": "reference", "ref": "r", "text": "K7"}, record="b"), _usd("lines.price", "73", {"source": "reference", "ref": "r", "text": "$73"}, record="b")], {"references": [{"id": "r", "text": "Item K7 costs $73.", "set": 1}]}, [(OK, "")] * 4),
]
#: (case, field, record, outcome, codes, replaced)
RECORDS = [
    ("record", "items", "1", OK, "", False), ("record without a code", "items", "1", NO, "RECORD_MEMBER_MISSING", False), ("record with two prices", "items", "1", LOOK, "RECORD_MEMBER_CONFLICT", False),
    ("record from two texts", "items", "1", LOOK, "RECORD_SOURCE_MIXED", False), ("replaced", "items", "old", OK, "", True), ("replaced", "items", "new", OK, "", False),
    ("replaces nothing", "items", "old", OK, "", False), ("replaces nothing", "items", "new", LOOK, "SET_REPLACES_NOTHING", False),
    ("twice the same code", "items", "a", LOOK, "SET_DUPLICATE", False), ("twice the same code", "items", "b", LOOK, "SET_DUPLICATE", False),
    ("other price in the set", "lines", "a", LOOK, "SET_CONFLICT", False), ("other price in the set", "lines", "b", LOOK, "SET_CONFLICT", False),
    ("same price in the set", "lines", "a", OK, "", False), ("same price in the set", "lines", "b", OK, "", False),
]
#: (case, holds, difference, allowance)
RELATIONS = [
    ("sums up", True, "0", "1.5"), ("sums up within half a place", True, "-0.5", "0.6"), ("does not sum up", False, "7", "1.5"),
    ("off by a small part of long numbers", False, "0.00000000000000000000000000007", "0.000000000000000000000000000015"),
]
_NAMES = [c[0] for c in CASES]


def case_packets(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """A packet for each order: that of case o_orderkey % (number of cases), with the order's number at its end. dealt: over tasks, before texts are made."""
    made = [(i, text, [json.dumps(c) for c in candidates], json.dumps(extras)) for i, (_, text, candidates, extras, _) in enumerate(CASES)]
    cases = spark.createDataFrame(made, "planted int, body string, candidates array<string>, extras string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    rows = (deal(orders) if dealt else orders).select(F.col("o_orderkey").cast("string").alias("doc_id"), (F.col("o_orderkey") % len(CASES)).cast("int").alias("planted"))
    text = F.concat("body", F.lit(" (order no. "), "doc_id", F.lit(")"))
    return rows.join(F.broadcast(cases), "planted").select("doc_id", "planted", text.alias("text"), "candidates", "extras")


def _judgments(packets: DataFrame) -> DataFrame:
    said = {"judged another field": ("doubted", "field_match", None, 0.1), "judged the key": ("cleared", "key", "children", 0.9)}
    out = None
    for name, (who, asked, answer, p) in said.items():
        own = packets.filter(F.col("planted") == _NAMES.index(name)).select("doc_id", F.lit(who).alias("candidate_id"), F.lit(asked).alias("question"), F.lit("reader").alias("judge_id"), F.lit("d1").alias("judge_digest"), F.lit(answer).cast("string").alias("answer"), F.lit(p).alias("p"))
        out = own if out is None else out.unionByName(own)
    return out


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = gate.admit(case_packets(spark, sf_dir, dealt=True), SCHEMA, POLICY, _judgments(case_packets(spark, sf_dir)), extras_col="extras")
    names = F.array(*(F.lit(n) for n in _NAMES))
    return rows.withColumn("case", F.element_at(names, (F.col("doc_id").cast("long") % len(CASES)).cast("int") + 1))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ORDERS = f"WITH k AS (SELECT o_orderkey % {len(CASES)} AS planted, count(*) AS n FROM orders GROUP BY 1), "


@query(_ORDERS + "c(planted, name, pos, outcome, codes) AS (VALUES " + ", ".join(f"({i}, {_sql(name)}, {pos}, '{outcome}', '{codes}')" for i, (name, _, _, _, want) in enumerate(CASES) for pos, (outcome, codes) in enumerate(want)) + ") SELECT name AS \"case\", CAST(pos AS INTEGER) AS pos, outcome, codes, n FROM c JOIN k USING (planted)")
def gate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each planted candidate gets from the gate, all flags included."""
    return _decided(spark, sf_dir).groupBy("case", "pos", "outcome", F.concat_ws(",", "codes").alias("codes")).agg(F.count("*").alias("n"))


@query(_ORDERS + "c(planted, name, field, record, outcome, codes, replaced) AS (VALUES " + ", ".join(f"({_NAMES.index(name)}, {_sql(name)}, '{field}', '{record}', '{outcome}', '{codes}', {replaced})" for name, field, record, outcome, codes, replaced in RECORDS) + ") SELECT name AS \"case\", field, record, outcome, codes, replaced, n FROM c JOIN k USING (planted)")
def gate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the planted candidates, with the codes of records and of document sets."""
    rows, s = _decided(spark, sf_dir), Schema.of(SCHEMA)
    positions = gate.set_positions(case_packets(spark, sf_dir), "doc_id", "extras")
    lines = None
    for name in ("items", "lines"):
        one = gate.record_lines(rows, s, s.fields[name], positions)
        lines = one if lines is None else lines.unionByName(one)
    names = F.array(*(F.lit(n) for n in _NAMES))
    case = F.element_at(names, (F.col("doc_id").cast("long") % len(CASES)).cast("int") + 1)
    live = lines.filter(F.col("record").isNotNull())
    return live.groupBy(case.alias("case"), "field", "record", "outcome", F.concat_ws(",", "codes").alias("codes"), "replaced").agg(F.count("*").alias("n"))


@query(_ORDERS + "c(planted, name, holds, difference, allowance) AS (VALUES " + ", ".join(f"({_NAMES.index(name)}, {_sql(name)}, {holds}, '{difference}', '{allowance}')" for name, holds, difference, allowance in RELATIONS) + ") SELECT name AS \"case\", holds, difference, allowance, n FROM c JOIN k USING (planted)")
def gate_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences and allowances of the planted relation, in exact decimals."""
    s = Schema.of(SCHEMA)
    rows = _decided(spark, sf_dir).withColumn("_k", F.coalesce("key", F.lit("")))
    found = gate.relation_results(rows.filter(F.col("outcome") != "rejected"), s, s.relations[0])
    names = F.array(*(F.lit(n) for n in _NAMES))
    case = F.element_at(names, (F.col("doc_id").cast("long") % len(CASES)).cast("int") + 1)
    return found.groupBy(case.alias("case"), "holds", "difference", "allowance").agg(F.count("*").alias("n"))
