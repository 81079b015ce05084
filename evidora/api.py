"""Public entry points: one document in plain Python, or tables of documents on Spark.

admit() and verify() decide a single packet without a cluster; admit_table() and the functions of
evidora.operators run the same rules over DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from .kernel.canonical import canonical as jcs
from .kernel.canonical import digest, text_digest
from .kernel.gate import FLAG_ORDER, INFO_ORDER, ROLES, Packet, decide
from .kernel.packs import check as load_pack
from .kernel.schema import Field, PacketError, Policy, Schema
from .operators.gate import admit as admit_table

__all__ = ["Field", "PacketError", "Policy", "Schema", "admit", "admit_table", "candidate_schema", "digest", "extractor_schema", "feedback_message", "jcs", "load_pack", "verify"]

#: Every reason code of a rejection (fixed values).
REJECT_CODES = (
    "CANDIDATE_INVALID", "FIELD_UNKNOWN", "NULL_STRING_LITERAL", "TYPE_INVALID", "RANGE_INVALID", "DATE_OUT_OF_RANGE", "OPTION_INVALID",
    "UNIT_INVALID", "KEY_INVALID", "RECORD_INVALID", "NO_EVIDENCE", "SPAN_INVALID", "SOURCE_NOT_READ", "QUOTE_NOT_FOUND", "VALUE_NOT_IN_EVIDENCE",
    "DATE_FORMAT_UNDECLARED", "UNIT_NOT_IN_EVIDENCE", "SOURCE_REJECTED", "PASSAGE_NOT_AT_HEADING", "PASSAGE_LABEL_MISMATCH", "PASSAGE_CUT_SHORT", "PASSAGE_OVERRUN",
)


def admit(text: str, schema: Mapping[str, Any], candidates: Sequence[Any], policy: Mapping[str, Any] | None = None, packs: Sequence[Mapping[str, Any]] = (), **more: Any) -> dict[str, Any]:
    """Decide the candidates of one document: {"decisions", "coverage", "sha256"}.

    Raises ValueError for a schema with relations or records and for a policy with a judge or with proposers that must be
    corroborated: these compare candidates with each other, which is left to admit_table() and its set operations.
    """
    import unicodedata

    if not isinstance(text, str) or not unicodedata.is_normalized("NFC", text):
        raise PacketError("the text is not a string in NFC")
    s, p = Schema.of(schema, packs), Policy.of(policy)
    if s.relations or s.record_of or p.judge or "corroborate" in p.proposers.values():
        raise ValueError("relations, records, judges and corroboration are decided by admit_table()")
    packet = Packet(text, s, p, **more)
    rows = [{"pos": i, **decide(packet, c)} for i, c in enumerate(candidates)]
    seen: dict[tuple, set] = {}
    for r in rows:
        if r["outcome"] != "rejected" and not s.fields[r["field"]].multiple and r["field"] not in s.record_of:
            seen.setdefault((r["field"], r["key"]), set()).add((r["value"], r["unit"]))
    for r in rows:
        if r["outcome"] != "rejected" and len(seen.get((r["field"], r["key"]), ())) > 1:
            r["codes"] = [c for c in (*FLAG_ORDER, *INFO_ORDER) if c in {*r["codes"], "CONFLICTING_CANDIDATES"}]
            r["outcome"] = "needs_verification"
    rows.sort(key=lambda r: (r["candidate_sha256"] or "", r["pos"]))
    live = {r["field"] for r in rows if r["outcome"] != "rejected"}
    coverage = [{"field": n, "code": "REQUIRED_FIELD_MISSING"} for n, f in sorted(s.fields.items()) if f.required and n not in live and n not in s.record_of]
    body = {"decisions": rows, "coverage": coverage, "text_sha256": text_digest("text", text), "schema_sha256": s.sha256, "policy_sha256": digest("policy", dict(policy or {}))}
    return {**body, "sha256": digest("receipt", body)}


def verify(receipt: Mapping[str, Any], text: str, schema: Mapping[str, Any], candidates: Sequence[Any], policy: Mapping[str, Any] | None = None, **more: Any) -> list[str]:
    """Members in which a receipt differs from one made again; none if it is the same."""
    again = admit(text, schema, candidates, policy, **more)
    return [k for k in sorted({*receipt, *again}) if receipt.get(k) != again.get(k)]


def feedback_message(receipt: Mapping[str, Any]) -> str | None:
    """What to tell an extractor; None if all of its candidates were admitted."""
    lines = [f"{r['field']}: {', '.join(r['codes'])}" + (f" (missing {', '.join(r['missing'])})" if r["missing"] else "") for r in sorted(receipt["decisions"], key=lambda r: r["pos"]) if r["outcome"] != "admitted"]
    lines += [f"{c['field']}: {c['code']}" for c in receipt["coverage"]]
    return "\n".join(lines) or None


_ITEM = {
    "type": "object",
    "properties": {
        "source": {"enum": ["document", "reference", "external", "knowledge"]}, "role": {"enum": list(ROLES)}, "ref": {"type": "string"}, "start": {"type": "integer"}, "end": {"type": "integer"},
        "text": {"type": "string"}, "url": {"type": "string"}, "retrieved": {"type": "string"},
    },
}


def candidate_schema() -> dict[str, Any]:
    """A JSON Schema of one candidate."""
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "type": "object",
        "required": ["field", "value"],
        "properties": {
            "field": {"type": "string"}, "value": {"type": ["string", "integer"]}, "unit": {"type": ["string", "null"]}, "key": {"type": ["string", "null"]}, "record": {"type": ["string", "null"]},
            "confidence": {"type": ["number", "null"], "minimum": 0, "maximum": 1}, "proposer": {"type": ["string", "null"], "pattern": "\\S"},
            "search_region": {"type": ["object", "null"], "required": ["start", "end"]}, "evidence": {"anyOf": [_ITEM, {"type": "array", "items": _ITEM}]},
        },
    }


def extractor_schema(schema: Mapping[str, Any]) -> dict[str, Any]:
    """A strict JSON Schema of an extractor's reply: candidates of the schema's fields, each with the unit and keys that its field has."""
    s = Schema.of(schema)
    item = {"type": "object", "additionalProperties": False, "required": ["role", "text"], "properties": {"role": {"enum": ["value", "sign", "scale", "unit", "key", "field"]}, "text": {"type": "string"}}}
    kinds = []
    for name, f in sorted(s.fields.items()):
        if f.type == "record":
            continue
        own: dict[str, Any] = {"field": {"const": name}, "value": {"enum": list(f.options)} if f.options else {"type": "string"}, "evidence": {"type": "array", "items": item, "minItems": 1}}
        if f.unit is not None:
            own["unit"] = {"const": f.unit}
        if f.keys is not None:
            own["key"] = {"enum": list(f.keys)}
        if name in s.record_of:
            own["record"] = {"type": "string"}
        kinds.append({"type": "object", "additionalProperties": False, "required": sorted(own), "properties": own})
    return {"type": "object", "additionalProperties": False, "required": ["candidates"], "properties": {"candidates": {"type": "array", "items": {"anyOf": kinds} if kinds else False}}}


