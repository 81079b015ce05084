"""Schemas, fields and policies: closed JSON objects, checked before any job runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as member, replace
from decimal import Decimal
from typing import Any

import regex

from . import dates
from .canonical import digest
from .text import BASE, Shapes, Vocabulary, fold, normalise, parse_value
from .units import UnitTable

TYPES = ("number", "integer", "string", "date", "record", "passage")
CHECKS = ("replace", "unique", "agree")
COMPARATORS = ("eq", "gt", "ge", "lt", "le", "approx", "range")
_NAME = regex.compile(r"[a-z][a-z0-9_]{0,63}")


class PacketError(ValueError):
    """A packet that is invalid as a whole; it gets no receipt."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise PacketError(what)


def _closed(obj: Any, names: set[str], what: str) -> Mapping[str, Any]:
    _need(isinstance(obj, Mapping), f"{what} is not an object")
    _need(set(obj) <= names, f"{what} has other members: {sorted(set(obj) - names)}")
    return obj


def _texts(value: Any, what: str) -> tuple[str, ...] | None:
    if value is None:
        return None
    _need(isinstance(value, (list, tuple)) and len(value) > 0 and all(isinstance(x, str) and x.strip() for x in value), f"{what} is not a list of words")
    _need(len({fold(normalise(x)) for x in value}) == len(value), f"{what} repeats a word")
    return tuple(value)


def _bound(value: Any, what: str) -> Decimal | None:
    if value is None:
        return None
    _need(isinstance(value, str) or isinstance(value, int) and not isinstance(value, bool), f"{what} is no decimal")
    out = parse_value(str(value))
    _need(out is not None, f"{what} is no decimal")
    return out


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "number"
    unit: str | None = None
    comparator: str = "eq"
    minimum: Any = None
    maximum: Any = None
    required: bool = False
    multiple: bool = False
    keys: tuple[str, ...] | None = None
    aliases: tuple[str, ...] | None = None
    options: tuple[str, ...] | None = None
    formats: tuple[str, ...] | None = None
    members: Mapping[str, "Field"] | None = None
    columns: tuple[str, ...] | None = None
    markers: tuple[str, ...] | None = None

    @staticmethod
    def of(name: str, obj: Any) -> Field:
        o = _closed(obj, {"type", "unit", "comparator", "minimum", "maximum", "required", "multiple", "keys", "aliases", "columns", "markers", "options", "formats", "members", "description"}, f"field {name}")
        _need(bool(_NAME.fullmatch(name)), f"{name!r} is no field name")
        kind, unit, comparator = o.get("type", "number"), o.get("unit"), o.get("comparator", "eq")
        _need(kind in TYPES, f"field {name}: type")
        _need(unit is None or isinstance(unit, str), f"field {name}: unit")
        _need(comparator in COMPARATORS, f"field {name}: comparator")
        flags = o.get("required", False), o.get("multiple", False)
        _need(all(isinstance(x, bool) for x in flags), f"field {name}: required and multiple are booleans")
        if "description" in o:
            _need(isinstance(o["description"], str) and bool(o["description"].strip()), f"field {name}: description")
        keys, aliases = _texts(o.get("keys"), f"field {name}: keys"), _texts(o.get("aliases"), f"field {name}: aliases")
        options = o.get("options")
        if options is not None:
            _need(kind == "string" and isinstance(options, list) and 1 <= len(options) <= 1000 and all(isinstance(x, str) and x.strip() for x in options), f"field {name}: options")
            _need(len({normalise(x) for x in options}) == len(options), f"field {name}: options repeat")
        if kind == "passage":
            _need(unit is None and comparator == "eq" and not {"minimum", "maximum", "keys", "aliases", "columns", "markers", "options", "formats"} & {k for k, v in o.items() if v is not None}, f"field {name}: a passage has no such member")
        formats, low, high, members = o.get("formats"), o.get("minimum"), o.get("maximum"), None
        if kind == "date":
            _need(isinstance(formats, list) and len(formats) > 0 and len(set(formats)) == len(formats) and set(formats) <= set(dates.FORMATS), f"field {name}: formats")
            _need(unit is None and comparator == "eq", f"field {name}: a date has no unit and no comparator")
            _need(all(x is None or dates.normal(x) for x in (low, high)), f"field {name}: bounds")
        else:
            _need(formats is None, f"field {name}: only a date has formats")
            low, high = _bound(low, f"field {name}: minimum"), _bound(high, f"field {name}: maximum")
        if kind == "record":
            _need(isinstance(o.get("members"), Mapping) and len(o["members"]) > 0, f"field {name}: members")
            members = {n: Field.of(n, m) for n, m in o["members"].items()}
            _need(all(m.keys is None and m.type != "record" for m in members.values()), f"field {name}: members have no keys and are no records")
        else:
            _need("members" not in o, f"field {name}: only a record has members")
        return Field(name, kind, unit, comparator, low, high, *flags, keys, aliases, tuple(options) if options is not None else None, tuple(formats) if formats else None, members, _texts(o.get("columns"), f"field {name}: columns"), _texts(o.get("markers"), f"field {name}: markers"))


@dataclass(frozen=True)
class Relation:
    id: str
    total: str
    parts: tuple[tuple[str, Decimal], ...]
    tolerance: Decimal


@dataclass(frozen=True)
class Check:
    """A check across the records of a document set."""

    id: str
    check: str
    field: str
    member: str
    compare: tuple[str, ...] = ()


@dataclass
class Schema:
    fields: dict[str, Field]
    units: UnitTable
    relations: tuple[Relation, ...] = ()
    checks: tuple[Check, ...] = ()
    record_of: dict[str, str] = member(default_factory=dict)  # member field -> record field
    sha256: str = ""
    vocabulary: Vocabulary = BASE
    shapes: Shapes = member(default_factory=Shapes, compare=False, repr=False)

    @staticmethod
    def of(obj: Any, packs: Sequence[Mapping[str, Any]] = ()) -> Schema:
        """A checked schema. packs: the packs that the packet gives."""
        from .packs import resolve

        o = _closed(obj, {"fields", "units", "relations", "checks", "packs"}, "the schema")
        _need(isinstance(o.get("fields"), Mapping), "the schema has no fields")
        used = resolve(o.get("packs", ()), packs)
        fields = {n: Field.of(n, used.filled(f)) for n, f in o["fields"].items()}
        record_of = {}
        for f in list(fields.values()):
            for m in (f.members or {}).values():
                m = replace(m, name=f"{f.name}.{m.name}")
                record_of[m.name] = f.name
                fields[m.name] = m
        units = o.get("units", {})
        _need(isinstance(units, Mapping), "units is not an object")
        for code, forms in units.items():
            u = _closed(forms, {"prefix", "suffix"}, f"unit {code}")
            _need(all(isinstance(x, list) and all(isinstance(y, str) and y.strip() for y in x) for x in u.values()), f"unit {code}")
        units = {**used.units(), **units}
        relations = tuple(Schema._relation(r, fields, record_of) for r in o.get("relations", ()))
        _need(len({r.id for r in relations}) == len(relations), "relations repeat an id")
        checks = Schema._checks(o.get("checks", []), fields)
        return Schema(fields, UnitTable(units), relations, checks, record_of, digest("schema", [_plain(o), used.digests()] if used.packs else _plain(o)), used.vocabulary())

    @staticmethod
    def _checks(given: Any, fields: Mapping[str, Field]) -> tuple[Check, ...]:
        _need(isinstance(given, (list, tuple)), "checks is not a list")
        out: list[Check] = []
        for obj in given:
            c = _closed(obj, {"id", "check", "field", "member", "compare"}, "a check")
            _need(isinstance(c.get("id"), str) and bool(c["id"].strip()) and c["id"] not in {x.id for x in out}, "a check has no id, or repeats one")
            name = f"check {c['id']}"
            _need(c.get("check") in CHECKS, f"{name}: kind")
            f = fields.get(c["field"]) if isinstance(c.get("field"), str) else None
            _need(f is not None and f.type == "record", f"{name}: field is no record")
            _need(c.get("member") in f.members and f.members[c["member"]].required, f"{name}: member is no required member")
            compare = c.get("compare")
            if c["check"] == "agree":
                ok = isinstance(compare, (list, tuple)) and len(compare) > 0 and all(isinstance(x, str) for x in compare)
                _need(ok and len(set(compare)) == len(compare) and all(x in f.members and x != c["member"] for x in compare), f"{name}: compare")
            else:
                _need("compare" not in c, f"{name}: only agree has compare")
            out.append(Check(c["id"], c["check"], f.name, c["member"], tuple(compare or ())))
        return tuple(out)

    @staticmethod
    def _relation(obj: Any, fields: Mapping[str, Field], record_of: Mapping[str, str]) -> Relation:
        r = _closed(obj, {"id", "total", "parts", "tolerance"}, "a relation")
        _need(isinstance(r.get("id"), str) and bool(r["id"].strip()), "a relation has no id")
        _need(isinstance(r.get("parts"), list) and len(r["parts"]) > 0, f"relation {r['id']}: parts")
        parts = []
        for p in r["parts"]:
            _closed(p, {"field", "factor"}, f"relation {r['id']}: a part")
            factor = _bound(p.get("factor", "1"), f"relation {r['id']}: factor")
            _need(bool(factor), f"relation {r['id']}: a factor is zero")
            parts.append((p.get("field"), factor))
        names = [r.get("total"), *(p for p, _ in parts)]
        _need(all(n in fields for n in names) and len(set(names)) == len(names), f"relation {r['id']}: fields")
        used = [fields[n] for n in names]
        _need(all(f.type in ("number", "integer") and not f.multiple and f.name not in record_of for f in used), f"relation {r['id']}: kinds of fields")
        _need(len({f.keys is None for f in used}) == 1, f"relation {r['id']}: some fields have keys")
        for p, f in zip(r["parts"], used[1:], strict=True):
            _need("factor" in p or f.unit == used[0].unit, f"relation {r['id']}: another unit needs a factor")
        tolerance = _bound(r.get("tolerance", "0"), f"relation {r['id']}: tolerance")
        _need(tolerance is not None and tolerance >= 0, f"relation {r['id']}: tolerance")
        return Relation(r["id"], r["total"], tuple(parts), tolerance)


def _plain(o: Any) -> Any:
    if isinstance(o, Mapping):
        return {k: _plain(v) for k, v in o.items()}
    return [_plain(x) for x in o] if isinstance(o, (list, tuple)) else o


@dataclass(frozen=True)
class Policy:
    min_confidence: float | None = None
    min_read_confidence: float = 1
    unit_window: int = 24
    reanchor: bool = True
    allow: tuple[str, ...] = ()
    other: str = "review"
    knowledge: str = "review"
    proposers: Mapping[str, str] = member(default_factory=dict)
    judge: Mapping[str, Any] | None = None

    @staticmethod
    def of(obj: Any) -> Policy:
        if obj is None:
            return Policy()
        o = _closed(obj, {"min_confidence", "min_read_confidence", "unit_window", "reanchor", "judge", "sources", "proposers"}, "the policy")
        unit = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= 1
        low, read = o.get("min_confidence"), o.get("min_read_confidence", 1)
        _need(low is None or unit(low), "min_confidence")
        _need(unit(read), "min_read_confidence")
        window, reanchor = o.get("unit_window", 24), o.get("reanchor", True)
        _need(isinstance(window, int) and not isinstance(window, bool) and window >= 0 and isinstance(reanchor, bool), "unit_window or reanchor")
        s = _closed(o.get("sources", {}), {"external", "knowledge"}, "sources")
        e = _closed(s.get("external", {}), {"allow", "other"}, "external sources")
        allow, other, known = e.get("allow", []), e.get("other", "review"), s.get("knowledge", "review")
        _need(isinstance(allow, list) and all(isinstance(x, str) and x.strip() for x in allow), "allow")
        _need(other in ("review", "reject") and known in ("admit", "review", "reject"), "actions of sources")
        who = o.get("proposers", {})
        _need(isinstance(who, Mapping) and all(k.strip() and v in ("admit", "corroborate") for k, v in who.items()), "proposers")
        judge = o.get("judge")
        if judge is not None:
            j = _closed(judge, {"id", "digest", "clear", "doubt"}, "the judge")
            _need(all(isinstance(j.get(x), str) and j[x].strip() for x in ("id", "digest")), "the judge has no id or digest")
            _need(set(j.get("clear", {})) <= {"KEY_NOT_AT_VALUE"} and set(j.get("doubt", {})) <= {"field_match"}, "thresholds of the judge")
            _need(all(unit(x) for t in ("clear", "doubt") for x in j.get(t, {}).values()), "thresholds of the judge")
        return Policy(low, read, window, reanchor, tuple(allow), other, known, dict(who), judge)
