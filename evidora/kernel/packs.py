"""Vocabulary packs and kind packs: closed, data-only, add-only objects that a schema names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as member
from typing import Any

import regex

from .canonical import canonical, digest
from .text import AFTER, BEFORE, SCALE_POWERS, Vocabulary, fold, normalise
from .units import BASE_UNITS

POWERS = (3, 5, 6, 7, 9, 12)
LISTS = {"scale", "units", "qualifiers", "sentence", "sign", "nulls", "heading_units"}
HEAD = {"pack", "type", "id", "version", "description"}
MOST_BYTES, MOST_ENTRIES, DEEPEST, MOST_TEMPLATES = 256 << 10, 2_000, 8, 200
_ID, _VERSION = regex.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*"), regex.compile(r"(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){2}")
TEMPLATE = {"type", "unit", "comparator", "aliases", "description"}


def _fail(pack: Any, what: str) -> None:
    from .schema import PacketError

    raise PacketError(f"pack {pack.get('id') if isinstance(pack, Mapping) else pack}: {what}")


def _data(pack: Mapping[str, Any], x: Any, depth: int = 1) -> None:
    if depth > DEEPEST:
        _fail(pack, "it is nested too deep")
    if isinstance(x, Mapping):
        if len(x) > MOST_ENTRIES:
            _fail(pack, "an object is too large")
        for v in x.values():
            _data(pack, v, depth + 1)
    elif isinstance(x, (list, tuple)):
        if len(x) > MOST_ENTRIES:
            _fail(pack, "a list is too large")
        for v in x:
            _data(pack, v, depth + 1)
    elif isinstance(x, (bool, float)) or not (x is None or isinstance(x, (str, int))):
        _fail(pack, "a value is no data")


def _word(pack: Mapping[str, Any], w: Any, lower: bool = False) -> str:
    import unicodedata

    if not isinstance(w, str) or not w.strip() or w != w.strip() or len(w) > 64 or regex.search(r"[\n\r\t]", w) or not unicodedata.is_normalized("NFC", w) or lower and w != w.lower():
        _fail(pack, f"{w!r} is no word")
    return w


def check(pack: Any) -> Mapping[str, Any]:
    """A well-formed pack."""
    if not isinstance(pack, Mapping):
        _fail(pack, "it is no object")
    _data(pack, pack)
    if len(canonical(dict(pack)).encode()) > MOST_BYTES:
        _fail(pack, "it is too large")
    kind = pack.get("type")
    if pack.get("pack") != 1 or kind not in ("vocabulary", "kind"):
        _fail(pack, "its format is unknown")
    if set(pack) - HEAD - (LISTS if kind == "vocabulary" else {"needs", "fields"}):
        _fail(pack, "it has other members")
    if not (isinstance(pack.get("id"), str) and _ID.fullmatch(pack["id"]) and len(pack["id"]) <= 64 and isinstance(pack.get("version"), str) and _VERSION.fullmatch(pack["version"])):
        _fail(pack, "its id or version has the wrong form")
    if kind == "kind":
        _check_kind(pack)
        return pack
    for w, p in pack.get("scale", {}).get("words", {}).items():
        _word(pack, w, lower=True)
        if p not in POWERS or SCALE_POWERS.get(w, p) != p:
            _fail(pack, f"the power of {w}")
    for side, base in (("before", BEFORE), ("after", AFTER)):
        for comparator, words in pack.get("qualifiers", {}).get(side, {}).items():
            if comparator not in ("approx", "gt", "lt", "ge", "le"):
                _fail(pack, f"{comparator} is no comparator")
            for w in words:
                _word(pack, w)
                for other, known in base.items():
                    if other != comparator and any(_holds(w, k) or _holds(k, w) for k in known):
                        _fail(pack, f"{w} conflicts with a phrase of {other}")
    if set(pack.get("qualifiers", {})) - {"before", "after"} or set(pack.get("sentence", {})) - {"abbreviations"} or set(pack.get("sign", {})) - {"loss"} or set(pack.get("scale", {})) - {"words"}:
        _fail(pack, "it gives a list that only the base can give")
    for w in pack.get("sentence", {}).get("abbreviations", ()):
        if not _word(pack, w, lower=True).endswith("."):
            _fail(pack, f"{w} has no dot at its end")
    for w in pack.get("sign", {}).get("loss", ()):
        if _word(pack, w) in ("income", "gain", "gains", "profit", "profits", "earnings"):
            _fail(pack, f"{w} is a gain word")
    for code, forms in pack.get("units", {}).items():
        if set(forms) - {"prefixes", "suffixes"}:
            _fail(pack, f"unit {code}")
        for side, k in (("prefixes", 0), ("suffixes", 1)):
            for w in forms.get(side, ()):
                _word(pack, w)
                if any(w in known[k] for other, known in BASE_UNITS.items() if other != code):
                    _fail(pack, f"{w} is a form of another unit")
    return pack


def _holds(a: str, b: str) -> bool:
    """Whether phrase a holds phrase b as whole words."""
    return bool(regex.search(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(fold(normalise(b)))}(?![\p{{L}}\p{{N}}])", fold(normalise(a))))


def _check_kind(pack: Mapping[str, Any]) -> None:
    from .schema import Field

    needs, fields = pack.get("needs", []), pack.get("fields", {})
    if not isinstance(needs, list) or not all(isinstance(n, Mapping) and set(n) == {"id", "version"} for n in needs) or len({n["id"] for n in needs}) != len(needs) or any(n["id"] == pack["id"] for n in needs):
        _fail(pack, "needs")
    if not isinstance(fields, Mapping) or len(fields) > MOST_TEMPLATES:
        _fail(pack, "fields")
    for name, t in fields.items():
        if not isinstance(t, Mapping) or set(t) - TEMPLATE:
            _fail(pack, f"template {name}")
        Field.of(name, {**t, **({"formats": ["YYYY-MM-DD"]} if t.get("type") == "date" else {})})


@dataclass
class Resolved:
    """The packs that a schema reads."""

    packs: list[Mapping[str, Any]] = member(default_factory=list)
    named: set[str] = member(default_factory=set)

    def _of(self, kind: str) -> list[Mapping[str, Any]]:
        return [p for p in self.packs if p["type"] == kind]

    def digests(self) -> list[dict[str, str]]:
        return [{"id": p["id"], "version": p["version"], "sha256": digest(f"pack-{p['type']}", dict(p))} for p in sorted(self.packs, key=lambda p: p["id"])]

    def filled(self, field: Any) -> Any:
        """A field with the members that its template gives."""
        from .schema import PacketError

        if not isinstance(field, Mapping) or "template" not in field:
            return field
        pack_id, _, name = str(field["template"]).partition("/")
        own = next((p for p in self._of("kind") if p["id"] == pack_id and pack_id in self.named), None)
        if own is None or name not in own.get("fields", {}):
            raise PacketError(f"no template {field['template']}")
        t = own["fields"][name]
        for k in ("type", "unit"):
            if k in t and k in field and t[k] != field[k]:
                raise PacketError(f"{k} of a field and of its template differ")
        return {**t, **{k: v for k, v in field.items() if k != "template"}}

    def units(self) -> dict[str, dict[str, list[str]]]:
        out: dict[str, dict[str, list[str]]] = {}
        for p in self._of("vocabulary"):
            for code, forms in p.get("units", {}).items():
                before, after = BASE_UNITS.get(code, ((), ()))
                own = out.setdefault(code, {"prefix": list(before), "suffix": list(after)})
                own["prefix"] += [w for w in forms.get("prefixes", ()) if w not in own["prefix"]]
                own["suffix"] += [w for w in forms.get("suffixes", ()) if w not in own["suffix"]]
        return out

    def vocabulary(self) -> Vocabulary:
        from .text import BASE

        own = self._of("vocabulary")
        if not own:
            return BASE
        merge = lambda side: {k: [w for p in own for w in p.get("qualifiers", {}).get(side, {}).get(k, ())] for k in {k for p in own for k in p.get("qualifiers", {}).get(side, {})}}
        return Vocabulary({w: n for p in own for w, n in p.get("scale", {}).get("words", {}).items()}, merge("before"), merge("after"), [w for p in own for w in p.get("sentence", {}).get("abbreviations", ())], sorted({w for p in own for w in p.get("sign", {}).get("loss", ())}))

    def marks(self, text: str) -> list[str]:
        """Ids of the packs whose words stand anywhere in a text."""
        folded = fold(text)
        out = []
        for p in self._of("vocabulary"):
            words = [*p.get("scale", {}).get("words", {}), *(w for side in p.get("qualifiers", {}).values() for ws in side.values() for w in ws), *p.get("sign", {}).get("loss", ())]
            if any(_holds(folded, w) for w in words):
                out.append(p["id"])
        return sorted(out)


#: Words of losses (fixed values): the built-in pack that a sign item reads.
FINANCE = {"pack": 1, "type": "vocabulary", "id": "finance", "version": "1.0.0", "sign": {"loss": ["loss", "losses", "deficit", "deficits"]}}
#: Unit forms of component datasheets (fixed values).
ELECTRONICS = {"pack": 1, "type": "vocabulary", "id": "electronics", "version": "1.0.0", "units": {"C": {"prefixes": [], "suffixes": ["°C"]}, "V": {"prefixes": [], "suffixes": ["V"]}, "mA": {"prefixes": [], "suffixes": ["mA"]}}}
BUILT_IN = {(p["id"], p["version"]): p for p in (FINANCE, ELECTRONICS)}


def resolve(names: Sequence[Mapping[str, Any]], given: Sequence[Mapping[str, Any]]) -> Resolved:
    """The packs that a schema names, and those that they need; each given or built in."""
    from .schema import PacketError

    if not isinstance(names, (list, tuple)):
        raise PacketError("packs is not a list")
    if not names and not given:
        return Resolved()
    have: dict[tuple[str, str], Mapping[str, Any]] = dict(BUILT_IN)
    for p in given:
        check(p)
        key = p["id"], p["version"]
        if p["id"] in {i for i, _ in BUILT_IN}:
            raise PacketError(f"{p['id']} is built in")
        if "-x-" not in p["id"]:
            raise PacketError(f"{p['id']} is no id of an own pack")
        if key in have and canonical(dict(have[key])) != canonical(dict(p)):
            raise PacketError(f"{p['id']} is given twice")
        have[key] = p
    wanted: dict[str, str] = {}
    pins: dict[str, str] = {}
    queue = []
    for n in names:
        if not isinstance(n, Mapping) or set(n) - {"id", "version", "sha256"} or not {"id", "version"} <= set(n):
            raise PacketError("an entry of packs has the wrong form")
        queue.append((n["id"], n["version"]))
        if "sha256" in n:
            pins[n["id"]] = n["sha256"]
    out = Resolved(named={n["id"] for n in names})
    while queue:
        key = queue.pop(0)
        if wanted.get(key[0], key[1]) != key[1]:
            raise PacketError(f"{key[0]} is named in two versions")
        if key[0] in wanted:
            continue
        wanted[key[0]] = key[1]
        if key not in have:
            raise PacketError(f"{key[0]} {key[1]} is not given")
        p = have[key]
        if key[0] in pins and digest(f"pack-{p['type']}", dict(p)) != pins[key[0]]:
            raise PacketError(f"{key[0]} has another digest")
        out.packs.append(p)
        queue += [(n["id"], n["version"]) for n in p.get("needs", ())]
    unused = {p["id"] for p in given} - set(wanted)
    if unused:
        raise PacketError(f"packs are given but not named: {sorted(unused)}")
    return out
