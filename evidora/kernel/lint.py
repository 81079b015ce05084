"""Warnings about a valid schema: words that fields share or that stand inside each other, units without forms, keys that hold each other."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import regex

from .schema import Schema
from .text import fold, normalise


def _inside(a: str, b: str) -> bool:
    """Whether word a stands in word b as a mention would."""
    return a != b and bool(regex.search(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(a)}(?![\p{{L}}\p{{N}}])", b))


def lint(schema: Mapping[str, Any]) -> list[tuple[str, str, str]]:
    """(code, field, what), in order of field.

    All words are found in all others by one automaton; hits are then held against the rule of mentions.
    """
    import ahocorasick

    s = Schema.of(schema)
    words: dict[str, set[str]] = {}
    for f in s.fields.values():
        for w in f.aliases or ():
            words.setdefault(fold(normalise(w)), set()).add(f.name)
    out = [("ALIAS_SHARED", sorted(names)[0], f"{w!r} names {', '.join(sorted(names))}") for w, names in words.items() if len(names) > 1]
    if words:
        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        machine.make_automaton()
        for outer, owners in words.items():
            for inner in {w for _, w in machine.iter(outer)}:
                if _inside(inner, outer):
                    for name in sorted(words[inner] - owners):
                        out.append(("ALIAS_INSIDE", name, f"{inner!r} stands in {outer!r} of {', '.join(sorted(owners))}"))
    for f in s.fields.values():
        if f.unit is not None and s.units.formless(f.unit):
            out.append(("UNIT_WITHOUT_FORMS", f.name, f"{f.unit} is at every number"))
        keys = [fold(normalise(k)) for k in f.keys or ()]
        out += [("KEY_INSIDE", f.name, f"{a!r} stands in {b!r}") for a in keys for b in keys if _inside(a, b)]
        if f.required and f.multiple:
            out.append(("REQUIRED_MULTIPLE", f.name, "one value covers it"))
    return sorted(set(out), key=lambda x: (x[1], x[0], x[2]))
