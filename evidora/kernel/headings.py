"""Headings that give the rows of a table below them a scale or a currency."""

from __future__ import annotations

from dataclasses import dataclass

import regex

from .text import CURRENCY_SIGNS, LN, SCALE_POWERS, Text, fold
from .units import UnitTable

# ---------------------------------------------------------------- fixed values
CURRENCIES: dict[str, tuple[tuple[str, ...], str]] = {
    "USD": (("US dollars", "U.S. dollars", "United States dollars"), "$"),
    "AUD": (("Australian dollars",), "$"),
    "CAD": (("Canadian dollars",), "$"),
    "HKD": (("Hong Kong dollars",), "$"),
    "NZD": (("New Zealand dollars",), "$"),
    "SGD": (("Singapore dollars",), "$"),
    "EUR": (("euros",), "€"),
    "GBP": (("pounds sterling", "sterling"), "£"),
    "INR": (("Indian rupees",), "₹"),
    "LKR": (("Sri Lankan rupees",), ""),
    "JPY": (("Japanese yen", "yen"), ""),
    "CNY": (("Chinese yuan", "yuan", "renminbi"), ""),
    "CHF": (("Swiss francs",), ""),
    "KRW": (("Korean won", "South Korean won"), ""),
    "SEK": (("Swedish kronor",), ""),
    "NOK": (("Norwegian kroner",), ""),
    "DKK": (("Danish kroner",), ""),
    "ZAR": (("South African rand",), ""),
    "BRL": (("Brazilian reais",), ""),
    "MXN": (("Mexican pesos",), ""),
}
SINGULAR = {"dollars": "dollar", "euros": "euro", "pounds": "pound", "rupees": "rupee", "francs": "franc", "kronor": "krona", "kroner": "krone", "reais": "real", "pesos": "peso"}
SCALE_MARKS = {"k": 3, "K": 3, "m": 6, "M": 6, "bn": 9, "Bn": 9, "BN": 9, "'000": 3, "’000": 3, "000": 3}
# ------------------------------------------------------------------------------
_SCALE = regex.compile(rf"(?<![{LN}])in\s+({'|'.join(SCALE_POWERS)})s?(?![{LN}])")
_HEADER = regex.compile(rf"(\p{{L}}*)([{CURRENCY_SIGNS}])(k|K|m|M|bn|Bn|BN|['’]000|000(?![.,][0-9]))(?![{LN}])")


def _names() -> dict[str, str]:
    out = {}
    for code, (names, _) in CURRENCIES.items():
        for n in names:
            out[fold(n)] = code
            words = n.split()
            if words[0] in SINGULAR:
                words = [SINGULAR[words[0]], *words[1:]]
            words[-1] = SINGULAR.get(words[-1], words[-1])
            out[fold(" ".join(words))] = code
    return out


_NAMES = _names()
_BY_NAME = "|".join(r"\s+".join(map(regex.escape, n.split())) for n in sorted(_NAMES, key=len, reverse=True))
_STATEMENT = regex.compile(rf"(?<![{LN}])in\s+(?:(?:{'|'.join(SCALE_POWERS)})s?\s+of\s+)?({_BY_NAME})(?![{LN}])")
_CODE = regex.compile(rf"(?<![{LN}])[iI][nN]\s+(?:(?i:{'|'.join(SCALE_POWERS)})s?\s+(?i:of)\s+)?({'|'.join(CURRENCIES)})(?![{LN}])")


@dataclass(frozen=True)
class Heading:
    line: int
    start: int
    end: int
    power: int | None  # scale
    form: str | None  # of a currency header
    code: str | None  # of a currency statement

    def allows(self, units: UnitTable) -> frozenset[str] | None:
        """Unit codes that it allows; None if it is an unknown header or no heading unit."""
        if self.code:
            return frozenset({self.code})
        if not self.form:
            return None
        own = {c for c, (before, _) in units.table.items() if self.form in before}
        if len(self.form) == 1:
            own |= {c for c, (_, sign) in CURRENCIES.items() if sign == self.form}
        return frozenset(own) or None


class Headings:
    """The headings of a text and which of them reach a place."""

    def __init__(self, text: Text) -> None:
        self.text = text
        self.starts, at = [], 0
        self.lines = text.text.split("\n")
        for line in self.lines:
            self.starts.append(at)
            at += len(line) + 1
        self._own: dict[int, list[Heading]] = {}

    def _line_of(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, at) - 1

    def of_line(self, i: int) -> list[Heading]:
        if i not in self._own:
            raw, base, out = self.lines[i], self.starts[i], []
            folded = self.text.folded[base : base + len(raw)]
            if "\t" not in raw:
                out += [Heading(i, base + m.start(), base + m.end(), SCALE_POWERS[m[1]], None, None) for m in _SCALE.finditer(folded)]
                out += [Heading(i, base + m.start(), base + m.end(), None, None, _NAMES[" ".join(m[1].split())]) for m in _STATEMENT.finditer(folded)]
                out += [Heading(i, base + m.start(), base + m.end(), None, None, m[1]) for m in _CODE.finditer(raw)]
            out += [Heading(i, base + m.start(), base + m.end(), SCALE_MARKS[m[3]], m[1] + m[2], None) for m in _HEADER.finditer(raw)]
            self._own[i] = out
        return self._own[i]

    def reaching(self, at: int) -> list[Heading]:
        """Headings above the tabbed line that holds a place: within its table, or right above it but for blank lines."""
        i = self._line_of(at)
        if "\t" not in self.lines[i]:
            return []
        out, j = [], i - 1
        while j >= 0 and "\t" in self.lines[j]:
            out += self.of_line(j)
            j -= 1
        while j >= 0 and not self.lines[j].strip():
            j -= 1
        if j >= 0 and "\t" not in self.lines[j]:
            out += self.of_line(j)
        elif j >= 0:  # the last row of a table above blank lines: the headings that stand in its rows
            out += self.of_line(j)
        return out


def of(text: Text) -> Headings:
    if not hasattr(text, "_headings"):
        text._headings = Headings(text)
    return text._headings


def is_currency(code: str | None, units: UnitTable) -> bool:
    return code in CURRENCIES or any(p[-1] in CURRENCY_SIGNS for p in units.table.get(code or "", ((), ()))[0])


def conflict(text: Text, at: int, code: str | None, units: UnitTable) -> bool:
    """Whether a heading unit that reaches a place does not allow a currency unit."""
    if not is_currency(code, units):
        return False
    return any((a := h.allows(units)) is not None and code not in a for h in of(text).reaching(at))


def currency(text: Text, at: int, code: str | None, units: UnitTable) -> bool:
    """Whether a unit is the heading currency of a place."""
    reach = of(text).reaching(at)
    settled = any(h.code == code or h.form in units.table.get(code or "", ((), ()))[0] for h in reach if h.code or h.form)
    return settled and not any((a := h.allows(units)) is not None and code not in a for h in reach)


def names(code: str, text: str) -> bool:
    """Whether a text holds a name of a currency, or its code."""
    folded = " ".join(fold(text).split())
    return any(c == code and regex.search(rf"(?<![{LN}]){regex.escape(n)}(?![{LN}])", folded) for n, c in _NAMES.items()) or bool(regex.search(rf"(?<![{LN}]){regex.escape(code)}(?![{LN}])", text))


def scale(text: Text, at: int) -> bool:
    return any(h.power is not None for h in of(text).reaching(at))
