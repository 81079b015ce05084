"""Units at a number token."""

from __future__ import annotations

from dataclasses import dataclass

import regex

from .text import Text, Token, fold

# ---------------------------------------------------------------- fixed values
BASE_UNITS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "USD": (("$", "US$"), ("USD", "dollars")),
    "EUR": (("€",), ("EUR", "euros")),
    "GBP": (("£",), ("GBP",)),
    "INR": (("₹", "Rs.", "Rs"), ("INR", "rupees")),
    "%": ((), ("%", "percent")),
    "mg": ((), ("mg",)),
    "mcg": ((), ("mcg",)),
    "g": ((), ("g",)),
    "kg": ((), ("kg",)),
    "mL": ((), ("mL",)),
    "L": ((), ("L",)),
    "hours": ((), ("hours", "hour", "-hour")),
    "days": ((), ("days", "day", "-day")),
    "weeks": ((), ("weeks", "week", "-week")),
    "months": ((), ("months", "month", "-month")),
    "years": ((), ("years", "year", "-year")),
    "minutes": ((), ("minutes", "minute", "-minute")),
}
PER_UNITS = ("kg", "kilogram", "kilograms", "lb", "lbs", "pound", "pounds", "m2", "m²", "m^2", "square meter", "square meters", "square metre", "square metres", "mL", "dL", "L", "liter", "liters", "litre", "litres")
# ------------------------------------------------------------------------------
_PER = regex.compile(r"\s*(?:/|(?<![\p{L}\p{N}])per(?![\p{L}\p{N}]))\s*(?:[0-9][0-9.,]*\s*)?(?:" + "|".join(r"\s+".join(map(regex.escape, fold(u).split())) for u in sorted(PER_UNITS, key=len, reverse=True)) + r")(?![A-Za-zſıİK])")


@dataclass(frozen=True)
class Near:
    """What stands next to a token: codes whose prefix ends there, codes of the first suffix, whether that is a per-unit."""

    before: frozenset[str]
    after: frozenset[str]
    per: bool

    @property
    def any(self) -> bool:
        return bool(self.before or self.after)


class UnitTable:
    def __init__(self, own: dict | None = None) -> None:
        table = dict(BASE_UNITS)
        for code, forms in (own or {}).items():
            table[code] = (tuple(forms.get("prefix", ())), tuple(forms.get("suffix", ())))
        self.table = table
        self.prefixes: dict[str, set[str]] = {}
        suffixes: dict[str, set[str]] = {}
        for code, (before, after) in table.items():
            for p in before:
                self.prefixes.setdefault(p, set()).add(code)
            for s in after:
                suffixes.setdefault(s, set()).add(code)
        self.suffixes = suffixes
        self.digitless = not any(c.isdigit() for form in (*self.prefixes, *suffixes) for c in form)
        longest = lambda forms: "|".join(regex.escape(x) for x in sorted(forms, key=len, reverse=True))
        self._before = regex.compile(rf"(?:{longest(self.prefixes)})\s*$") if self.prefixes else None
        self._after = regex.compile(rf"(?:{longest(suffixes)})") if suffixes else None

    def formless(self, code: str) -> bool:
        """A code without forms is at every token."""
        return not any(self.table.get(code, ((), ())))

    def near(self, text: Text, t: Token, window: int) -> Near:
        if text.shared and not self.digitless:
            return self._near(text, t, window)
        known, key = text.shape.near, (self, t.start, window)
        if key not in known:
            known[key] = self._near(text, t, window)
        return known[key]

    def _near(self, text: Text, t: Token, window: int) -> Near:
        s = text.text
        before: set[str] = set()
        low = max(0, t.start - 24)
        stop = t.start
        while stop > low and s[stop - 1].isspace():
            stop -= 1
        for p, codes in self.prefixes.items():
            at = stop - len(p)
            if at >= 0 and s.startswith(p, at) and not (p[0].isalnum() and at and s[at - 1].isalnum()):
                before |= codes
        after: set[str] = set()
        per = False
        end = text.sentence(t.start)[1]
        if self._after is not None:
            for m in self._after.finditer(s, t.end, min(end, t.end + window + 64), overlapped=True):
                if m.start() > t.end + window:
                    break
                form = m[0]
                if form[0].isascii() and form[0].isalnum() and m.start() > t.end and s[m.start() - 1].isascii() and s[m.start() - 1].isalnum():
                    continue
                if form[-1].isascii() and form[-1].isalnum() and m.end() < len(s) and s[m.end()].isascii() and s[m.end()].isalnum():
                    shorter = next((x for x in sorted(self.suffixes, key=len, reverse=True) if len(x) < len(form) and s.startswith(x, m.start()) and not (s[m.start() + len(x)].isascii() and s[m.start() + len(x)].isalnum() and x[-1].isalnum())), None)
                    if shorter is None:
                        continue
                    form = shorter
                per = bool(_PER.match(text.folded, m.start() + len(form)))
                after = set(self.suffixes[form])
                break
        return Near(frozenset(before), frozenset(after), per)

    def is_at(self, near: Near, code: str) -> bool:
        return self.formless(code) or code in near.before or code in near.after and not near.per

    def held(self, code: str, text: str) -> bool:
        """Whether a text holds a form of the unit as a whole."""
        for form in (*self.table.get(code, ((), ()))[0], *self.table.get(code, ((), ()))[1]):
            left = r"(?<![\p{L}\p{N}])" if form[0].isalnum() else ""
            right = r"(?![\p{L}\p{N}])" if form[-1].isalnum() else ""
            if regex.search(left + regex.escape(form) + right, text):
                return True
        return False
