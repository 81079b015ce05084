"""Where else than next to a value its unit can stand: on its line, in a caption of its table, in its column.

What a table says about a unit is read once for all values of the table, so that a long table with many candidates costs one
pass a unit.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field as member

import regex

from . import headings
from .text import LN, Text, Token

_LONE_DASH = regex.compile(r"(?<!\S)[-–—](?!\S)")


@dataclass(frozen=True)
class Forms:
    """The forms of one unit."""

    prefixes: tuple[str, ...]
    suffixes: tuple[str, ...]

    def within(self, text: str, low: int, high: int) -> list[tuple[int, int, bool]]:
        """(start, end, is it a prefix) of the forms that stand as a whole between two places."""
        out = []
        for forms, leads in ((self.prefixes, True), (self.suffixes, False)):
            for form in forms:
                left = rf"(?<![{LN}])" if form[0].isalnum() else ""
                right = rf"(?![{LN}])" if form[-1].isalnum() else ""
                found = regex.compile(left + regex.escape(form) + right)
                out += [(*m.span(), leads) for m in found.finditer(text, low, high, overlapped=True)]
        return out


@dataclass
class Seen:
    """The first line of a table that says a unit, in a caption and in each column."""

    caption: int | None = None
    columns: dict[int, int] = member(default_factory=dict)


class Places:
    def __init__(self, text: Text) -> None:
        self.text = text
        layout = headings.of(text)
        self.lines, self.starts = layout.lines, layout.starts
        self.numbered = [bool(text.tokens_in(a, a + len(line))) for a, line in zip(self.starts, self.lines, strict=True)]
        self.top: list[int] = []
        for i in range(len(self.lines)):
            self.top.append(self.top[i - 1] if i and self.of_table(i - 1) else i)
        self._cells: dict[tuple[int, Forms], list[tuple[int, int]] | None] = {}
        self._seen: dict[tuple[int, Forms], Seen] = {}

    def line_of(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at) - 1

    def of_table(self, i: int) -> bool:
        """Whether a line can stand in a table: it is not blank and has a tab or no number."""
        return bool(self.lines[i].strip()) and ("\t" in self.lines[i] or not self.numbered[i])

    def captioned(self, top: int) -> int | None:
        """The caption above a table, over blank lines."""
        i = top - 1
        while i >= 0 and not self.lines[i].strip():
            i -= 1
        return i if i >= 0 and "\t" not in self.lines[i] and not self.numbered[i] else None

    def cells(self, i: int, forms: Forms) -> list[tuple[int, int]] | None:
        """The cells of a line after its first tab, one a column; None if they are ambiguous."""
        if (i, forms) not in self._cells:
            self._cells[i, forms] = self._read(i, forms)
        return self._cells[i, forms]

    def _read(self, i: int, forms: Forms) -> list[tuple[int, int]] | None:
        raw, base = self.lines[i], self.starts[i]
        label, tab, rest = raw.partition("\t")
        slots, at = [], base + len(label) + 1
        for part in rest.split("\t") if tab else ():
            slots.append((at, at + len(part)))
            at += len(part) + 1
        out: list[tuple[int, int]] = []
        for n, (a, b) in enumerate(slots):
            body = self.text.text[a:b].strip()
            if not body:
                out.append((a, b))
            elif body in forms.prefixes:
                after = self.text.text[slice(*slots[n + 1])].strip() if n + 1 < len(slots) else None
                if after is not None and (not after or _LONE_DASH.fullmatch(after)) or self._number_follows(b):
                    continue
                start = self.text.text.index(body, a)
                out.append((start, start + len(body)))
            else:
                held = [(t.start, t.end) for t in self.text.tokens_in(a, b)]
                held += [m.span() for m in _LONE_DASH.finditer(self.text.text, a, b)]
                if len(held) != 1:
                    return None
                out += held
        return out

    def _number_follows(self, at: int) -> bool:
        s = self.text.text
        while at < len(s) and s[at].isspace():
            at += 1
        i = bisect.bisect_left(self.text._starts, at)
        return s[at : at + 1] == "(" or i < len(self.text.tokens) and self.text.tokens[i].start == at

    def column(self, i: int, at: int, forms: Forms) -> int | None:
        """The column of a line whose cell starts at a place."""
        return next((n for n, (a, _) in enumerate(self.cells(i, forms) or ()) if a == at), None)

    def heads(self, cell: tuple[int, int], form: tuple[int, int, bool]) -> bool:
        """Whether a form stands at a cell that is not blank, only white space between."""
        start, end, leads = form
        s = self.text.text
        if not s[slice(*cell)].strip():
            return False
        return end <= cell[0] and not s[end : cell[0]].strip() if leads else start >= cell[1] and not s[cell[1] : start].strip()

    def seen(self, top: int, forms: Forms) -> Seen:
        """What the lines of the table that begins at `top`, and its caption, say of a unit."""
        if (top, forms) not in self._seen:
            found = Seen()
            rows = [] if (c := self.captioned(top)) is None else [c]
            i = top
            while i < len(self.lines) and self.top[i] == top and self.of_table(i):
                rows.append(i)
                i += 1
            for i in rows:
                at = self.starts[i]
                hits = forms.within(self.text.text, at, at + len(self.lines[i]))
                if not hits:
                    continue
                if "\t" not in self.lines[i]:
                    found.caption = i if found.caption is None else found.caption
                    continue
                for n, cell in enumerate(self.cells(i, forms) or ()):
                    if n not in found.columns and any(self.heads(cell, h) for h in hits):
                        found.columns[n] = i
            self._seen[top, forms] = found
        return self._seen[top, forms]

    def _bracketed(self, t: Token, forms: Forms) -> tuple[int, int] | None:
        """The places between which a prefix ends that stands before brackets around a value."""
        s = self.text.text
        lead = "|".join(map(regex.escape, sorted(forms.prefixes, key=len, reverse=True))) or r"(?!)"
        low = max(0, t.start - 64)
        opened = regex.search(rf"\((?:\s|{lead})*$", s[low : t.start])
        if not opened or not regex.compile(r"\s*\)").match(s, t.end):
            return None
        paren = at = low + opened.start()
        while at and s[at - 1].isspace():
            at -= 1
        return at, paren

    def says(self, t: Token, forms: Forms) -> bool:
        """Whether a form before a value stands at one of its unit places."""
        i = self.line_of(t.start)
        hits = forms.within(self.text.text, self.starts[i], t.start)
        if hits:
            return True
        if (b := self._bracketed(t, forms)) and any(leads and b[0] <= end <= b[1] for _, end, leads in forms.within(self.text.text, max(0, b[0] - 24), b[1])):
            return True
        if "\t" not in self.lines[i]:
            return False
        found = self.seen(self.top[i], forms)
        n = self.column(i, t.start, forms)
        return found.caption is not None and found.caption < i or found.columns.get(n, i) < i

    def holds(self, t: Token, item: tuple[int, int], forms: Forms) -> bool:
        """Whether a cited item before a value holds a form that stands at one of its unit places."""
        if item[1] > t.start:
            return False
        i = self.line_of(t.start)
        hits = forms.within(self.text.text, *item)
        b = self._bracketed(t, forms) if hits else None
        for hit in hits:
            start, end, leads = hit
            if start >= self.starts[i] or b and leads and b[0] <= end <= b[1]:
                return True
            j = self.line_of(start)
            if "\t" not in self.lines[i] or end > self.starts[j] + len(self.lines[j]):
                continue
            inside = self.top[i] <= j < i
            if "\t" not in self.lines[j] and (inside or j == self.captioned(self.top[i])):
                return True
            n = self.column(i, t.start, forms)
            row = self.cells(j, forms) or () if inside and "\t" in self.lines[j] else ()
            if n is not None and n < len(row) and self.heads(row[n], hit):
                return True
        return False


def of(text: Text) -> Places:
    if not hasattr(text, "_places"):
        text._places = Places(text)
    return text._places
