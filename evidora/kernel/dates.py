"""Date mentions of a text in declared formats."""

from __future__ import annotations

import datetime
from typing import NamedTuple

import regex

from .text import Text, fold

# ---------------------------------------------------------------- fixed values
FORMATS = ("YYYY-MM-DD", "D/M/YYYY", "M/D/YYYY", "D.M.YYYY", "D Month YYYY", "Month D, YYYY")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
# ------------------------------------------------------------------------------
_D, _Y = r"(?P<d>[0-9]{1,2})", r"(?P<y>[0-9]{4})"
_MONTH = rf"(?P<m>(?:{'|'.join(MONTHS)})|(?:sept|{'|'.join(x for x in SHORT if x != 'sept')})\.?)"
_NTH = r"(?P<nth>st|nd|rd|th)?"
_PATTERNS = {
    "YYYY-MM-DD": rf"{_Y}-(?P<n>[0-9]{{2}})-(?P<d>[0-9]{{2}})",
    "D/M/YYYY": rf"{_D}/(?P<n>[0-9]{{1,2}})/{_Y}",
    "M/D/YYYY": rf"(?P<n>[0-9]{{1,2}})/{_D}/{_Y}",
    "D.M.YYYY": rf"{_D}\.(?P<n>[0-9]{{1,2}})\.{_Y}",
    "D Month YYYY": rf"{_D}{_NTH}\s+{_MONTH}\s+{_Y}",
    "Month D, YYYY": rf"{_MONTH}\s+{_D}{_NTH},?\s+{_Y}",
}
_EDGE = r"(?<![\p{L}\p{N}])(?<!\p{N}[-/.])"
_COMPILED = {f: regex.compile(rf"{_EDGE}{p}(?![\p{{L}}\p{{N}}])(?![-/.]\p{{N}})") for f, p in _PATTERNS.items()}


class Mention(NamedTuple):
    start: int
    end: int
    format: str
    date: str


def ordinal(day: int) -> str:
    return "th" if 10 < day % 100 < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


NORMAL = regex.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def normal(text: object) -> str | None:
    """The text if it is a date in the normal form."""
    if isinstance(text, str) and NORMAL.fullmatch(text):
        try:
            return datetime.date.fromisoformat(text).isoformat()
        except ValueError:
            return None
    return None


def _places(text: str) -> list[tuple]:
    """(start, end, format, span of the year, month or its span, span of the day, ending of the day) of all that is written as a date, in order."""
    folded = fold(text)
    out = []
    for name, pattern in _COMPILED.items():
        for m in pattern.finditer(folded, overlapped=True):
            g = m.groupdict()
            if g.get("m"):
                word = g["m"].rstrip(".")
                month = SHORT.get(word) or MONTHS.index(word) + 1
            else:
                month = m.span("n")
            out.append((m.start(), m.end(), name, m.span("y"), month, m.span("d"), g.get("nth")))
    return sorted(out, key=lambda x: x[:3])


def mentions(text: str, shared: Text | None = None) -> list[Mention]:
    """shared: the text with its shape, in which the places are kept."""
    if shared is None:
        places = _places(text)
    elif (places := shared.shape.dates) is None:
        places = shared.shape.dates = _places(text)
    out = []
    for start, end, name, y, month, d, nth in places:
        day = int(text[d[0] : d[1]])
        if nth and nth != ordinal(day):
            continue
        try:
            date = datetime.date(int(text[y[0] : y[1]]), month if isinstance(month, int) else int(text[month[0] : month[1]]), day).isoformat()
        except ValueError:
            continue
        out.append(Mention(start, end, name, date))
    return out
