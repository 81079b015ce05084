"""Letters, white space, numbers, scales, sentences and qualifiers of a text."""

from __future__ import annotations

import bisect
from decimal import Decimal
from functools import cached_property
from typing import NamedTuple

import regex

# ---------------------------------------------------------------- fixed values
SCALE_POWERS = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12, "lakh": 5, "crore": 7}
SUFFIX_POWERS = {"k": 3, "K": 3, "m": 6, "M": 6, "bn": 9, "Bn": 9, "BN": 9}
CURRENCY_SIGNS = "$€£₹"
ABBREVIATIONS = (
    "a.m.", "p.m.", "approx.", "ca.", "cf.", "e.g.", "i.e.", "etc.", "vs.", "viz.", "no.", "nos.", "p.", "pp.", "para.",
    "fig.", "figs.", "vol.", "rs.", "u.s.", "u.k.", "dr.", "mr.", "mrs.", "ms.", "jr.", "sr.", "st.", "inc.", "co.",
    "corp.", "ltd.", "est.", "min.", "max.", "hr.", "hrs.", "mo.", "mos.", "yr.", "yrs.", "wk.", "wks.", "wt.", "oz.",
    "lb.", "lbs.",
)
BEFORE = {
    "approx": ("approximately", "approx", "about", "around", "nearly", "roughly", "generally", "~", "≈"),
    "gt": ("more than", "greater than", "above", "over", "exceed", "exceeds", "exceeding", ">"),
    "lt": ("less than", "fewer than", "below", "under", "<"),
    "ge": ("at least", "minimum of", "no less than", "≥"),
    "le": ("up to", "maximum of", "at most", "no more than", "≤"),
}
AFTER = {
    "ge": ("or more", "or greater", "or older", "or higher", "or above"),
    "le": ("or less", "or fewer", "or younger", "or lower", "or below"),
}
INVERTED = {"gt": "le", "le": "gt", "lt": "ge", "ge": "lt"}
DETERMINERS = ("the", "a", "an", "its", "their", "this", "that", "these", "those")
NOT_IN_CHANGE = (
    "about", "above", "across", "after", "among", "at", "before", "below", "between", "by", "during", "for", "from", "in",
    "into", "on", "over", "per", "since", "through", "to", "under", "until", "with", "within", "range", "ranges", "ranged",
    "ranging", "vary", "varies", "varied", "varying",
)
CHANGE_WORDS = (
    "increase", "increases", "increased", "increasing", "decrease", "decreases", "decreased", "decreasing", "raise",
    "raises", "raised", "raising", "reduce", "reduces", "reduced", "reducing", "reduction", "reductions", "lowers",
    "lowered", "lowering", "rise", "rises", "rose", "risen", "rising", "fall", "falls", "fell", "fallen", "falling",
    "drop", "drops", "dropped", "dropping", "grow", "grows", "grew", "grown", "growing", "change", "changes", "changed",
    "changing", "decline", "declines", "declined", "declining", "adjust", "adjusts", "adjusted", "adjusting",
    "adjustment", "adjustments", "revise", "revises", "revised", "revising", "revision", "revisions",
)
# ------------------------------------------------------------------------------
DIGIT_LIMIT, WINDOW = 1_000_000, 40
LN, GROUP_SPACE = r"\p{L}\p{N}", " \u00a0\u2009\u202f"


class _Fold(dict):
    def __init__(self) -> None:
        super().__init__({ord("ſ"): "s", ord("ı"): "i", ord("İ"): "i", 0x212A: "k"})

    def __missing__(self, code: int) -> str:
        c = chr(code)
        low = c.lower()
        self[code] = out = low if len(low) == 1 else c
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Lower case letter by letter; as long as the text."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def normalise(text: str) -> str:
    return " ".join(text.split())


_HYPHENATED = regex.compile(r"-\n\s*")


def verbatim(text: str) -> str:
    return normalise(_HYPHENATED.sub("", text) if "-\n" in text else text)


def plain(number: Decimal) -> str:
    """The decimal without exponent, trailing zeros or a signed zero."""
    s = format(number, "f")
    if "." in s:
        s = s.rstrip("0").rstrip(".")
    return "0" if s in ("-0", "") else s


class Token(NamedTuple):
    start: int
    end: int
    value: Decimal | None
    places: int  # digits after the point

    @property
    def negative(self) -> bool:
        return self.value is not None and self.value < 0


_PLAIN = regex.compile(rf"(?<![{LN}.,])(?:(?<![{LN}])[-−])?+[0-9][0-9,]*+(?:\.[0-9]++)?+")
_SPACED = regex.compile(rf"(?<![{LN}.,])(?<![0-9][{GROUP_SPACE}])(?:(?<![{LN}])[-−])?+[0-9]{{1,3}}+(?:[{GROUP_SPACE}][0-9]{{3}}(?![0-9]))++(?:\.[0-9]++)?+(?![0-9]|[{GROUP_SPACE}][0-9]|[,.][0-9])")
_GROUPS = regex.compile(r"[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,2}(?:,[0-9]{2})*,[0-9]{3}")
_FOREIGN = regex.compile(r"(?V1)[.,]?[\p{N}--[0-9]]")
_THOUSANDS = regex.compile(rf"[{CURRENCY_SIGNS}]['’]?000(?![{LN}])(?![.,][0-9])")


def _decimal(raw: str) -> tuple[Decimal | None, int]:
    body = raw.lstrip("-−")
    whole, _, frac = body.partition(".")
    if not _GROUPS.fullmatch(whole):
        return None, len(frac)
    digits = whole.replace(",", "") + ("." + frac if frac else "")
    return Decimal(("-" if body != raw else "") + digits), len(frac)


def parse_value(text: str) -> Decimal | None:
    """The number that a whole string is, or None."""
    s = text.strip()
    m = _PLAIN.fullmatch(s)
    return _decimal(s)[0] if m and not s.endswith(",") else None


def number_tokens(text: str) -> list[Token]:
    """All number tokens, with a value or without, in order."""
    barred = {m.end() - 3 for m in _THOUSANDS.finditer(text)} if "000" in text else set()
    spaced = []
    if "\t" in text:
        at = 0
        for line in text.split("\n"):
            if "\t" in line:
                for m in _SPACED.finditer(text, at, at + len(line)):
                    digits = m.end() - len(m[0].lstrip("-−"))
                    if digits not in barred and not _FOREIGN.match(text, m.end()):
                        value, places = _decimal(regex.sub(f"[{GROUP_SPACE}]", "", m[0]))
                        spaced.append(Token(m.start(), m.end(), value, places))
            at += len(line) + 1
    out, k = [], 0
    for m in _PLAIN.finditer(text):
        raw = m[0]
        end = m.end()
        while raw.endswith(","):
            raw, end = raw[:-1], end - 1
        while k < len(spaced) and spaced[k].end <= m.start():
            k += 1
        if k < len(spaced) and spaced[k].start < end:
            continue
        if _FOREIGN.match(text, end) or (m.end() - len(m[0].lstrip("-−"))) in barred:
            continue
        out.append(Token(m.start(), end, *_decimal(raw)))
    return sorted(out + spaced, key=lambda t: t.start)


_SCALE_SUFFIX = regex.compile(rf"(bn|Bn|BN|k|K|m|M)(?![{LN}])")


def scaled(value: Decimal, power: int) -> Decimal | None:
    if value.adjusted() + 1 + power > DIGIT_LIMIT:
        return None
    return value.scaleb(power)


def _words(forms) -> str:
    """A pattern of folded phrases, longest first; letters and digits bound a phrase that has them at its ends."""
    parts = []
    for w in sorted(forms, key=lambda w: (-len(w), w)):
        p = r"\s+".join(regex.escape(x) for x in fold(w).split())
        parts.append((rf"(?<![{LN}])" if w[0].isalnum() else "") + p + (rf"(?![{LN}])" if w[-1].isalnum() else ""))
    return "|".join(parts)


class Vocabulary:
    """Word lists and the patterns made of them; packs add words to the base."""

    def __init__(self, scales: dict[str, int] | None = None, before: dict[str, list[str]] | None = None, after: dict[str, list[str]] | None = None, abbreviations: list[str] = (), loss: list[str] = ()) -> None:
        self.scales = {**SCALE_POWERS, **(scales or {})}
        self.loss = tuple(loss)
        merged = lambda base, more: {k: (*base.get(k, ()), *sorted(set((more or {}).get(k, ())) - set(base.get(k, ())), key=lambda w: (-len(w), w))) for k in {**base, **(more or {})}}
        self.words_before, self.words_after = merged(BEFORE, before), merged(AFTER, after)
        self.before = [(k, regex.compile(_words(v))) for k, v in self.words_before.items()]
        self.after = [(k, regex.compile(_words(v))) for k, v in self.words_after.items()]
        names = "|".join(map(regex.escape, sorted(map(fold, self.scales), key=len, reverse=True)))
        self.scale_names = names
        self.scale = regex.compile(rf"\s{{0,2}}({names})(?![{LN}])")
        short = sorted({*ABBREVIATIONS, *abbreviations}, key=len, reverse=True)
        self.abbreviation = regex.compile(rf"(?<![{LN}])(?:{'|'.join(regex.escape(x) for x in short)})$")
        self.longest_abbreviation = max(map(len, short))
        said = [*self.scales, *(w for side in (self.words_before, self.words_after) for ws in side.values() for w in ws), *short, *self.loss]
        self.digitless = not any(c.isdigit() for w in said for c in w)


_NEGATED = regex.compile(rf"(?<![{LN}])(?:not|cannot|can['’]t)(?:\s+be)?\s+$")
_SPACES, _SOLID, _GAP = regex.compile(r"\s*"), regex.compile(r"\S*"), regex.compile(r"\s+")
_BREAK = regex.compile(r"[.;](?=\s)|•|\n[ \t\r]*\n")
_TO_NEXT = regex.compile(r"(?:\s*(?P<word>[^\s\d]{1,12}))?(?P<gap>\s*)(?P<c>to|through|thru|and|[-–])\s*[^\s]{0,4}?\s*")
_BETWEEN = regex.compile(rf"(?<![{LN}])between(?![{LN}])")
_SIX = regex.compile(r"(?:\s+\p{L}[\p{L}\p{M}]*){0,6}\s+")
_FROM = regex.compile(rf"(?<![{LN}])from(?![{LN}])\s*\S{{0,4}}\s*$")
_CHANGE = regex.compile(rf"(?<![{LN}])(?:{'|'.join(CHANGE_WORDS)})(?![{LN}])((?:\s+\p{{L}}(?:[\p{{L}}'’-]*\p{{L}})?){{0,6}})\s+(?=from)")


BASE = Vocabulary()

_TO_NOUGHT = bytes.maketrans(b"123456789", b"000000000")
#: The rules that tell one digit from another: thousands after a currency sign, and the per-units of square metres.
_TOLD_APART = regex.compile(r"[mM]\^?2|[$]['’]?000")


def digits_hidden(text: str) -> bytes:
    """An ASCII text with noughts for its digits."""
    return text.encode().translate(_TO_NOUGHT)


class Memo:
    """The last results by their text: a bounded number, those in use kept."""

    def __init__(self, most: int = 2048) -> None:
        self._most, self._new, self._old = most, {}, {}

    def get(self, key: str | bytes):
        got = self._new.get(key)
        if got is None and (got := self._old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: str | bytes, value) -> None:
        if len(self._new) >= self._most:
            self._old, self._new = self._new, {}
        self._new[key] = value


class Shape:
    """What the rules find by kinds of characters alone; texts that differ in their digits share it."""

    __slots__ = ("tokens", "starts", "hard", "soft", "scales", "qualifiers", "near", "dates", "lone")

    def __init__(self) -> None:
        self.tokens = self.starts = self.hard = self.soft = self.dates = None
        self.scales, self.qualifiers, self.near, self.lone = {}, {}, {}, {}


class Shapes:
    """Shapes of the texts of one schema."""

    LONGEST = 1000

    def __init__(self) -> None:
        self._known = Memo()

    def of(self, text: str, vocabulary: Vocabulary) -> Shape | None:
        """The shape that a text shares; None where a rule could tell its digits apart, or it is long."""
        if len(text) > self.LONGEST or not vocabulary.digitless or not text.isascii() or _TOLD_APART.search(text):
            return None
        key = digits_hidden(text)
        out = self._known.get(key)
        if out is None:
            out = Shape()
            self._known.put(key, out)
        return out


class Text:
    """A text with its indexes, built when first asked for and kept for all candidates of a document."""

    def __init__(self, text: str, vocabulary: Vocabulary | None = None, shapes: Shapes | None = None) -> None:
        self.text, self.vocabulary = text, vocabulary or BASE
        shape = shapes.of(text, self.vocabulary) if shapes is not None else None
        self.shared = shape is not None
        self.shape = shape or Shape()
        self._read: dict[int, Token] = {}

    @cached_property
    def folded(self) -> str:
        return fold(self.text)

    @cached_property
    def tokens(self) -> list[Token]:
        return [self._token(i) for i in range(len(self._starts))]

    @property
    def _starts(self) -> list[int]:
        shape = self.shape
        if shape.starts is None:
            found = number_tokens(self.text)
            self._read = dict(enumerate(found))
            shape.tokens = [(t.start, t.end, t.value is not None, t.places) for t in found]
            shape.starts = [t.start for t in found]
        return shape.starts

    def _token(self, i: int) -> Token:
        got = self._read.get(i)
        if got is None:  # found in another text of the shape, which is ASCII
            start, end, valued, places = self.shape.tokens[i]
            got = self._read[i] = Token(start, end, Decimal(self.text[start:end].replace(",", "").replace(" ", "")) if valued else None, places)
        return got

    @property
    def _hard(self) -> list[int]:
        """Sentence ends: where the next sentence may begin."""
        if self.shape.hard is None:
            self.shape.hard = [m.end() for m in _BREAK.finditer(self.text)]
        return self.shape.hard

    @property
    def _soft(self) -> list[int]:
        """Sentence ends that stay when listed abbreviations join sentences (for qualifiers)."""
        if self.shape.soft is None:
            self.shape.soft = [m.end() for m in _BREAK.finditer(self.text) if not self._joins(m.start(), m.end())]
        return self.shape.soft

    def _joins(self, at: int, end: int) -> bool:
        if self.text[at] != ".":
            return False
        m = self.vocabulary.abbreviation.search(self.folded, max(0, at - self.vocabulary.longest_abbreviation - 1), at + 1)
        if not m:
            return False
        gap = _SPACES.match(self.text, end)
        if gap[0].count("\n") > 1:
            return False
        rest = self.text[gap.end() : gap.end() + 1]
        if rest and (rest.islower() or rest.isdigit() or rest in CURRENCY_SIGNS) or m[0] == "u.s.":
            return True
        if m[0] in ("no.", "nos."):
            word = _SOLID.match(self.text, gap.end())[0]
            return any(c.isdigit() for c in word) or bool(regex.match("[A-Z]{2}", word))
        return False

    def tokens_in(self, start: int, end: int) -> list[Token]:
        starts = self._starts
        i, out = bisect.bisect_left(starts, start), []
        while i < len(starts) and starts[i] < end:
            if self.shape.tokens[i][1] <= end:
                out.append(self._token(i))
            i += 1
        return out

    def previous(self, t: Token) -> Token | None:
        i = bisect.bisect_left(self._starts, t.start)
        return self._token(i - 1) if i else None

    def next(self, t: Token) -> Token | None:
        i = bisect.bisect_left(self._starts, t.end)
        return self._token(i) if i < len(self._starts) else None

    def sentence(self, at: int, joined: bool = False) -> tuple[int, int]:
        ends = self._soft if joined else self._hard
        i = bisect.bisect_right(ends, at)
        return (ends[i - 1] if i else 0), (ends[i] if i < len(ends) else len(self.text))

    def scale(self, t: Token) -> int | None:
        """The power of ten that a scale word or suffix gives a token."""
        if t.value is None:
            return None
        known = self.shape.scales
        if t.start not in known:
            known[t.start] = self._scale(t)
        return known[t.start]

    def _scale(self, t: Token) -> int | None:
        m = self.vocabulary.scale.match(self.folded, t.end)
        if m:
            return self.vocabulary.scales[m[1]]
        digits = t.start + (1 if self.text[t.start] in "-−" else 0)
        if digits == t.start and t.start and self.text[t.start - 1] in CURRENCY_SIGNS:
            m = _SCALE_SUFFIX.match(self.text, t.end)
            if m:
                return SUFFIX_POWERS[m[1]]
        return None

    def scaled_value(self, t: Token) -> Decimal | None:
        power = self.scale(t)
        return None if power is None else scaled(t.value, power)

    def scale_between(self, low: int, high: int, power: int) -> bool:
        """Whether a scale word, or a currency scale of another power, stands between two places."""
        if regex.compile(rf"(?<![{LN}])(?:{self.vocabulary.scale_names})s?(?![{LN}])").search(self.folded, low, high):
            return True
        marks = regex.compile(rf"[{CURRENCY_SIGNS}](?:(bn|Bn|BN|k|K|m|M)|['’]?000(?![.,][0-9]))(?![{LN}])").finditer(self.text, low, high)
        return any((SUFFIX_POWERS[m[1]] if m[1] else 3) != power for m in marks)

    def qualifiers(self, t: Token) -> set[str]:
        """Comparators that apply to a token; not to be changed."""
        known = self.shape.qualifiers
        if t.start not in known:
            known[t.start] = self._qualifiers(t)
        return known[t.start]

    def _qualifiers(self, t: Token) -> set[str]:
        low, high = self.sentence(t.start, joined=True)
        before, after = self.previous(t), self.next(t)
        lo = max(low, t.start - WINDOW, before.end if before else 0)
        hi = min(high, t.end + WINDOW, after.start if after else len(self.text))
        found: list[tuple[int, int, str]] = []
        for kind, pattern in self.vocabulary.before:
            for m in pattern.finditer(self.folded, lo, t.start):
                k = kind
                if k in INVERTED and _NEGATED.search(self.folded, low, m.start()):
                    k = INVERTED[k]
                found.append((m.start(), m.end(), k))
        for kind, pattern in self.vocabulary.after:
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(self.folded, t.end, hi)]
        out = {k for s, e, k in found if not any(a <= s and e <= b and b - a > e - s for a, b, _ in found)}
        if self._is_range(t, after, first=True) or before and self._is_range(before, t, first=False):
            out.add("range")
        return out

    def _is_range(self, a: Token, b: Token | None, first: bool) -> bool:
        """Whether tokens a and b are the ends of a range; for the second end, a change of value is none."""
        if b is None or b.start > self.sentence(a.start, joined=True)[1]:
            return False
        body = self.folded[a.end : b.start]
        m = None
        # the sign of b may itself be the connector
        for tail in (b.start, b.start + (self.text[b.start] == "-")):
            m = _TO_NEXT.fullmatch(self.folded, a.end, tail)
            if m:
                break
        if not m:
            return False
        c, gap = m["c"], m["gap"]
        if c in "-–" and m["word"]:
            return False
        if c == "-" and "\t" in gap and self.text[m.end("c") : m.end("c") + 1].isdigit():
            return False
        if c.isalpha():
            edge = self.folded[m.start("c") - 1]
            if edge.isalnum() or self.folded[m.end("c") : m.end("c") + 1].isalpha():
                return False
        if c == "and":
            low = self.sentence(a.start)[0]
            if not any(_SIX.fullmatch(self.folded, x.end(), a.start) or regex.fullmatch(r"\s*\S{0,4}\s*", self.folded[x.end() : a.start]) for x in _BETWEEN.finditer(self.folded, low, a.start)):
                return False
        elif not first and self._changes(a):
            return False
        return bool(body)

    def _changes(self, a: Token) -> bool:
        """Whether the number a follows "from" in a phrase that begins with a change word."""
        low = self.sentence(a.start, joined=True)[0]
        m = _FROM.search(self.folded, low, a.start)
        if not m:
            return False
        for x in _CHANGE.finditer(self.folded[low : m.start() + 4]):
            if low + x.end() != m.start():
                continue
            words = x[1].split()
            if not words:
                return True
            at = 1 if words[0] in ("in", "of", "to") else 0
            if at < len(words) and words[at] in DETERMINERS and not any(w in NOT_IN_CHANGE for w in words[at + 1 :]):
                return True
        return False

    def occurrences(self, quote: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
        """Where a quote stands; runs of white space match each other."""
        parts = quote.split()
        if not parts:
            return []
        if len(parts) == 1:
            return self._plain_occurrences(parts[0], start, len(self.text) if end is None else end)
        return self._spaced_occurrences(parts, start, len(self.text) if end is None else end)

    def _spaced_occurrences(self, parts: list[str], start: int, end: int) -> list[tuple[int, int]]:
        text, out, first = self.text, [], parts[0]
        at = text.find(first, start, end)
        while at >= 0:
            stop = at + len(first)
            for p in parts[1:]:
                gap = _GAP.match(text, stop, end)
                if gap is None or not text.startswith(p, gap.end(), end):
                    stop = -1
                    break
                stop = gap.end() + len(p)
            if stop >= 0:
                out.append((at, stop))
            at = text.find(first, at + 1 if stop < 0 else stop, end)
        return out

    def _plain_occurrences(self, word: str, start: int, end: int) -> list[tuple[int, int]]:
        out, at = [], self.text.find(word, start, end)
        while at >= 0:
            out.append((at, at + len(word)))
            at = self.text.find(word, at + len(word), end)
        return out

    @cached_property
    def _bytes(self) -> list[int] | None:
        """Byte offset of each code point, or None for ASCII."""
        if self.text.isascii():
            return None
        out, n = [0], 0
        for c in self.text:
            n += len(c.encode("utf-8", "surrogatepass"))
            out.append(n)
        return out

    def from_bytes(self, at: int) -> int | None:
        """The code point at a byte offset, None off a boundary."""
        if self._bytes is None:
            return at if 0 <= at <= len(self.text) else None
        i = bisect.bisect_left(self._bytes, at)
        return i if i < len(self._bytes) and self._bytes[i] == at else None

    def to_bytes(self, at: int) -> int:
        return at if self._bytes is None else self._bytes[at]
