"""Text functions as column expressions, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number token: not after a letter, digit, dot or comma, nor before a number character that ends no token.
NUMBER = r"(?<![\p{L}\p{N}.,])(?:(?<![\p{L}\p{N}])[-−])?[0-9][0-9,]*(?:\.[0-9]+)?"
GROUPED = r"^[-−]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,2}(?:,[0-9]{2})*,[0-9]{3})(?:\.[0-9]+)?$"
#: Powers of ten of the scale words (fixed values).
SCALES = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12, "lakh": 5, "crore": 7}
#: Every character that Python's str.isspace() accepts (fixed values).
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def number_tokens(text: Column) -> Column:
    """Number tokens of a text, trailing commas dropped (the prefilter of the kernel's rule)."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r",+$", ""))


def has_value(token: Column) -> Column:
    """Whether a token's digits are ungrouped, grouped in threes or the Indian way."""
    return token.rlike(GROUPED)


def plain_number(token: Column) -> Column:
    """A token without grouping, with an ASCII minus."""
    return F.regexp_replace(F.translate(token, "−", "-"), ",", "")


def canonical_decimal(number: Column) -> Column:
    """A plain decimal without leading zeros, trailing fractional zeros or a signed zero, of any length."""
    s = F.regexp_replace(number, r"^(-?)0+(?=[0-9])", "$1")
    s = F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")).otherwise(s)
    return F.when(s == "-0", F.lit("0")).otherwise(s)


def normalise_space(text: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def verbatim(text: Column) -> Column:
    """normalise_space, after joining words that a line break hyphenates."""
    return normalise_space(F.regexp_replace(text, "-\n" + SPACE + "*", ""))


def fold(text: Column) -> Column:
    """Lower case letter by letter, with the four look-alike letters; a capital sigma is no final one at a word's end."""
    return F.lower(F.translate(text, "ſıİKΣ", "siikσ"))


def url_host(url: Column) -> Column:
    """The host of a URL, in lower case: after the scheme and any user, without the port; an address in brackets keeps them."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(rest)


def occurrences(text: Column, quote: Column) -> Column:
    """How often a quote stands in a text, without overlaps."""
    gone = F.length(text) - F.length(F.replace(text, quote))
    return F.when(F.length(quote) > 0, (gone / F.length(quote)).cast("long")).otherwise(F.lit(0).cast("long"))


def text_selector(text: Column, start: Column, end: Column, context: int = 32) -> tuple[Column, Column, Column]:
    """(prefix, exact, suffix) of a code-point span."""
    before = F.greatest(start - context, F.lit(0))
    return text.substr(before + 1, start - before), text.substr(start + 1, end - start), text.substr(end + 1, F.lit(context))


def byte_offset(text: Column, at: Column) -> Column:
    """UTF-8 offset of a code-point offset."""
    return F.octet_length(text.substr(F.lit(1), at))


def digest(kind: str, canonical: Column, prefix: str = "evidora/1") -> Column:
    """Domain-separated SHA-256 of canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(f"{prefix}:{kind}\x00"), canonical), 256))


def visible(text: Column) -> Column:
    """Control characters other than tab and line break shown as ?."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f]", "?")


def rate(number: Column) -> Column:
    """A rate with at most four places, without exponent and trailing zeros."""
    s = F.format_string("%.4f", number.cast("double"))
    return F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")
