"""Canonical JSON (RFC 8785) and domain-separated digests."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

PREFIX = "evidora/1"
SAFE = 2**53 - 1


class NotCanonical(ValueError):
    """A value that has no canonical form."""


def _number(x: float) -> str:
    """The shortest decimal of a double, written as ECMAScript writes numbers."""
    if not math.isfinite(x):
        raise NotCanonical("a number must be finite")
    if x == 0:
        return "0"
    sign, digits = ("-" if x < 0 else ""), repr(abs(x))
    mantissa, _, exponent = digits.partition("e")
    whole, _, frac = mantissa.partition(".")
    frac = "" if frac == "0" else frac
    point = len(whole) + int(exponent or 0)
    figures = (whole + frac).lstrip("0")
    point -= len(whole + frac) - len(figures)
    figures = figures.rstrip("0")
    n = len(figures)
    if n <= point <= 21:
        out = figures + "0" * (point - n)
    elif 0 < point <= 21:
        out = figures[:point] + "." + figures[point:]
    elif -6 < point <= 0:
        out = "0." + "0" * -point + figures
    else:
        e = point - 1
        out = figures[0] + ("." + figures[1:] if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + out


def _simple(value: Any) -> bool:
    """Whether the standard writer gives the canonical text: no floats, member names and strings without surrogates, names in ASCII."""
    kind = type(value)
    if kind is str:
        return value.isascii()
    if kind is int:
        return -SAFE <= value <= SAFE
    if kind is list:
        return all(map(_simple, value))
    if kind is dict:
        for k, v in value.items():
            if type(k) is not str or not k.isascii() or not (v.isascii() if type(v) is str else _simple(v)):
                return False
        return True
    return value is None or kind is bool


_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))
if (_make := json.encoder.c_make_encoder) is not None:  # made once, not for each call
    _parts = _make(None, _ENCODER.default, json.encoder.encode_basestring, None, ":", ",", True, False, True)

    def _write(value: Any) -> str:
        return "".join(_parts(value, 0))
else:
    _write = _ENCODER.encode


def canonical(value: Any) -> str:
    """RFC 8785 text of a JSON value: members by UTF-16 code units, no space, shortest numbers."""
    return _write(value) if _simple(value) else _canonical(value)


def _canonical(value: Any) -> str:
    if value is None or value is True or value is False:
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        try:
            value.encode("utf-8")
        except UnicodeEncodeError as e:
            raise NotCanonical("a string holds a lone surrogate") from e
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        if abs(value) > SAFE:
            raise NotCanonical("an integer is out of range")
        return str(value)
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_canonical, value)) + "]"
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise NotCanonical("a member name must be a string")
        return "{" + ",".join(f"{_canonical(k)}:{_canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    raise NotCanonical(f"{type(value).__name__} is no JSON value")


def digest(kind: str, value: Any) -> str:
    """sha256 over the domain, the kind and the canonical text."""
    return "sha256:" + hashlib.sha256(f"{PREFIX}:{kind}\x00{canonical(value)}".encode()).hexdigest()


#: A text without surrogates as a JSON string.
quoted = json.encoder.encode_basestring


def text_digest(kind: str, text: str) -> str:
    return "sha256:" + hashlib.sha256(f"{PREFIX}:{kind}\x00{text}".encode()).hexdigest()


def _members(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise NotCanonical("a member is repeated")
    return out


def _refuse(x):
    raise NotCanonical(f"{x} is no number")


def _whole(x):
    if abs(int(x)) > SAFE:
        raise NotCanonical("an integer is out of range")
    return int(x)


_DECODER = json.JSONDecoder(object_pairs_hook=_members, parse_constant=_refuse, parse_int=_whole)


def loads(text: str) -> Any:
    """Strict JSON: no repeated member, no NaN or infinity, integers within 2**53."""
    return _DECODER.decode(text) if type(text) is str and text[:1] != "\ufeff" else json.loads(text, object_pairs_hook=_members, parse_constant=_refuse, parse_int=_whole)
