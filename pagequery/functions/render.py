"""Values as the texts that rules yield: numbers and containers the way Java prints them."""

from __future__ import annotations

import json
import math
from decimal import Decimal
from typing import Any

from ..operators.html_tree import Node


class Literal(float):
    """A JSON number that remembers how it was written."""

    def __new__(cls, source: str):
        self = super().__new__(cls, source)
        self.source = source
        return self


def java_double(v: float) -> str:
    """Double.toString: plain between 1e-3 and 1e7, else with an exponent."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    if v == 0:
        return "-0.0" if math.copysign(1, v) < 0 else "0.0"
    sign, digits, exp = Decimal(repr(v)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    point = exp + len(digits)
    if 1e-3 <= abs(v) < 1e7:
        if point <= 0:
            out = "0." + "0" * -point + text
        else:
            out = text[:point].ljust(point, "0") + "." + (text[point:] or "0")
    else:
        out = f"{text[0]}.{text[1:] or '0'}E{point - 1}"
    return ("-" if sign else "") + out


def json_text(v: Any) -> str:
    """Compact JSON with slashes escaped."""
    return json.dumps(v, ensure_ascii=False, separators=(",", ":")).replace("/", "\\/")


def pretty_json(v: Any) -> str:
    """JSON in lines, two spaces a level; empty containers in one piece."""
    return json.dumps(v, ensure_ascii=False, indent=2)


def java_hash(text: str) -> int:
    """String.hashCode: a signed 32-bit number over UTF-16 units."""
    h = 0
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (31 * h + (units[i] << 8 | units[i + 1])) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def hash_map_order(keys: list[str]) -> list[str]:
    """Keys in the order in which a HashMap that got them one after the other lists them."""
    size = 16
    while len(dict.fromkeys(keys)) > 0.75 * size:
        size *= 2
    spread = lambda k: (h := java_hash(k) & 0xFFFFFFFF) ^ (h >> 16)
    return sorted(dict.fromkeys(keys), key=lambda k: spread(k) & (size - 1))


def java_string(v: Any) -> str:
    """String.valueOf of a value: ``null``, ``[a, b]``, ``{k=v}``; numbers in Java's layout."""
    if type(v) is str:
        return v
    from ..operators.text import outer_html

    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return java_double(v)
    if isinstance(v, Node):
        return outer_html(v) if v.is_element else v.text
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(java_string, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k}={java_string(x)}" for k, x in v.items()) + "}"
    return str(v)


def value_string(v: Any) -> str:
    """A rule's value as text: nodes as HTML lines, JSON arrays as JSON, maps as ``{k=v}``, integral template numbers without a fraction."""
    if type(v) is str:
        return v
    from ..operators.text import outer_html

    if isinstance(v, list) and v and all(isinstance(x, Node) for x in v):
        return "\n".join(outer_html(x) for x in v)
    if isinstance(v, list):
        return java_string(v)
    return "" if v is None else java_string(v)
