"""Splitting rules at separators outside brackets, and templates inside rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache


class RuleError(ValueError):
    """A rule that can't be compiled."""


class UnsupportedRule(RuleError):
    """A rule that needs what this engine doesn't offer, such as an unregistered script."""


def trim_rule(rule: str) -> str:
    """Without leading ``@`` and characters up to the space."""
    i = 0
    while i < len(rule) and (rule[i] == "@" or rule[i] < "!"):
        i += 1
    if rule and i == len(rule):
        raise RuleError("nothing is left of the rule")
    return rule[i:]


def group_end(s: str, i: int, code: bool) -> int:
    """Place after the bracket that closes the one at ``i``. Brackets of the other kind nest too, and quotes protect. In code a backslash
    protects everywhere, in rules outside quotes only."""
    pairs = {"[": "]", "(": ")"} if not code else {s[i]: "]" if s[i] == "[" else ")"}
    stack, quote = [], ""
    while i < len(s):
        c = s[i]
        if c == "\\" and (code or not quote):
            i += 2
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in pairs:
            stack.append(pairs[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
        i += 1
    raise RuleError(f"{s}后未平衡")


def split_rule(rule: str, separators: list[str], code: bool = False) -> tuple[list[str], str]:
    """See ``_split``; rules meet page after page, so what they split into is kept."""
    parts, separator = _split(rule, tuple(separators), code)
    return list(parts), separator


@lru_cache(maxsize=4096)
def _split(rule: str, separators: tuple[str, ...], code: bool) -> tuple[list[str], str]:
    """Parts and the separator they were split at. The first separator that is found outside brackets decides; others after it are text."""
    parts: list[str] = []
    chosen, start, i = "", 0, 0
    while i < len(rule):
        sep = next((s for s in ([chosen] if chosen else separators) if rule.startswith(s, i)), None)
        if sep is not None:
            parts.append(rule[start:i])
            chosen = sep
            i += len(sep)
            start = i
        elif rule[i] in "[(":
            i = group_end(rule, i, code)
        else:
            i += 1
    parts.append(rule[start:])
    return parts, chosen


def inner_rule(rule: str, opening: str, fill: Callable[[str], str | None]) -> str:
    """``{$.…}``: each balanced group that starts with ``opening`` is filled; empty if none was."""
    out, at, found = [], 0, False
    while (i := rule.find(opening, at)) >= 0:
        depth, j = 0, i
        while j < len(rule):
            depth += (rule[j] == "{") - (rule[j] == "}")
            j += 1
            if not depth:
                break
        if depth:
            break
        value = fill(rule[i + 1 : j - 1])
        if value:
            out += [rule[at:i], value]
            at, found = j, True
        else:
            out.append(rule[at : i + len(opening)])
            at = i + len(opening)
    return "".join([*out, rule[at:]]) if found else ""


def inner_text(rule: str, opening: str, closing: str, fill: Callable[[str], str | None]) -> str:
    """``{{…}}``: each delimited region is filled, a missing value as ``null``; the rule itself if there is none."""
    out, at = [], 0
    while (i := rule.find(opening, at)) >= 0 and (j := rule.find(closing, i + len(opening))) >= 0:
        value = fill(rule[i + len(opening) : j])
        out += [rule[at:i], "null" if value is None else value]
        at = j + len(closing)
    return "".join([*out, rule[at:]])


def merge(lists: list[list], separator: str) -> list:
    """Lists of a rule's branches as one: interleaved over the first one's length for ``%%``, else one after the other (``||`` leaves one only)."""
    if separator == "%%" and lists:
        return [x[i] for i in range(len(lists[0])) for x in lists if i < len(x)]
    return [v for x in lists for v in x]
