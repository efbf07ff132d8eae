"""The regular-expression dialect of java.util.regex on top of the ``regex`` module, and its replacement strings."""

from __future__ import annotations

import re as _re
from functools import lru_cache

import regex

#: Java's classes are ASCII unless asked otherwise; these stand for them inside and outside brackets.
_CLASSES = {"d": "0-9", "w": "a-zA-Z0-9_", "s": " \\t\\n\\x0B\\f\\r", "h": " \\t\\xA0\\u1680\\u180e\\u2000-\\u200a\\u202f\\u205f\\u3000"}
_NEGATED = {"D": "d", "W": "w", "S": "s", "H": "h"}


def translate(pattern: str) -> str:
    """Pattern of the ``regex`` module that means the same."""
    out, i, n, depth = [], 0, len(pattern), 0
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            e = pattern[i + 1]
            i += 2
            if e in _CLASSES:
                out.append(_CLASSES[e] if depth else f"[{_CLASSES[e]}]")
            elif e in _NEGATED:
                out.append(f"[^{_CLASSES[_NEGATED[e]]}]")
            elif e == "z":
                out.append(r"\Z")
            elif e == "Z":
                out.append(r"(?=\n?\Z)")
            elif e == "Q":
                end = pattern.find("\\E", i)
                end = n if end < 0 else end
                out.append(regex.escape(pattern[i:end], special_only=False))
                i = end + 2
            elif e == "u" and _re.match(r"[0-9a-fA-F]{4}", pattern[i:]):
                out.append("\\u" + pattern[i : i + 4])
                i += 4
            elif e == "e":
                out.append("\\x1b")
            elif e in "pP" and pattern[i : i + 3] == "{Is" :
                out.append(f"\\{e}{{" + pattern[i + 3 :].split("}", 1)[0] + "}")
                i = pattern.index("}", i) + 1
            else:
                out.append("\\" + e)
            continue
        if c == "[":
            depth += 1
            out.append("[")
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "]" and depth:
            depth -= 1
            out.append("]")
        elif c == "$" and not depth:
            out.append(r"(?=\n?\Z)")
        else:
            out.append(c)
        i += 1
    return "".join(out)


@lru_cache(maxsize=1024)
def compile_java(pattern: str) -> regex.Pattern:
    """Raises ``regex.error`` where the pattern isn't one."""
    multiline = _re.search(r"\(\?[a-z]*m[a-z]*[):]", pattern) is not None
    return regex.compile(translate(pattern) if not multiline else translate(pattern).replace(r"(?=\n?\Z)", "$"), regex.V1)


#: Seconds that one search may take; a pattern that backtracks without end raises TimeoutError, which fails its rule and not the task.
LIMIT = 4.0


class ReplacementError(ValueError):
    """A replacement that refers to what the pattern doesn't have."""


def expand(match: regex.Match, replacement: str) -> str:
    """``$n`` takes as many digits as make a group that exists; ``${name}`` a named group; a backslash protects the next character."""
    out, i, n = [], 0, len(replacement)
    groups = match.re.groups
    while i < n:
        c = replacement[i]
        if c == "\\":
            if i + 1 == n:
                raise ReplacementError("a backslash ends the replacement")
            out.append(replacement[i + 1])
            i += 2
        elif c == "$":
            i += 1
            if i < n and replacement[i] == "{":
                end = replacement.find("}", i)
                name = replacement[i + 1 : end]
                if end < 0 or name not in match.re.groupindex:
                    raise ReplacementError(f"no group {name!r}")
                out.append(match[name] or "")
                i = end + 1
                continue
            if i == n or not replacement[i].isascii() or not replacement[i].isdigit():
                raise ReplacementError("$ without a group")
            k = int(replacement[i])
            if k > groups:
                raise ReplacementError(f"no group {k}")
            i += 1
            while i < n and replacement[i].isascii() and replacement[i].isdigit() and k * 10 + int(replacement[i]) <= groups:
                k = k * 10 + int(replacement[i])
                i += 1
            out.append(match[k] or "")
        else:
            out.append(c)
            i += 1
    return "".join(out)


def replace_all(text: str, pattern: str, replacement: str) -> str:
    return compile_java(pattern).sub(lambda m: expand(m, replacement), text, timeout=LIMIT)


def replace(text: str, pattern: str, replacement: str, first: bool) -> str:
    """Never fails. All matches: where pattern or replacement is invalid, the pattern is taken as a plain string. First match: only the match,
    replaced inside, is returned; nothing found gives an empty string, an invalid pattern the replacement."""
    if first:
        try:
            m = compile_java(pattern).search(text, timeout=LIMIT)
            return "" if m is None else replace_all(m[0], pattern, replacement)
        except (regex.error, ReplacementError):
            return replacement
    try:
        return replace_all(text, pattern, replacement)
    except (regex.error, ReplacementError):
        return text.replace(pattern, replacement)


def find_all(text: str, pattern: str, most: int = 50) -> list[list[str | None]]:
    """Groups of the matches, whole match first; a group that took no part is None."""
    out = []
    for m in compile_java(pattern).finditer(text, timeout=LIMIT):
        out.append([m[k] for k in range(m.re.groups + 1)])
        if len(out) == most:
            break
    return out
