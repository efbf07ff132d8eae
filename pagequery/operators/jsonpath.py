"""JSONPath over parsed JSON, and the rule language on top of it.

Paths are definite (one value or PathMissing) or indefinite (a list). Supported: keys in both notations, several keys, indexes from either end,
several indexes, slices, wildcards, deep scans and filters with comparisons, existence, ``&&``, ``||``, ``!`` and brackets.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache
from typing import Any

from ..functions.render import java_double, java_string, json_text
from ..plans.splitter import RuleError, inner_rule, merge, split_rule


class PathError(ValueError):
    """A path that can't be parsed."""


class PathMissing(LookupError):
    """A definite path that leads nowhere."""


# --- JSON texts

_LENIENT = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|\#[^\n]*""", re.S)
_BARE = re.compile(r"[^\s,:{}\[\]\"'=;]+")


def loads(text: str) -> Any:
    """Strict JSON."""
    return json.loads(text)


def lenient(text: str) -> Any:
    """JSON with single quotes, bare words, comments, trailing commas and ``=`` or ``;`` as separators. Raises ValueError."""
    value, at = _value(text, _gap(text, 0))
    if _gap(text, at) != len(text):
        raise ValueError("text after the value")
    return value


def _gap(s: str, i: int) -> int:
    while m := _LENIENT.match(s, i):
        i = m.end()
    return i


def _quoted(s: str, i: int) -> tuple[str, int]:
    q, out, i = s[i], [], i + 1
    while i < len(s):
        c = s[i]
        if c == q:
            return "".join(out), i + 1
        if c == "\\" and i + 1 < len(s):
            e = s[i + 1]
            if e == "u" and re.fullmatch("[0-9a-fA-F]{4}", s[i + 2 : i + 6]):
                out.append(chr(int(s[i + 2 : i + 6], 16)))
                i += 6
                continue
            out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(e, e))
            i += 2
            continue
        out.append(c)
        i += 1
    raise ValueError("a string isn't closed")


def _value(s: str, i: int) -> tuple[Any, int]:
    if i >= len(s):
        raise ValueError("a value is missing")
    c = s[i]
    if c in "\"'":
        return _quoted(s, i)
    if c == "{":
        out: dict = {}
        i = _gap(s, i + 1)
        while i < len(s) and s[i] != "}":
            if s[i] in ",;":
                i = _gap(s, i + 1)
                continue
            if s[i] in "\"'":
                key, i = _quoted(s, i)
            elif m := _BARE.match(s, i):
                key, i = m[0], m.end()
            else:
                raise ValueError("a key is missing")
            i = _gap(s, i)
            if i >= len(s) or s[i] not in ":=":
                raise ValueError("a colon is missing")
            i = _gap(s, i + 1 + s.startswith("=>", i))
            out[key], i = _value(s, i)
            i = _gap(s, i)
            if i < len(s) and s[i] not in ",;}":
                raise ValueError("a comma is missing")
        if i >= len(s):
            raise ValueError("an object isn't closed")
        return out, i + 1
    if c == "[":
        items: list = []
        i = _gap(s, i + 1)
        while i < len(s) and s[i] != "]":
            if s[i] in ",;":
                items.append(None)
                i = _gap(s, i + 1)
                continue
            v, i = _value(s, i)
            items.append(v)
            i = _gap(s, i)
            if i < len(s) and s[i] in ",;":
                i = _gap(s, i + 1)
            elif i < len(s) and s[i] != "]":
                raise ValueError("a comma is missing")
        if i >= len(s):
            raise ValueError("an array isn't closed")
        return items, i + 1
    m = _BARE.match(s, i)
    if not m:
        raise ValueError(f"can't read {s[i]!r}")
    word = m[0]
    try:
        value = json.loads(word)
    except ValueError:
        value = {"null": None, "true": True, "false": False}.get(word.lower(), word)
    return value, m.end()


def document(text: str) -> Any:
    """The value that a rule reads: JSON, lenient JSON, or the text itself as a string. Empty text and ``null`` are errors."""
    if not text.strip() or text.strip() == "null":
        raise ValueError("no JSON")
    for read in (loads, lenient):
        try:
            return read(text)
        except ValueError:
            continue
    return text


# --- paths

Step = tuple[str, Any]


class _PathParser:
    def __init__(self, source: str):
        self.s, self.i = source, 0

    def steps(self, stop: str = "") -> tuple[list[Step], bool]:
        out: list[Step] = []
        definite = True
        while self.i < len(self.s) and not (stop and (self.s[self.i] in stop or self.s[self.i].isspace())):
            if self.s.startswith("..", self.i):
                self.i += 2
                definite = False
                out.append(("scan", None))
                if self.s[self.i : self.i + 1] != "[":
                    out.append(self.dotted(stop))
                continue
            c = self.s[self.i]
            if c == ".":
                self.i += 1
                if self.s[self.i : self.i + 1] == "[":
                    continue
                out.append(self.dotted(stop))
            elif c == "[":
                out.append(self.bracket())
            else:
                raise PathError(f"unexpected {c!r} in {self.s!r}")
            definite &= out[-1][0] in ("key", "index") or out[-1][0] == "keys"
        for a, b in zip(out, out[1:], strict=False):
            definite &= not (a[0] == "keys" and b)
        return out, definite

    def dotted(self, stop: str) -> Step:
        end = self.i
        while end < len(self.s) and self.s[end] not in ".[" and not (stop and (self.s[end] in stop or self.s[end].isspace())):
            end += 1
        name = self.s[self.i : end]
        if not name:
            raise PathError(f"a name is missing in {self.s!r}")
        self.i = end
        return ("all", None) if name == "*" else ("key", name)

    def bracket(self) -> Step:
        depth, quote, j = 0, "", self.i
        while j < len(self.s):
            c = self.s[j]
            if c == "\\":
                j += 1
            elif quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "[(":
                depth += 1
            elif c in "])":
                depth -= 1
                if not depth:
                    break
            j += 1
        else:
            raise PathError(f"[ is not closed in {self.s!r}")
        body = self.s[self.i + 1 : j].strip()
        self.i = j + 1
        if body == "*":
            return "all", None
        if body[:1] in "\"'":
            keys = [re.sub(r"\\(.)", r"\1", a or b) for a, b in re.findall(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\"""", body)]
            return ("key", keys[0]) if len(keys) == 1 else ("keys", keys)
        if body.startswith("?"):
            inner = body[1:].strip()
            if not (inner.startswith("(") and inner.endswith(")")):
                raise PathError(f"can't read the filter {body!r}")
            return "filter", _Filter(inner[1:-1]).whole()
        if re.fullmatch(r"-?\d+", body):
            return "index", int(body)
        if re.fullmatch(r"-?\d+(\s*,\s*-?\d+)+", body):
            return "indexes", [int(x) for x in body.split(",")]
        if m := re.fullmatch(r"(-?\d+)?\s*:\s*(-?\d+)?", body):
            return "slice", (int(m[1]) if m[1] else None, int(m[2]) if m[2] else None)
        raise PathError(f"can't read [{body}]")


_MISSING = object()


class _Filter:
    """Predicates of ``[?(…)]``."""

    def __init__(self, source: str):
        self.s, self.i = source, 0

    def whole(self) -> Callable[[Any, Any], bool]:
        test = self.either()
        self.space()
        if self.i < len(self.s):
            raise PathError(f"can't read the filter {self.s!r}")
        return test

    def space(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def take(self, word: str) -> bool:
        self.space()
        if self.s.startswith(word, self.i):
            self.i += len(word)
            return True
        return False

    def either(self):
        tests = [self.both()]
        while self.take("||"):
            tests.append(self.both())
        return tests[0] if len(tests) == 1 else lambda x, root: any(t(x, root) for t in tests)

    def both(self):
        tests = [self.one()]
        while self.take("&&"):
            tests.append(self.one())
        return tests[0] if len(tests) == 1 else lambda x, root: all(t(x, root) for t in tests)

    def one(self):
        self.space()
        if self.s.startswith("!", self.i) and not self.s.startswith("!=", self.i):
            self.i += 1
            test = self.one()
            return lambda x, root: not test(x, root)
        if self.take("("):
            test = self.either()
            if not self.take(")"):
                raise PathError("a bracket isn't closed")
            return test
        left, is_path = self.operand()
        op = next((o for o in ("==", "!=", "<=", ">=", "<", ">") if self.take(o)), None)
        if op is None:
            if not is_path:
                raise PathError("a filter needs a comparison")
            return lambda x, root: left(x, root) is not _MISSING
        right, _ = self.operand()
        return lambda x, root: _compare(left(x, root), op, right(x, root))

    def operand(self):
        self.space()
        c = self.s[self.i : self.i + 1]
        if c in ("@", "$") and c:
            p = _PathParser(self.s)
            p.i = self.i + 1
            steps, definite = p.steps("=!<>&|)")
            self.i = p.i
            return (lambda x, root: _lookup(steps, definite, x if c == "@" else root, root)), True
        if c in ("'", '"') and c:
            value, self.i = _quoted(self.s, self.i)
            return (lambda x, root: value), False
        m = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null").match(self.s, self.i)
        if not m:
            raise PathError(f"can't read an operand in {self.s!r}")
        self.i = m.end()
        value = json.loads(m[0])
        return (lambda x, root: value), False


def _lookup(steps: list[Step], definite: bool, start: Any, root: Any) -> Any:
    try:
        found = _walk(steps, [start], root, definite)
    except PathMissing:
        return _MISSING
    return (found[0] if found else _MISSING) if definite else (found or _MISSING)


def _compare(a: Any, op: str, b: Any) -> bool:
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if a is _MISSING or b is _MISSING:
        return op == "!=" and a is not b
    if number(a) and number(b) or isinstance(a, str) and isinstance(b, str):
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    same = type(a) is type(b) and a == b
    return same if op == "==" else not same if op == "!=" else False


def _all(x: Any) -> list:
    return list(x.values()) if isinstance(x, dict) else list(x) if isinstance(x, list) else []


def _deep(x: Any) -> list:
    out = [x]
    for c in _all(x):
        if isinstance(c, (dict, list)):
            out += _deep(c)
    return out


def _one(step: Step, x: Any, root: Any, strict: bool, last: bool) -> list:
    kind, arg = step
    if kind == "key":
        if isinstance(x, dict) and arg in x:
            return [x[arg]]
        if strict:
            raise PathMissing(arg)
        return []
    if kind == "keys":
        if not isinstance(x, dict):
            if strict:
                raise PathMissing(arg)
            return []
        return [{k: x[k] for k in arg if k in x}] if last else [x[k] for k in arg if k in x]
    if kind == "index":
        if isinstance(x, list) and -len(x) <= arg < len(x):
            return [x[arg]]
        if strict:
            raise PathMissing(arg)
        return []
    if kind == "indexes":
        return [x[k] for k in arg if -len(x) <= k < len(x)] if isinstance(x, list) else []
    if kind == "slice":
        if not isinstance(x, list):
            return []
        a, b = arg
        n = len(x)
        a = 0 if a is None else a + n if a < 0 else a
        b = n if b is None else b + n if b < 0 else min(b, n)
        return x[max(a, 0) : max(b, 0)]
    if kind == "all":
        return _all(x)
    if kind == "scan":
        return _deep(x)
    return [v for v in (x if isinstance(x, list) else [x] if isinstance(x, dict) else []) if arg(v, root)]


def _walk(steps: list[Step], start: list, root: Any, definite: bool) -> list:
    found = start
    for k, step in enumerate(steps):
        found = [v for x in found for v in _one(step, x, root, definite, k + 1 == len(steps))]
    return found


@lru_cache(maxsize=1024)
def compile_path(path: str) -> tuple[list[Step], bool]:
    """Steps, and whether the path is definite. A path without ``$`` or ``@`` gets ``$.`` put before it, blanks and all."""
    if path[:1] not in ("$", "@"):
        path = "$." + path
    p = _PathParser(path)
    p.i = 1
    return p.steps()


def read(doc: Any, path: str) -> Any:
    """Value of a definite path (PathMissing if there is none) or list of an indefinite one."""
    steps, definite = compile_path(path)
    found = _walk(steps, [doc], doc, definite)
    return found[0] if definite else found


# --- the rule language


def render(v: Any) -> str:
    """A JSON value as text: strings as they are, arrays as JSON, objects as ``{k=v}``."""
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return json_text(v)
    if isinstance(v, float):
        return java_double(v)
    return java_string(v)


def _filled(doc: Any, rule: str) -> str:
    return inner_rule(rule, "{$.", lambda r: string(doc, r))


def string(doc: Any, rule: str) -> str:
    """Texts of a rule joined by line breaks; whatever fails yields an empty text."""
    if not rule.strip():
        return ""
    try:
        branches, sep = split_rule(rule, ["&&", "||"], code=True)
    except RuleError:
        return ""
    if len(branches) == 1:
        if filled := _filled(doc, rule):
            return filled
        try:
            v = read(doc, rule)
        except (PathError, PathMissing, TypeError):
            return ""
        if isinstance(v, list):
            return "\n".join(render(x) for x in v)
        return "" if v is None else render(v)
    out = []
    for b in branches:
        if part := string(doc, b):
            out.append(part)
            if sep == "||":
                break
    return "\n".join(out)


def string_list(doc: Any, rule: str) -> list[str]:
    if not rule.strip():
        return []
    branches, sep = split_rule(rule, ["&&", "||", "%%"], code=True)
    if len(branches) == 1:
        if filled := _filled(doc, rule):
            return [filled]
        try:
            v = read(doc, rule)
        except (PathError, PathMissing, TypeError):
            return []
        return [render(x) for x in v] if isinstance(v, list) else [] if v is None else [render(v)]
    lists = []
    for b in branches:
        part = string_list(doc, b)
        if part:
            lists.append(part)
            if sep == "||":
                break
    return merge(lists, sep)


def items(doc: Any, rule: str) -> list:
    """Items of a list rule; a definite value that isn't an array is no list."""
    if not rule.strip():
        return []
    branches, sep = split_rule(rule, ["&&", "||", "%%"], code=True)
    if len(branches) == 1:
        try:
            v = read(doc, rule)
        except (PathError, PathMissing, TypeError):
            return []
        return v if isinstance(v, list) else []
    lists = []
    for b in branches:
        part = items(doc, b)
        if part:
            lists.append(part)
            if sep == "||":
                break
    return merge(lists, sep)
