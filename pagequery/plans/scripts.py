"""Scripts that rules may call: exact sources mapped to Python functions. There is no script interpreter; an unknown script is an error when the rule is compiled."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from .splitter import UnsupportedRule

#: Gets the value before the script and the evaluation's context.
Script = Callable[[Any, "object"], Any]


class ScriptRegistry:
    """Scripts by source text, and small built-in expressions of templates."""

    def __init__(self, scripts: dict[str, Script] | None = None):
        self.scripts = dict(scripts or {})

    def register(self, source: str, function: Script) -> None:
        self.scripts[source.strip()] = function

    def find(self, source: str) -> Script:
        s = source.strip()
        if s in self.scripts:
            return self.scripts[s]
        if s in ("key", "page", "baseUrl", "result", "src", "title", "nextChapterUrl"):
            return lambda value, c: value if s == "result" else c.binding(s)
        if m := re.fullmatch(r"page\s*([+\-*])\s*(\d+)", s):
            op, n = m[1], int(m[2])
            return lambda value, c: _arith(int(c.binding("page") or 1), op, n)
        if m := re.fullmatch(r"\(\s*page\s*-\s*1\s*\)\s*\*\s*(\d+)", s):
            n = int(m[1])
            return lambda value, c: (int(c.binding("page") or 1) - 1) * n
        if m := re.fullmatch(r"""(["'])(.*)\1""", s, re.S):
            text = m[2]
            return lambda value, c: text
        if re.fullmatch(r"-?\d+(\.\d+)?", s):
            number = float(s)
            return lambda value, c: number
        raise UnsupportedRule(f"script is not registered: {s[:80]}")


def _arith(a: int, op: str, b: int) -> int:
    return a + b if op == "+" else a - b if op == "-" else a * b
