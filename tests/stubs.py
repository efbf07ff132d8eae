"""Scripts for tests."""

from __future__ import annotations

from typing import Any

from pagequery.plans.scripts import Script, ScriptRegistry


class StubScripts(ScriptRegistry):
    """Deterministic commands in place of scripts, for tests: ``#echo:``, ``#num:``, ``#bool:``, ``#list:``, ``#get:``, ``#put:``, ``#null``, ``#result``, ``#err`` and bindings. Other text is returned as it is."""

    def find(self, source: str) -> Script:
        s = source.strip()
        name, _, arg = s.partition(":")
        if s == "#null":
            return lambda value, c: None
        if s == "#result":
            return lambda value, c: None if value is None else _as_text(value)
        if s in ("#baseUrl", "#src", "#title", "#nextChapterUrl", "#key", "#page"):
            return lambda value, c: c.binding(s[1:])
        if s == "#fromBookInfo":
            return lambda value, c: "true" if c.binding("fromBookInfo") else "false"
        if s == "#err":
            return _fail
        if name == "#num":
            return lambda value, c: float(arg)
        if name == "#bool":
            return lambda value, c: arg.lower() == "true"
        if name == "#echo":
            return lambda value, c: arg
        if name == "#list":
            return lambda value, c: arg.split("|")
        if name == "#get":
            return lambda value, c: c.get(arg)
        if name == "#put":
            key, eq, text = arg.partition("=")
            return (lambda value, c: (c.put(key, text), text)[1]) if eq else _fail
        return self.scripts.get(s, lambda value, c: source)


def _as_text(value: Any) -> str:
    from pagequery.functions.render import value_string

    return value_string(value)


def _fail(value: Any, c: Any) -> Any:
    raise RuntimeError("#err")
