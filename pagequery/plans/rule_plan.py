"""Rules as typed plans: segments with a mode, variables to put, template parts and a replacement.

A plan is compiled once on the driver, is immutable and pickles, and is evaluated per row in one fused kernel.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from .splitter import RuleError

JS = re.compile(r"<js>(.*?)</js>|@js:(.*)", re.S | re.I)
WEB_JS = re.compile(r"@webjs:(.{5,})", re.S | re.I)
PUT = re.compile(r"@put:(\{[^}]+?\})", re.I)
TEMPLATE = re.compile(r"@get:\{([^}]+?)\}|\{\{([\w\W]*?)\}\}", re.I)
GROUP = re.compile(r"\$(\d{1,2})")

DOM, XPATH, JSON, REGEX, SCRIPT = "dom", "xpath", "json", "regex", "script"


@dataclass(frozen=True)
class Part:
    """Piece of a template: ``text``, ``get`` a variable, ``rule`` or ``script`` in braces, or ``group`` of a list of texts."""

    kind: str
    value: str


@dataclass(frozen=True)
class Segment:
    mode: str  # "auto" is settled by the content: JSON or DOM
    rule: str
    parts: tuple[Part, ...]  # empty: the rule is no template
    pattern: str
    replacement: str
    first: bool
    puts: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class RulePlan:
    source: str
    segments: tuple[Segment, ...]
    regex_list: bool = False


def _mode(rule: str) -> tuple[str, str]:
    """Mode by prefix, and the rule without it."""
    if rule[:5].upper() == "@CSS:":
        return DOM, rule
    if rule.startswith("@@"):
        return DOM, rule[2:]
    if rule[:7].upper() == "@XPATH:":
        return XPATH, rule[7:]
    if rule[:6].upper() == "@JSON:":
        return JSON, rule[6:]
    if rule.startswith(("$.", "$[")):
        return JSON, rule
    if rule.startswith("/"):
        return "auto-xpath", rule
    return "auto", rule


def _segment(rule: str, regex: bool) -> Segment:
    mode, rule = (REGEX, rule) if regex else _mode(rule)
    puts: list[tuple[str, str]] = []

    def keep(m: re.Match) -> str:
        from ..operators.jsonpath import lenient

        try:
            values = json.loads(m[1])
        except ValueError:
            try:
                values = lenient(m[1])
            except ValueError:
                raise RuleError(f"can't read {m[0]}") from None
        puts.extend((str(k), str(v)) for k, v in values.items())
        return ""

    rule = PUT.sub(keep, rule)
    parts: list[Part] = []
    at = 0
    for m in TEMPLATE.finditer(rule):
        if not parts and mode != SCRIPT and not regex and (at == 0 and m.start() == 0 or "##" not in rule[: m.start()]):
            mode = REGEX
        if m.start() > at:
            parts += _groups(rule[at : m.start()])
        if m[1] is not None:
            parts.append(Part("get", m[1]))
        else:
            body = m[2]
            parts.append(Part("rule" if body.startswith(("@", "$.", "$[", "//")) else "script", body))
        at = m.end()
    tail = _groups(rule[at:]) if rule[at:] else []
    templated = bool(parts) or any(p.kind == "group" for p in tail)
    if any(p.kind == "group" for p in tail) and mode not in (SCRIPT, REGEX):
        mode = REGEX
    parts = [*parts, *tail] if templated else []
    if templated:
        return Segment(mode, "", tuple(parts), "", "", False, tuple(puts))
    body, pattern, replacement, first = cut_replacement(rule)
    return Segment(mode, body, (), pattern, replacement, first, tuple(puts))


def _groups(text: str) -> list[Part]:
    """``$N`` before the first ``##`` refers to an item of the value before."""
    head, sep, tail = text.partition("##")
    out, at = [], 0
    for m in GROUP.finditer(head):
        if m.start() > at:
            out.append(Part("text", head[at : m.start()]))
        out.append(Part("group", m[1]))
        at = m.end()
    rest = head[at:] + sep + tail
    return [*out, Part("text", rest)] if rest else out


def cut_replacement(rule: str) -> tuple[str, str, str, bool]:
    """``rule##pattern##replacement##``: a fourth part asks for the first match alone."""
    bits = rule.split("##")
    return bits[0].strip(), bits[1] if len(bits) > 1 else "", bits[2] if len(bits) > 2 else "", len(bits) > 3


def compile_rule(source: str, listing: bool = False) -> RulePlan:
    """Plan of a rule. In a list rule a leading colon makes it a chain of regular expressions."""
    text = source or ""
    regex_list = listing and text.startswith(":")
    if regex_list:
        return RulePlan(source, (Segment(REGEX, text[1:], (), "", "", False, ()),), True)
    segments: list[Segment] = []
    at = 0
    marks = sorted([*((m.start(), m.end(), m[1] if m[1] is not None else m[2]) for m in JS.finditer(text))])
    for a, b, code in marks:
        if before := text[at:a].strip():
            segments.append(_segment(before, False))
        segments.append(Segment(SCRIPT, code, (), "", "", False, ()))
        at = b
    if tail := text[at:].strip():
        if WEB_JS.search(tail):
            from .splitter import UnsupportedRule

            raise UnsupportedRule("@webjs needs a browser")
        segments.append(_segment(tail, False))
    return RulePlan(source, tuple(segments))
