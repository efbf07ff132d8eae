"""Evaluation of compiled rules over one content: parse once, run every rule on the same tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions import java_regex
from ..functions.format import unescape
from ..functions.render import java_string, value_string
from ..functions.url import absolute, is_json
from ..plans.rule_plan import DOM, JSON, REGEX, SCRIPT, XPATH, RulePlan, Segment, compile_rule, cut_replacement
from ..plans.scripts import ScriptRegistry
from . import dom, jsonpath, xpath
from .html_tree import Node, parse


LAYERS = ("chapter", "book", "run", "source")


@dataclass
class Context:
    """Variables by layer, addresses and bindings that rules see."""

    base_url: str = ""
    redirect_url: str = ""
    layers: dict[str, dict[str, str]] = field(default_factory=lambda: {"run": {}})
    bindings: dict[str, Any] = field(default_factory=dict)
    scripts: ScriptRegistry = field(default_factory=ScriptRegistry)

    def put(self, key: str, value: str) -> None:
        """Into the first layer that there is."""
        for name in LAYERS:
            if name in self.layers:
                self.layers[name][key] = value
                return

    def get(self, key: str) -> str:
        """From the first layer with something for it."""
        if key in ("bookName", "title") and self.bindings.get(key):
            return str(self.bindings[key])
        return next((v for name in LAYERS if (v := self.layers.get(name, {}).get(key))), "")

    def binding(self, name: str) -> Any:
        return self.base_url if name == "baseUrl" else self.bindings.get(name)


class MapContent(dict):
    """A map as content: a rule is the key of its value and nothing else."""


class Content:
    """A document with its parsed forms, each made when first needed."""

    def __init__(self, value: Any, shared: bool = False):
        self.value = value
        self.shared = shared  # no rule changes the tree, so that one serves all kinds of rules
        self._tree: Node | None = None
        self._xtree: Node | None = None
        self._json: Any = None
        self.is_json = isinstance(value, (dict, list)) or isinstance(value, str) and is_json(value)

    def tree(self) -> Node:
        if self._tree is None:
            self._tree = self.value if isinstance(self.value, Node) else parse(value_string(self.value))
        return self._tree

    def xtree(self) -> Node:
        if self._xtree is None:
            if isinstance(self.value, Node):
                self._xtree = self.value
            else:
                text = value_string(self.value)
                self._xtree = self.tree() if self.shared and xpath.is_whole(text) else xpath.document(text)
        return self._xtree

    def json(self) -> Any:
        if self._json is None:
            self._json = self.value if isinstance(self.value, (dict, list)) else jsonpath.document(value_string(self.value))
        return self._json


def _settled(mode: str, content: Content) -> str:
    if mode == "auto":
        return JSON if content.is_json else DOM
    if mode == "auto-xpath":
        return JSON if content.is_json else XPATH
    return mode


class Evaluator:
    """Runs rules on a content. Rules run in the order in which they are asked for: actions may change the tree."""

    def __init__(self, content: Any, context: Context | None = None):
        self.context = context or Context()
        self.set(content)

    def set(self, content: Any) -> None:
        self.content = content if isinstance(content, Content) else Content(content)

    # --- pieces
    def _puts(self, segment: Segment) -> None:
        for key, rule in segment.puts:
            self.context.put(key, self.string(rule))

    def _filled(self, segment: Segment, value: Any) -> tuple[str, str, str, bool]:
        """Rule and replacement of a segment, its template filled."""
        if not segment.parts:
            return segment.rule, segment.pattern, segment.replacement, segment.first
        out = []
        for p in segment.parts:
            if p.kind == "text":
                out.append(p.value)
            elif p.kind == "get":
                out.append(self.context.get(p.value))
            elif p.kind == "rule":
                out.append(self.string(p.value))
            elif p.kind == "script":
                v = self.context.scripts.find(p.value)(value, self.context)
                if v is not None:
                    out.append(str(int(v)) if isinstance(v, float) and v == int(v) else java_string(v))
            elif isinstance(value, (list, tuple)):
                k = int(p.value)
                if k < len(value):
                    out.append(f"${p.value}" if value[k] is None else java_string(value[k]))
            else:
                out.append(f"${p.value}")
        return cut_replacement("".join(out))

    def _of(self, value: Any) -> Content:
        return self.content if value is self.content.value else Content(value)

    def _run(self, segment: Segment, value: Any, many: bool) -> Any:
        """Value of a segment after the one before it."""
        if segment.mode == SCRIPT:
            return _plain(self.context.scripts.find(segment.rule)(value, self.context))
        self._puts(segment)
        if isinstance(value, MapContent):  # what a script gave: the rule is a key
            return value.get(segment.rule)
        rule, pattern, replacement, first = self._filled(segment, value)
        source = self._of(value)
        mode = _settled(segment.mode, source)
        if mode == REGEX:
            out: Any = rule if rule or segment.parts else value
        elif not rule:
            out = value
        elif mode == XPATH:
            out = xpath.string_list(source.xtree(), rule) if many else xpath.string(source.xtree(), rule)
        elif mode == JSON:
            try:
                doc = source.json()
            except ValueError:
                doc = None
            out = ([] if many else "") if doc is None else jsonpath.string_list(doc, rule) if many else jsonpath.string(doc, rule)
        else:
            out = dom.string_list(source.tree(), rule) if many else dom.string(source.tree(), rule)
        if pattern and out is not None:
            if isinstance(out, list):
                out = [java_regex.replace(value_string(x), pattern, replacement, first) for x in out]
            else:
                out = java_regex.replace(value_string(out), pattern, replacement, first)
        return out

    # --- results
    def value(self, plan: RulePlan, many: bool = False) -> Any:
        content = self.content.value
        if isinstance(content, MapContent):
            return content.get(plan.segments[0].rule) if plan.segments else None
        out: Any = content
        for s in plan.segments:
            if out is None:
                break
            out = self._run(s, out, many)
        return out if plan.segments else None

    def string(self, rule: str | RulePlan, is_url: bool = False, entities: bool = True) -> str:
        plan = rule if isinstance(rule, RulePlan) else compile_rule(rule)
        out = self.value(plan)
        text = "" if out is None else value_string(out)
        if entities and "&" in text:
            text = unescape(text)
        if is_url:
            return absolute(self.context.redirect_url or self.context.base_url, text) if text.strip() else self.context.base_url
        return text

    def string_list(self, rule: str | RulePlan, is_url: bool = False) -> list[str]:
        plan = rule if isinstance(rule, RulePlan) else compile_rule(rule)
        out = self.value(plan, many=True)
        if out is None or out == "":
            return []
        items = out.split("\n") if isinstance(out, str) else [value_string(x) for x in out] if isinstance(out, list) else [value_string(out)]
        if is_url:
            base = self.context.redirect_url or self.context.base_url
            items = list(dict.fromkeys(u for u in (absolute(base, x) for x in items) if u))
        return items

    def element(self, rule: str | RulePlan) -> Any:
        """The value of a rule as a content for others: the first nodes or items, or a text where something was replaced."""
        plan = rule if isinstance(rule, RulePlan) else compile_rule(rule)
        value: Any = self.content.value
        for s in plan.segments:
            if value is None:
                return None
            if s.mode == SCRIPT:
                value = _plain(self.context.scripts.find(s.rule)(value, self.context))
                continue
            self._puts(s)
            text, pattern, replacement, first = self._filled(s, value)
            source = self._of(value)
            mode = _settled(s.mode, source)
            if mode == JSON:
                try:
                    value = jsonpath.read(source.json(), text)
                except (ValueError, LookupError):
                    value = None
            elif mode == XPATH:
                value = xpath.elements(source.xtree(), text)
            elif mode == REGEX:
                rows = regex_rows(value_string(value), text.split("&&"))
                value = rows[0] if rows else None
            else:
                value = dom.elements(source.tree(), text)
            if pattern:
                value = java_regex.replace("null" if value is None else value_string(value), pattern, replacement, first)
        return value

    def items(self, rule: str | RulePlan) -> list[Any]:
        """Items of a list rule, each a content for the rules of its fields."""
        plan = rule if isinstance(rule, RulePlan) else compile_rule(rule, listing=True)
        value: Any = self.content.value
        for s in plan.segments:
            if value is None:
                return []
            if s.mode == SCRIPT:
                value = _plain(self.context.scripts.find(s.rule)(value, self.context))
                continue
            self._puts(s)
            source = self._of(value)
            if plan.regex_list:
                value = regex_rows(value_string(value), s.rule.split("&&"))
                continue
            mode = _settled(s.mode, source)
            rule = s.rule or "".join(p.value for p in s.parts)
            if mode == JSON:
                try:
                    value = jsonpath.items(source.json(), rule)
                except ValueError:
                    value = []
            elif mode == XPATH:
                value = xpath.elements(source.xtree(), rule)
            elif mode == REGEX:
                value = regex_rows(value_string(value), rule.split("&&"))
            else:
                value = dom.elements(source.tree(), rule)
            if s.pattern:
                value = java_regex.replace(value_string(value), s.pattern, s.replacement, s.first)
        return list(value) if isinstance(value, (list, tuple)) else []


def _plain(value: Any) -> Any:
    """What a script gave, as rules read it: elements as nodes, maps by key."""
    from .elements import Elements

    if isinstance(value, Elements):
        return value.to_array()
    return MapContent(value) if isinstance(value, dict) else value


def regex_rows(text: str, patterns: list[str]) -> list[list[str]]:
    """Whole matches of each pattern, joined, are the text of the next; the last one's matches are rows of groups, missing ones empty."""
    for p in patterns[:-1]:
        text = "".join(m[0] for m in java_regex.compile_java(p).finditer(text, timeout=java_regex.LIMIT))
        if not text:
            return []
    return [[m[k] or "" for k in range(m.re.groups + 1)] for m in java_regex.compile_java(patterns[-1]).finditer(text, timeout=java_regex.LIMIT)]


