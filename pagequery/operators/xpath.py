"""An XPath dialect over HTML trees.

Beside the core it has the node tests ``text() allText() html() outerHtml() num()``, the operators ``^= $= *= ~= !~``, the axes
``following-sibling-one`` and ``preceding-sibling-one`` and indexes that count siblings with the same tag inside the context, from the end if negative.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from ..functions.java_regex import LIMIT, compile_java
from ..functions.render import java_double
from ..plans.splitter import merge, split_rule
from .html_tree import Node, index_of, parse
from .text import fold, inner_html, outer_html, own_text, text, trim


class XPathError(ValueError):
    """An expression that can't be parsed or evaluated."""


_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+(?:\.\d+)?|\.\d+)|(?P<str>"[^"]*"|'[^']*')|(?P<op>//|::|\.\.|!=|<=|>=|\^=|\$=|\*=|~=|!~|[/.@()\[\],|=<>+*\-$])|(?P<name>[^\W\d][\w.\-]*(?::(?!:)[^\W\d][\w.\-]*)?))"""
)
AXES = frozenset(
    "self child parent ancestor ancestor-or-self descendant descendant-or-self following preceding following-sibling preceding-sibling"
    " following-sibling-one preceding-sibling-one attribute".split()
)
_TESTS = frozenset("text allText html outerHtml node num".split())


@dataclass(frozen=True)
class Step:
    axis: str
    test: str  # a name, `*`, or a node test with brackets
    deep: bool
    predicates: tuple


@dataclass(frozen=True)
class Path:
    absolute: bool
    steps: tuple[Step, ...]
    start: Any = None


class _Parser:
    def __init__(self, source: str):
        self.t: list[tuple[str, str]] = []
        i = 0
        while i < len(source) and source[i:].strip():
            m = _TOKEN.match(source, i)
            if not m:
                raise XPathError(f"can't read {source[i:]!r}")
            self.t.append((m.lastgroup, m[m.lastgroup]))
            i = m.end()
        self.i = 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k][0] if self.i + k < len(self.t) else ""

    def take(self, *values: str) -> str | None:
        if self.kind() in ("op", "name") and self.peek() in values:
            self.i += 1
            return self.t[self.i - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise XPathError(f"{value} is missing before {self.peek()!r}")

    def binary(self, level: int = 0):
        levels = (("or",), ("and",), ("=", "!="), ("<", ">", "<=", ">=", "^=", "$=", "*=", "~=", "!~"), ("+", "-"), ("*", "div", "mod"))
        if level == len(levels):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*levels[level]):
            left = ("op", op, left, self.binary(level + 1))
        return left

    def unary(self):
        if self.take("-"):
            return ("neg", self.unary())
        left = self.path()
        while self.take("|"):
            left = ("union", left, self.path())
        return left

    def path(self):
        kind, value = self.kind(), self.peek()
        start = None
        if kind == "num":
            self.i += 1
            return ("value", float(value) if "." in value else int(value))
        if kind == "str":
            self.i += 1
            return ("value", value[1:-1])
        if value == "$":
            raise XPathError("variables aren't supported")
        if value == "(":
            self.i += 1
            start = self.binary()
            self.need(")")
        elif kind == "name" and self.peek(1) == "(" and value not in _TESTS:
            self.i += 2
            args = []
            while not self.take(")"):
                args.append(self.binary())
                if not self.take(",") and self.peek() != ")":
                    raise XPathError("a bracket isn't closed")
            start = ("call", value, tuple(args))
        if start is not None:
            predicates = self.predicates()
            if predicates:
                start = ("filter", start, predicates)
            if self.peek() not in ("/", "//"):
                return start
        steps: list[Step] = []
        absolute = start is None and self.peek() in ("/", "//")
        deep = False
        if start is not None or absolute:
            deep = self.peek() == "//"
            self.i += 1
        while True:
            steps.append(self.step(deep))
            if self.peek() not in ("/", "//"):
                break
            deep = self.peek() == "//"
            self.i += 1
        return ("path", Path(absolute, tuple(steps), start))

    def step(self, deep: bool) -> Step:
        if self.take(".."):
            return Step("parent", "*", deep, self.predicates())
        if self.take("."):
            return Step("self", "node()", deep, self.predicates())
        axis = "child"
        if self.take("@"):
            axis = "attribute"
        elif self.kind() == "name" and self.peek(1) == "::":
            axis = self.peek()
            self.i += 2
            if axis not in AXES:
                raise XPathError(f"no axis {axis}")
        value = self.peek()
        if value == "*" or self.kind() == "name":
            self.i += 1
        else:
            raise XPathError(f"a step is missing before {value!r}")
        if value in _TESTS and self.take("("):
            self.need(")")
            value += "()"
        return Step(axis, value, deep, self.predicates())

    def predicates(self) -> tuple:
        out = []
        while self.take("["):
            out.append(self.binary())
            self.need("]")
        return tuple(out)


@lru_cache(maxsize=512)
def compile_xpath(source: str):
    """Syntax tree; what follows a complete expression is ignored."""
    return _Parser(source).binary()


# --- evaluation: values are lists of nodes, lists of strings, strings, numbers, booleans or None


def _str(v: Any) -> str:
    if isinstance(v, list):
        return "".join(text(x) if isinstance(x, Node) else _str(x) for x in v)
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return java_double(v)
    return "" if v is None else text(v) if isinstance(v, Node) else str(v)


def _num(v: Any) -> float | None:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v)
    try:
        return float(_str(v).strip())
    except ValueError:
        return None


def _bool(v: Any) -> bool:
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return v != 0
    if isinstance(v, list):
        return bool(v)
    return bool(v and str(v).strip())


def _tag_place(n: Node, scope: list[Node]) -> tuple[int, int]:
    """Place of a node, from 1, among the siblings with its tag that are in the context, and how many there are."""
    ids = {id(x) for x in scope}
    same = [s for s in n.siblings() if s.tag == n.tag and id(s) in ids] or [n]
    return next(i for i, s in enumerate(same) if s is n) + 1, len(same)


@dataclass
class _Context:
    root: Node
    node: Any
    scope: list


def _evaluate(e: Any, c: _Context) -> Any:
    kind = e[0]
    if kind == "value":
        return e[1]
    if kind == "neg":
        v = _num(_evaluate(e[1], c))
        return None if v is None else (-int(v) if v == int(v) else -v)
    if kind == "union":
        a, b = _evaluate(e[1], c), _evaluate(e[2], c)
        if a is None or b is None:
            return b if a is None else a
        if isinstance(a, list) or isinstance(b, list):
            a, b = a if isinstance(a, list) else [a], b if isinstance(b, list) else [b]
            seen = {id(x) for x in a if isinstance(x, Node)}
            return [*a, *(x for x in b if not isinstance(x, Node) or id(x) not in seen)]
        return f"{_str(a)}{_str(b)}" if isinstance(a, str) or isinstance(b, str) else a
    if kind == "op":
        return _operate(e[1], _evaluate(e[2], c), _evaluate(e[3], c))
    if kind == "call":
        return _call(e[1], [_evaluate(a, c) for a in e[2]], c)
    if kind == "filter":
        v = _evaluate(e[1], c)
        return _filtered(v if isinstance(v, list) else [v], e[2], c)
    return _path(e[1], c)


def _operate(op: str, a: Any, b: Any) -> Any:
    if op in ("or", "and"):
        return (_bool(a) or _bool(b)) if op == "or" else (_bool(a) and _bool(b))
    if op in ("=", "!="):
        same = a == b if type(a) is type(b) and not isinstance(a, list) else _str(a) == _str(b) if not _numeric(a, b) else _num(a) == _num(b)
        return same if op == "=" else not same
    if op in ("^=", "$=", "*=", "~=", "!~"):
        x, y = _str(a), _str(b)
        if op in ("~=", "!~"):
            return (compile_java(y).fullmatch(x, timeout=LIMIT) is not None) == (op == "~=")
        return x.startswith(y) if op == "^=" else x.endswith(y) if op == "$=" else y in x
    x, y = _num(a), _num(b)
    if op in ("<", ">", "<=", ">="):
        if x is None or y is None:
            x, y = _str(a), _str(b)
        return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    if x is None or y is None:
        return float("nan")
    if op in ("div", "mod") and y == 0:
        return float("nan") if op == "mod" or x == 0 else float("inf") if x > 0 else float("-inf")
    return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "div": lambda: x / y, "mod": lambda: x - y * int(x / y)}[op]()


def _numeric(a: Any, b: Any) -> bool:
    plain = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    return (plain(a) or plain(b)) and _num(a) is not None and _num(b) is not None


def _call(name: str, a: list, c: _Context) -> Any:
    s = [_str(x) for x in a]
    need = {"concat": 1, "contains": 2, "starts-with": 2, "count": 1, "first": 0, "last": 0, "position": 0, "not": 1, "string-length": 1, "substring": 2, "substring-ex": 3,
            "substring-after": 2, "substring-after-last": 2, "substring-before": 2, "substring-before-last": 2, "sum": 1}
    if name not in need:
        raise XPathError(f"no function {name}")
    if len(a) < need[name]:
        raise XPathError(f"{name} needs {need[name]} arguments")
    if name == "concat":
        return "".join(s)
    if name == "contains":
        return s[1] in s[0]
    if name == "starts-with":
        return s[0].startswith(s[1])
    if name == "count":
        return len(a[0]) if isinstance(a[0], list) else 0 if a[0] is None else 1
    if name in ("first", "position", "last"):
        place, size = _tag_place(c.node, c.scope) if isinstance(c.node, Node) else (1, len(c.scope))
        return 1 if name == "first" else place if name == "position" else size
    if name == "not":
        return not _bool(a[0])
    if name == "string-length":
        return len(s[0].encode("utf-16-le")) // 2
    if name in ("substring", "substring-ex"):
        units = s[0].encode("utf-16-le")
        n = len(units) // 2
        start = int(_num(a[1]) or 0)
        if name == "substring":
            start = max(start - 1, 0)
            end = min(start + int(_num(a[2]) or 0), n) if len(a) > 2 else n
        else:
            end = int(_num(a[2]) or 0)
            end = end + n if end < 0 else min(end, n)
            start = start + n if start < 0 else start
        return units[2 * min(start, n) : 2 * max(end, start)].decode("utf-16-le", "replace")
    if name == "substring-after":
        return s[0].partition(s[1])[2] if s[1] in s[0] else ""
    if name == "substring-after-last":
        return s[0].rpartition(s[1])[2] if s[1] in s[0] else ""
    if name == "substring-before":
        return s[0].partition(s[1])[0] if s[1] in s[0] else ""
    if name == "substring-before-last":
        return s[0].rpartition(s[1])[0] if s[1] in s[0] else ""
    values = [_num(x) for x in (a[0] if isinstance(a[0], list) else [a[0]])]
    return sum(v for v in values if v is not None) if any(v is not None for v in values) else None


def _path(p: Path, c: _Context) -> Any:
    if p.start is not None:
        v = _evaluate(p.start, c)
        found: Any = v if isinstance(v, list) else [v]
    elif p.absolute:
        found = [c.root]
    else:
        found = [c.node] if isinstance(c.node, Node) else c.node
    for step in p.steps:
        found = _take(step, found, c)
    return found


def _take(step: Step, nodes: Any, c: _Context) -> Any:
    nodes = [n for n in nodes if isinstance(n, Node)] if isinstance(nodes, list) else []
    if step.axis == "attribute":
        values = []
        for n in nodes:
            for e in n.descendants() if step.deep else [n]:
                if step.test == "*":
                    values += list(e.attrs.values())
                elif step.test.lower() in e.attrs:
                    values.append(e.attrs[step.test.lower()])
        return values
    if step.test in ("text()", "allText()", "html()", "outerHtml()", "num()"):
        base = [e for n in nodes for e in (n.descendants() if step.deep else [n])] if step.axis == "child" else _axis(step, nodes)
        if step.test == "text()":
            out = [t for n in base for t in _texts(n)] if not step.deep else [t for n in nodes for t in [own_text(e) for e in n.descendants()] if t]
            return [t for k, t in enumerate(out, 1) if all(_text_kept(p, k, len(out), c) for p in step.predicates)]
        if step.test == "num()":
            out = []
            for n in base:
                if m := re.search(r"[-+]?\d+(?:\.\d+)?", own_text(n)):
                    out.append(float(m[0]) if "." in m[0] else int(m[0]))
            return out
        read = {"allText()": text, "html()": inner_html, "outerHtml()": outer_html}[step.test]
        return [read(n) for n in base]
    found = _axis(step, nodes)
    if step.test not in ("*", "node()"):
        name = step.test.lower()
        found = [n for n in found if n.tag == name]
    return _filtered(found, step.predicates, c)


def _texts(n: Node) -> list[str]:
    return [t for t in (trim(fold(x.text)) for x in n.children if x.tag == "#text") if t]


def _text_kept(p: Any, k: int, n: int, c: _Context) -> bool:
    v = _evaluate(p, c)
    return (k == v or k == n + v + 1) if isinstance(v, int) and not isinstance(v, bool) else _bool(v)


def _axis(step: Step, nodes: list[Node]) -> list[Node]:
    out: dict[int, Node] = {}
    for n in nodes:
        for m in _along(step.axis, n) if not step.deep else (x for e in n.descendants() for x in _along(step.axis, e)):
            out.setdefault(id(m), m)
        if step.deep and n.tag == "#document" and step.axis == "child":
            for m in n.elements():
                out.setdefault(id(m), m)
    return _in_order(list(out.values())) if step.deep else list(out.values())


def _in_order(nodes: list[Node]) -> list[Node]:
    if len(nodes) < 2:
        return nodes
    top = nodes[0]
    while top.parent is not None:
        top = top.parent
    order = {id(n): i for i, n in enumerate(top.walk())}
    return sorted(nodes, key=lambda n: order.get(id(n), 0))


def _along(axis: str, n: Node) -> list[Node]:
    if axis == "self":
        return [n]
    if axis == "child":
        return n.elements()
    if axis == "parent":
        return [n.parent] if n.parent is not None and n.parent.is_element else []
    if axis in ("ancestor", "ancestor-or-self"):
        return [*([n] if axis == "ancestor-or-self" else []), *n.ancestors()]
    if axis in ("descendant", "descendant-or-self"):
        return [d for d in n.descendants() if d is not n or axis == "descendant-or-self"]
    siblings = n.siblings()
    i = index_of(siblings, n)
    if axis == "following-sibling":
        return siblings[i + 1 :]
    if axis == "following-sibling-one":
        return siblings[i + 1 : i + 2]
    if axis == "preceding-sibling":
        return siblings[:i]
    if axis == "preceding-sibling-one":
        return siblings[max(i - 1, 0) : i]
    chain = [n, *n.ancestors()]
    if axis == "following":
        return [d for a in chain for s in a.siblings()[index_of(a.siblings(), a) + 1 :] for d in s.descendants()]
    return [d for a in reversed(chain) for s in a.siblings()[: index_of(a.siblings(), a)] for d in s.descendants()]


def _filtered(found: list, predicates: tuple, c: _Context) -> list:
    for p in predicates:
        kept = []
        for n in found:
            v = _evaluate(p, _Context(c.root, n, found))
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                place, size = _tag_place(n, found) if isinstance(n, Node) else (index_of(found, n) + 1, len(found))
                if place == v or v < 0 and place == size + v + 1:
                    kept.append(n)
            elif _bool(v):
                kept.append(n)
        found = kept
    return found


def is_whole(html: str) -> bool:
    """Whether ``document`` makes the plain parse of the text."""
    return not html[:1].isspace() and not html[-1:].isspace() and not html.endswith(("</td>", "</tr>", "</tbody>"))


def document(html: str) -> Node:
    """Document of a text; fragments of tables get the elements around them."""
    s = html.strip()
    if s.endswith("</td>"):
        s = f"<tr>{s}</tr>"
    if s.endswith(("</tr>", "</tbody>")):
        s = f"<table>{s}</table>"
    return parse(s)


def evaluate(root: Node, expression: str) -> Any:
    return _evaluate(compile_xpath(expression), _Context(root, root, [root]))


def _rendered(v: Any) -> list[str]:
    if v is None:
        return []
    return [outer_html(x) if isinstance(x, Node) else "null" if x is None else _str(x) for x in (v if isinstance(v, list) else [v])]


def _branches(rule: str, separators: list[str]) -> tuple[list[str], str]:
    return split_rule(rule, separators)


def string(root: Node, rule: str) -> str:
    """Texts joined by line breaks; ``%%`` isn't a separator here."""
    branches, sep = _branches(rule, ["&&", "||"])
    out = []
    for b in branches:
        if found := "\n".join(_rendered(evaluate(root, b))):
            out.append(found)
            if sep == "||":
                break
    return "\n".join(out)


def string_list(root: Node, rule: str) -> list[str]:
    branches, sep = _branches(rule, ["&&", "||", "%%"])
    lists = []
    for b in branches:
        if found := _rendered(evaluate(root, b)):
            lists.append(found)
            if sep == "||":
                break
    return merge(lists, sep)


def elements(root: Node, rule: str) -> list:
    branches, sep = _branches(rule, ["&&", "||", "%%"])
    lists = []
    for b in branches:
        v = evaluate(root, b)
        if found := v if isinstance(v, list) else [] if v is None else [v]:
            lists.append(found)
            if sep == "||":
                break
    return merge(lists, sep)
