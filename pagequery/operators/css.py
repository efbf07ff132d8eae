"""CSS-like selectors, compiled to predicates that are tested from the right-most part outwards.

The root of the search belongs to the candidates. Classes and attribute values compare without case; ``[a~=re]`` finds a regular
expression; ``[a!=v]`` also takes elements without the attribute.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from ..functions.java_regex import LIMIT, compile_java
from .html_tree import Node
from .text import own_text, text

Test = Callable[[Node, Node], bool]


class SelectorError(ValueError):
    """A selector that can't be parsed or isn't supported."""


class _Parser:
    def __init__(self, source: str):
        self.s, self.i = source.strip(), 0
        if not self.s:
            raise SelectorError("empty selector")

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def groups(self) -> Test:
        tests = [self.chain()]
        while self.peek() == ",":
            self.i += 1
            self.space()
            tests.append(self.chain())
        if self.i < len(self.s):
            raise SelectorError(f"unexpected {self.s[self.i :]!r} in {self.s!r}")
        return tests[0] if len(tests) == 1 else lambda n, root: any(t(n, root) for t in tests)

    def space(self) -> bool:
        start = self.i
        while self.peek() and self.peek().isspace():
            self.i += 1
        return self.i > start

    def chain(self) -> Test:
        self.space()
        # A leading combinator starts at the root itself.
        test: Test = (lambda n, root: n is root) if self.peek() and self.peek() in ">+~" else self.compound()
        while True:
            gap = self.space()
            c = self.peek()
            if not c or c == ",":
                return test
            if c in ">+~":
                self.i += 1
                self.space()
            elif gap:
                c = " "
            else:
                raise SelectorError(f"unexpected {c!r} in {self.s!r}")
            test = _combined(c, test, self.compound())

    def compound(self) -> Test:
        tests: list[Test] = []
        while True:
            c = self.peek()
            if c == "#":
                self.i += 1
                name = self.name()
                tests.append(lambda n, root, v=name: n.attrs.get("id") == v)
            elif c == ".":
                self.i += 1
                name = self.name().lower()
                tests.append(lambda n, root, v=name: v in n.attrs.get("class", "").lower().split())
            elif c == "*" and not tests:
                self.i += 1
                if self.peek() == "|":
                    self.i += 1
                    name = self.name().lower()
                    tests.append(lambda n, root, v=name: n.tag == v or n.tag.endswith(":" + v))
                else:
                    tests.append(lambda n, root: True)
            elif c == "[":
                tests.append(_attribute(self.balanced("[", "]")))
            elif c == ":":
                self.i += 1
                tests.append(self.pseudo())
            elif not tests and (c.isalnum() or c in "_-\\"):
                name = self.name().lower()
                if self.peek() == "|":
                    self.i += 1
                    name += ":" + self.name().lower()
                tests.append(lambda n, root, v=name: n.tag == v)
            else:
                break
        if not tests:
            raise SelectorError(f"nothing to select at {self.s[self.i :]!r} in {self.s!r}")
        return tests[0] if len(tests) == 1 else lambda n, root: all(t(n, root) for t in tests)

    def name(self) -> str:
        m = re.compile(r"(?:[\w\-]|\\.)+").match(self.s, self.i)
        if not m:
            raise SelectorError(f"a name is missing in {self.s!r}")
        self.i = m.end()
        return re.sub(r"\\(.)", r"\1", m[0])

    def balanced(self, a: str, b: str) -> str:
        """Text between matching brackets; quotes and backslashes protect brackets."""
        depth, quote, start = 0, "", self.i
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "\\":
                self.i += 1
            elif quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == a:
                depth += 1
            elif c == b:
                depth -= 1
                if not depth:
                    self.i += 1
                    return self.s[start + 1 : self.i - 1]
            self.i += 1
        raise SelectorError(f"{a} is not closed in {self.s!r}")

    def pseudo(self) -> Test:
        name = self.name().lower()
        arg = self.balanced("(", ")") if self.peek() == "(" else None
        if arg is None:
            if name in _PLAIN:
                return _PLAIN[name]
        elif name in ("lt", "gt", "eq"):
            if not re.fullmatch(r"\s*-?\d+\s*", arg):
                raise SelectorError(f":{name} needs a number")
            k = int(arg)
            return {"lt": lambda n, r: n.place() < k, "gt": lambda n, r: n.place() > k, "eq": lambda n, r: n.place() == k}[name]
        elif name in ("nth-child", "nth-of-type", "nth-last-of-type"):
            a, b = _step(arg)
            return lambda n, r: _nth(n, name, a, b)
        elif name in ("contains", "containsown"):
            needle = re.sub(r"\s+", " ", arg.strip()).strip("\"'") if arg.strip()[:1] in "\"'" and arg.strip()[-1:] == arg.strip()[:1] else re.sub(r"\s+", " ", arg.strip())
            needle = re.sub(r"\\(.)", r"\1", needle).lower()
            if not needle:
                raise SelectorError(f":{name} needs a text")
            read = text if name == "contains" else own_text
            return lambda n, r: needle in read(n).lower()
        elif name in ("matches", "matchesown"):
            pattern = compile_java(arg)
            read = text if name == "matches" else own_text
            return lambda n, r: pattern.search(read(n), timeout=LIMIT) is not None
        elif name == "has":
            inner = compile_selector(arg)
            return lambda n, r: any(inner(d, n) for d in n.descendants() if d is not n)
        elif name == "not":
            inner = compile_selector(arg)
            return lambda n, r: not inner(n, r)
        raise SelectorError(f":{name} is not supported")


def _combined(c: str, left: Test, right: Test) -> Test:
    """The right part is tested first: it is the cheaper one, and mostly false."""
    if c == " ":

        def test(n: Node, root: Node) -> bool:
            if not right(n, root):
                return False
            while n is not root:
                n = n.parent
                if n is None:
                    return False
                if left(n, root):
                    return True
            return False

    elif c == ">":

        def test(n: Node, root: Node) -> bool:
            return right(n, root) and n is not root and n.parent is not None and left(n.parent, root)  # the document is a parent too

    else:

        def test(n: Node, root: Node) -> bool:
            if n is root or not right(n, root):
                return False
            kids, at = n.siblings(), n.place()
            if c == "+":
                return at > 0 and left(kids[at - 1], root)
            # The first sibling that the left part takes is looked for once for all of them.
            key = (id(kids), id(root), id(left))
            if key not in _FIRST:
                _FIRST[key] = next((i for i, k in enumerate(kids) if left(k, root)), len(kids))
            return _FIRST[key] < at

    return test


#: During one selection, by list of siblings, root and left part: the first sibling taken.
_FIRST: dict[tuple[int, int, int], int] = {}


def _first(n: Node) -> bool:
    return n.parent is not None and n.place() == 0


def _last(n: Node) -> bool:
    return n.parent is not None and n.siblings()[-1] is n


def _empty(n: Node, root: Node) -> bool:
    for c in n.children:
        if c.tag == "#text":
            return not c.text.strip()
        if c.is_element:
            return False
    return True


_PLAIN: dict[str, Test] = {
    "first-child": lambda n, r: _first(n),
    "last-child": lambda n, r: _last(n),
    "only-child": lambda n, r: _first(n) and _last(n),
    "first-of-type": lambda n, r: _nth(n, "nth-of-type", 0, 1),
    "last-of-type": lambda n, r: _nth(n, "nth-last-of-type", 0, 1),
    "empty": _empty,
    "root": lambda n, r: n is next((e for e in r.elements()), None) if r.tag == "#document" else n is r,
}


def _step(arg: str) -> tuple[int, int]:
    """``an+b``, ``odd``, ``even`` or a number."""
    s = re.sub(r"\s+", "", arg.lower())
    if s in ("odd", "even"):
        return 2, int(s == "odd")
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", s):
        a = m[1]
        return (int(a + "1") if a in ("", "+", "-") else int(a)), int(m[2] or 0)
    if re.fullmatch(r"[+-]?\d+", s):
        return 0, int(s)
    raise SelectorError(f"can't read {arg!r} as a place")


def _nth(n: Node, name: str, a: int, b: int) -> bool:
    if n.parent is None:
        return False
    _, places, tags = n.parent.order()
    at, same = places[id(n)]
    k = {"nth-child": at + 1, "nth-of-type": same + 1, "nth-last-of-type": tags[n.tag] - same}[name]
    return k == b if a == 0 else (k - b) * a >= 0 and (k - b) % a == 0


def _attribute(body: str) -> Test:
    m = re.fullmatch(r"\s*(\^?)([^=!^$*~\s]+)\s*(?:(=|!=|\^=|\$=|\*=|~=)\s*(.*?)\s*)?", body, re.S)
    if not m:
        raise SelectorError(f"can't read [{body}]")
    prefix, name, op, value = m[1], m[2].lower(), m[3], m[4]
    if op is None:
        if prefix:
            return lambda n, r: any(k.startswith(name) for k in n.attrs)
        if name.startswith("abs:"):
            name = name[4:]
        return lambda n, r: name in n.attrs
    if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]:
        value = value[1:-1]
    if op == "~=":
        pattern = compile_java(value)
        return lambda n, r: name in n.attrs and pattern.search(n.attrs[name], timeout=LIMIT) is not None
    value = value.strip().lower()
    if not value:
        raise SelectorError(f"[{body}] has no value")
    if op == "=":
        return lambda n, r: name in n.attrs and n.attrs[name].strip().lower() == value
    if op == "!=":
        return lambda n, r: name not in n.attrs or n.attrs[name].strip().lower() != value
    test = {"^=": str.startswith, "$=": str.endswith, "*=": str.__contains__}[op]
    return lambda n, r: name in n.attrs and test(n.attrs[name].lower(), value)


@lru_cache(maxsize=1024)
def compile_selector(source: str) -> Test:
    return _Parser(source).groups()


def select(root: Node, source: str) -> list[Node]:
    """Elements below ``root``, and itself, that match, in document order."""
    test = compile_selector(source)
    _FIRST.clear()
    return [n for n in root.descendants() if test(n, root)]
