"""Elements as registered scripts see them: a list of nodes with the operations that rules' scripts call."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from . import css
from . import text as texts
from .html_tree import Node, parse


class Elements:
    """Some elements of a page. What the operations give is new; ``remove`` changes the page."""

    def __init__(self, nodes: list[Node]):
        self.nodes = list(nodes)

    @classmethod
    def of(cls, value: Any) -> Elements:
        """Of a rule's value: nodes, a node, or a text that is parsed."""
        if isinstance(value, Elements):
            return value
        if isinstance(value, Node):
            return cls([value])
        if isinstance(value, (list, tuple)) and all(isinstance(x, Node) for x in value):
            return cls(list(value))
        return cls([parse("" if value is None else str(value))])

    def select(self, selector: str) -> Elements:
        found: dict[int, Node] = {}
        for n in self.nodes:
            for m in css.select(n, selector):
                found.setdefault(id(m), m)
        return Elements(list(found.values()))

    def text(self) -> str:
        return " ".join(t for t in map(texts.text, self.nodes) if t)

    def html(self) -> str:
        return "\n".join(map(texts.inner_html, self.nodes))

    def outer_html(self) -> str:
        return "\n".join(map(texts.outer_html, self.nodes))

    def attr(self, name: str) -> str:
        """Of the first element that has it."""
        return next((n.attr(name) for n in self.nodes if name.lower() in n.attrs), "")

    def first(self) -> Elements:
        return Elements(self.nodes[:1])

    def last(self) -> Elements:
        return Elements(self.nodes[-1:])

    def eq(self, place: int) -> Elements:
        return Elements(self.nodes[place : place + 1] if place >= 0 else self.nodes[place:][:1])

    def get(self, place: int) -> Node:
        return self.nodes[place]

    def without(self, selector: str) -> Elements:
        """Those that a selector doesn't take."""
        gone = {id(m) for n in self.nodes for m in css.select(self._top(n), selector)}
        return Elements([n for n in self.nodes if id(n) not in gone])

    @staticmethod
    def _top(n: Node) -> Node:
        while n.parent is not None:
            n = n.parent
        return n

    def parent(self) -> Elements:
        found = {id(n.parent): n.parent for n in self.nodes if n.parent is not None and n.parent.is_element}
        return Elements(list(found.values()))

    def remove(self) -> Elements:
        for n in self.nodes:
            n.detach()
        return self

    def for_each(self, f: Callable[[Elements], Any]) -> None:
        for n in self.nodes:
            f(Elements([n]))

    def to_array(self) -> list[Node]:
        return list(self.nodes)

    def size(self) -> int:
        return len(self.nodes)

    __len__ = size

    def __iter__(self) -> Iterator[Node]:
        return iter(self.nodes)
