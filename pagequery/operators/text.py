"""Texts of nodes, and nodes as HTML again."""

from __future__ import annotations

import re

from .html_tree import BLOCK, VOID, Node, index_of

_SPACES = " \t\n\f\r\xa0"
_DROPPED = re.compile("[​­]")
_RUN = re.compile("[ \t\n\f\r\xa0]+")
_KEEP = frozenset("pre plaintext textarea".split())
# Blocks whose content is laid out in line when pretty-printing.
_INLINE_CONTENT = frozenset("title a p h1 h2 h3 h4 h5 h6 pre address li th td script style ins del s button".split())


def fold(text: str) -> str:
    """White space, non-breaking included, folded into single spaces; zero-width spaces and soft hyphens dropped."""
    return _RUN.sub(" ", _DROPPED.sub("", text))


def trim(text: str) -> str:
    """Without characters up to the space at either end."""
    return text.strip("".join(map(chr, range(33))))


def _preserves(node: Node | None) -> bool:
    for _ in range(6):
        if node is None or not node.is_element:
            return False
        if node.tag in _KEEP:
            return True
        node = node.parent
    return False


def text(node: Node) -> str:
    """Text of an element and all below it, blocks and line breaks set apart by a space."""
    out: list[str] = []
    last = " "

    def add(value: str) -> None:
        nonlocal last
        if value:
            out.append(value)
            last = value[-1]

    def enter(n: Node) -> bool:
        """What comes before a node's children; whether there are any to go to."""
        if n.tag == "#text":
            if _preserves(n.parent):
                add(n.text)
            else:
                value = fold(n.text)
                add(value.lstrip(" ") if last == " " else value)
            return False
        if not n.is_element and n.tag != "#document":
            return False
        if out and (n.tag in BLOCK or n.tag == "br") and last != " ":
            add(" ")
        return True

    def leave(kids: list[Node], i: int) -> None:
        c = kids[i]
        if c.is_element and c.tag in BLOCK and last != " " and i + 1 < len(kids) and kids[i + 1].tag == "#text":
            add(" ")

    # Pages may be nested deeper than calls can be.
    stack: list[tuple[list[Node], int]] = [([node], 0)] if node.is_element or node.tag in ("#text", "#document") else []
    while stack:
        kids, i = stack.pop()
        if i and len(stack):
            leave(kids, i - 1)
        if i < len(kids):
            stack.append((kids, i + 1))
            if enter(kids[i]):
                stack.append((kids[i].children, 0))
    return trim("".join(out))


def own_text(node: Node) -> str:
    """Text of an element's own text nodes; a line break counts as a space."""
    out = ""
    for c in node.children:
        if c.tag == "#text":
            value = c.text if _preserves(node) else fold(c.text)
            out += value.lstrip(" ") if out.endswith(" ") and not _preserves(node) else value
        elif c.tag == "br" and not out.endswith(" "):
            out += " "
    return trim(out)


def whole_text(node: Node) -> str:
    return "".join(n.text if n.tag == "#text" else "\n" for n in node.walk() if n.tag in ("#text", "br"))


def data(node: Node) -> str:
    return "".join(n.text for n in node.walk() if n.tag == "#data")


def text_nodes(node: Node) -> list[str]:
    """Own text nodes, trimmed, blank ones left out."""
    found = (trim(fold(c.text)) for c in node.children if c.tag == "#text")
    return [t for t in found if t]


def _escape(value: str) -> str:
    return value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&nbsp;")


def _escape_attr(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def outer_html(node: Node) -> str:
    """Pretty-printed HTML of a node: blocks on lines of their own, indented by a space per level below the node."""
    out: list[str] = []
    _write(node, out)
    return "".join(out).strip("\n") if node.tag == "#document" else "".join(out)


def inner_html(node: Node) -> str:
    out: list[str] = []
    for c in node.children:
        _write(c, out)
    return trim("".join(out))


def _as_block(n: Node | None) -> bool:
    return n is not None and (n.tag in BLOCK and n.tag not in _INLINE_CONTENT or n.tag == "#document")


def _write(node: Node, out: list[str]) -> None:
    """A node and all below it, with a stack of its own: pages may be nested deeper than calls can be."""
    stack: list[tuple[Node | None, list[Node], int, int]] = [(None, [node], 0, 0)]
    while stack:
        owner, kids, i, depth = stack.pop()
        if i < len(kids):
            stack.append((owner, kids, i + 1, depth))
            n = kids[i]
            if _begin(n, i if owner is not None else None, depth, out):
                stack.append((n, n.children, 0, 0 if n.tag == "#document" else depth + 1))
        elif owner is not None and owner.tag != "#document":
            if owner.children and _as_block(owner) and not _preserves(owner) and any(c.is_element and c.tag in BLOCK or c.tag in ("#text", "#comment") for c in owner.children):
                _line(depth - 1, out)
            out.append(f"</{owner.tag}>")


def _begin(n: Node, at: int | None, depth: int, out: list[str]) -> bool:
    """What comes before a node's children; whether these, and an end, follow. ``at`` is its place where that is known."""
    parent = n.parent
    if n.tag == "#text":
        if _preserves(parent):
            out.append(_escape(n.text))
            return False
        value = fold(n.text)
        first = parent is None or not parent.children or parent.children[0] is n
        last = parent is None or parent.children[-1] is n
        if _as_block(parent) or parent is not None and parent.tag in BLOCK:
            value = value.lstrip(" ") if first else value
            value = value.rstrip(" ") if last else value
        if not value.strip(" ") and (first or last or _block_neighbour(n, at)):
            return False
        if first and _as_block(parent) and out:
            _line(depth, out)
        out.append(_escape(value))
        return False
    if n.tag == "#data":
        out.append(n.text)
        return False
    if n.tag == "#comment":
        if _as_block(parent) and out:
            _line(depth, out)
        out.append(f"<!--{n.text}-->")
        return False
    if n.tag == "#doctype":
        out.append("<!doctype html>")
        return False
    if n.tag == "#document":
        return True
    block = n.tag in BLOCK or _as_block(parent)
    inline = n.tag not in BLOCK and parent is not None and parent.children and parent.children[0] is not n and n.tag != "br"
    if out and block and not inline and not _preserves(parent):
        _line(depth, out)
    attrs = "".join(f' {k}="{_escape_attr(v)}"' if v or k not in ("checked", "disabled", "selected", "hidden", "async", "defer") else f" {k}" for k, v in n.attrs.items())
    out.append(f"<{n.tag}{attrs}>")
    return n.tag not in VOID


def _block_neighbour(n: Node, at: int | None) -> bool:
    siblings = n.parent.children
    i = index_of(siblings, n) if at is None else at
    return siblings[i - 1].tag in BLOCK or siblings[i + 1].tag in BLOCK


def _line(depth: int, out: list[str]) -> None:
    if out:
        out[-1] = out[-1].rstrip(" ")
    out.append("\n" + " " * min(depth, 30))
