"""The DOM rule language: steps joined by ``@``, each with an index part, and an action at the end.

Branches join with ``&&``, ``||`` and ``%%``. ``@CSS:`` makes the left part one selector and what follows the last ``@`` the action.
"""

from __future__ import annotations

import re
from functools import lru_cache

from ..plans.splitter import merge, split_rule, trim_rule
from .css import select
from .html_tree import Node
from .text import data, fold, outer_html, own_text, text, text_nodes

SEPARATORS = ["&&", "||", "%%"]


@lru_cache(maxsize=2048)
def _branches(rule: str) -> tuple[list[str], str]:
    return split_rule(rule, SEPARATORS)


@lru_cache(maxsize=4096)
def _steps(rule: str) -> list[str]:
    return split_rule(trim_rule(rule) if rule[:1] == "@" or rule[:1] < "!" else rule, ["@"])[0]


def _css(rule: str) -> str | None:
    return rule[5:].strip() if rule[:5].upper() == "@CSS:" else None


@lru_cache(maxsize=4096)
def _index(step: str) -> tuple[str, bool, tuple]:
    """Selector of a step, whether its places are excluded, and the places: numbers, or (start, end, step)."""
    step = step.strip()
    if step.endswith("]") and (m := re.search(r"\[(!?)([-\d\s:,]*)\]$", step)) and m[2].strip():
        places = []
        for part in m[2].split(","):
            if ":" in part:
                bits = [p.strip() for p in part.split(":")]
                places.append(tuple(int(b) if b else None for b in [*bits, ""][:3]))
            elif part.strip():
                places.append(int(part))
        return step[: m.start()], bool(m[1]), tuple(places)
    # The old form: `.0:2` or `!0:1` after the selector.
    if m := re.search(r"([.!])(-?\d+(?::-?\d+)*)$", step):
        return step[: m.start()], m[1] == "!", tuple(int(p) for p in m[2].split(":"))
    return step, False, ()


def pick(items: list, exclude: bool, places: tuple) -> list:
    """Items at the places, in the order written and each once; negative places count from the end, those outside are dropped."""
    n = len(items)
    if not places:
        return items
    order: dict[int, None] = {}
    for p in places:
        if isinstance(p, int):
            k = p + n if p < 0 else p
            if 0 <= k < n:
                order[k] = None
            continue
        start, end, step = p
        start, end, step = 0 if start is None else start, n - 1 if end is None else end, 1 if step is None else step
        start, end = start + n if start < 0 else start, end + n if end < 0 else end
        if (start < 0 and end < 0) or (start >= n and end >= n):
            continue
        start, end = min(max(start, 0), n - 1), min(max(end, 0), n - 1)
        step = abs(step) if step > 0 else step + n if step + n > 0 else 1
        walk = range(start, end + 1, step) if start <= end else range(start, end - 1, -step)
        order.update(dict.fromkeys(walk))
    if exclude:
        return [x for i, x in enumerate(items) if i not in order]
    return [items[k] for k in order]


def _candidates(node: Node, selector: str) -> list[Node]:
    if not selector or selector == "children":
        return node.elements()
    kind, _, name = selector.partition(".")
    if name and kind in ("class", "tag", "id", "text"):
        if kind == "class":
            want = name.lower()
            return [n for n in node.descendants() if want in n.attrs.get("class", "").lower().split() or n.attrs.get("class", "").strip().lower() == want]
        if kind == "tag":
            want = name.lower()
            return [n for n in node.descendants() if n.tag == want]
        if kind == "id":
            return [n for n in node.descendants() if n.attrs.get("id") == name]
        want = fold(name).strip().lower()
        return [n for n in node.descendants() if want in own_text(n).lower()]
    return select(node, selector)


def _step(nodes: list[Node], step: str) -> list[Node]:
    """A step applied to each node; results one after the other, repeats kept."""
    selector, exclude, places = _index(step)
    return [m for n in nodes for m in pick(_candidates(n, selector), exclude, places)]


def elements(root: Node, rule: str) -> list[Node]:
    if not rule.strip():
        return []
    css = _css(rule)
    branches, sep = _branches(css if css is not None else rule)
    lists: list[list[Node]] = []
    for branch in branches:
        if css is not None:
            found = select(root, branch)
        else:
            found = [root]
            for step in _steps(branch):
                found = _step(found, step)
        if found:
            lists.append(found)
            if sep == "||":
                break
        elif sep == "%%":
            lists.append(found)
    return merge(lists, sep)


def _action(nodes: list[Node], action: str) -> list[str]:
    if action == "text":
        return [t for t in map(text, nodes) if t]
    if action == "textNodes":
        return [t for t in ("\n".join(text_nodes(n)) for n in nodes) if t]
    if action == "ownText":
        return [t for t in map(own_text, nodes) if t]
    if action == "html":
        for n in nodes:
            for d in [d for d in n.descendants() if d.tag in ("script", "style") and d is not n]:
                d.detach()
        out = "\n".join(outer_html(n) for n in nodes)
        return [out] if out else []
    if action == "all":
        return ["\n".join(outer_html(n) for n in nodes)] if nodes else []
    values = (n.attr(action) for n in nodes)
    return list(dict.fromkeys(v for v in values if v.strip()))


def string_list(root: Node, rule: str) -> list[str]:
    if not rule.strip():
        return []
    css = _css(rule)
    if css == "":
        return [data(root)]
    branches, sep = _branches(css if css is not None else rule)
    lists: list[list[str]] = []
    for branch in branches:
        if css is not None:
            selector, _, action = branch.rpartition("@")
            found = _action(select(root, selector.strip()), action.strip()) if selector else []
        else:
            *steps, action = _steps(branch)
            nodes = [root]
            for step in steps:
                nodes = _step(nodes, step)
            found = _action(nodes, action) if nodes else []
        if found:
            lists.append(found)
            if sep == "||":
                break
        elif sep == "%%":
            lists.append(found)
    return merge(lists, sep)


def string(root: Node, rule: str) -> str | None:
    found = string_list(root, rule)
    return "\n".join(found) if found else None


def first_string(root: Node, rule: str) -> str:
    found = string_list(root, rule)
    return found[0] if found else ""
