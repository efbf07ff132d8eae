"""HTML text to a tree: a tokenizer and the tree-construction rules of the HTML standard that pages rely on.

Covered: implied html/head/body, implied end tags, raw-text elements, table sections and rows with foster parenting, lists,
options, headings, forms, active formatting elements with reconstruction and the adoption agency.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr basefont bgsound frame".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
TEXT_ONLY = frozenset("title textarea".split())
# Elements that are laid out as blocks.
BLOCK = frozenset(
    "html head body frameset script noscript style meta link title frame noframes section nav aside hgroup header footer p h1 h2 h3 h4 h5 h6"
    " ul ol pre div blockquote hr address figure figcaption form fieldset ins del dl dt dd li table caption thead tfoot tbody colgroup col tr th td"
    " video audio canvas details menu plaintext template article main svg math center dir applet marquee listing".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr"
    " main menu nav ol p pre listing search section summary table ul xmp plaintext".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noframes script style template title".split())
_SCOPE = frozenset("applet caption html table td th marquee object template".split())
_SPECIAL = _SCOPE | _CLOSES_P | BLOCK - frozenset("ins del video audio canvas svg math".split()) | frozenset("button li option optgroup select tbody tfoot thead tr iframe input img br".split())
_IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())

_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG_NAME = re.compile(r"[^ \t\n\f\r/>]+")
_BEFORE_NAME = re.compile(r"[ \t\n\f\r/]*")
_NAME = re.compile(r"=?[^ \t\n\f\r/>=]*")
_SPACES = re.compile(r"[ \t\n\f\r]*")
_UNQUOTED = re.compile(r"[^ \t\n\f\r>]*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[ \t\n\f\r/>])|\Z", re.I) for t in RAW | TEXT_ONLY}


class Node:
    """An element, or with a tag that starts with ``#`` a text, data or comment node or the document."""

    __slots__ = ("_order", "attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None
        self._order: tuple | None = None

    @property
    def is_element(self) -> bool:
        return self.tag[0] != "#"

    def append(self, child: Node) -> Node:
        if child.parent is not None:
            child.detach()
        child.parent = self
        self.children.append(child)
        self._order = None
        return child

    def insert_before(self, child: Node, ref: Node) -> None:
        if child.parent is not None:
            child.detach()
        child.parent = self
        self.children.insert(index_of(self.children, ref), child)
        self._order = None

    def detach(self) -> None:
        if self.parent is not None:
            del self.parent.children[index_of(self.parent.children, self)]
            self.parent._order = None
            self.parent = None

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag[0] != "#"]

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def descendants(self) -> Iterator[Node]:
        """This element and the elements below it."""
        stack = [self]
        while stack:
            n = stack.pop()
            if n.tag[0] != "#":
                yield n
            if n.children:
                stack += [c for c in reversed(n.children) if c.tag[0] != "#"]

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None and n.tag[0] != "#":
            yield n
            n = n.parent

    def siblings(self) -> list[Node]:
        """The parent's elements; not to be changed."""
        return self.parent.order()[0] if self.parent is not None else [self]

    def order(self) -> tuple[list[Node], dict[int, tuple[int, int]], dict[str, int]]:
        """Elements among the children; by their identity the place among them and among those of the same tag; number of each tag. Made once, until the children change."""
        if self._order is None:
            kids, places, tags = self.elements(), {}, {}
            for i, c in enumerate(kids):
                k = tags.get(c.tag, 0)
                tags[c.tag] = k + 1
                places[id(c)] = (i, k)
            self._order = (kids, places, tags)
        return self._order

    def place(self) -> int:
        """Place among the parent's elements."""
        return self.parent.order()[1][id(self)][0] if self.parent is not None else 0

    def attr(self, name: str) -> str:
        return self.attrs.get(name.lower(), "")

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


def index_of(nodes: list[Node], node: Node) -> int:
    """Place of a node, looked for from the end, where changes are made mostly."""
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i] is node:
            return i
    raise ValueError("not a child")


def _attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag from the end of its name on, and the place after the tag; -1 if the text ends in it. Each character is looked at once."""
    attrs: dict[str, str] = {}
    n = len(source)
    while True:
        at = _BEFORE_NAME.match(source, at).end()
        if at >= n:
            return attrs, -1
        if source[at] == ">":
            return attrs, at + 1
        m = _NAME.match(source, at)
        name, at = m[0].lower(), m.end()
        at = _SPACES.match(source, at).end()
        value = ""
        if source.startswith("=", at):
            at = _SPACES.match(source, at + 1).end()
            quote = source[at : at + 1]
            if quote in ('"', "'") and quote:
                end = source.find(quote, at + 1)
                if end < 0:
                    return attrs, -1
                value, at = source[at + 1 : end], end + 1
            else:
                m = _UNQUOTED.match(source, at)
                value, at = m[0], m.end()
        if name not in attrs:
            attrs[name] = _html.unescape(value) if "&" in value else value


def tokens(source: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Start tags, end tags, texts, comments and doctypes in order, in one pass. What stands in a tag that the text ends in is lost, as the standard has it."""
    at, n = 0, len(source)
    while at < n:
        m = _MARKUP.search(source, at)
        lt = m.start() if m else n
        if lt == n - 2 and source[n - 1] == "/":
            lt = n  # `</` at the end is text
        if lt > at:
            yield "text", _html.unescape(source[at:lt]), {}
        if lt == n:
            return
        c = source[lt + 1]
        if c.isalpha():
            m = _TAG_NAME.match(source, lt + 1)
            name = m[0].lower()
            attrs, at = _attributes(source, m.end())
            if at < 0:
                return
            yield "start", name, attrs
            if name in _RAW_END:
                end = _RAW_END[name].search(source, at).start()
                if end > at:
                    body = source[at:end]
                    yield ("data", body, {}) if name in RAW else ("text", _html.unescape(body), {})
                gt = source.find(">", end)
                at = n if gt < 0 else gt + 1
                yield "end", name, {}
        elif c == "/" and source[lt + 2].isascii() and source[lt + 2].isalpha():
            m = _TAG_NAME.match(source, lt + 2)
            at = _attributes(source, m.end())[1]
            if at < 0:
                return
            yield "end", m[0].lower(), {}
        elif source.startswith("</>", lt):
            at = lt + 3
        elif source.startswith("<!--", lt):
            if source.startswith((">", "->"), lt + 4):
                at = source.index(">", lt) + 1
                yield "comment", "", {}
                continue
            m = _COMMENT_END.search(source, lt + 4)
            yield "comment", source[lt + 4 : m.start() if m else n], {}
            at = m.end() if m else n
        else:
            gt = source.find(">", lt)
            gt = n if gt < 0 else gt
            body = source[lt + 1 : gt] if c != "/" else source[lt + 2 : gt]
            if body[:8].lower() == "!doctype":
                yield "doctype", body, {}
            else:
                yield "comment", body, {}
            at = gt + 1


class _Open(list):
    """The stack of open elements, which knows without a search what is in it."""

    def __init__(self, nodes: list[Node] = ()):  # type: ignore[assignment]
        super().__init__(nodes)
        self.tags: dict[str, int] = {}
        self.ids: set[int] = set()
        for n in nodes:
            self._in(n)

    def _in(self, n: Node) -> None:
        self.tags[n.tag] = self.tags.get(n.tag, 0) + 1
        self.ids.add(id(n))

    def _out(self, n: Node) -> None:
        self.tags[n.tag] -= 1
        self.ids.discard(id(n))

    def has(self, tag: str) -> bool:
        return self.tags.get(tag, 0) > 0

    def holds(self, n: Node) -> bool:
        return id(n) in self.ids

    def append(self, n: Node) -> None:
        super().append(n)
        self._in(n)

    def pop(self) -> Node:  # type: ignore[override]
        n = super().pop()
        self._out(n)
        return n

    def insert(self, i: int, n: Node) -> None:  # type: ignore[override]
        super().insert(i, n)
        self._in(n)

    def __delitem__(self, i) -> None:
        for n in self[i] if isinstance(i, slice) else [self[i]]:
            self._out(n)
        super().__delitem__(i)

    def __setitem__(self, i: int, n: Node) -> None:  # type: ignore[override]
        self._out(self[i])
        super().__setitem__(i, n)
        self._in(n)

    def at(self, n: Node) -> int | None:
        """Place of a node, from the top."""
        return index_of(self, n) if self.holds(n) else None


class _Builder:
    def __init__(self):
        self.doc = Node("#document")
        self.html = self.head = self.body = None
        self._open = _Open()
        self.active: list[Node | None] = []  # None is a marker
        self.form: Node | None = None

    # --- stack helpers
    @property
    def open(self) -> _Open:
        return self._open

    @open.setter
    def open(self, nodes: list[Node]) -> None:
        self._open = nodes if isinstance(nodes, _Open) else _Open(nodes)

    @property
    def current(self) -> Node:
        return self._open[-1] if self._open else self.doc

    def in_scope(self, tag: str, extra: frozenset = frozenset()) -> bool:
        if not self._open.has(tag):
            return False
        for n in reversed(self._open):
            if n.tag == tag:
                return True
            if n.tag in _SCOPE or n.tag in extra:
                return False
        return False

    def pop_to(self, tag: str) -> None:
        while self._open:
            if self._open.pop().tag == tag:
                return

    def implied(self, but: str = "") -> None:
        while self._open and self._open[-1].tag in _IMPLIED and self._open[-1].tag != but:
            self._open.pop()

    def close_p(self) -> None:
        if self.in_scope("p", frozenset(["button"])):
            self.implied("p")
            self.pop_to("p")

    def ensure_html(self) -> None:
        if self.html is None:
            self.html = self.doc.append(Node("html"))
            self.open = [self.html]

    def ensure_head(self) -> None:
        self.ensure_html()
        if self.head is None:
            self.head = self.html.append(Node("head"))

    def ensure_body(self) -> None:
        self.ensure_head()
        if self.body is None:
            self.body = self.html.append(Node("body"))
            self.open = [self.html, self.body]

    # --- insertion
    def place(self) -> tuple[Node, Node | None]:
        """Parent for a new node, and the sibling before which it goes when content strays inside a table."""
        target = self.current
        if target.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self._open) - 1, -1, -1):
                if self._open[i].tag == "table":
                    table = self._open[i]
                    return (table.parent, table) if table.parent is not None else (self._open[i - 1], None)
        return target, None

    def put(self, node: Node, foster: bool = True) -> Node:
        parent, before = self.place() if foster else (self.current, None)
        if before is not None:
            parent.insert_before(node, before)
        else:
            parent.append(node)
        return node

    def push(self, tag: str, attrs: dict[str, str], foster: bool = True) -> Node:
        node = self.put(Node(tag, attrs), foster)
        self._open.append(node)
        return node

    def text(self, value: str) -> None:
        if self.body is None and not (self.head is not None and self.current.tag in ("title", "textarea", "noscript")):
            if not value.strip(" \t\n\r\f"):
                return
            if self.frameset():
                return
            self.ensure_body()
        if value.strip(" \t\n\r\f"):
            self.reconstruct()
        blank = not value.strip(" \t\n\r\f")
        parent, before = (self.current, None) if blank else self.place()
        if before is None:
            if parent.children and parent.children[-1].tag == "#text":
                parent.children[-1].text += value
            else:
                parent.append(Node("#text", text=value))
            return
        i = index_of(parent.children, before)
        if i and parent.children[i - 1].tag == "#text":
            parent.children[i - 1].text += value
        else:
            parent.insert_before(Node("#text", text=value), before)

    def frameset(self) -> bool:
        return self._open.has("frameset")

    # --- formatting elements
    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self._open.holds(self.active[-1]):
            return
        i = len(self.active) - 1
        while i and self.active[i - 1] is not None and not self._open.holds(self.active[i - 1]):
            i -= 1
        for j in range(i, len(self.active)):
            old = self.active[j]
            self.active[j] = self.push(old.tag, dict(old.attrs))

    def adopt(self, tag: str) -> None:
        """End tag of a formatting element."""
        if self.current.tag == tag and not any(self.current is n for n in self.active):
            self._open.pop()
            return
        for _ in range(8):
            element, where = None, 0
            for i in range(len(self.active) - 1, -1, -1):
                if self.active[i] is None:
                    break
                if self.active[i].tag == tag:
                    element, where = self.active[i], i
                    break
            if element is None:
                self.any_end(tag)
                return
            depth = self._open.at(element)
            if depth is None:
                del self.active[where]
                return
            if not self.in_scope(tag):
                return
            block = next((i for i in range(depth + 1, len(self._open)) if self._open[i].tag in _SPECIAL), None)
            if block is None:
                del self._open[depth:]
                del self.active[where]
                return
            furthest, above = self._open[block], self._open[depth - 1]
            bookmark, last = where, furthest
            i, inner = block, 0
            while True:
                inner += 1
                i -= 1
                node = self._open[i]
                if node is element:
                    break
                known = next((k for k, a in enumerate(self.active) if a is node), None)
                if inner > 3 and known is not None:
                    del self.active[known]
                    bookmark -= known < bookmark
                    known = None
                if known is None:
                    del self._open[i]
                    continue
                copy = Node(node.tag, dict(node.attrs))
                self.active[known] = self._open[i] = copy
                if last is furthest:
                    bookmark = known + 1
                copy.append(last)
                last = copy
            keep = self._open
            self.open = list(keep[: keep.at(above) + 1])
            if above.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                last.detach() if last.parent else None
                self.put(last)
            else:
                above.append(last)
            self.open = keep
            copy = Node(element.tag, dict(element.attrs))
            copy.children, furthest.children, furthest._order = furthest.children, [], None
            for child in copy.children:
                child.parent = copy
            furthest.append(copy)
            gone = next(k for k, a in enumerate(self.active) if a is element)
            del self.active[gone]
            self.active.insert(bookmark - (gone < bookmark), copy)
            del self._open[self._open.at(element)]
            self._open.insert(self._open.at(furthest) + 1, copy)

    def any_end(self, tag: str) -> None:
        if not self._open.has(tag):
            return
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i].tag == tag:
                del self._open[i:]
                return
            if self._open[i].tag in _SPECIAL:
                return

    # --- tags
    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            self.ensure_html()
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None:
                self.ensure_head()
                self.head.attrs.update(attrs)
                self.open = [self.html, self.head]
            return
        if tag == "body":
            if self.body is None:
                self.ensure_body()
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)
            return
        if self.body is None and tag in _IN_HEAD:
            self.ensure_head()
            node = self.head.append(Node(tag, attrs))
            if tag not in VOID:
                self.open = [self.html, self.head, node]
            return
        if self.body is None and tag == "noscript":
            self.ensure_head()
            self.open = [self.html, self.head, self.head.append(Node(tag, attrs))]
            return
        if tag == "frameset" and self.body is None:
            self.ensure_head()
            self.open = [self.html]
            self.push(tag, attrs)
            return
        if tag == "frame" and self.frameset():
            self.put(Node(tag, attrs))
            return
        self.ensure_body()
        if self.table_start(tag, attrs):
            return
        if tag in _CLOSES_P:
            self.close_p()
            if tag in _HEADINGS and self.current.tag in _HEADINGS:
                self._open.pop()
        elif tag in ("li", "dd", "dt"):
            same = ("li",) if tag == "li" else ("dd", "dt")
            for n in reversed(self._open):
                if n.tag in same:
                    self.implied(n.tag)
                    self.pop_to(n.tag)
                    break
                if n.tag in _SPECIAL and n.tag not in ("address", "div", "p"):
                    break
            self.close_p()
        elif tag in ("option", "optgroup"):
            if self.current.tag == "option":
                self._open.pop()
            if tag == "optgroup" and self.current.tag == "optgroup":
                self._open.pop()
        elif tag == "button" and self.in_scope("button"):
            self.implied()
            self.pop_to("button")
        elif tag == "select" and self.in_scope("select"):
            self.pop_to("select")
            return
        elif tag in ("rb", "rp", "rt", "rtc") and self.in_scope("ruby"):
            self.implied()
        if tag == "form":
            if self.form is not None:
                return
            self.form = self.push(tag, attrs)
            return
        if tag == "a" and any(n is not None and n.tag == "a" for n in self.active[self.marker() :]):
            self.adopt("a")
            self.active = [n for k, n in enumerate(self.active) if k < self.marker() or n is None or n.tag != "a"]
        if tag == "nobr" and self.in_scope("nobr"):
            self.adopt("nobr")
        if tag == "image":
            tag = "img"
        if tag not in _CLOSES_P and tag not in ("li", "dd", "dt"):
            self.reconstruct()
        if tag in VOID:
            self.put(Node(tag, attrs))
            return
        node = self.push(tag, attrs)
        if tag in FORMATTING:
            same = [k for k in range(self.marker(), len(self.active)) if self.active[k].tag == tag and self.active[k].attrs == attrs]
            if len(same) >= 3:
                del self.active[same[0]]
            self.active.append(node)
        elif tag in ("applet", "marquee", "object"):
            self.active.append(None)

    def marker(self) -> int:
        """Place after the last marker."""
        return next((k + 1 for k in range(len(self.active) - 1, -1, -1) if self.active[k] is None), 0)

    def clear_active(self) -> None:
        del self.active[max(self.marker() - 1, 0) :]

    def to_context(self, *tags: str) -> None:
        while self._open and self.current.tag not in tags and self.current.tag not in ("html", "template"):
            self._open.pop()

    def table_start(self, tag: str, attrs: dict[str, str]) -> bool:
        if not self._open.has("table"):
            # Table parts outside a table are dropped.
            return tag in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        inside = self.in_cell()
        if tag in ("caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th"):
            if inside and self.in_scope(inside):
                self.close_cell(inside)
            if self.in_scope("caption"):
                self.pop_to("caption")
                self.clear_active()
            if tag in ("td", "th"):
                if not any(n.tag == "tr" for n in self.since_table()):
                    self.table_start("tr", {})
                self.to_context("tr")
                self.push(tag, attrs, False)
                self.active.append(None)
            elif tag == "tr":
                if not any(n.tag in ("tbody", "thead", "tfoot") for n in self.since_table()):
                    self.to_context("table")
                    self.push("tbody", {}, False)
                self.to_context("tbody", "thead", "tfoot")
                self.push(tag, attrs, False)
            elif tag == "col":
                if self.current.tag != "colgroup":
                    self.to_context("table")
                    self.push("colgroup", {}, False)
                self.put(Node(tag, attrs), False)
            else:
                self.to_context("table")
                self.push(tag, attrs, False)
                if tag == "caption":
                    self.active.append(None)
            return True
        if inside or any(n.tag == "caption" for n in self.since_table()):
            return False
        if self.current.tag == "colgroup":
            self._open.pop()
        if self.current.tag not in ("table", "tbody", "thead", "tfoot", "tr"):
            return False
        if tag in ("style", "script", "template") or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
            node = self.put(Node(tag, attrs), False)
            if tag != "input":
                self._open.append(node)
            return True
        if tag == "table":
            self.end("table")
        return False

    def since_table(self) -> list[Node]:
        i = next((k for k in range(len(self._open) - 1, -1, -1) if self._open[k].tag == "table"), 0) if self._open.has("table") else 0
        return list(self._open[i:])

    def in_cell(self) -> str:
        return next((n.tag for n in reversed(self.since_table()) if n.tag in ("td", "th")), "")

    def close_cell(self, tag: str) -> None:
        self.implied()
        self.pop_to(tag)
        self.clear_active()

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            self.ensure_body()
            return
        if tag == "head":
            self.ensure_head()
            if self.body is None:
                self.open = [self.html]
            return
        if tag == "br":
            self.start("br", {})
            return
        if tag == "p":
            self.ensure_body()
            if not self.in_scope("p", frozenset(["button"])):
                self.push("p", {})
            self.close_p()
            return
        if self.body is None:
            if self._open.has(tag) and any(n.tag == tag for n in self._open[2:]):
                self.pop_to(tag)
            return
        if tag in FORMATTING:
            self.adopt(tag)
        elif tag in _HEADINGS:
            if any(self.in_scope(h) for h in _HEADINGS):
                self.implied()
                while self._open and self._open.pop().tag not in _HEADINGS:
                    pass
        elif tag in ("td", "th"):
            if self.in_scope(tag):
                self.close_cell(tag)
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and self._open.holds(node):
                self.implied()
                self.open = [n for n in self._open if n is not node]
        elif tag in ("table", "caption", "tbody", "thead", "tfoot", "tr"):
            if self._open.has(tag) and (tag == "table" or any(n.tag == tag for n in self.since_table())):
                cell = self.in_cell()
                if cell:
                    self.close_cell(cell)
                self.pop_to(tag)
                if tag == "caption":
                    self.clear_active()
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope(tag):
                self.implied()
                self.pop_to(tag)
                self.clear_active()
        elif tag in _CLOSES_P or tag in ("button", "li", "dd", "dt", "select"):
            extra = frozenset(["ol", "ul"]) if tag == "li" else frozenset()
            if self.in_scope(tag, extra):
                self.implied(tag)
                self.pop_to(tag)
        else:
            self.any_end(tag)


def parse(source: str) -> Node:
    """Document of an HTML text; never fails."""
    b = _Builder()
    for kind, value, attrs in tokens(source):
        if kind == "text":
            b.text(value)
        elif kind == "start":
            b.start(value, attrs)
        elif kind == "end":
            b.end(value)
        elif kind == "data":
            b.current.append(Node("#data", text=value))
        elif kind == "comment":
            (b.doc if b.html is None else b.current).append(Node("#comment", text=value))
        elif b.html is None:
            b.doc.append(Node("#doctype", text=value))
    b.ensure_body()
    return b.doc
