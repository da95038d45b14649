"""A page as an ordered, labelled tree in region encoding.

Nodes stand in document order; a node's descendants are the ``size`` nodes
behind it. Rules of recovery: void elements have no content; p ends before block
elements; li, dt, dd, option, tr, td and th end before their like; script and
style hold raw text; html and body are implied; what cannot be parsed is an
empty page.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEAD = frozenset("title meta link style script base noscript template".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th"), "thead": ("tr", "td", "th")}
SCOPE = frozenset("table ul ol dl select body html article section div".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
_PLAIN = re.compile(r"<(/?)([a-z][a-z0-9]*)>")


@dataclass(slots=True)
class Node:
    pre: int
    tag: str
    attrs: dict[str, str]
    parent: int
    level: int
    size: int = 0
    content: list[int | str] = field(default_factory=list)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.open: list[int] = []
        self.names: dict[str, str] = {}  # of tags and attributes, each kept once
        self.classed: dict[str, dict[str, str]] = {}  # attributes of elements with a class and nothing else

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines

    def parse_starttag(self, i):
        """Tags without attributes need no more than one pattern."""
        plain = _PLAIN.match(self.rawdata, i)
        if not plain or plain[1] or plain[2] in RAW:
            return super().parse_starttag(i)
        self.handle_starttag(plain[2], [])
        return plain.end()

    def parse_endtag(self, i):
        plain = _PLAIN.match(self.rawdata, i)
        if not plain or not plain[1] or plain[2] in RAW or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[2])
        return plain.end()

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        parent = self.open[-1] if self.open else -1
        node = Node(len(self.nodes), self.names.setdefault(tag, tag), attrs, parent, len(self.open))
        self.nodes.append(node)
        if parent >= 0:
            self.nodes[parent].content.append(node.pre)
        self.open.append(node.pre)

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.nodes[self.open.pop()]
            node.size = len(self.nodes) - node.pre - 1

    def _depth_of(self, tags: tuple[str, ...]) -> int | None:
        """Depth of the nearest open element of ``tags`` that no element of scope hides."""
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.nodes[self.open[depth]].tag
            if tag in tags:
                return depth
            if tag in SCOPE:
                return None
        return None

    def _imply(self, tag: str) -> None:
        if not self.open:
            self._push("html", {})
        if len(self.open) == 1 and tag not in ("head", "body", "frameset") and tag not in HEAD:
            self._push("body", {})
        elif len(self.open) == 2 and self.nodes[self.open[1]].tag == "head" and tag not in HEAD:
            self._pop_to(1)
            if tag != "body":
                self._push("body", {})

    def handle_starttag(self, tag, attrs):
        found = {}
        for name, value in attrs:
            found.setdefault(self.names.setdefault(name, name), value or "")
        if tag == "html" and self.nodes:
            self.nodes[0].attrs.update({k: v for k, v in found.items() if k not in self.nodes[0].attrs})
            return
        if tag != "html":
            self._imply(tag)
            if len(found) == 1 and "class" in found:
                found = self.classed.setdefault(found["class"], found)
        if tag == "body" and any(n.tag == "body" for n in self.nodes[:50]):
            return
        if tag in BLOCK and (depth := self._depth_of(("p",))) is not None:
            self._pop_to(depth)
        if tag in ENDS:
            while (depth := self._depth_of(ENDS[tag])) is not None:
                self._pop_to(depth)
        self._push(tag, found)
        if tag in VOID:
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]].tag == tag:
                self._pop_to(depth)
                return

    def handle_data(self, data):
        if not self.open or (len(self.open) <= 2 and self.nodes[self.open[-1]].tag in ("html", "head")):
            if not data.strip():
                return
            self._imply("#text")
        self.nodes[self.open[-1]].content.append(data)


class _Bare(_Builder):
    """Tags alone."""

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, ())

    def handle_data(self, data):
        super().handle_data(data)
        if self.open and (content := self.nodes[self.open[-1]].content) and isinstance(content[-1], str):
            content.pop()


class Page:
    """A parsed page; ``bare`` leaves out attributes and texts."""

    def __init__(self, html: str | None, bare: bool = False):
        builder = _Bare() if bare else _Builder()
        text = html or ""
        collects = gc.isenabled()
        gc.disable()  # a tree has no garbage while it grows, and looking for it takes longer than growing
        try:
            if not text.lstrip("﻿ \t\r\n").startswith("<?xml"):
                builder.feed(text)
                builder.close()
        finally:
            if collects:
                gc.enable()
        builder._pop_to(0)
        self.nodes = builder.nodes
        self._places: list[int] | None = None
        self._like: dict[tuple[int, str], int] = {}

    def descendants(self, node: Node) -> list[Node]:
        return self.nodes[node.pre + 1 : node.pre + 1 + node.size]

    def children(self, node: Node) -> list[Node]:
        return [self.nodes[c] for c in node.content if isinstance(c, int)]

    def text(self, node: Node) -> str:
        """All text below a node."""
        out: list[str] = []
        stack: list[int | str] = [node.pre]
        while stack:
            top = stack.pop()
            if isinstance(top, str):
                out.append(top)
            else:
                stack.extend(reversed(self.nodes[top].content))
        return "".join(out)

    def html(self, node: Node, without: Callable[[Node], bool] = lambda n: False, most: int | None = None) -> str:
        """Markup of a node; elements below it that ``without`` names are left out with all they hold. With ``most`` what lies well behind so many characters may be missing; the last one is no space then."""
        out: list[str] = []
        size = 0
        stack: list[tuple[int | str, bool]] = [(node.pre, False)]  # what is to write, and whether it is markup already
        while stack:
            top, ready = stack.pop()
            if isinstance(top, str):
                out.append(top if ready else escape(top, quote=False))
                if most is not None and (size := size + len(out[-1])) >= most and out[-1][-1:].strip():
                    break
                continue
            n = self.nodes[top]
            if n.pre != node.pre and without(n):
                continue
            out.append("<" + n.tag + "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items()) + ">")
            size += len(out[-1])
            if n.tag not in VOID:
                stack.append((f"</{n.tag}>", True))
                stack.extend((c, n.tag in ("script", "style")) for c in reversed(n.content))
        return "".join(out)

    def xml(self) -> str:
        """The whole tree as well-formed XML; names and characters that XML forbids are left out, an element of a forbidden name is a ``span``."""
        out: list[str] = []
        good = re.compile(r"[A-Za-z_][\w.-]*")
        plain = lambda text: escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\ud800-\udfff]", "", text))
        stack: list[int | str] = [0] if self.nodes else []
        while stack:
            top = stack.pop()
            if isinstance(top, str):
                out.append(top)
                continue
            n = self.nodes[top]
            tag = n.tag if good.fullmatch(n.tag) else "span"
            out.append(f"<{tag}" + "".join(f' {k}="{plain(v or "")}"' for k, v in n.attrs.items() if good.fullmatch(k) and not k.lower().startswith("xmlns")) + ">")
            stack.append(f"</{tag}>")
            stack.extend(c if isinstance(c, int) else plain(c) for c in reversed(n.content))
        return "".join(out)

    def xpath(self, node: Node) -> str:
        """Canonical path; an index only where siblings share the tag."""
        if self._places is None:  # of all elements at once, so that a long listing costs no more than its length
            self._places, seen = [0] * len(self.nodes), {}
            for n in self.nodes:
                self._places[n.pre] = seen[n.parent, n.tag] = seen.get((n.parent, n.tag), 0) + 1
            self._like = seen
        steps = []
        while True:
            steps.append(node.tag + (f"[{self._places[node.pre]}]" if self._like[node.parent, node.tag] > 1 and node.parent >= 0 else ""))
            if node.parent < 0:
                return "/" + "/".join(reversed(steps))
            node = self.nodes[node.parent]

    def skeleton(self) -> str:
        """Opening and closing tags in order, without text or attributes."""
        out: list[str] = []
        level = 0
        for n in self.nodes:
            out.append("/" * (level - n.level) + f"<{n.tag}>")
            level = n.level + 1
        return "".join(out) + "/" * level
