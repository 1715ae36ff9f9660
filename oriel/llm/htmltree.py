"""A small tolerant HTML tree, built in time linear in the page.

Block elements are nodes, and so are inline ones whose attributes say something;
other inline markup is folded into the text around it.
"""

from __future__ import annotations

import functools
import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: What holds no text of the page, whatever surrounds it.
SILENT = frozenset("script style head title template svg math iframe noembed noframes noscript button select textarea object canvas audio video datalist".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Start tags that end an open sibling, and what the search for it stops at.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)", re.S)
#: The same where quotes are not to be trusted: a tag ends at the first angle bracket.
PLAIN_TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)", re.S)
OPEN = re.compile(r"<[a-zA-Z/!?]")
ATTR = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORD = re.compile(r"[a-z]+")


class Node:
    """A block element, or an inline one with attributes. ``parts`` holds its own text, in pieces, and its children, in page order."""

    __slots__ = ("tag", "parent", "children", "parts", "tokens", "inline", "depth", "chars", "words", "link_chars", "links", "nodes", "marks", "place", "own")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset[str] = frozenset(), inline: bool = False):
        self.tag, self.parent, self.tokens, self.inline = tag, parent, tokens, inline
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.words = self.link_chars = self.links = self.nodes = self.marks = self.place = self.own = 0


def attribute_tokens(text: str) -> frozenset[str]:
    """Lower-case words of the id, class, role and similar attributes."""
    out: set[str] = set()
    for name, a, b, c in ATTR.findall(text):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label", "data-component"):
            out.update(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()))
    return frozenset(out)


class _Open:
    """The open elements, with the places of each tag, so that no tag looks through them all."""

    def __init__(self, root: Node):
        #: (tag, node that takes the text, whether the element is a node of its own)
        self.items: list[tuple[str, Node, bool]] = [("html", root, True)]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.blocks: list[int] = [0]
        self.silent = self.links = 0

    @property
    def node(self) -> Node:
        return self.items[-1][1]

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag, or -1."""
        at = self.places.get(tag)
        return at[-1] if at else -1

    def push(self, tag: str, node: Node, own: bool) -> None:
        if tag not in INLINE:
            self.blocks.append(len(self.items))
        self.places.setdefault(tag, []).append(len(self.items))
        self.items.append((tag, node, own))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def close(self, depth: int) -> None:
        while len(self.items) > max(depth, 1):
            tag, _, _ = self.items.pop()
            self.places[tag].pop()
            if self.blocks[-1] == len(self.items):
                self.blocks.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"


def parse(page: str) -> Node:
    """The tree of a page; markup that is never closed or never opened does no harm.

    A tag whose quotes do not end on the page ends at its first angle bracket, and so does
    each later one; text after the last angle bracket that ends a tag is text.
    """
    root = Node("html", None)
    open_ = _Open(root)
    at, n, final = 0, len(page), page.rfind(">")
    pattern = TAG

    def say(text: str) -> None:
        if open_.silent or not text:
            return
        node = open_.node
        text = html.unescape(text) if "&" in text else text
        node.parts.append(text)
        size = len(text) - text.count(" ") - text.count("\n")
        node.chars += size
        node.own += size
        node.words += len(text.split())
        node.marks += text.count(".") + text.count(",") + text.count("?") + text.count("!")
        if open_.links:
            node.link_chars += size

    def add(tag: str, attributes: str, inline: bool) -> None:
        tokens = attribute_tokens(attributes) if "=" in attributes else frozenset()
        if "-" in tag:  # a custom element says what it is
            tokens |= frozenset(WORD.findall(tag))
        if inline and not tokens:
            open_.push(tag, open_.node, False)
            return
        parent = open_.node
        node = Node(tag, parent, tokens, inline)
        parent.parts.append(node)
        node.place = len(parent.children)
        parent.children.append(node)
        open_.push(tag, node, True)

    while at < n:
        m = OPEN.search(page, at)
        if m is None or m.start() > final and not page.startswith("<!", m.start()):
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.start()
        m = pattern.match(page, at)
        if m is None and pattern is TAG and page.startswith("<", at) and at < final:
            # looked at once to the end of the page, and not again
            if page[at + 1].isalpha() or page[at + 1 : at + 2] == "/" and page[at + 2 : at + 3].isalpha():
                pattern = PLAIN_TAG
            m = pattern.match(page, at)
        if m is None:
            say(page[at])
            at += 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if not m[1]:
                add(tag, m[3], True)
                if tag == "a":
                    open_.node.links += 1
            elif (i := open_.last(tag)) > open_.blocks[-1]:
                open_.close(i)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and not m[1]:
                say(" " if tag != "wbr" else "")
            continue
        if m[1]:
            if (i := open_.last(tag)) > 0:
                open_.close(i)
            continue
        if tag in ENDS_P or tag in SIBLINGS:
            ends, bounds = SIBLINGS.get(tag, ({"p"}, {"td", "th", "li", "button", "table", "html"}))
            bound = max(open_.last(x) for x in bounds - ends)
            i = max(open_.last(x) for x in ends)
            if i > max(bound, 0):
                open_.close(i)
        if tag in ("html", "body") and open_.last(tag) >= 0:
            continue
        if tag == "body":
            open_.close(1)  # a head that was not closed
        if tag in RAW:
            at = raw_end(tag, page, at)
            continue
        add(tag, m[3], False)
    _sum(root)
    return root


@functools.cache
def raw_close(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def raw_end(tag: str, page: str, at: int) -> int:
    """Where the content of a raw element that began at ``at`` is over; a closing tag without > runs to the end, found in one pass."""
    close = raw_close(tag).search(page, at)
    end = page.find(">", close.end()) if close else -1
    return end + 1 if end >= 0 else len(page)


def walk(root: Node) -> list[Node]:
    """Every node, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


def _sum(root: Node) -> None:
    for node in reversed(walk(root)):
        node.nodes += 1
        if node.parent is not None:
            p = node.parent
            p.chars += node.chars
            p.words += node.words
            p.link_chars += node.link_chars
            p.links += node.links
            p.nodes += node.nodes
            p.marks += node.marks


def blocks(root: Node, kept: set[int]) -> list[str]:
    """Text blocks of the nodes whose ``id()`` is kept, white space as one space, in page order.

    Inline nodes continue the text around them; others begin and end a block.
    """
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    todo: list[str | Node | None] = [root]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            run.append(part)
        elif part.inline:
            if id(part) in kept:
                todo += reversed(part.parts)
        else:
            flush()
            todo.append(None)
            if id(part) in kept:
                todo += reversed(part.parts)
    flush()
    return out
