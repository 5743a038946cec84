"""Block-level trees of HTML pages: a small helper of the extraction.

Elements that start a block become nodes; inline elements only mark their text (links).
End tags that HTML implies are supplied, stray ones passed over. A segment is the text of a
node between two changes of block, so the page's text is its segments in order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head script style noscript template svg math iframe object canvas audio video map textarea select button datalist".split()
)
IN_HEAD = frozenset("title meta link base script style noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "header hgroup legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an element's start tag ends, if open and not beyond one of the walls.
ENDS = {
    **dict.fromkeys(BLOCK - frozenset("td th tr tbody thead tfoot caption dd dt li option optgroup".split()), ({"p"}, {"td", "th", "caption"})),
    **dict.fromkeys(HEADINGS, ({"p", *HEADINGS}, {"td", "th", "div", "section", "article"})),
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    names: frozenset[str] = frozenset()
    hidden: bool = False
    mark: str | None = None
    chars: int = 0  # of its own segments, without white space at the ends
    words: int = 0
    linked: int = 0  # characters inside links


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: node and text, white space as one space, in page order
    segments: list[tuple[int, str]] = field(default_factory=list)


def _names(attributes: dict[str, str | None]) -> frozenset[str]:
    """Lower-case words of class, id and role."""
    given = " ".join(attributes.get(k) or "" for k in ("class", "id", "role"))
    return frozenset(w.lower() for w in _NAME.findall(given)) if given.strip() else frozenset()


#: Elements in which a slash ends a tag's element, and elements in them that hold HTML again.
FOREIGN = frozenset(("svg", "math"))
INTEGRATION = frozenset(("foreignobject", "desc", "title", "mi", "mo", "mn", "ms", "mtext"))


class _Builder(HTMLParser):
    def __init__(self, mark: str | None):
        super().__init__(convert_charrefs=True)
        self.page = Page([Node("body", -1, 0)])
        #: open elements: tag and node (None for inline ones)
        self.open: list[tuple[str, int | None]] = []
        self.blocks = [0]
        self.unseen = self.links = 0
        self.text: list[str] = []
        self.mark = mark

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                node = self.page.nodes[self.blocks[-1]]
                node.chars += len(text)
                node.words += text.count(" ") + 1
                self.page.segments.append((self.blocks[-1], text))

    def _pop(self) -> None:
        tag, node = self.open.pop()
        self._left(tag, node)

    def _left(self, tag: str, node: int | None) -> None:
        self.unseen -= tag in UNSEEN
        self.links -= tag == "a"
        if node is not None:
            self._flush()
            self.blocks.pop()

    def _end_implied(self, tag: str) -> None:
        ended, walls = ENDS.get(tag, ((), ()))
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ended:
                while len(self.open) > k:
                    self._pop()
                break
            if self.open[k][0] in walls:
                break

    def _node(self, tag: str, parent: int, depth: int, attributes: dict[str, str | None], filled: Node | None = None) -> Node:
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style") or ""))
        mark = attributes.get(self.mark) if self.mark else None
        node = Node(tag, parent, depth, _names(attributes), hidden, mark)
        if filled:
            node.chars, node.words, node.linked = filled.chars, filled.words, filled.linked
        return node

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._pop()
        if tag in VOID:
            if tag == "hr":
                self._end_implied("div")
                self._flush()
            elif tag == "br":
                self.text.append(" ")
            return
        if tag == "body":
            self.page.nodes[0] = self._node(tag, -1, 0, dict(attrs), self.page.nodes[0])
        if tag in ("html", "body"):
            return
        if tag in BLOCK and not self.unseen:
            self._end_implied(tag)
            self._flush()
            parent = self.blocks[-1]
            self.page.nodes.append(self._node(tag, parent, self.page.nodes[parent].depth + 1, dict(attrs)))
            self.blocks.append(len(self.page.nodes) - 1)
            self.open.append((tag, self.blocks[-1]))
            return
        self.unseen += tag in UNSEEN
        self.links += tag == "a"
        self.open.append((tag, None))

    def _foreign(self) -> bool:
        """Whether an element would be part of an svg or math element here."""
        for tag, _ in reversed(self.open):
            if tag in FOREIGN or tag in INTEGRATION:
                return tag in FOREIGN
        return False

    def handle_startendtag(self, tag: str, attrs) -> None:
        # elsewhere HTML passes over the slash
        if tag not in FOREIGN and not self._foreign():
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.text.append(" ")
            return
        inner_block = False
        for k in range(len(self.open) - 1, -1, -1):
            own, node = self.open[k]
            if own == tag:
                if node is None and inner_block:
                    # an inline element that ends within a block begun inside it
                    del self.open[k]
                    self._left(own, None)
                else:
                    while len(self.open) > k:
                        self._pop()
                return
            inner_block |= node is not None

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)
            if self.links:
                self.page.nodes[self.blocks[-1]].linked += len(data)


def parse(html: str | None, mark: str | None = None) -> Page:
    """mark: an attribute whose value is kept on nodes (labels of training pages)."""
    builder = _Builder(mark)
    builder.feed(html or "")
    builder.close()
    builder._flush()
    return builder.page
