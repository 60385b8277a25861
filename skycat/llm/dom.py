"""A small tolerant HTML tree for text extraction, and the features of its nodes."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Start tags that end an open paragraph.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Start tag -> tags it ends, up to the list of tags that keep them.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
HIDDEN = frozenset("script style template head title iframe svg textarea select option button datalist noembed noframes xmp".split())

_DECLARATION = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.DOTALL)
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_MARK = re.compile(r"[>\"']")
#: Characters in which a tag is looked for by pattern; longer ones use the page's table of ends.
NEAR = 256
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "depth", "size", "link_size", "tags", "place", "same_before", "kids", "counts")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list = []  # Node or str
        self.depth = parent.depth + 1 if parent else 0
        self.place = self.same_before = 0
        self.kids: list = []
        self.counts: dict[str, int] = {}  # child elements by tag

    def attribute_tokens(self) -> list[str]:
        values = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attributes)]
        text = " ".join(v for k, v in values if k in ("class", "id", "role", "aria-label", "itemprop", "data-role"))
        return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower())


class _Ends:
    """Where tags of a page end: at the first > outside quotes, else (a quote that never closes) at the next >.

    One pass from the page's end finds the end for every mark (>, " or '), so a page full of
    quotes that do not close is read in a time in proportion to its length."""

    def __init__(self, source: str):
        self.marks = [m.start() for m in _MARK.finditer(source)]
        n = len(self.marks)
        self.strict, self.loose = [-1] * (n + 1), [-1] * (n + 1)
        following = {'"': n, "'": n}
        for i in range(n - 1, -1, -1):
            mark = source[self.marks[i]]
            if mark == ">":
                self.strict[i] = self.loose[i] = self.marks[i]
            else:
                # behind the closing quote, if there is one
                self.strict[i] = self.strict[min(n, following[mark] + 1)]
                self.loose[i] = self.loose[i + 1]
                following[mark] = i

    def of(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at ``at``, -1 without one."""
        i = bisect_left(self.marks, at)
        return self.strict[i] if self.strict[i] >= 0 else self.loose[i]


def parse(source: str) -> Node:
    """The tree; text stays undecoded until ``text_of``."""
    root = at = Node("#root", "", None)
    path = _Path()
    pos, n = 0, len(source)
    ends = None
    last = source.rfind(">")  # behind it no tag ends
    while pos < n:
        lt = source.find("<", pos)
        if lt < 0:
            at.children.append(source[pos:])
            break
        if source.startswith(("<!", "<?"), lt):
            m = _DECLARATION.match(source, lt)
            if lt > pos:
                at.children.append(source[pos:lt])
            pos = m.end()
            if m[0].startswith("<![CDATA["):
                at.children.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        close = name = None
        if lt > last:
            pass
        elif m := _TAG.match(source, lt, lt + NEAR):
            close, name, attributes, end = m[1], m[2], m[3], m.end()
        elif m := _NAME.match(source, lt):
            ends = ends or _Ends(source)
            if (end := ends.of(m.end()) + 1) > 0:
                close, name, attributes = m[1], m[2], source[m.end() : end - 1]
        if name is None:  # a bare <
            at.children.append(source[pos : lt + 1])
            pos = lt + 1
            continue
        if lt > pos:
            at.children.append(source[pos:lt])
        pos = end
        tag = name.lower()
        if close:
            at = path.up(at, _closed(at, tag)) if path.holds(tag) else at
            continue
        at = path.up(at, _opened(at, tag, path))
        node = Node(tag, attributes.rstrip("/"), at)
        at.children.append(node)
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCK and tag not in RAW):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(source, pos)
            stop = end.start() if end else n
            node.children.append(source[pos:stop])
            pos = end.end() if end else n
            continue
        at = node
        path.down(tag)
    return root


class _Path:
    """How often each tag is open, and of inline tags how often within the innermost block.

    A tag that is not open needs no climb through its would-be ancestors, so a page of
    unmatched tags is read in a time in proportion to its length."""

    def __init__(self):
        self.open: dict[str, int] = {}
        self.inline: list[dict[str, int]] = [{}]

    def down(self, tag: str) -> None:
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in BLOCK:
            self.inline.append({})
        else:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1

    def up(self, at: Node, to: Node) -> Node:
        """Leave the elements from ``at`` up to its ancestor ``to``."""
        while at is not to:
            self.open[at.tag] -= 1
            if at.tag in BLOCK:
                self.inline.pop()
            else:
                self.inline[-1][at.tag] -= 1
            at = at.parent
        return to

    def holds(self, tag: str) -> bool:
        """Whether an end tag may find its element."""
        return (self.open if tag in BLOCK else self.inline[-1]).get(tag, 0) > 0


def _opened(at: Node, tag: str, path: _Path) -> Node:
    """Where a start tag goes, after the elements it ends."""
    if tag in BLOCK and path.open.get("p"):
        x = at
        while x.parent and x.tag not in ("button", "td", "th", "table", "#root", "div", "article", "section", "li", "body"):
            if x.tag == "p":
                at = x.parent
                break
            x = x.parent
    if tag in CLOSES and any(path.open.get(x) for x in CLOSES[tag][0]):
        ends, keep = CLOSES[tag]
        x = at
        while x.parent and x.tag not in keep:
            if x.tag in ends:
                at = x.parent
            x = x.parent
    return at


def _closed(at: Node, tag: str) -> Node:
    """The element open after an end tag; a tag that is not open is ignored."""
    x = at
    while x.parent:
        if x.tag == tag:
            return x.parent
        if tag not in BLOCK and x.tag in BLOCK:
            return at  # an inline end tag does not end blocks
        x = x.parent
    return at


def text_of(raw: str) -> str:
    return html.unescape(raw) if "&" in raw else raw


#: Attribute tokens with a meaning for the classifier, by kind.
KINDS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip",
    "head": "header masthead banner topbar logo brand hero",
    "foot": "footer foot copyright colophon legal bottom",
    "side": "sidebar side aside rail related recommended popular trending widget secondary complementary more latest tags",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense banner outbrain taboola dfp",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay dialog newsletter subscribe signup subscription toast disclaimer paywall privacy",
    "comment": "comment comments commentlist disqus reply replies respond discussion thread reviews review feedback",
    "share": "share sharing social follow facebook twitter buttons toolbar tools print actions rating",
    "form": "form search searchbox login signin register input field contact",
    "main": "main content article post entry story body text page blog maincontent articlebody",
}
#: Elements whose name says as much as an attribute.
NAMING = frozenset("nav header footer aside form main article".split())
_KIND_OF: dict[str, list[int]] = {}
for _i, _w in enumerate(KINDS.values()):
    for _x in _w.split():
        _KIND_OF.setdefault(_x, []).append(_i)
TAGS = "p h1 h2 h3 h4 h5 h6 li ul ol a div span section article main nav header footer aside form table tr td blockquote pre figure figcaption dl address body".split()
_TAG_NO = {t: i for i, t in enumerate(TAGS)}
N_FEATURES = 18 + 2 * len(KINDS) + len(TAGS)


def strings(root: Node) -> Iterator[str]:
    """All text of a tree in page order, undecoded."""
    stack: list = [root]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            yield item
        else:
            stack.extend(reversed(item.children))


def candidates(root: Node) -> list[Node]:
    """Block nodes in page order, without what scripts, styles and controls hold; sizes are set on the way."""
    out: list[Node] = []
    stack: list[tuple[Node, int, bool]] = [(root, 0, False)]
    order: list[Node] = []
    while stack:  # no recursion: pages may nest deeply
        node, place, link = stack.pop()
        order.append(node)
        node.place = place
        node.size = node.link_size = 0
        node.tags = 1
        if node.tag in BLOCK or node.tag == "#root":
            out.append(node)
        link = link or node.tag == "a"
        kids = node.kids
        for c in node.children:
            if isinstance(c, str):
                node.size += len(c.strip())
            else:
                kids.append(c)
        if link:
            node.link_size = node.size
        seen = node.counts
        todo = []
        for i, c in enumerate(kids):
            c.same_before = seen.get(c.tag, 0)
            seen[c.tag] = c.same_before + 1
            if c.tag not in HIDDEN:
                todo.append((c, i, link))
        stack.extend(reversed(todo))
    for node in reversed(order):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.link_size += node.link_size
            node.parent.tags += node.tags
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: subtree density, attribute tokens (own and inherited), depth, sibling statistics, tag."""
    rows = []
    kinds: dict[int, list] = {}
    none = [0] * len(KINDS)
    no_tag = [0] * len(TAGS)
    whole = max(1, nodes[0].size) if nodes else 1
    for node in nodes:
        up = node.parent
        around, siblings, alike = (up.size, len(up.kids), up.counts.get(node.tag, 1)) if up else (node.size, 1, 1)
        count = node.counts.get
        kids = len(node.kids)
        p = up
        while p is not None and id(p) not in kinds:
            p = p.parent
        inherited = kinds[id(p)] if p is not None else none
        own, any_own = none, 0
        names = node.attribute_tokens() if node.attributes else []
        if node.tag in NAMING:
            names.append(node.tag)
        if names:
            own = none.copy()
            for t in names:
                for k in _KIND_OF.get(t, ()):
                    own[k] = any_own = 1
        kinds[id(node)] = [a | b for a, b in zip(own, inherited, strict=True)] if any_own else inherited
        tag, no = no_tag, _TAG_NO.get(node.tag)
        if no is not None:
            tag = no_tag.copy()
            tag[no] = 1
        rows.append(
            (
                math.log1p(node.size), node.link_size / max(1, node.size), node.size / node.tags, node.size / whole, node.size / max(1, around),
                min(node.depth, 40), math.log1p(siblings), node.place / (siblings - 1) if siblings > 1 else 0.5, node.same_before, alike / max(1, siblings),
                math.log1p(kids), count("p", 0), count("a", 0) / max(1, kids), sum(count(t, 0) for t in ("h1", "h2", "h3", "h4")),
                sum(count(t, 0) for t in ("input", "button", "select", "textarea", "form")), math.log1p(around), up.link_size / max(1, up.size) if up else 0, any_own,
                *own, *inherited, *tag,
            )
        )
    return np.array(rows, np.float32).reshape(-1, N_FEATURES)


def blocks(root: Node, nodes: list[Node], kept: np.ndarray) -> str:
    """The text of the kept nodes: white space in a block as one space, blocks joined by a line end."""
    keep = {id(n) for n, k in zip(nodes, kept, strict=True) if k}
    done: list[str] = []
    run: list[str] = []

    def flush() -> None:
        t = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if t:
            done.append(t)

    stack: list[tuple] = [(root, True)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if inside:
                run.append(text_of(item))
        elif item.tag == "br":
            run.append(" ")
        elif item.tag not in HIDDEN:
            block = item.tag in BLOCK or item.tag == "#root"
            if block:
                flush()
                stack.append((None, False))
                inside = id(item) in keep
            stack.extend((c, inside) for c in reversed(item.children))
    flush()
    return "\n".join(done)

