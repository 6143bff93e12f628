"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors; a container's points are
discounted by its share of linked text. The best container, and siblings of it that score well or read
like prose, are kept. Elements that are never article text (menus, headers, footers, asides, scripts, styles)
are cut out before scoring. Containers whose class, id or role sounds like a sidebar, notice, advert or reader
comments, and forms, are cut out too, unless most of the page's unlinked text lies in them: such a wrapper
around a whole page is only unwrapped, and has half its points. Words of layout and state (`has-sidebar`,
`no-comments`, `comments-open`) name no content and do not count.

A page is one row and one small tree; Spark distributes the pages. Null or empty html gives an empty
text. A page without paragraphs is scored by its text blocks; without any text the result is empty.
Repeated rows give repeated results. Nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import tidy

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")

# Fixed values of HTML: elements without an end tag, with raw text, and those that start a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# What is never article text, by element, by word of class or id, and by role.
DROP_TAGS = frozenset(
    "script style noscript iframe template svg math canvas object embed nav footer aside button select textarea "
    "input label dialog menu head title audio video".split()
)
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner nav "
    "navbar navigation menu menubar breadcrumb breadcrumbs sidebar rail footer masthead cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup login popup modal overlay comment comments commentlist "
    "respond reply replies disqus share sharing social related recommended recommendations trending popular widget widgets "
    "toolbar pagination pager skip skiplink search tags outbrain taboola paywall disclaimer".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
KEEP_TAGS = frozenset("html body article main".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
LAYOUT_WORDS = frozenset("has no with without not non".split())  # in front: `has-sidebar`
STATE_WORDS = frozenset("open closed enabled disabled on off".split())  # behind: `comments-open`
MOST, NEARLY_ALL = 0.5, 0.95  # shares of the unlinked text above which a wrapper stays; readers' comments can be long


class _Node:
    __slots__ = ("tag", "parent", "children", "words", "drop", "share", "points", "text", "linked", "commas")

    def __init__(self, tag: str, parent: _Node | None, drop: bool, share: float, words: frozenset):
        self.tag, self.parent, self.drop, self.share, self.words = tag, parent, drop, share, words
        self.children: list[_Node | str] = []
        self.points, self.text, self.linked, self.commas = 0.0, 0, 0, 0


def _unwanted(tag: str, attributes: str) -> tuple[bool, float, frozenset]:
    """(never article text, share of the page's text up to which it is cut, words of class and id)."""
    if tag in DROP_TAGS:
        return True, 0.0, frozenset()
    share = MOST if tag == "form" else 0.0
    if not attributes or attributes.isspace():
        return False, share, frozenset()
    words: set[str] = set()
    hidden = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id"):
            for one in value.split():
                parts = [x for x in _SPLIT.split(one) if x]
                if parts and parts[0] not in LAYOUT_WORDS and parts[-1] not in STATE_WORDS:
                    words.update(parts)
        elif name == "role" and value.strip() in DROP_ROLES:
            share = MOST
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    if tag in KEEP_TAGS and not (tag == "article" and words & {"comment", "comments", "reply"}):
        return hidden, 0.0, frozenset(words)
    if words & DROP_WORDS:
        share = NEARLY_ALL if words & COMMENT_WORDS else max(share, MOST)
    return hidden, share, frozenset(words)


def parse(page: str) -> _Node:
    """A tree of the elements, tolerant of missing and stray end tags."""
    root = here = _Node("#root", None, False, 0.0, frozenset())
    at, end = 0, len(page)
    lowered = None
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            here.children.append(page[at:])
            break
        if found.start() > at:
            here.children.append(page[at:found.start()])
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            node = here
            while node is not root and node.tag != tag:
                if tag not in BLOCK and node.tag in BLOCK:  # a stray inline end tag closes no block
                    node = root
                    break
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if tag in BLOCK:
            node = here
            while node is not root and node.tag != "p" and (node.tag not in BLOCK):
                node = node.parent
            if node.tag == "p":  # a block ends an open paragraph
                here = node.parent
        if tag in CLOSES:
            closed, border = CLOSES[tag]
            node, last = here, None
            while node is not root and node.tag not in border:
                if node.tag in closed:
                    last = node
                node = node.parent
            if last is not None:
                here = last.parent
        node = _Node(tag, here, *_unwanted(tag, attributes))
        here.children.append(node)
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            if lowered is None:
                lowered = page.lower() if len(page.lower()) == len(page) else page
            stop = lowered.find(f"</{tag}", at)
            stop = end if stop < 0 else stop
            node.children.append(page[at:stop])
            close = page.find(">", stop)
            at = end if close < 0 else close + 1
            continue
        here = node
    return root


def _squeeze(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _drop_page_headers(node: _Node) -> None:
    """A header is the page's, not the article's, unless it lies in an article or main element with a headline."""
    stack = [(node, False)]
    while stack:
        current, inside = stack.pop()
        for child in current.children:
            if isinstance(child, _Node) and not child.drop:
                kept = inside or child.tag in ("article", "main")
                if child.tag == "header" or "header" in child.words and child.tag in ("div", "section"):
                    child.drop = not (inside and any(isinstance(x, _Node) and x.tag in HEADS for x in child.children))
                stack.append((child, kept))


def _cut_suspects(root: _Node) -> None:
    """Containers that sound unwanted go, but for those that hold most of the page's unlinked text."""
    order = _measure(root)
    whole = root.text - root.linked
    for node in order:
        if node.share and node.text - node.linked <= node.share * whole:
            node.drop = True


def _measure(root: _Node) -> list[_Node]:
    """Text length, linked length and commas of each kept element; elements in page order."""
    order: list[_Node] = []
    stack = [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        node.text = node.linked = node.commas = 0
        linked = linked or node.tag == "a"
        for child in node.children:
            if isinstance(child, str):
                text = _squeeze(child)
                node.text += len(text)
                node.linked += len(text) * linked
                node.commas += sum(text.count(c) for c in ",，、،")
            elif not child.drop:
                stack.append((child, linked))
    for node in reversed(order):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
            node.parent.commas += node.commas
    return order


def _density(node: _Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _below(node: _Node, top: _Node) -> bool:
    while node is not None and node is not top:
        node = node.parent
    return node is top


def _blocks(node: _Node, out: list[str]) -> None:
    """Texts of the blocks below `node` in page order."""
    buffer: list[str] = []

    def flush():
        text = _squeeze("".join(buffer))
        buffer.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            buffer.append(item)
        elif item.drop:
            continue
        elif item.tag == "br":
            buffer.append(" ")
        else:
            block = item.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()


def _score(order: list[_Node]) -> list[_Node]:
    """Containers with points: all of a paragraph's for its parent, a half for the next, then a sixth and a ninth."""
    scored: list[_Node] = []
    for least in (25, 1):  # a page of short paragraphs only is scored by those
        for node in order:
            if node.tag in ("p", "pre", "blockquote", "td", "li", "dd") and node.text >= least:
                points = (1 + node.commas + min(node.text / 100, 3)) * (1 - _density(node))
                parent, share = node.parent, 1.0
                level = 0
                while parent is not None and level < 4:
                    if not parent.points:
                        scored.append(parent)
                    parent.points += points * share
                    level += 1
                    share = 1 / (2 if level == 1 else 3 * level)
                    parent = parent.parent
        if scored:
            return scored
    scored = [n for n in order if n.text]
    for n in scored:
        own = sum(len(_squeeze(c)) for c in n.children if isinstance(c, str))
        n.points += own / 100 + n.text / 1e6
    return scored


def main_text(page: str | None) -> str:
    """The article of a page: blocks joined by an empty line."""
    if not page:
        return ""
    root = parse(page)
    _drop_page_headers(root)
    _cut_suspects(root)
    scored = _score(_measure(root))
    if not scored:
        return ""
    value = {id(n): n.points * (1 - _density(n)) * (0.5 if n.share else 1) for n in scored}
    best = max(scored, key=lambda n: value[id(n)])
    if best.tag in ("ul", "ol", "dl", "table", "tbody", "tr") and best.parent is not None:
        best = best.parent
    node = best
    while node.parent is not None:  # the article element around the best container is the article
        node = node.parent
        if node.tag in ("article", "main") and _density(node) < 0.5:
            best = node
            if node.tag == "article":
                break
    if best.tag not in ("article", "main"):  # and an article inside the best container, if it holds much of the points
        inner = [n for n in scored if n.tag in ("article", "main") and _below(n, best)]
        chosen = max(inner, key=lambda n: (value[id(n)], n.tag == "article"), default=None)
        if chosen is not None and value[id(chosen)] >= 0.3 * value.get(id(best), 0.0):
            best = chosen
    out: list[str] = []
    if best.parent is None or best.tag in ("article", "main", "body", "html"):
        _blocks(best, out)
        return "\n\n".join(out)
    bar = max(10.0, 0.2 * value.get(id(best), 0.0))
    for sibling in best.parent.children:
        if isinstance(sibling, str) or sibling.drop:
            continue
        prose = sibling.tag in HEADS or sibling.tag in ("p", "blockquote", "pre", "figure", "ul", "ol", "table")
        if sibling is best or value.get(id(sibling), 0.0) >= bar or prose and sibling.text and _density(sibling) < 0.25:
            _blocks(sibling, out)
    return "\n\n".join(out)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    source = pages.select(key, url, page)
    schema = f"{key} {dict(source.dtypes)[key]}, {url} {dict(source.dtypes)[url]}, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[key, url, "text", "n_chars"],
            )

    return source.mapInArrow(tidy(run), schema)
