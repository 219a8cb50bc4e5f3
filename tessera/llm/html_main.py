"""Main text of web pages by tree scoring.

A page is read into a tree of elements once, and its text into blocks. What never holds the article
(navigation, footers, scripts, what is hidden) is left out as it opens. Forms, and elements named or marked
as sidebar, advert, notice or comments, are only suspected until the whole page is known: one that holds
the page's only articles, or most of its text, is a wrapper and stays (see `settled`); the others go. Each
block left passes points for its length and its commas to its container, half of them to the next ancestor
and less to those above; points are discounted by the share of link text. The best container is kept (the
article or main element around it, if any) with those siblings whose points are near its own, and with
every other article of the page that is not mostly links.

Defined results: null and empty html, and pages without text, give an empty text; unclosed and
stray tags are repaired as browsers do for paragraphs, list items and table cells; a page cut off
in mid-tag or mid-script ends there; elements nested over 512 deep are siblings; of containers with equal points the first is best; rows that repeat
are read one by one.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and naming habits of web pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math canvas object audio video select".split())
DROPPED = frozenset("head nav footer aside button dialog menu datalist".split())
SUSPECT = frozenset("form fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements deeper than this become siblings, as in browsers; what is done for each block stays bounded.
DEPTH = 512
#: Parts of a text, never its container.
INNER = frozenset("p pre li ul ol dl dt dd blockquote h1 h2 h3 h4 h5 h6 hgroup table caption thead tbody tfoot tr td th figure figcaption details summary".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NOT_ARTICLE = frozenset(
    """ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies disclaimer disqus
    footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended related
    replies reply respond responses search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe teaser toolbar tooltip widget widgets""".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond responses".split())
#: Beginnings and ends of names that say how an element is laid out, not what it is.
MODIFIERS = frozenset("has no with without is not show hide use enable enabled disabled on off open closed active".split())
ARTICLE = frozenset("article articlebody body content entry hentry main post story text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")


class Node:
    """dropped: never part of an article; suspect: by its marks (2: as comments) hardly part of one."""

    __slots__ = ("tag", "parent", "dropped", "suspect", "bonus", "points", "chars", "links", "in_link")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, suspect: int = 0, bonus: float = 0.0):
        self.tag, self.parent, self.dropped, self.suspect, self.bonus = tag, parent, dropped, suspect, bonus
        self.points, self.chars, self.links = 0.0, 0, 0
        self.in_link = tag == "a" or parent is not None and parent.in_link


def parts_of(names: str) -> tuple[set[str], set[str]]:
    """The parts of class names and ids, and those of names that do not only describe a layout."""
    every, telling = set(), set()
    for name in names.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        every.update(parts)
        if parts and not (parts[0] in MODIFIERS or parts[-1] in MODIFIERS):
            telling.update(parts)
    return every, telling


def opened(tag: str, attributes: str, parent: Node) -> Node:
    """The element, and what its name and marks say of it."""
    if parent.dropped:
        return Node(tag, parent, True)
    dropped, suspect, bonus = tag in DROPPED or tag == "header" and not within(parent, ("article", "main")), int(tag in SUSPECT), 0.0
    if tag in ("article", "main"):
        bonus = 25.0
    if attributes and not attributes.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        every, names = parts_of(f"{found.get('class', '')} {found.get('id', '')}")
        dropped |= "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        if tag not in ("html", "body", "main", "h1"):
            if tag in ("article", "p"):
                names &= COMMENTS | {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "related", "teaser", "cookie", "cookies"}
            suspect = 2 if names & COMMENTS else int(suspect or bool(names & NOT_ARTICLE) or found.get("role", "").lower() in ROLES)
        if every & ARTICLE or found.get("role") in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
            bonus += 25.0
    return Node(tag, parent, dropped, suspect, bonus)


def ancestors(node: Node | None):
    """The node and all above it."""
    while node is not None:
        yield node
        node = node.parent


def within(node: Node | None, tags: tuple[str, ...]) -> Node | None:
    """The outermost of the node and its ancestors that has one of the tags."""
    found = None
    while node is not None:
        found = node if node.tag in tags else found
        node = node.parent
    return found


def read(page: str) -> list[tuple[Node, list[tuple[Node, str]]]]:
    """Blocks in page order, each with its innermost block element and its pieces of text with the element of each."""
    root = Node("#root", None)
    stack, out, parts, at, end = [root], [], [], 0, len(page)

    def flush() -> None:
        if parts:
            out.append((next(n for n in reversed(stack) if n.tag in BLOCK or n is root), parts.copy()))
            parts.clear()

    def add(text: str) -> None:
        if text and not stack[-1].dropped:
            parts.append((stack[-1], html.unescape(text)))

    def close(down_to: int) -> None:
        if any(n.tag in BLOCK for n in stack[down_to:]):
            flush()
        del stack[down_to:]

    while at < end:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        m = TOKEN.match(page, start)
        if not m:  # a sign that opens nothing
            add("<")
            at = start + 1
            continue
        at = m.end()
        if m[1]:
            add(m[1])
        if not m[3]:
            continue
        tag = m[3].lower()
        if not m[5]:  # the page is cut off inside a tag
            break
        if m[2]:
            if tag == "br":
                add(" ")
                continue
            back = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if back and (tag in BLOCK or not any(n.tag in BLOCK for n in stack[back + 1 :])):
                close(back)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
            back = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
            if back and not any(n.tag in ("td", "th", "button") for n in stack[back:]):
                close(back)
            if tag in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in SCOPE[tag]:
                        break
                    if stack[i].tag in CLOSES[tag]:
                        close(i)
        if tag in VOID or m[4].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        if len(stack) > DEPTH:
            close(DEPTH)
        stack.append(opened(tag, m[4], stack[-1]))
    flush()
    return out


def settled(read_blocks: list[tuple[Node, list[tuple[Node, str]]]]) -> list[tuple[Node, str]]:
    """Blocks of text without what suspected elements hold, but for wrappers.

    Where no article stands outside of them and less than half of the text does, those around the articles
    are wrappers; without articles, so are those that hold over half of the text and are not comments."""
    sizes: dict[Node, int] = {}
    total = free = 0
    for _, pieces in read_blocks:
        for node, text in pieces:
            size = len(text.strip())
            suspected = False
            for n in ancestors(node):
                if n.suspect or n.tag in ("article", "main"):
                    sizes[n] = sizes.get(n, 0) + size
                    suspected = suspected or n.suspect > 0
            total += size
            free += 0 if suspected else size
    articles = [n for n in sizes if n.tag in ("article", "main") and not n.suspect and sizes[n]]
    if 2 * free < total and not any(all(not n.suspect for n in ancestors(a)) for a in articles):
        most = max((sizes[a] for a in articles), default=0)
        wrapped = [n for a in articles if 2 * sizes[a] >= most for n in ancestors(a)]
        for n in wrapped or [n for n, size in sizes.items() if 2 * size > total and n.suspect == 1]:
            n.suspect = 0
    out = []
    for home, pieces in read_blocks:
        kept = [(n, t) for n, t in pieces if not any(a.suspect for a in ancestors(n))]
        text = SPACE.sub(" ", "".join(t for _, t in kept)).strip()
        if text:
            out.append((home, text))
            linked = min(sum(len(t) for n, t in kept if n.in_link), len(text))
            for n in ancestors(home):
                n.chars += len(text)
                n.links += linked
    return out


def density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def main_text(page: str | None) -> str:
    found = settled(read(page or ""))
    if not found:
        return ""
    nodes: dict[Node, None] = {}
    for home, text in found:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        node = home
        while node.tag in INNER and node.parent is not None:
            node = node.parent
        for level, n in enumerate(ancestors(node)):
            n.points += points / (1, 2, 6, 9, 12)[min(level, 4)]
            nodes[n] = None
    score = lambda n: (n.points + n.bonus) * (1 - density(n))
    best = max(nodes, key=score)
    best = within(best, ("article",)) or within(best, ("main",)) or best
    keep = {best, *(n for n in nodes if n.tag == "article" and density(n) < 0.5)}
    least = max(10.0, 0.2 * score(best))
    for home, text in found:  # siblings: the child of best's parent that holds the block
        node = next((n for n in ancestors(home) if n.parent is best.parent), None)
        if node is not None and best.parent is not None and node is not best:
            near = node in nodes and score(node) - node.bonus >= least
            if near or node.tag == "p" and density(node) < 0.25 and len(text) > 80 or node.tag == "h1":
                keep.add(node)
    return "\n\n".join(text for home, text in found if any(n in keep for n in ancestors(home)))


def extracted(pages: DataFrame, page: str = "html") -> DataFrame:
    """The columns of pages without the html, and text and n_chars."""
    kept = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    return pages.select(*kept, F.col(page).cast("string")).mapInArrow(run, schema)
