"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul caption".split()
)
#: Elements that hold no article text.
DROP = frozenset(
    "head script style noscript template iframe object embed applet svg math canvas audio video map nav footer aside button "
    "select textarea input option datalist dialog menu title".split()
)
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
#: Blocks whose own text counts as a paragraph (parted by br: as paragraphs inside them).
BOX = frozenset("div section article main center body html #root address details fieldset figure dd".split()) - PARAGRAPH
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that no name or attribute marks.
FRAME = frozenset(("#root", "html", "body", "main", "article"))
#: A start tag of the left ends an open element of the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
P_FENCE = frozenset(("table", "td", "th", "button", "object"))
#: Whole class and id names of what stands beside an article (fixed values). A name that only holds such a word is not one.
BESIDE = re.compile(
    r"(?:ads?|adv|adverts?|advertisements?|advertising|adsense|adsbygoogle|adslot|(?:ads?|advert)[-_][\w-]+|[\w-]+[-_](?:ads?|advert)|"
    r"sponsor(?:s|ed)?(?:[-_]\w+)?|promos?|promotions?|promo[-_](?:box|block|banner|bar|unit)|"
    r"cookies?|cookies?[-_]?(?:notice|banner|bar|consent|popup|message|law)|gdpr(?:[-_]\w+)?|consent|consent[-_](?:banner|bar|popup)|"
    r"notices?|(?:site|top|page|privacy|legal)[-_]notice|notifications?|alert|alert[-_](?:info|warning|danger|success|box|bar)|paywall|"
    r"menu|menubar|nav|navbar|navigation|nav[-_](?:menu|bar|links|list|wrapper)|(?:main|top|site|side|footer|header|primary|mobile)[-_]?(?:menu|nav|navigation|bar)|"
    r"breadcrumbs?|side[-_]?bars?|(?:left|right)[-_]?(?:rail|sidebar)|rail|footer|(?:site|page|post)[-_]?footer|footer[-_]\w+|masthead|site[-_]?header|"
    r"social|social[-_]\w+|share|sharing|share[-_]\w+|related|related[-_](?:posts|articles|links|content|stories|items|news)|recommended(?:[-_]\w+)?|"
    r"more[-_](?:stories|articles|posts|news)|newsletter(?:[-_]\w+)?|subscribe(?:[-_]\w+)?|sign[-_]?up(?:[-_](?:form|box))?|login(?:[-_](?:form|box))?|"
    r"pop[-_]?up|modal|overlay|lightbox|widgets?|widget[-_]area|pagination|pager|tags|tag[-_]list|post[-_]tags|copyright|skip[-_]?link|search|search[-_](?:form|box|bar))",
    re.I,
)
READERS = re.compile(
    r"(?:comments?|comments?[-_]?(?:list|body|area|section|thread|box|form|wrapper|container|item)|(?:user|reader|fb)[-_]comments|"
    r"respond|replies|reply[-_]list|disqus|disqus[-_]thread|discussion|discussion[-_]\w+)",
    re.I,
)
LIKELY = re.compile(r"(?:article|content|entry|main|page|post|story|text|blog)(?:[-_]?(?:body|content|text|main|area))?|body[-_]?(?:text|content)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")


class Node:
    """An element; `dead` ones hold no article text. What only a name or an attribute marks is `marked` as well: revive() may bring it back."""

    __slots__ = ("tag", "names", "parent", "kids", "points", "dead", "marked", "inside", "text", "linked", "links")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.parent, self.kids, self.points = tag, parent, [], 0.0
        self.names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split() if "class" in attrs or "id" in attrs else ()
        self.inside = parent is not None and (parent.inside or parent.tag in ARTICLE)
        self.text = self.linked = self.links = 0
        self.dead = tag in DROP or (tag == "header" and not self.inside)
        self.marked = not self.dead and (_marked(tag, self.names, attrs) or (tag == "article" and self.inside and self.readers()))
        self.dead |= self.marked

    def readers(self) -> bool:
        return any(READERS.fullmatch(n) for n in self.names)


def _marked(tag: str, names, attrs: dict[str, str]) -> bool:
    if tag in FRAME or tag == "header":
        return False
    if tag == "form" or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    return any(BESIDE.fullmatch(n) or READERS.fullmatch(n) for n in names) or ("style" in attrs and bool(HIDDEN.search(attrs["style"])))


def revive(root: Node) -> None:
    """Bring back what only a name or an attribute marks, if it wraps the article.

    It does if it holds most of the page's text outside links and readers' comments and no
    article or main outside such elements has any, or if it holds an article or main with more of it
    than those have. If no text is
    outside such elements, the largest and those nearly as large come back.
    """
    nodes, todo = [], [(root, False, False, False)]
    while todo:
        n, link, main, lost = todo.pop()
        link, main, lost = link or n.tag == "a", main or n.tag in ARTICLE, lost or n.marked
        nodes.append((n, link, main, lost))
        todo += [(k, link, main, lost) for k in n.kids if isinstance(k, Node) and (k.marked or not k.dead)]
    if not any(n.marked for n, *_ in nodes):
        return
    text: dict[int, int] = {}
    inside: dict[int, int] = {}
    living = outside = 0
    for n, link, main, lost in reversed(nodes):
        own = 0 if link else sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        living += own if main and not lost else 0
        outside += 0 if lost else own
        text[id(n)] = 0 if n.marked and n.readers() else text.get(id(n), 0) + own
        inside[id(n)] = text[id(n)] if n.tag in ARTICLE else inside.get(id(n), 0)
        if n.parent is not None:
            up = id(n.parent)
            text[up], inside[up] = text.get(up, 0) + text[id(n)], inside.get(up, 0) + inside[id(n)]
    largest = max(text[id(n)] for n, *_ in nodes if n.marked)
    for n, *_ in nodes:
        if n.marked and text[id(n)]:
            n.dead = not ((not outside and 4 * text[id(n)] > 3 * largest) or (2 * text[id(n)] > text[id(root)] and not living) or inside[id(n)] > living)


class Tree(HTMLParser):
    """Builds the tree of a page; a block's start ends an open p, as browsers do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}  # places on the stack, by tag

    def _end(self, tags, fence=frozenset()) -> None:
        """End the innermost open element of tags, and what is open in it, unless a fence is further in."""
        at = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        if at and at > max((self.open[t][-1] for t in fence if self.open.get(t)), default=0):
            for n in self.stack[at:]:
                self.open[n.tag].pop()
            del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and tag not in ("html", "body"):
            self._end(("p",), P_FENCE)
        if tag in ENDS:
            self._end(ENDS[tag], FENCE[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.stack[-1])
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end((tag,))

    def handle_endtag(self, tag):
        self._end((tag,))

    def handle_data(self, data):
        self.stack[-1].kids.append(data)


def score(root: Node) -> list[Node]:
    """Measure all living elements and give ancestors of paragraphs points; return those with points.

    A paragraph passes points for its length and commas on: whole to its parent, half to
    the element above, less to those further up. So does a box (div, section and the like) with
    text of its own; where that text is parted by br, or stands beside blocks, it is paragraphs
    inside the box, which then gets the whole. Each total is discounted by the share of
    the text that is links and weighed by tag and name. All elements are visited once.
    """
    nodes, todo = [], [(root, False, root)]
    own: dict[int, list[int]] = {}  # by paragraph or block: characters and commas that are not in another one, breaks, blocks inside
    while todo:
        n, link, block = todo.pop()
        if n.tag in BLOCK or n.tag in PARAGRAPH:
            if n is not block:
                own[id(block)][3] += n.tag != "hr"
            block = n
        link = link or n.tag == "a"
        nodes.append(n)
        n.text = n.linked = 0
        n.links = int(n.tag == "a")
        count = own.setdefault(id(block), [0, 0, 0, 0])
        count[2] += n.tag in ("br", "hr")
        for k in n.kids:
            if isinstance(k, str):
                size = len(k) - k.count(" ") if k.isspace() else len(SPACE.sub(" ", k))
                size = 0 if k.isspace() else size
                n.text += size
                n.linked += size * link
                count[0] += size
                count[1] += k.count(",")
            elif not k.dead:
                todo.append((k, link, block))
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.text, n.parent.linked, n.parent.links = n.parent.text + n.text, n.parent.linked + n.linked, n.parent.links + n.links
    found: dict[int, Node] = {}
    for n in nodes:
        size, commas, breaks, inner = own.get(id(n), (0, 0, 0, 0)) if n.tag in PARAGRAPH or n.tag in BOX else (0, 0, 0, 0)
        if not size:
            continue
        several = n.tag in BOX and (breaks or inner)
        points = min(1.0, size / 25) + commas + min(size / 100, 3.0 * (1 + breaks * several))
        level, up = 0, n if several else n.parent
        while up is not None and level < 6:
            up.points += points / (1, 2, 6, 9, 12, 15)[level]
            found[id(up)] = up
            level, up = level + 1, up.parent
    for n in found.values():
        n.points *= (1 - n.linked / n.text if n.text else 0.0) * (1.5 if n.tag in ARTICLE else 1.0) * (1.25 if any(map(LIKELY.fullmatch, n.names)) else 1.0)
    return list(found.values())


def select(root: Node) -> list[Node]:
    """The best container, or the article that it is part of, and the siblings that belong to it: beside what isn't an article also any with more text."""
    scored = score(root)
    if not scored:  # no paragraph: all text there is
        return [root]
    best = max(scored, key=lambda n: n.points)
    whole, up = best, best.parent
    while up is not None:  # outwards to the article; to a main only where no article is
        if up.tag == "article" or (up.tag == "main" and whole.tag != "article"):
            whole = up
        up = up.parent
    if whole.parent is None:
        return [whole]
    keep, least = [], max(2.0, 0.2 * best.points)
    for k in whole.parent.kids:
        if not isinstance(k, Node) or k.dead:
            continue
        plain = k.text and 4 * k.linked < k.text
        if k is whole or (whole.tag not in ARTICLE and k.text - k.linked > whole.text - whole.linked):
            keep.append(k)
        elif whole.tag in ARTICLE:  # beside an article: more of the kind, and its headline
            if (k.tag in ARTICLE and k.points >= least) or (k.tag == "h1" and plain):
                keep.append(k)
        elif k.points >= least or (plain and (k.tag in HEADING or k.tag in ("p", "pre", "blockquote", "ul", "ol"))):
            keep.append(k)
    prune(keep)
    return keep


def prune(kept: list[Node]) -> None:
    """Drop lists of links from what is kept: blocks of three links or more that are little else, and not most of it."""
    total = sum(n.text for n in kept)
    todo = list(kept)
    while todo:
        n = todo.pop()
        if n.tag in ("ul", "ol", "div", "section", "table", "dl") and n.links >= 3 and 10 * n.linked > 9 * n.text and 2 * n.text < total:
            n.dead = True
        else:
            todo += [k for k in n.kids if isinstance(k, Node) and not k.dead]


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space turned into one space."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if text := SPACE.sub(" ", "".join(parts)).strip():
            out.append(text)
        parts.clear()

    todo: list = list(reversed(nodes))
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            parts.append(n)
        elif n.tag == "br":
            parts.append(" ")
        elif not n.dead:
            if n.tag in BLOCK:
                flush()
                todo.append(None)
            elif n.tag in ("td", "th"):
                parts.append(" ")
            todo += reversed(n.kids)
    flush()
    return out


def main_text(html: str) -> str:
    tree = Tree()
    tree.feed(html)
    tree.close()
    revive(tree.root)
    return "\n\n".join(blocks(select(tree.root)))


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page: page_id, url, text, n_chars (code points).

    Null html is empty and gives empty text, as does a page without text. Very long and
    deeply nested pages are read whole, in time linear in their length. Pages are taken
    one by one, so null ids, repeated rows and ties change nothing; no rows give no rows.
    Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(_extract_batches, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
