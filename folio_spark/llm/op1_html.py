"""Main-text extraction from raw HTML by text-to-tag ratios.

Parser events of the standard library stream into blocks ("lines"), each with its text, how much
of it is linked and the number of tags met on the way to it.  A line's ratio is its unlinked text
a tag.  Elements, roles and class words that announce boilerplate only *discount* the ratio of
what they enclose; nothing but scripts, styles and form controls is cut by its name.  Ratios are
smoothed by a Gaussian and clustered by a threshold: lines of the upper cluster weigh as content.
The content region is the smallest container that holds most of that weight, lifted to a
surrounding article or over headings.  In it, a discounted or mostly linked line stays only if it
belongs to the upper cluster; every other line stays, however short.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm.base import lean, table, unused

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold no prose: code, styles, controls and embedded objects.
UNREAD = frozenset("button canvas head iframe input noscript object option script select style svg template textarea title".split())
CONTAINERS = frozenset("article body center div form main section table tbody td tr html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class or id that announce boilerplate.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disclaimer disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay "
    "paywall popup promo promos promotion recommended related reply replies respond search share sharing sidebar sidebars signup skyscraper social sponsor "
    "sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
#: Words that say where or how a marked part stands: with them alone a class name stays fully marked.
NEUTRAL = frozenset(
    "area articles bar block bottom box buttons col column container content global group inner items left links list main outer page panel posts primary right "
    "secondary section site slot top unit wrap wrapper".split()
)
#: Words after which a class name tells of the page's state, not of what the element holds.
STATES = frozenset("with without no not non has have is hide show".split())
#: Class names of the text itself; beside them a mark counts as a hint only.
PROSE = frozenset("article articlebody body content copy entry main post prose story text".split())
REMARKS = frozenset("comment comments commentlist disqus reply replies respond".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
ELEMENTS = frozenset("aside dialog footer form menu nav search".split())
#: Discounts of a line's ratio inside what is marked, and inside what is hinted at.
MARK, HINT = 0.05, 0.5
#: Share of the page's text from which a marked container is taken for the page's own frame.
FRAME = 0.8
#: A start tag that ends an open element of these names by itself.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES |= {
    t: ("p",)
    for t in BLOCK - {"body", "html", "head", "li", "dt", "dd", "tr", "td", "th", "option", "optgroup", "title", "tbody", "thead", "tfoot", "legend", "summary"}
}
_SCOPE = frozenset("article aside body button caption div footer form header html main nav object section table td th ul ol".split())
_NAMES = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def class_discount(value: str) -> tuple[float, bool]:
    """Discount by a class or id attribute, and whether its mark speaks of reader comments."""
    out, prose, remarks = 1.0, False, False
    for name in value.split():
        words = _NAMES.findall(_HUMP.sub(r"\1 \2", name).lower())
        prose |= len(words) == 1 and words[0] in PROSE
        if STATES.intersection(words):
            continue
        marks = MARKED.intersection(words)
        if marks:
            out = min(out, MARK if all(w in MARKED or w in NEUTRAL or w.isdigit() for w in words) else HINT)
            remarks |= bool(marks & REMARKS)
    return (max(out, HINT) if prose else out), remarks


def discount(tag: str, attrs: list, in_article: bool) -> tuple[float, bool]:
    """Discount by an element's name and attributes, and whether only an article in it can lift that."""
    out = MARK if tag in ELEMENTS or (tag == "header" and not in_article) else 1.0
    fixed = out < 1.0 and tag != "form"
    for k, v in attrs:
        v = v or ""
        if k == "class" or k == "id":
            if tag in BLOCK and tag not in ("html", "body", "main") and tag not in HEADINGS:
                d, remarks = class_discount(v)
                out, fixed = min(out, d), fixed or remarks
        elif (k == "role" and v.lower() in ROLES) or k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and _HIDDEN.search(v)):
            out = MARK
    return out, fixed


class Node:
    __slots__ = ("parent", "tag", "unread", "linked", "discount", "fixed", "scope", "depth", "article", "mass", "lines", "core", "trust", "held", "others")

    def __init__(self, parent, tag, unread, linked, discount, fixed):
        self.parent, self.tag, self.unread, self.linked, self.discount, self.fixed = parent, tag, unread, linked, discount, fixed
        self.depth = parent.depth + 1 if parent else 0
        self.scope = self.depth if tag in _SCOPE or parent is None else parent.scope  # depth of the nearest element that confines implied ends
        self.article = parent.article if parent else None
        self.mass = self.lines = self.others = 0
        self.core, self.trust, self.held = False, 1.0, 0.0


class Line:
    __slots__ = ("node", "text", "tags", "linked")

    def __init__(self, node, text, tags, linked):
        self.node, self.text, self.tags, self.linked = node, text, tags, linked


class PageLines(HTMLParser):
    """Streams events into ``lines``; ``nodes`` are the elements met, parents first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.node = Node(None, "html", False, False, 1.0, False)
        self.nodes = [self.node]
        self.open: dict[str, list[Node]] = {}
        self.lines: list[Line] = []
        self.buffer: list[str] = []
        self.owner = self.node
        self.linked = self.tags = 0

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer.clear()
            if text:
                self.lines.append(Line(self.owner, text, self.tags, min(self.linked, len(text))))
                self.tags = 0
            self.linked = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.buffer.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
        for name in CLOSES.get(tag, ()):
            there = self.open.get(name)
            if there and there[-1].depth >= self.node.scope:
                self._close(there[-1])
        up = self.node
        if tag in ("html", "body") and self.open.get(tag):  # a second one only adds attributes
            return
        d, fixed = discount(tag, attrs, up.article is not None) if attrs or tag in ELEMENTS or tag == "header" else (1.0, False)
        # A link around whole blocks is a card; only text in the link's own block counts as linked.
        node = Node(up, tag, up.unread or tag in UNREAD, tag == "a" or (up.linked and tag not in BLOCK), d, fixed)
        if node.article is None and d == 1.0 and (tag in ("article", "main") or any(k == "role" and v in ("main", "article") for k, v in attrs)):
            node.article = node
        self.node = node
        self.nodes.append(node)
        self.open.setdefault(tag, []).append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style", "p", "div", "span", "a", "b", "i", "em", "strong"):
            self.handle_endtag(tag)

    def _close(self, last: Node) -> None:
        """End the elements from the innermost to ``last``; each is ended once, so this is linear over a page."""
        while True:
            node = self.node
            self.open[node.tag].pop()
            self.node = node.parent
            if node is last:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        there = self.open.get(tag)
        if there and tag not in ("body", "html"):
            self._close(there[-1])

    def handle_data(self, data):
        if self.node.unread:
            return
        if not self.buffer:
            self.owner = self.node
        self.buffer.append(data)
        if self.node.linked:
            self.linked += len(data)

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no section the parser knows: a bogus comment up to the next ">", as browsers read it
            return self.parse_bogus_comment(i)

    def error(self, message):  # pragma: no cover
        pass


def read_lines(html: str) -> PageLines:
    page = PageLines()
    page.feed(html)
    page.close()
    page.flush()
    return page


def weigh_marks(page: PageLines) -> None:
    """``trust`` of every node: the product of the discounts around it, of all but the page's own frame."""
    for line in page.lines:
        line.node.mass += len(line.text) - line.linked
        line.node.lines += 1
    for node in reversed(page.nodes):
        node.core |= node.article is node or (node.tag == "h1" and node.lines > 0)
        up = node.parent
        if up is not None:
            up.mass += node.mass
            up.lines += node.lines
            up.core |= node.core and (node.discount == 1.0 or node.article is node)
    total = page.nodes[0].mass
    for node in page.nodes:
        d = node.discount
        if d < 1.0 and node.tag in CONTAINERS and node.mass >= FRAME * total and (node.core or (node.lines >= 3 and not node.fixed)):
            d = 1.0
        node.trust = d * (node.parent.trust if node.parent else 1.0)


def gaussian(values: list[float], sigma: float) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    n, out = len(values), []
    for i in range(n):
        lo, hi = max(0, i - reach), min(n, i + reach + 1)
        ks = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(v * k for v, k in zip(values[lo:hi], ks, strict=True)) / sum(ks))
    return out


def upper_cluster(lines: list[Line], sigma: float, share: float) -> list[bool]:
    """Which lines' smoothed text-to-tag ratio, discounted, reaches the threshold ``share`` * min(deviation, mean) of the plain ratios."""
    ratios = [(len(x.text) - x.linked) / max(1, x.tags) for x in lines]
    plain = gaussian(ratios, sigma)
    smooth = gaussian([r * x.node.trust for r, x in zip(ratios, lines, strict=True)], sigma)
    mean = sum(plain) / len(plain)
    spread = math.sqrt(sum((s - mean) ** 2 for s in plain) / len(plain))
    # Ratios all alike have no spread: then the mean alone parts them from lines without any text of their own.
    limit = share * (min(spread, mean) or mean)
    return [s * x.node.trust >= limit and s > 0 for s, x in zip(smooth, lines, strict=True)]


def content_region(page: PageLines, lines: list[Line], upper: list[bool], hold: float) -> Node:
    """The smallest container with ``hold`` of the upper cluster's text, lifted to its article or over headings and content."""
    for line, up in zip(lines, upper, strict=True):
        if up:
            line.node.held += len(line.text)
        elif line.node.tag not in HEADINGS:
            line.node.others += 1
    for node in reversed(page.nodes):
        if node.parent is not None:
            node.parent.held += node.held
            node.parent.others += node.others
    total = page.nodes[0].held
    region = page.nodes[0]
    for node in page.nodes:  # parents first: the last one that still holds enough is the deepest
        if node.tag in CONTAINERS and node.depth > region.depth and node.held >= hold * total > 0:
            region = node
    if region.article is not None:
        return region.article
    own = [n for n in page.nodes if n.article is n and n.held >= 0.5 * total > 0]
    if own:
        return own[0]
    while region.parent is not None and region.parent.others == region.others:
        region = region.parent
    return region


def extract(html: str | None, sigma: float = 1.0, share: float = 0.5, hold: float = 0.8) -> str:
    """Main text of one page; empty for null, empty or text-free pages."""
    if not html:
        return ""
    page = read_lines(html)
    if not page.lines:
        return ""
    weigh_marks(page)
    upper = upper_cluster(page.lines, sigma, share)
    region = content_region(page, page.lines, upper, hold)
    inside = {id(region)}
    for node in page.nodes:
        if node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
    kept = [x.text for x, up in zip(page.lines, upper, strict=True) if id(x.node) in inside and (up or (x.node.trust >= HINT and 2 * x.linked <= len(x.text)))]
    return "\n".join(kept)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), out: str = "text") -> DataFrame:
    """``keep`` columns and the main text of every row's whole HTML.

    Null or empty HTML and pages without main text give an empty string; broken markup, unknown
    declarations included, is read to its end; very long and very deeply nested pages take time
    in proportion to their size; every row, repeated or of a null id, gives one row; an empty
    table gives none.  A kept column named like ``out`` gives way to the text; other columns are
    dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                html = part.column(part.num_columns - 1)
                texts = [extract(html[k].as_py()) for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], out])

    keep = [k for k in keep if k != out]
    src = pages.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{html_col}`").alias(unused("html", keep)))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    return src.mapInArrow(lean(run), f"{kinds}`{out}` string")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
