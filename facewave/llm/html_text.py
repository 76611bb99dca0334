"""Main-text extraction from HTML by composite text density (operator 6).

Every page is parsed into its tree of block elements. Each node has its characters, link characters, tags and link tags; its
composite density is characters per tag, lowered by its share of link text measured against that of the body; text that stands directly in a
node beside its children counts as one more child. The node with the largest sum of its children's densities is the article. The threshold is the density of
the thinnest node on the way from it up to the body. Of every other node at least that dense, the node with the largest sum in it is content too if that sum is
at least ``SHARE`` of the article's (a page may have several sections, while a lone line of an advert is dense but small); thinner
nodes are only gone through. An enclosing ``article`` or ``main`` takes the place of a part of it. Outside an ``article``, blocks below the
threshold that are mostly link text (lists of links) are left out of what is kept.

Density does not tell a footer of one sentence from an article of one sentence. Elements whose name, role, class or id says that they are menus, headers or
footers of the page, side bars, forms, notices, adverts or reader comments therefore weigh ``DOUBT`` of their text in every density, theirs
and those around them. Where no ``article`` or ``main`` stands outside them, a word of class, role or id counts the less the more of the page's text without links its
element holds: of an element that holds it all, nothing is doubted. Words behind "no", "with", "has" and the like ("main-with-sidebar") say nothing. What lies in a menu, footer or side
bar by the element's own name is never the article; where all else is empty, so is the text. Only what is never text (scripts, styles, controls) is skipped.

Defined results: null or empty html, and pages without text, give an empty text; plain text without tags is its own content;
unclosed elements end where HTML says or with the page; equal pages get equal results; other columns are not touched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from facewave.llm._shared import by_place, named
from facewave.llm._text import tidy

# Element groups of HTML, and words of class, id and role that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video head title button select option textarea input".split())
NEVER = frozenset("nav footer aside menu".split())
BESIDE = NEVER | {"dialog", "form"}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("table ul ol dl td th body article section div nav aside footer header main".split())
NOT_CONTENT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    r"sidebar|side-bar|footer|masthead|cookie|cookies|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|search|social|share|sharing|"
    r"related|recommended|pagination|pager|comment|comments|respond|disqus|discussion|replies|widget|toolbar|copyright|skip|hidden)(?:$|[\s_-])"
)
ABSENT = re.compile(r"(?:^|(?<=[\s_-]))(?:no|not|non|without|with|has|have|hide|show)[_-]\w+")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SPACES = re.compile(r"\s+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What the text of an element of another purpose weighs, and the share of the article's sum that makes a node content.
DOUBT, SHARE = 0.01, 0.25
LEAST = DOUBT**4  # what an element weighs at least, however deep it lies in others that are doubted


class Node:
    """A block element. ``parts`` holds its text, link text and child nodes in page order."""

    __slots__ = ("tag", "up", "parts", "chars", "link_chars", "tags", "link_tags", "density", "sum", "own", "own_chars", "top", "article", "doubted", "named", "nested", "weight")

    def __init__(self, tag: str, up: Node | None) -> None:
        self.tag, self.up, self.parts = tag, up, []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = self.own = 0.0
        self.own_chars, self.top, self.doubted, self.nested, self.weight = 0, self, False, 0, 1.0
        self.named = bool(up and up.named)  # in an element whose own name says that it is no article
        self.article: Node | None = self if tag in ("article", "main") else up.article if up else None


class Tree(HTMLParser):
    """Builds the tree of block elements; inline elements only count as tags of their block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)
        self.skip: list[str] = []  # open elements inside one that counts for nothing
        self.links = 0
        self.open: Counter[str] = Counter()  # elements around the place that is read

    def _rise(self, to: Node) -> None:
        while self.at is not to:
            self.open[self.at.tag] -= 1
            self.at = self.at.up
        self.links = 0

    def close(self) -> None:
        """What the parser still holds at the end of a page that breaks off is text, unless it is the beginning of a tag."""
        rest, self.rawdata = self.rawdata, ""
        super().close()
        if rest and not self.cdata_elem and not re.match(r"<[a-zA-Z!/?]", rest):
            from html import unescape

            self.handle_data(unescape(rest))

    def _leave(self, tags: set[str] | frozenset[str], scope: frozenset[str] = SCOPES) -> None:
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node.up and node.tag not in tags:
            if node.tag in scope:
                return
            node = node.up
        if node.up:
            self._rise(node.up)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag in ("html", "body", "head"):
            if tag == "head":
                self.skip = ["head"]
            return
        if tag in INLINE and tag != "wbr":
            self.at.tags += 1
            if tag == "a":
                self.at.link_tags += 1
                self.links += 1
        if tag in ENDS_P:
            self._leave({"p"})
        if tag in CLOSES:
            self._leave(CLOSES[tag])
        if tag in VOID:
            self.at.tags += 1
            if tag in ("br", "hr"):
                self.at.parts.append((" ", False))
            return
        about = dict(attrs)
        names = f"{about.get('class') or ''} {about.get('id') or ''}".lower()
        doubted = tag in BESIDE or (tag == "header" and not self.at.article) or (about.get("role") or "").lower() in ROLES or bool(names.strip() and tag not in ("article", "main", "body") and NOT_CONTENT.search(ABSENT.sub("", names)))
        if tag in SKIPPED or "hidden" in about:
            self.skip = [tag]
        elif tag not in INLINE or doubted:
            self.at.tags += tag not in INLINE
            node = Node(tag, self.at)
            node.doubted = doubted
            node.named = self.at.named or tag in NEVER
            self.at.parts.append(node)
            self.open[tag] += 1
            self.at, self.links = node, self.links if tag in INLINE else 0
        else:
            self.at.nested += tag == self.at.tag

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "iframe", "svg", "path", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            elif tag in ("body", "html"):
                self.skip = []
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag == "br":
            self.at.parts.append((" ", False))
        if tag in INLINE and self.at.tag == tag:  # an inline element is a node only if it is doubted
            if self.at.nested:
                self.at.nested -= 1
            elif self.at.up:
                self.open[tag] -= 1
                self.at = self.at.up
        if tag in INLINE or tag in VOID or tag in ("html", "body", "head"):
            return
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            node = node.up
        self._rise(node.up)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.at.parts.append((data, self.links > 0))


def _nodes(root: Node) -> list[Node]:
    """All nodes, each before its children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    return out


def _length(text: str) -> int:
    return len(SPACES.sub(" ", text).strip())


def _settle(root: Node) -> None:
    """Gives doubted elements their weight."""
    nodes = _nodes(root)
    if not any(x.doubted for x in nodes):
        return
    plain: dict[Node, int] = {}
    for node in reversed(nodes):
        plain[node] = sum(plain[x] if isinstance(x, Node) else _length(x[0]) * (not x[1]) for x in node.parts)
    # text of articles that no doubted element holds: where there is any, no doubted element stands for the page
    clear, stack = 0, [root]
    while stack:
        node = stack.pop()
        clear += sum(_length(x[0]) for x in node.parts if not isinstance(x, Node)) if node.article else 0
        stack.extend(x for x in node.parts if isinstance(x, Node) and not x.doubted)
    for node in nodes[1:]:
        share = 0.0 if clear or node.named or not plain[root] else plain[node] / plain[root]
        node.weight = max(node.up.weight * (DOUBT ** (1 - share) if node.doubted else 1.0), LEAST)


def _density(c: int, lc: int, t: int, lt: int, share: float) -> float:
    if not c:
        return 0.0
    t, plain = max(t, 1), max(c - lc, 1)
    base = math.log(c / plain * lc + share * c + math.e)
    return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0 + 1e-9)) / math.log(max(base, 1.0 + 1e-9) + 1)


def _measure(root: Node) -> list[Node]:
    nodes = _nodes(root)
    direct = []
    for node in reversed(nodes):
        kids = [x for x in node.parts if isinstance(x, Node)]
        own = own_links = 0
        for x in node.parts:
            if not isinstance(x, Node):
                n = _length(x[0])
                own += n
                own_links += n * x[1]
        node.own_chars = own
        direct.append((own, own_links, node.tags - len(kids), node.link_tags))
        # a child of less weight than the node counts by that much less
        share = [x.weight / node.weight for x in kids]
        node.chars = own + sum(x.chars * w for x, w in zip(kids, share, strict=True))
        node.link_chars = own_links + sum(x.link_chars * w for x, w in zip(kids, share, strict=True))
        node.tags += sum(x.tags * w - (1 - w) for x, w in zip(kids, share, strict=True))
        node.link_tags += sum(x.link_tags * w for x, w in zip(kids, share, strict=True))
    share = root.link_chars / root.chars if root.chars else 0.0
    for node, about in zip(reversed(nodes), direct, strict=True):
        kids = [x for x in node.parts if isinstance(x, Node)]
        node.own = node.weight * _density(*about, share)
        node.density = node.weight * _density(node.chars, node.link_chars, node.tags, node.link_tags, share) if kids else node.own
        node.sum = sum(x.density for x in kids) + node.own
        node.top = max((node, *(x.top for x in kids)), key=lambda n: n.sum)
    return nodes


def _without_links(node: Node, least: float) -> list:
    """The parts of a kept node but for lists of links: several links in one block, or in blocks side by side."""
    if node.article and node.article.tag == "article":
        return [x for x in node.parts if not isinstance(x, Node) or x.weight == node.weight or x.density >= least]
    kids = [x for x in node.parts if isinstance(x, Node) and x.chars]
    linked = [x.link_chars * 2 > x.chars and x.density < least and x.tag not in HEADINGS for x in kids]
    out = {x for i, x in enumerate(kids) if linked[i] and (x.link_tags > 1 or any(linked[max(i - 1, 0) : i]) or any(linked[i + 1 : i + 2]))}
    out |= {x for x in kids if x.weight < node.weight and (x.named or x.density < least)}
    return [x for x in node.parts if x not in out] if out else node.parts


def _blocks(root: Node, kept: set[Node], own: set[Node], least: float) -> list[str]:
    """Texts of the blocks of kept nodes in page order: text on both sides of a child block are blocks of their own. Of a node in ``own``
    only the text directly in it is taken."""
    out: list[str] = []
    run: list[str] = []
    enter = lambda n, whole: (iter(_without_links(n, least) if whole else n.parts), whole, whole or n in own)
    stack = [enter(root, root in kept)]
    while stack:
        parts, whole, text = stack[-1]
        for x in parts:
            if isinstance(x, Node):
                out.append("".join(run))
                run.clear()
                stack.append(enter(x, whole or x in kept))
                break
            if text:
                run.append(x[0])
        else:
            stack.pop()
            out.append("".join(run))
            run.clear()
    return out


def main_text(html: str | None, weigh: bool = True, dense: bool = True) -> str:
    """The main text of a page; without weights, or without the choice by density, only to show what each of them does."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    if weigh:
        _settle(tree.root)
    nodes = _measure(tree.root)
    best = node = tree.root.top
    if not tree.root.chars or best.named and weigh:
        return ""
    least = node.density
    while node.up:
        node = node.up
        least = min(least, node.density)
    enough = SHARE * best.sum
    tops = {n.top for n in nodes if n.chars and n.density >= least and (n.top.sum >= enough or n.top.article and n.top.weight == 1)}
    kept = {n.article or n for n in tops} | {best.article or best}  # a part of an article stands for all of it
    own = {n for n in nodes if n.own_chars and n.own >= max(least, enough)}
    if not dense:
        kept = {tree.root}
    return " ".join(t for x in _blocks(tree.root, kept, own, least) if (t := SPACES.sub(" ", x).strip()))


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of every row; a column of that name is replaced."""
    kept = [c for c in df.columns if c != text or c == html]
    names = [c for c in kept if c != text]
    schema = StructType([*(df.schema[c] for c in names), StructField(text, StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(h) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], [*names, text])

    return by_place(df.select(named(html), *map(named, names))).mapInArrow(tidy(work), schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages.withColumn("h", F.col("html")).drop("html"), "h").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
