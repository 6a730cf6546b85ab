"""Operator 11: main text of pages by a site style tree.

The pages of a host are merged into one tree. An element node is an element's
place in the page (its ancestors' tags and class names, and its number among
equal siblings); elements that only shape text (paragraphs, headings, list
items, inline marks without a class) belong to the node they stand in. A style
node of an element is one of the sequences of child nodes that pages have
there. Every node counts the pages that have it.

For an element E on m pages with l styles (S_i on m_i = p_i m pages):

  presentation  NodeImp(E) = - sum p_i log_m p_i               (1 where m = 1)
  content       ContImp(S_i) = entropy of the texts of E on the m_i pages to
                the base m_i                                   (1 where m_i = 1)
  importance    (1 - g^l) NodeImp(E) + g^l sum p_i ContImp(S_i),  g = 0.9

A branch that looks and reads the same on every page has importance 0, one that
differs from page to page has 1. Branches below ``LEAST`` are removed from each
page; what remains is the text, block by block in page order.

Two facts about presentation need no counting and weigh every node: elements
whose tag, role or class names a page's furniture (``FURNITURE_*``) have
importance 0, and an ``article`` or ``main`` element has importance 1. Where
pages of the host that have E also have such an element outside of which E
stands, E's importance is multiplied by the share of those that don't: text
beside a declared article isn't the article. A first-level heading outside all
furniture goes without this factor.

Pages count once per text: copies of a page (equal text outside furniture) are
one page of the tree, else a host that repeats one article would make it
unimportant. For the same reason the text of an element is taken as a whole.

In Spark: every page is parsed twice by a linear scan and moves through no
shuffle. The first pass gives small rows (host, page text hash, node, style
hash, text hash), counted by hash aggregations that combine in each task, so a
hot host is no hot task. Only the branches to be removed are brought to the
pages: up to ``TABLE_BRANCHES`` of them by broadcast, beyond that by a join on
the host with both sides salted.

Defined cases: null or empty html, or a page without text, gives an empty text;
a null or unreadable url is a host of its own name (""); rows that repeat are
rows of their own; other columns are kept; unclosed elements and comments end
with the page; a tag cut off by the page's end is dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.llm.common import free_name, small_batches, stash

#: Branches of less importance are removed.
LEAST = 0.3
#: The damping of presentation against content.
DAMPING = 0.9
#: Branches that may be broadcast (16 bytes and the host's name each).
TABLE_BRANCHES = 200_000
SALTS = 16

#: FIXED VALUES: tags, roles and words of class names or ids that name furniture of a page.
FURNITURE_TAGS = frozenset("nav header footer aside form dialog menu button select noscript iframe object svg template".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset("""
    ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner
    nav navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs
    header masthead footer copyright sidebar aside widget related recommended
    topnav sidenav navbar topbar adsbygoogle adsense adslot adbox gdpr commentlist cookiebar
    cookie cookies consent notice notification alert popup modal overlay newsletter subscribe subscription signup login search
    share sharing social comment comments disqus replies respond reactions
    """.split())
#: FIXED VALUES: tags whose content is no text; those whose content is no markup either.
UNSEEN = frozenset("head title script style textarea noscript template svg iframe object".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: FIXED VALUES: elements that end a line of text before and after them; of these, those that shape a page.
SHAPES = frozenset("html body div section article main nav header footer aside form table ul ol dl menu dialog fieldset details figure".split())
BLOCKS = SHAPES | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote address hr tr td th thead tbody tfoot caption figcaption summary option legend hgroup search center".split())
MAIN = frozenset(["article", "main"])
HEAD = frozenset("title meta link base style script noscript template".split())
#: FIXED VALUES: words that name an article's own headline inside it; words that turn a name's sense ("with-sidebar").
HEADER_WORDS = frozenset(["header", "masthead", "banner"])
DENYING_WORDS = frozenset(["with", "has", "no", "without"])

#: Kinds of nodes: what names furniture, a main element, what stands beside the page's main element, all other.
PLAIN, BESIDE, MAIN_ELEMENT, FURNITURE = range(4)

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TELLING = re.compile(r"class|id|role|hidden", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
#: FIXED VALUES: what an element's start ends, if it is open within the same shape.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in reversed(_ATTRIBUTE.findall(source))}


def _is_furniture(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    """Whether tag, role or names say so. An article's own header holds its headline."""
    if tag in FURNITURE_TAGS and not (tag == "header" and in_main) or attributes.get("role", "").lower() in FURNITURE_ROLES:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if tag in ("html", "body"):  # their names speak of the page, not of a part
        return False
    names = {w.lower() for w in _NAME_WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")}
    if in_main:
        names -= HEADER_WORDS
    return not names.isdisjoint(FURNITURE_WORDS) and names.isdisjoint(DENYING_WORDS)


def _digest(text: str) -> int:
    """A signed 64-bit hash."""
    x = xxhash.xxh3_64_intdigest(text.encode())
    return x - (1 << 64) if x >> 63 else x


class Node:
    """An element of one page that is a node of the site's tree."""

    __slots__ = ("tag", "key", "parent", "furniture", "in_main", "children", "seen", "texts", "encloses_main")

    def __init__(self, tag: str, name: str, parent: Node | None, furniture: bool):
        self.tag, self.parent, self.furniture = tag, parent, furniture
        self.in_main = bool(parent and parent.in_main) or (tag in MAIN and not furniture)
        self.encloses_main = False
        self.children: list[str] = []
        self.seen: dict[str, int] = {}
        self.texts: list[str] = []
        self.key = 0
        if parent is not None:
            parent.seen[name] = n = parent.seen.get(name, 0) + 1
            parent.children.append(name)
            self.key = _digest(f"{parent.key}>{name}[{n}]")

    def loose(self) -> int:
        """The key of text that stands in the node itself, beside a main element below it."""
        return _digest(f"{self.key}>#text")


class Page:
    """The nodes of a page in page order, and its blocks: the parts of a line, each with its node."""

    def __init__(self, source: str):
        self.root = Node("", "", None, False)
        self.nodes = [self.root]
        self.blocks: list[list[tuple[Node, str]]] = []
        self.headline = False
        self._pieces: list[tuple[Node, str]] = []
        self._open: list[tuple[str, Node]] = []
        self._read(source)
        self.has_main = any(n.in_main and not n.furniture and n.texts for n in self.nodes)
        for n in self.nodes:
            if self.has_main and n.in_main and not n.furniture:
                up = n.parent
                while up is not None and not up.encloses_main and not up.in_main:
                    up.encloses_main = True
                    up = up.parent

    def _close(self, depth: int) -> None:
        del self._open[depth:]

    def _start(self, tag: str, rest: str) -> None:
        stack = self._open
        if tag in BLOCKS:  # a block ends a paragraph
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == "p":
                    self._close(d)
                    break
                if stack[d][0] in SHAPES:
                    break
        if ends := _ENDS.get(tag):
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in ends:
                    self._close(d)
                    break
                if stack[d][0] in SHAPES or tag in ("td", "th") and stack[d][0] == "tr":
                    break
        node = stack[-1][1] if stack else self.root
        attributes = _attributes(rest) if rest and _TELLING.search(rest) else {}
        furniture = _is_furniture(tag, attributes, node.in_main) if attributes else tag in FURNITURE_TAGS and not (tag == "header" and node.in_main)
        names = " ".join(sorted((attributes.get("class", "") or attributes.get("id", "")).split()))
        if tag == "h1" and node.in_main and not furniture:
            self.headline = True
        if furniture or tag in SHAPES or names or tag == "h1" and not node.in_main:
            # role and hidden count, but are no part of tag and names: they tell nodes apart
            name = (f"{tag}.{names}" if names else tag) + ("!" if furniture else "")
            node = Node(tag, name, node, furniture or node.furniture)
            self.nodes.append(node)
        elif tag not in BLOCKS and not any(t == tag for t, _ in stack):
            return  # an inline mark without a name changes nothing, nor does its end
        stack.append((tag, node))

    def _end(self, tag: str) -> None:
        for d in range(len(self._open) - 1, -1, -1):
            if self._open[d][0] == tag:
                self._close(d)
                return
            if tag not in BLOCKS and self._open[d][0] in SHAPES:
                return

    def _say(self, text: str) -> None:
        if text:
            self._pieces.append((self._open[-1][1] if self._open else self.root, text))

    def _read(self, source: str) -> None:
        at, unseen = 0, None
        for m in _TOKEN.finditer(source):
            if m.start() < at:
                continue
            if unseen is None:
                self._say(source[at:m.start()])
            at = m.end()
            closing, tag, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
            if not tag or m.group(5) and not m.group().endswith(">"):
                continue
            tag = tag.lower()
            if not closing and tag in RAW:
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else len(source)
                continue
            if unseen is not None:
                if closing and tag == unseen or unseen == "head" and not closing and tag not in HEAD:
                    unseen = None
                if unseen is not None or closing:
                    continue
            if tag in BLOCKS:
                self._flush()
            if closing:
                self._end(tag)
            elif tag in UNSEEN:
                unseen = None if rest.endswith("/") else tag
            elif tag == "br":
                self._say(" ")
            elif tag not in VOID:
                self._start(tag, rest)
        if unseen is None:
            self._say(source[at:])
        self._flush()

    def _flush(self) -> None:
        """Ends a block."""
        held: list[tuple[Node, str]] = []
        for node, piece in self._pieces:
            if held and held[-1][0] is node:
                held[-1] = (node, held[-1][1] + piece)
            else:
                held.append((node, piece))
        self._pieces = []
        parts = [(node, entities.unescape(t) if "&" in t else t) for node, t in held]
        if any(t.strip() for _, t in parts):
            self.blocks.append(parts)
            for node, t in parts:
                if t.strip():
                    node.texts.append(t)

    def branch_digests(self) -> dict[int, int]:
        """A hash of the text of each node's branch, by the node's key; furniture counts for itself, not for what holds it."""
        digests: dict[int, int] = {}
        below: dict[int, list[int]] = {}
        for n in reversed(self.nodes):
            parts = below.pop(n.key, [])
            if n.texts or parts:
                digests[n.key] = _digest(f"{' '.join(' '.join(n.texts).split())}\x00{parts}")
                if n.parent is not None and (n.parent.furniture or not n.furniture):
                    below.setdefault(n.parent.key, []).append(digests[n.key])
        return digests

    def facts(self) -> tuple[int, list[tuple[int, int, int, int]]]:
        """(hash of all text outside furniture, [(node, style, hash of the branch's text, kind)]) of the nodes that hold text."""
        digests = self.branch_digests()
        out = []
        for n in self.nodes:
            if n.key not in digests and not n.encloses_main or n.parent is not None and n.parent.furniture:
                continue
            if n.encloses_main:
                if n.texts:
                    out.append((n.loose(), 0, _digest(" ".join(" ".join(n.texts).split())), BESIDE))
                continue
            if n is self.root:
                continue  # a whole page is no branch
            if n.furniture:
                kind = FURNITURE
            elif n.tag in MAIN and n.in_main:
                kind = MAIN_ELEMENT
            elif self.has_main and not n.in_main and (n.tag != "h1" or self.headline):
                kind = BESIDE
            else:
                kind = PLAIN
            out.append((n.key, _digest("|".join(n.children)), digests[n.key], kind))
        return digests.get(0, 0), out

    def lines(self, removed: frozenset[int]) -> list[str]:
        """The blocks outside furniture and outside the branches whose keys are in ``removed``."""
        gone: dict[int, bool] = {}
        for n in self.nodes:  # parents come first
            gone[id(n)] = n.furniture or n.parent is not None and gone[id(n.parent)] or n.key in removed
        if removed:
            loose = {id(n): n.encloses_main and n.loose() in removed for n in self.nodes}
            blocks = [[t for n, t in parts if not gone[id(n)] and not loose[id(n)]] for parts in self.blocks]
        else:
            blocks = [[t for n, t in parts if not gone[id(n)]] for parts in self.blocks]
        return [line for b in blocks if (line := " ".join("".join(b).split()))]

    def text(self, removed: frozenset[int] = frozenset()) -> str:
        return "\n".join(self.lines(removed) or self.lines(frozenset()))


def host_of(url: str):
    """The host of a url as a Column: lower case, without user and port; "" where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), F.lit("")))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, node, kind, pages, styles, presentation, content, outside, importance) of each element node that holds text and
    isn't part of furniture itself."""
    small_batches(pages.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, source in zip(batch["host"], batch["html"], strict=True):
                whole, found = Page(source).facts()
                rows += [(host, whole, *f) for f in found]
            yield pd.DataFrame(rows, columns=["host", "whole", "node", "style", "content", "kind"])

    rows = pages.select(host_of(url).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html")).mapInPandas(
        read, "host string, whole long, node long, style long, content long, kind long")
    # copies of a page are one; a node stands once on a page
    once = rows.groupBy("host", "node", "whole").agg(F.min(F.struct("style", "content", "kind")).alias("f")).select("host", "node", "f.*")
    texts = once.groupBy("host", "node", "style", "content").agg(F.count("*").alias("c"), F.count_if(F.col("kind") == BESIDE).alias("beside"), F.max("kind").alias("kind"))
    styles = texts.groupBy("host", "node", "style").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.sum("beside").alias("beside"), F.max("kind").alias("kind"))
    told = F.when(F.col("m") == 1, 1.0).otherwise(1 - F.col("clogc") / (F.col("m") * F.log("m")))
    tree = styles.groupBy("host", "node").agg(
        F.sum("m").alias("pages"), F.count("*").alias("styles"), F.sum(F.col("m") * F.log("m")).alias("mlogm"), F.sum(F.col("m") * told).alias("told"),
        F.sum("beside").alias("beside"), F.max("kind").alias("kind"))
    damped = F.pow(F.lit(DAMPING), F.col("styles"))
    return tree.select(
        "host", "node", "kind", "pages", "styles", F.when(F.col("pages") == 1, 1.0).otherwise(1 - F.col("mlogm") / (F.col("pages") * F.log("pages"))).alias("presentation"),
        (F.col("told") / F.col("pages")).alias("content"), (F.col("beside") / F.col("pages")).alias("outside")).withColumn(
        "importance", F.when(F.col("kind") == FURNITURE, 0.0).when(F.col("kind") == MAIN_ELEMENT, 1.0).otherwise(
            ((1 - damped) * F.col("presentation") + damped * F.col("content")) * (1 - F.col("outside"))))


def extract(pages: DataFrame, url: str = "url", html: str = "html", into: str = "text", least: float = LEAST, table_branches: int = TABLE_BRANCHES) -> DataFrame:
    """The rows with the column ``into``, the main text."""
    # furniture has importance 0 on every host: pages know it without the tree
    low = style_tree(pages, url, html).where((F.col("importance") < least) & (F.col("kind") != FURNITURE))
    branches = stash(low.select("host", "node"), "branches")
    host, salt, removed = free_name(pages, "host"), free_name(pages, "salt"), free_name(pages, "removed")
    by_host = branches.groupBy(F.col("host").alias(host)).agg(F.collect_set("node").alias(removed))
    rows = pages.withColumn(host, host_of(url))
    if branches.count() <= table_branches:
        rows = rows.join(F.broadcast(by_host), host, "left")
    else:
        by_host = by_host.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(html), F.lit(SALTS))).join(by_host, [host, salt], "left").drop(salt)
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def main_text(sources: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([Page(s or "").text(frozenset(r) if r is not None else frozenset()) for s, r in zip(sources, removed, strict=True)], dtype=object)

    return rows.withColumn(into, main_text(F.col(html), F.col(removed))).drop(host, removed)
