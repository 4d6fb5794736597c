"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: nodes with the same path of tags, classes
and roles are one node of the tree. For each the entropies of its presentation
(the sequences of child tags that pages have there) and of its content are
computed over the pages that have the node, in units of the largest possible
entropy. A branch that looks and reads the same on many pages has low importance
and is cut from each page; so is one whose tag, class, id or role says that it is
no part of an article. Inside an article a block is cut for low importance only if
the content of the article itself differs from page to page, so that an article
which pages share stays whole; inline elements and articles within articles are
not cut there. Of what is left, the text of article elements is taken if
there is any, else of the main element, else all.

Only counts of (host, node, presentation) and (host, node, content) are shuffled,
partly aggregated, so a host may hold any share of the pages.

Defined results: null or empty html has no text; a page whose URL is null or has
no host counts with the host ''; character references are decoded as browsers do;
repeated pages get a row each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound_arrow, staged

#: A node is judged by its importance from so many pages on, and cut below this.
LEAST_PAGES = 8
LEAST_IMPORTANCE = 0.25
#: The entropy of content from which on articles differ, so that what repeats in them is cut.
DIFFERENT = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|noscript|template|iframe|noembed|noframes|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</\1\b[^>]*>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_NOT_P = frozenset("caption dd dt li option tbody td tfoot th thead tr html body".split())
_CUT_TAGS = frozenset("nav footer aside form button select svg canvas object menu dialog head input audio video math".split())
_CUT_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead banner footer sidebar aside widget ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus search form pagination pager toolbar copyright".split()
)
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_MASK = (1 << 63) - 1


class _Walker:
    """One pass over a page's tokens with a stack of open elements. Subclasses
    say what happens with elements and text."""

    def walk(self, page: str) -> None:
        self.stack: list[tuple] = [("", 0, "", False)]  # tag, node, -, cut
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if m[2]:
                self.close(tag)
            else:
                self.open(tag, m[4])
        if at < len(page):
            self.text(page[at:])

    def pop(self, size: int) -> None:
        del self.stack[size:]

    def close(self, tag: str) -> None:
        stack = self.stack
        if tag in _BLOCKS:
            self.edge()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                self.pop(i)
                return
            if tag not in _BLOCKS and stack[i][0] in _BLOCKS:
                return  # an inline end tag closes nothing beyond its block

    def open(self, tag: str, attributes: str) -> None:
        stack = self.stack
        if tag in _BLOCKS:
            self.edge()
            if tag not in _NOT_P:
                self._close_within(("p",), ("article", "aside", "body", "div", "footer", "header", "li", "main", "nav", "section", "td", "table", "button"))
        if tag in _CLOSES:
            self._close_within(_CLOSES[tag], _WITHIN[tag])
        if tag in _VOID:
            if tag in ("br", "hr"):
                self.text(" ")
            return
        found = {}
        if "=" in attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), a or b or c)
        sign = tag + "." + found.get("class", "") + "@" + found.get("role", "")
        node = (stack[-1][1] * 1_000_003 + crc32(sign.encode())) & _MASK
        self.element(tag, node, sign, found, attributes.rstrip().endswith("/") and tag in ("svg",))

    def _close_within(self, tags: tuple, limits: tuple) -> None:
        stack = self.stack
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                self.pop(i)
                return
            if stack[i][0] in limits:
                return

    def edge(self) -> None: ...

    def text(self, raw: str) -> None: ...

    def element(self, tag: str, node: int, sign: str, found: dict, closed: bool) -> None: ...


class _Style(_Walker):
    """Presentation and content of each node of a page."""

    def __init__(self, page: str):
        self.looks: dict[int, int] = {}
        self.says: dict[int, int] = {}
        self.last: dict[int, int] = {}
        self.walk(page)

    def element(self, tag, node, sign, found, closed):
        parent, child = self.stack[-1][1], crc32(sign.encode())
        if self.last.get(parent) != child:  # runs of like children count once
            self.last[parent] = child
            self.looks[parent] = (self.looks.get(parent, 0) * 1_000_003 + child) & _MASK
        self.looks.setdefault(node, 0)
        if not closed:
            self.stack.append((tag, node, "", False))

    def text(self, raw):
        raw = raw.strip()
        if raw:
            value = crc32(raw.encode(errors="replace")) + (len(raw) << 32)
            for _, node, _, _ in self.stack[1:]:
                self.says[node] = (self.says.get(node, 0) * 31 + value) & _MASK


def _named_out(tag: str, found: dict, in_article: bool) -> bool:
    if tag in _CUT_TAGS:
        return True
    if tag == "header":
        return not in_article
    if tag in ("html", "body", "main"):
        return False
    role = found.get("role", "").lower()
    if role in _CUT_ROLES:
        return True
    names = {n.lower() for c in ("class", "id") for n in _NAME.findall(found.get(c, ""))} if found else ()
    if names and ("header" in names and not in_article and tag not in ("article", "h1", "h2", "h3")):
        return True
    return bool(names) and not _CUT_NAMES.isdisjoint(names)


class _Text(_Walker):
    """Blocks of text outside of cut branches, by where they are: in an article,
    in the main element, elsewhere. Level 3 is an article in which the tree cuts."""

    def __init__(self, page: str, low: frozenset, shared: frozenset):
        self.low, self.shared = low, shared
        self.blocks: tuple[list, list, list] = ([], [], [])
        self.parts: list[str] = []
        self.level = 0
        self.walk(page)
        self.edge()

    def edge(self):
        if self.parts:
            whole = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if whole:
                self.blocks[self.level].append(whole)
            self.parts = []

    def element(self, tag, node, sign, found, closed):
        _, _, level, cut = self.stack[-1]
        level = level or 0
        article = tag == "article" or found.get("role") == "article" or found.get("itemprop", "").lower() == "articlebody"
        if not cut:
            # An article that many pages share is still their text.
            judged = tag not in ("html", "body", "article", "main") if level < 2 else level == 3 and tag in _BLOCKS and not article
            cut = _named_out(tag, found, level >= 2) or (judged and node in self.low)
        if article:
            level = 2 if node in self.shared else 3
        elif (tag == "main" or found.get("role") == "main") and level < 1:
            level = 1
        if not closed:
            self.stack.append((tag, node, level, cut))

    def text(self, raw):
        _, _, level, cut = self.stack[-1]
        if not cut:
            self.level = min(level or 0, 2)
            self.parts.append(raw)

    def result(self) -> str:
        elsewhere, main, article = self.blocks
        return "\n".join(article or main or elsewhere)


def main_text(page: str | None, low: frozenset = frozenset(), shared: frozenset = frozenset()) -> str:
    return _Text(page or "", low, shared).result()


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def importance(pages: DataFrame) -> DataFrame:
    """host, node, pages, looks, says: the site style tree of each host, with the
    entropies of presentation and content between 0 and 1."""
    bound_arrow(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            for where, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = _Style(page or "")
                for node, look in s.looks.items():
                    for key in ((where, node, False, look), (where, node, True, s.says.get(node, 0))):
                        seen[key] = seen.get(key, 0) + 1
            if seen:
                columns = list(zip(*seen))
                kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(seen.values(), pa.int64())], names=["host", "node", "content", "value", "n"])

    counts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, node long, content boolean, value long, n long")
    each = counts.groupBy("host", "node", "content", "value").agg(F.sum("n").alias("n"))
    of = lambda content, v: F.sum(F.when(F.col("content") == content, v).otherwise(0))
    n, n_log_n = F.col("n"), F.col("n") * F.log2(F.col("n"))
    sums = each.groupBy("host", "node").agg(of(False, n).alias("pages"), of(False, n_log_n).alias("a"), of(True, n_log_n).alias("b"))
    entropy = lambda s: F.when(F.col("pages") > 1, 1 - F.col(s) / (F.col("pages") * F.log2("pages"))).otherwise(1.0)
    return sums.select("host", "node", "pages", entropy("a").alias("looks"), entropy("b").alias("says"))


def extract(pages: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = importance(pages)
    low, shared = F.greatest("looks", "says") < LEAST_IMPORTANCE, F.col("says") < DIFFERENT
    some = tree.where((F.col("pages") >= LEAST_PAGES) & (low | shared))
    nodes = lambda which, name: F.collect_list(F.when(which, F.col("node"))).alias(name)
    cut = staged(some.groupBy("host").agg(nodes(low, "low"), nodes(shared, "shared")), "low-importance")
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    joined = keyed.join(F.broadcast(cut) if cut.count() <= broadcast_rows else cut, "host", "left")

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = lambda x: frozenset(x) if x is not None else frozenset()
        for page, low, shared in batches:
            yield pd.Series([main_text(p, known(x), known(y)) for p, x, y in zip(page, low, shared)], dtype=object)

    out = joined.withColumn("text", text("html", "low", "shared"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
