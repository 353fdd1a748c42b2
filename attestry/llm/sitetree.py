"""Main text of web pages by site style trees.

The DOMs of all pages of a host are merged into one tree of presentation nodes: an element is known by the chain of block elements
above it with their class words. Over the m pages that hold a node,

* its content importance is 1 less the mean entropy of the texts below it, where a text found on n pages has entropy log_m n:
  text of its own on each page counts 1, the same text on every page 0;
* its presentation importance is the entropy of its child sequences over the pages, unless HTML itself says what the branch is: 0
  for landmarks around an article (nav, footer, form, ..., the same as role or class words, and anything beside an article),
  1 for the article;
* both are blended: ``(1 - 0.9**l) * presentation + 0.9**l * content`` over l child sequences, and for landmarks 0.6 to 0.4, so
  that statistics of a host with few pages or many copies cannot turn a menu into content or an article into a menu.

Branches below ``least`` are removed from each page with all that is in them, save an article. The body itself is never removed.
Nodes that are no landmark need ``least_pages`` pages of evidence; on fewer they stay. Where nothing of a page would remain although it
has texts outside landmarks, none of these are removed: a host of copies gives no evidence.

Scripts, styles, the head, comments, form controls and embedded media are never text. Pages are parsed twice, for the statistics
and for the text, so that no page text is moved. Moved: one hash per (page, node, text), pre-aggregated by (host, node, text) and
then (host, node); a hot host only adds to counts. The removed nodes are broadcast if they are at most ``most_broadcast``; beyond,
each page gets those of its own nodes by a join. No list is held per host then.

Defined results: null or empty html, and pages without content: empty text. A null url, or one without host, is of the host ''.
Repeated ids and rows are pages of their own. Broken, nested or truncated markup is read as far as it goes; elements close
implicitly at the next block or at the end of their parent. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.session import cut_lineage

GAMMA, LANDMARK = 0.9, 0.6
DEPTH = 512  # as in browsers: elements nested deeper are taken for children of this level

# Elements and words of HTML and of common page templates
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style noscript template svg canvas iframe object audio video button select datalist textarea option".split())
BLOCK = frozenset(
    "html body main article section nav aside header footer form fieldset dialog menu search div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre address figure figcaption details summary center hr br".split()
)
CLOSES_P = BLOCK - frozenset("br td th tr html body thead tbody tfoot caption".split())
CLOSED_BY_NEXT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("table ul ol dl body html article section div td".split())
ASIDE_TAGS = frozenset("nav aside footer form dialog menu search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar aside ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner cookie cookies consent gdpr "
    "notice popup modal newsletter subscribe signup login comment comments disqus respond replies share sharing social related recommended pagination pager".split()
)
OUTSIDE_ONLY = frozenset(["header"])  # inside an article a header holds its title
PLAIN = frozenset("html body p h1 h2 h3 h4 h5 h6 table tbody tr td th li b i em strong a".split())  # their class words say how text looks, not what it is
ARTICLE_WORDS = frozenset(["comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "related", "promo"])

AROUND, ARTICLE, NEITHER = 0, 1, 2
WORDS = re.compile(r"[a-z]+")
HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=4096)
def landmark(tag: str, role: str | None, words: str | None, inside: bool) -> int:
    """What HTML says of an element with this role and these class and id words: around the article, the article itself, or neither."""
    role = (role or "").lower()
    named = set(WORDS.findall(HUMPS.sub(" ", words).lower())) if words else set()
    if tag in ("article", "main") or role in ("article", "main"):
        return AROUND if tag == "article" and named & ARTICLE_WORDS else ARTICLE
    if tag in ASIDE_TAGS or role in ASIDE_ROLES or not inside and (tag == "header" or named & OUTSIDE_ONLY):
        return AROUND
    return AROUND if tag not in PLAIN and named & ASIDE_WORDS else NEITHER


@lru_cache(maxsize=4096)
def shown(tag: str, classes: str | None) -> str:
    """An element's name in the tree: its tag and class words."""
    return ".".join([tag, *sorted(set(classes.lower().split()))]) if classes else tag


class Page(HTMLParser):
    """The text blocks of a page, each with its chain of nodes; per node its landmark and child sequence."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int]] = []  # tag, node (-1: inline), landmark in force
        self.names: list[tuple[int, str]] = []  # node: parent, name
        self.known: dict[tuple[int, str], int] = {}
        self.marks: list[int] = []
        self.children: list[list[str]] = []
        self.blocks: list[tuple[int, str]] = []
        self.buffer: list[str] = []
        self.quiet = 0
        self.deeper: Counter[str] = Counter()  # open elements beyond DEPTH
        self.feed(html)
        self.close()
        self._flush()

    def is_root(self, node: int) -> bool:
        return self.names[node][1].partition("#")[0].partition(".")[0] in ("html", "body")

    def _node(self) -> int:
        for _, node, _ in reversed(self.open):
            if node >= 0:
                return node
        return -1

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer = []
            if text:
                self.blocks.append((self._node(), text))

    def _pop(self, at: int) -> None:
        for tag, node, _ in self.open[at:]:
            if node >= 0:
                self._flush()
            if tag in SILENT:
                self.quiet -= 1
        del self.open[at:]

    def _close_implied(self, tag: str) -> None:
        if tag in CLOSES_P:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == "p":
                    return self._pop(at)
                if self.open[at][0] in BLOCK:
                    break
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in CLOSED_BY_NEXT.get(tag, ()):
                return self._pop(at)
            if self.open[at][0] in SCOPES - {"td"} or not CLOSED_BY_NEXT.get(tag):
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
            self._close_implied(tag)
        if tag in VOID:
            return
        if len(self.open) >= DEPTH and tag not in SILENT:
            self.deeper[tag] += 1
            return
        attributes = dict(attrs) if attrs else {}
        above = self.open[-1][2] if self.open else NEITHER
        classes, name = attributes.get("class"), attributes.get("id")
        mark = landmark(tag, attributes.get("role"), f"{classes or ''} {name or ''}" if classes or name else None, above == ARTICLE)
        node = -1
        if tag in BLOCK or mark != NEITHER:
            if tag not in BLOCK:
                self._flush()
            node = self._enter(shown(tag, classes), mark)
        self.open.append((tag, node, above if mark == NEITHER else mark))
        self.quiet += tag in SILENT

    def _enter(self, name: str, mark: int) -> int:
        parent = self._node()
        if parent >= 0 and self.children[parent][-1:] != [name]:  # a run of like children is one
            self.children[parent].append(name)
        named = f"{name}#{mark}"
        node = self.known.setdefault((parent, named), len(self.names))
        if node == len(self.names):
            self.names.append((parent, named))
            self.marks.append(mark)
            self.children.append([])
        return node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no self-closing elements but the void ones

    def handle_endtag(self, tag: str) -> None:
        if tag in ("p", "br"):
            self._flush()
        if self.deeper[tag]:
            self.deeper[tag] -= 1
            return self._flush() if tag in BLOCK else None
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                return self._pop(at)
            if tag not in BLOCK and self.open[at][0] in BLOCK:
                return None  # an inline end tag ends nothing outside its block
        return None

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)  # ``<![``: in HTML a comment up to the next ``>``

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self.buffer.append(data)


class Branches:
    """A page's nodes with what the host's tree knows them by."""

    def __init__(self, html: str):
        self.page = page = Page(html)
        self.has_article = any(mark == ARTICLE for mark in page.marks)
        self.marks: list[int] = []
        self.ids: list[int] = []
        for (parent, name), own in zip(page.names, page.marks):
            above = self.marks[parent] if parent >= 0 else NEITHER
            mark = above if own == NEITHER else own
            if mark == NEITHER and self.has_article and not page.is_root(len(self.marks)):
                mark = NEITHER if self._leads(len(self.marks)) else AROUND
            self.marks.append(mark)
            self.ids.append(xxhash.xxh3_64_intdigest(f"{self.ids[parent] if parent >= 0 else ''}/{name}@{mark}") - 2**63)

    def _leads(self, node: int) -> bool:
        """Does the article stand below this node?"""
        if not hasattr(self, "_above"):
            self._above: set[int] = set()
            for i, mark in enumerate(self.page.marks):
                while mark == ARTICLE and i >= 0 and i not in self._above:
                    self._above.add(i)
                    i = self.page.names[i][0]
        return node in self._above

    def chain(self, node: int) -> Iterator[int]:
        while node >= 0:
            yield node
            node = self.page.names[node][0]

    def statistics(self) -> Iterator[tuple[int, int, int, int]]:
        """(node, landmark, kind, hash) of each distinct text below a node (kind 1), of its child sequence (2), and of the page (0)."""
        texts: list[set[int]] = [set() for _ in self.ids]
        for node, text in self.page.blocks:
            digest = xxhash.xxh3_64_intdigest(text) - 2**63
            for n in self.chain(node):
                texts[n].add(digest)
        for n, own in enumerate(self.ids):
            yield own, self.marks[n], 0, 0
            yield own, self.marks[n], 2, xxhash.xxh3_64_intdigest(" ".join(self.page.children[n])) - 2**63
            for digest in texts[n]:
                yield own, self.marks[n], 1, digest

    def text(self, removed: set[int]) -> str:
        """The page's blocks outside removed branches."""
        stays: list[bool] = []  # a node's parent comes before it
        for n, (parent, _) in enumerate(self.page.names):
            above = self.page.marks[n] == ARTICLE or parent < 0 or stays[parent]
            stays.append(above and (self.ids[n] not in removed or self.page.is_root(n)))
        kept = [text for node, text in self.page.blocks if node < 0 or stays[node]]
        return " ".join(kept or [text for node, text in self.page.blocks if node < 0 or self.marks[node] == NEITHER])


def _parsed(html: str | None) -> Branches:
    return Branches(html or "")


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, mark, kind, digest) of every page."""
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = ["host", "node", "mark", "kind", "digest"]
    for batch in batches:
        found: list[tuple] = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
            found.extend((host, *row) for row in _parsed(html.as_py()).statistics())
            if len(found) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)


def _page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, host, node) of every page."""
    for batch in batches:
        rows, hosts, nodes = [], [], []
        for row, host, html in zip(batch.column("_row").to_pylist(), batch.column("host").to_pylist(), batch.column("html")):
            own = _parsed(html.as_py()).ids
            rows += [row] * len(own)
            hosts += [host] * len(own)
            nodes += own
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(hosts, pa.string()), pa.array(nodes, pa.int64())], names=["_row", "host", "node"])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def importances(pages: DataFrame) -> DataFrame:
    """host, node, mark, pages, importance of every node of every host's tree; ``pages`` has host and html."""
    rows = pages.select("host", "html").mapInArrow(_statistics, "host string, node long, mark int, kind int, digest long")
    seen = rows.groupBy("host", "node", "kind", "digest").agg(F.count("*").alias("n"), F.first("mark").alias("mark"))
    nodes = seen.groupBy("host", "node").agg(
        F.first("mark").alias("mark"),
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.avg(F.when(F.col("kind") == 1, F.log("n"))).alias("_repeats"),
        F.count_if(F.col("kind") == 2).alias("_styles"),
        F.sum(F.when(F.col("kind") == 2, F.col("n") * F.log("n"))).alias("_spread"),
    )
    log_m = F.log("pages")
    alone = F.col("pages") < 2
    content = F.when(alone, 1.0).otherwise(1 - F.coalesce("_repeats", F.lit(0.0)) / log_m)
    presentation = F.when(alone, 1.0).otherwise((log_m - F.col("_spread") / F.col("pages")) / log_m)
    fade = F.pow(F.lit(GAMMA), F.col("_styles"))
    tree = (1 - fade) * presentation + fade * content
    said = F.when(F.col("mark") == ARTICLE, 1.0).when(F.col("mark") == AROUND, 0.0)
    return nodes.select("host", "node", "mark", "pages", F.coalesce(LANDMARK * said + (1 - LANDMARK) * tree, tree).alias("importance"))


def extracted(pages: DataFrame, *, id_column: str = "page_id", url: str = "url", html: str = "html", least: float = 0.5, least_pages: int = 10, most_broadcast: int = 500_000) -> DataFrame:
    """id, url and text of every page."""
    named = pages.select(F.col(id_column).alias("_id"), F.col(url).alias("_url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    landmarks = F.col("mark") != NEITHER
    low = cut_lineage(importances(named).filter((F.col("importance") < least) & (landmarks | (F.col("pages") >= least_pages))).select("host", "node"))
    if low.count() <= most_broadcast:
        lists = F.broadcast(low.groupBy("host").agg(F.collect_list("node").alias("removed")))  # together at most most_broadcast nodes
        asked = named.join(lists, "host", "left")
    else:
        keyed = named.withColumn("_row", F.sha2(F.concat_ws("\x00", "host", F.coalesce("html", F.lit(""))), 256))
        own = keyed.select("_row", "host", "html").mapInArrow(_page_nodes, "_row string, host string, node long").distinct()
        lists = own.join(low, ["host", "node"]).groupBy("_row").agg(F.collect_list("node").alias("removed"))  # a page's own nodes
        asked = keyed.join(lists, "_row", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_parsed(page.as_py()).text(set(removed.as_py() or ())) for page, removed in zip(batch.column("html"), batch.column("removed"))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], names=["_id", "_url", "text"])

    kinds = dict(named.dtypes)
    out = asked.select("_id", "_url", "html", "removed").mapInArrow(extract, f"_id {kinds['_id']}, _url {kinds['_url']}, text string")
    return out.select(F.col("_id").alias(id_column), F.col("_url").alias(url), "text")
