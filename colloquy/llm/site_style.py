"""Main text of web pages by site style trees.

Pages of one host are merged into a tree of style nodes: a node is the path of
elements (with their classes and ids) down to it. Over a host's pages

- the presentation importance of a node is the normalised entropy of the sequences
  of children it is used with,
- the content importance is one minus the mean, over the distinct texts directly in
  it, of log(pages with that text) / log(pages with the node),

and a branch is as important as the most important node in it; nodes on fewer than
``min_pages`` pages, copies counted once, have full importance. What an element's tag,
class, id and role say is added, and a branch whose sum is below ``threshold`` is removed:

- ``NOISE`` for navigation, headers, footers, sidebars, notices, adverts, forms and
  comments, by tag or by whole class names ("site-footer", not "article-header");
- ``HINT`` for class names that only contain such a word, so there the tree decides;
- ``MARKED`` for classed elements inside a marked article; plain ones in it stay.

A wrapper is not condemned by its name: where an element holds most of the page's
prose, ``NOISE`` and ``HINT`` are not added, unless it is a comment section, or by its
tag a menu or the like that does not hold every marked article. A marked article is judged by neither
its wrappers nor the tree; what lies outside it is left out. Scripts and styles have no text.

Trees are counted as (host, node, feature) rows with map-side combining, so a host
with a third of all pages is no hot spot. The removed branches go to the tasks as a
broadcast if they are few, else each page's own nodes are joined with them.

Rows: a NULL html is empty, a NULL url has the empty host. NULL or repeated page
ids are pages like any other. An empty table gives no rows. A page is read whole by one
task, however long; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stored

THRESHOLD = 0.4
NOISE, HINT, MARKED = -0.7, -0.3, 0.2
MIN_PAGES = 5
BROADCAST_NODES = 200_000
#: Elements below this depth are one node with the one above them; no text is lost.
MAX_DEPTH = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_HOST = re.compile(r"(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
NOISE_TAGS = frozenset(
    "nav header footer aside form button select dialog menu head svg canvas object search".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond".split())
#: Parts of a class name that leave the meaning of a noise word beside them as it is.
FILLERS = frozenset(
    "area bar bottom box container footer global inner item left links list main page primary right secondary "
    "section site slot top unit wrap wrapper".split()
)
#: First parts that say how a wrapper is laid out.
LAYOUT = frozenset("closed has hide is no not open show with without".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices popup promo related respond share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget".split()
)
#: Start tag -> open elements that it ends, and those it does not look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select"}),
}
_P = ({"p"}, {"article", "aside", "button", "div", "footer", "header", "main", "nav", "section", "table", "td", "th", "li"})


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _said(tokens) -> tuple[float, bool]:
    """What class names add to importance, and whether they mean comments."""
    prior, comment = 0.0, False
    for token in tokens:
        parts = _WORD.findall(token)
        found = NOISE_WORDS.intersection(parts)
        if not found:
            continue
        if parts[0] not in LAYOUT and not COMMENT_WORDS.isdisjoint(parts):
            comment = True
        whole = all(part in NOISE_WORDS or part in FILLERS for part in parts)
        prior = min(prior, NOISE if whole or comment else HINT)
    return prior, comment


class _Element:
    __slots__ = ("tag", "parent", "node", "depth", "styled", "said", "comment", "mark", "children", "prose", "holds", "noise", "main", "prior")

    def __init__(self, parent, tag, attributes):
        self.tag, self.parent, self.children = tag, parent, []
        named = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        style = " ".join(named[k] for k in ("class", "id") if k in named)
        role = named.get("role", "").lower()
        self.styled = bool(style)
        self.said, self.comment = _said(f"{style} {role}".lower().split()) if style or role else (0.0, False)
        self.mark = tag in ("article", "main") or role == "main" or "articlebody" in named.get("itemprop", "").lower()
        if self.mark and not self.comment or tag in ("html", "body"):
            self.said = 0.0
        elif tag in NOISE_TAGS:
            self.said = NOISE
        self.prose, self.holds = 0, 0
        self.noise, self.main, self.prior = False, False, None
        self.depth = parent.depth + 1 if parent is not None else 0
        if self.depth >= MAX_DEPTH:
            self.node = parent.node
        else:
            self.node = xxhash.xxh64_intdigest(f"{parent.node if parent is not None else 0} {tag} {style}") >> 1

    def judge(self, root: _Element) -> None:
        """Sets ``noise`` (no importance could make up for it), ``main`` and ``prior`` (None: not judged)."""
        above, said = self.parent, self.said
        may_wrap = self.tag not in NOISE_TAGS or self.tag == "form" or self.holds == root.holds > 0
        if 2 * self.prose > root.prose and may_wrap and not self.comment:
            said = 0.0
        self.noise = above.noise or said <= NOISE
        opens = self.mark and not self.noise
        self.main = above.main or opens
        if opens or self.holds or self.tag in ("html", "body") or (above.main and not self.styled):
            self.prior = None
        else:
            self.prior = said + (MARKED if above.main else 0.0)


class Page:
    """``blocks``: ``(element, text)`` in page order; ``elements``: all block elements met."""

    def __init__(self, source: str):
        self.blocks, self.elements, self._text = [], [], []
        self.stack = [_Element(None, "html", "")]
        at = 0
        while (m := _TOKEN.search(source, at)) is not None:
            if m.start() > at:
                self._text.append(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else len(source)
                self._text.append(" ")
            else:
                self._start(tag, m[3])
        self._text.append(source[at:])
        self._flush()
        self._judge()

    def _judge(self):
        root = self.stack[0]
        prose = any(e.tag in PROSE for e, _ in self.blocks)
        for e, text in self.blocks:
            if not prose or e.tag in PROSE:
                e.prose += len(text)
        for e in reversed(self.elements):
            e.parent.prose += e.prose
            e.parent.holds += e.holds + (e.mark and not e.comment)
        for e in self.elements:
            e.judge(root)

    def _flush(self):
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            self._text = []
            if text:
                self.blocks.append((self.stack[-1], text))

    def _close(self, ended, barriers):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in ended:
                del self.stack[k:]
                return
            if self.stack[k].tag in barriers:
                return

    def _start(self, tag, attributes):
        if tag == "br":
            self._text.append(" ")
            return
        if tag == "html":
            return
        if tag in BLOCK:
            self._flush()
            self._close(*_P)
            if tag in ENDS:
                self._close(*ENDS[tag])
            if tag in VOID:
                return
            self._push(_Element(self.stack[-1], tag, attributes))
        elif tag not in VOID and "=" in attributes:
            inline = _Element(self.stack[-1], tag, attributes)
            if inline.said <= NOISE:
                self._flush()
                self._push(inline)

    def _push(self, element):
        self.stack[-1].children.append(element.node)
        self.stack.append(element)
        self.elements.append(element)

    def _end(self, tag):
        if tag in BLOCK:
            self._flush()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._flush()
                del self.stack[k:]
                return

    def main_text(self, importance, threshold: float = THRESHOLD) -> str:
        """Blocks of the article, or of the whole page if none is marked, without removed branches.

        ``importance`` holds the nodes of the host that may be removed; others have full importance.
        """
        marked = any(e.main for e in self.elements)
        removed = set()
        for e in self.elements:
            low = e.prior is not None and importance.get(e.node, 1.0) + e.prior < threshold
            if low or e.noise or e.parent in removed:
                removed.add(e)
        return "\n".join(text for e, text in self.blocks if e not in removed and (e.main or not marked))


def parse(source: str | None) -> Page:
    return Page(source or "")


def _features(page: Page):
    """``(node, kind, feature)`` of a page: 0 it has the node, 1 a text, 2 its children, 3 an ancestor."""
    out = set()
    for e in page.elements:
        if e.noise:
            continue
        out.add((e.node, 2, xxhash.xxh64_intdigest(repr(e.children)) >> 1))
        if (e.node, 0, 0) in out:
            continue
        out.add((e.node, 0, 0))
        above = e
        while above is not None:
            out.add((e.node, 3, above.node))
            above = above.parent
    for e, text in page.blocks:
        if not e.noise:
            out.add((e.node, 1, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1))
    return out


def _copies(pages: DataFrame, url: str, html: str, broadcast_groups: int) -> DataFrame:
    """``(_url, _html, _copies)`` per page: how often its host has its content."""
    rows = pages.select(
        F.col(url).alias("_url"), F.col(html).alias("_html"),
        F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), f"^{_HOST.pattern}", 1)).alias("_site"),
        F.xxhash64(html).alias("_content"),
    )
    same = rows.groupBy("_site", "_content").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    same = stored(same, "copies")
    if same.count() <= broadcast_groups:
        same = F.broadcast(same)
    return rows.join(same, ["_site", "_content"], "left").select("_url", "_html", F.coalesce("_copies", F.lit(1)).alias("_copies"))


def style_nodes(
    pages: DataFrame, url: str = "url", html: str = "html", broadcast_groups: int = BROADCAST_NODES
) -> DataFrame:
    """``(host, node, kind, feature, n)``: the merged style trees; ``n`` counts distinct contents of pages.

    Each of a content's ``c`` copies on a host counts ``1 / c``, so no page has to move.
    """

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for u, source, copies in zip(*(c.to_pylist() for c in batch.columns)):
                host = xxhash.xxh64_intdigest(host_of(u)) >> 1
                for f in _features(parse(source)):
                    seen[(host, *f)] += 1 / copies
            columns = zip(*((*k, n) for k, n in seen.items())) if seen else ((),) * 5
            names = ["host", "node", "kind", "feature", "n"]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = _copies(pages, url, html, broadcast_groups).mapInArrow(
        run, "host bigint, node bigint, kind int, feature bigint, n double"
    )
    return rows.groupBy("host", "node", "kind", "feature").agg(F.round(F.sum("n")).cast("bigint").alias("n"))


def removed_branches(nodes: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, node, importance)`` of the branches that are below ``threshold`` or that ``HINT`` can bring there."""
    text, children = F.col("kind") == 1, F.col("kind") == 2
    count = lambda kind, value: F.sum(F.when(kind, value))
    own = (
        nodes.where("kind < 3")
        .groupBy("host", "node")
        .agg(
            F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
            F.avg(F.when(text, F.ln("n"))).alias("text_spread"),
            count(children, F.col("n")).alias("uses"),
            count(children, F.col("n") * F.ln("n")).alias("use_logs"),
        )
        .select(
            "host", "node", "pages",
            F.greatest(
                F.coalesce(1 - F.col("text_spread") / F.ln("pages"), F.lit(0.0)),
                F.coalesce((F.ln("uses") - F.col("use_logs") / F.col("uses")) / F.ln("pages"), F.lit(0.0)),
            ).alias("importance"),
        )
        .withColumn("importance", F.when(F.col("pages") < min_pages, 1.0).otherwise(F.col("importance")))
    )
    above = nodes.where("kind = 3").select("host", "node", F.col("feature").alias("branch"))
    return (
        above.join(own, ["host", "node"])
        .groupBy("host", "branch")
        .agg(F.max("importance").alias("importance"))
        .where(F.col("importance") < threshold - HINT)
        .select("host", F.col("branch").alias("node"), "importance")
    )


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD,
    min_pages: int = MIN_PAGES, broadcast_nodes: int = BROADCAST_NODES,
) -> DataFrame:
    """``(key, url, text)`` per row of ``pages``: its main text, one block a line."""
    kind = pages.schema[key].dataType.simpleString()
    nodes = stored(style_nodes(pages, url, html, broadcast_nodes), "nodes")
    removed = stored(removed_branches(nodes, threshold, min_pages), "branches")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    few = removed.count() <= broadcast_nodes
    if few:
        by_host: dict[int, dict[int, float]] = {}
        for r in removed.collect():
            by_host.setdefault(r["host"], {})[r["node"]] = r["importance"]
        sent = pages.sparkSession.sparkContext.broadcast(by_host)
        rows = rows.withColumn("_removed", F.lit(None).cast("array<struct<node:bigint,importance:double>>"))
    else:
        sent = None
        rows = rows.withColumn("_page", F.xxhash64("_url", "_html"))
        found = (
            page_nodes(rows).join(removed, ["host", "node"]).groupBy("_page")
            .agg(F.collect_list(F.struct("node", "importance")).alias("_removed"))
        )
        rows = rows.join(found, "_page", "left").select("_key", "_url", "_html", "_removed")

    def run(batches):
        for batch in batches:
            texts = []
            for u, source, nodes in zip(*(batch.column(c).to_pylist() for c in ("_url", "_html", "_removed"))):
                if sent is not None:
                    low = sent.value.get(xxhash.xxh64_intdigest(host_of(u)) >> 1, {})
                else:
                    low = {x["node"]: x["importance"] for x in nodes or ()}
                texts.append(parse(source).main_text(low, threshold))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_url"), pa.array(texts, pa.string())], names=["_key", "_url", "text"]
            )

    return rows.mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string")


def page_nodes(rows: DataFrame) -> DataFrame:
    """``(_page, host, node)`` for the style nodes of every page."""

    def run(batches):
        for batch in batches:
            out = set()
            for page, u, source in zip(*(c.to_pylist() for c in batch.columns)):
                host = xxhash.xxh64_intdigest(host_of(u)) >> 1
                out.update((page, host, e.node) for e in parse(source).elements)
            columns = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_page", "host", "node"])

    return rows.select("_page", "_url", "_html").mapInArrow(run, "_page bigint, host bigint, node bigint").distinct()
