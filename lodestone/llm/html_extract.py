"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree. Its nodes are the paths of block elements (tag and class names, digits
aside); a node has the styles, that is the sequences of child nodes, and the text blocks that its pages put there, each
with the number of pages that do. Importance is an entropy. Presentation counts as much as a node's styles vary from
page to page; content as little as its blocks recur, since a block on every page has entropy one over the pages. A node's
importance is ``(1 - GAMMA) * presentation + GAMMA * content`` of the whole branch, and 1 where one page alone has it.
What HTML says of a node is a feature of its content: importance falls by the share of its pages on which the node's
element or names are those of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader
comments, and by BESIDE of the share on which it stands beside an article (or, without one, the main element).

Each page loses its branches of importance under LOW; the other blocks are its text. A node is judged if at least PAGES
pages have it, whatever the size of its host; of fewer pages no entropy tells, so HTML's word stands alone. Low nodes that
one in RARE of a host's pages have go to all its pages as a list, which is bounded by the pages' size, whatever their
number; rarer ones are joined, node by node, with the pages that have them. A branch that holds all the text that is left stays, and so does all
of an article that would lose half of its characters. Equal pages of a host are counted once in its tree.

Counts are summed by host, node and block before anything is gathered, so a host with a third of all pages is no special
case. Null html or html without text gives the empty text;
pages with a null url or one without a host form a host together; repeated rows have equal texts; an empty table gives an
empty result. White space is what str.split() takes for it. A line break inside a block is white space. Other columns
aren't read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, per_batch, slices, small_batches, split_by, stored

#: Weight of content against presentation; importance below which a branch goes; what a place beside an article takes off.
GAMMA, LOW, BESIDE = 0.9, 0.3, 0.75
#: Pages that a node must be on to be judged; a node on fewer than one in so many of its host's pages isn't sent to all of them.
PAGES, RARE = 4, 100

BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul optgroup option".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
SILENT = frozenset("head svg math object canvas audio video select button datalist".split())
NOISE = frozenset("nav footer aside form dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar toolbar comment comments reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login widget pagination pager copyright".split())
HEADERS = frozenset({"header"})
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
#: Elements beyond which an implied end doesn't reach.
WALL = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": set()}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[^a-z]+")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass
class Node:
    tag: str
    path: int
    noise: bool
    landmark: str
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """blocks: (text, paths from the root down, noise, landmark); nodes: (path, hash of the style); noise: paths of nodes that HTML says are no content."""

    blocks: list[tuple[str, tuple[int, ...], bool, str]] = field(default_factory=list)
    nodes: list[tuple[int, int]] = field(default_factory=list)
    noise: set[int] = field(default_factory=set)

    def main(self) -> tuple[list[tuple[str, tuple[int, ...], bool, str]], bool]:
        """(the blocks of the article, of the main element, or all that aren't noise; whether it is one of the first two)."""
        good = [b for b in self.blocks if not b[2]]
        for landmark in ("article", "main"):
            if found := [b for b in good if b[3] == landmark]:
                return found, True
        return good, False


def hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host(url_col: str) -> Column:
    """The hash of a url's host, in lower case; of "" where there is none."""
    return F.xxhash64(F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit(""))))


def parse(html: str | None) -> Page:
    """The blocks and nodes of a page; elements that are left open end where HTML says."""
    page, text = Page(), html or ""
    stack = [Node("", 0, False, "")]
    said: list[str] = []
    silent, at, n = 0, 0, len(text)

    def flush() -> None:
        if said:
            words = " ".join(entities.unescape("".join(said)).split())
            said.clear()
            if words:
                page.blocks.append((words, tuple(x.path for x in stack[1:]), stack[-1].noise, stack[-1].landmark))

    def end() -> None:
        x = stack.pop()
        if x.noise:
            page.noise.add(x.path)
        page.nodes.append((x.path, hash64(repr([c for i, c in enumerate(x.children) if not i or x.children[i - 1] != c]))))

    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            if not silent:
                said.append(text[at:])
            break
        if m.start() > at and not silent:
            said.append(text[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and (e := re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)):
                at = e.end()
            elif not closing:
                at = n
            continue
        if tag in SILENT:
            silent = max(0, silent + (-1 if closing else not m[3].endswith("/")))
            continue
        if tag in ("body", "article", "main"):
            silent = 0  # a head or the like that was left open
        if tag == "br":
            said.append(" ")
        if tag not in BLOCK:
            continue
        flush()
        if closing:
            if any(x.tag == tag for x in stack):
                while stack[-1].tag != tag:
                    end()
                end()
            continue
        if tag == "hr":
            continue
        if stack[-1].tag == "p":  # a paragraph holds no block
            end()
        if tag in CLOSES:
            open_ = len(stack)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in WALL[tag]:
                    break
                if stack[k].tag in CLOSES[tag]:
                    open_ = k
            while len(stack) > open_:
                end()
        stack.append(_node(stack[-1], tag, m[3]))
    flush()
    while len(stack) > 1:
        end()
    return page


def _node(above: Node, tag: str, attributes: str) -> Node:
    names: list[str] = []
    hidden = False
    if attributes.strip(" /\t\n"):
        has = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        names = (has.get("class", "") + " " + has.get("id", "")).lower().split()
        style = has.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in has or has.get("aria-hidden") == "true" or "display:none" in style or has.get("role", "").lower() in ROLES
        if has.get("role") == "main":
            tag = "main"
    label = ".".join([tag, *sorted({re.sub(r"\d+", "#", x) for x in names})])
    path = hash64(f"{above.path}>{label}")
    above.children.append(path)
    parts = {p for x in names for p in _WORD.split(x)}
    inside = above.landmark
    noise = above.noise or hidden or tag in NOISE or bool(parts & NAMES) or (not inside and (tag in HEADERS or bool(parts & HEADERS)))
    landmark = "article" if tag == "article" and not noise else inside or ("main" if tag == "main" else "")
    return Node(tag, path, noise, landmark)


def text_of(page: Page, low: frozenset[int] = frozenset()) -> str:
    """The page's text without the branches in low."""
    blocks, marked = page.main()
    if not blocks:
        return ""
    whole = frozenset.intersection(*(frozenset(b[1]) for b in blocks))  # branches that hold all of it
    kept = [b for b in blocks if whole.issuperset(low.intersection(b[1]))]
    size = lambda of: sum(len(b[0]) for b in of)
    if not kept or (marked and 2 * size(kept) < size(blocks)):
        kept = blocks
    return "\n\n".join(b[0] for b in kept)


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, node, pages, presentation, content, importance: the merged trees of all hosts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in chain.from_iterable(map(slices, batches)):
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(html)
                nodes = dict(page.nodes)
                blocks, marked = page.main()
                inside = {e for b in blocks for e in b[1]}
                seen.update((h, e, 3, 0) for e in page.noise)
                seen.update((h, e, 4, 0) for e in nodes if marked and e not in inside)
                seen.update((h, e, 1, s) for e, s in nodes.items())
                seen.update((h, e, 2, 0) for e in nodes)
                seen.update({(h, e, 0, t) for text, path, *_ in page.blocks for t in (hash64(text),) for e in path})
                if len(seen) > 1 << 18:
                    yield emit(seen)
        if seen:
            yield emit(seen)

    def emit(seen: Counter) -> pa.RecordBatch:
        cols = np.array([*seen.keys()], dtype=np.int64).reshape(-1, 4).T
        out = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([*seen.values()], pa.int64())], names=["host", "node", "kind", "value", "n"])
        seen.clear()
        return out

    small_batches(pages.sparkSession)
    distinct = pages.select(host(url_col).alias("host"), F.xxhash64(F.coalesce(html_col, F.lit(""))).alias("hash"), F.col(html_col).alias("html"))
    copies = cut(distinct.groupBy("host", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("host", "hash"))
    near, rest = split_by(distinct, copies, ["host", "hash"])
    distinct = rest.unionByName(near.dropDuplicates(["host", "hash"]))  # pages without a copy stay where they are
    rows = distinct.select("host", "html").mapInArrow(run, "host long, node long, kind long, value long, n long")
    rows = rows.groupBy("host", "node", "kind", "value").agg(F.sum("n").cast("double").alias("n"))
    kind = F.col("kind")
    of = rows.groupBy("host", "node").agg(
        F.max(F.when(kind == 2, F.col("n"))).alias("pages"),
        F.avg(F.when(kind == 0, F.log("n"))).alias("recurs"),
        F.sum(F.when(kind == 1, F.col("n") * F.log("n"))).alias("styles"),
        F.coalesce(F.max(F.when(kind == 3, F.col("n"))), F.lit(0.0)).alias("noise"),
        F.coalesce(F.max(F.when(kind == 4, F.col("n"))), F.lit(0.0)).alias("beside"),
    )
    log_m = F.log("pages")
    several = F.col("pages") > 1
    presentation = F.when(several, 1 - F.col("styles") / F.col("pages") / log_m).otherwise(1.0)
    content = F.when(several & F.col("recurs").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("recurs") / log_m)).otherwise(1.0)
    hints = (1 - F.col("noise") / F.col("pages")) * (1 - BESIDE * F.col("beside") / F.col("pages"))
    of = of.select("host", "node", F.col("pages").cast("long").alias("pages"), presentation.alias("presentation"), content.alias("content"), hints.alias("hints"))
    return of.withColumn("importance", (F.lit(1 - GAMMA) * F.col("presentation") + F.lit(GAMMA) * F.col("content")) * F.col("hints"))


def _low(tree: DataFrame) -> DataFrame:
    """host, node, rare: the judged nodes of low importance; rare ones are on fewer than one in RARE pages of the host."""
    most = tree.groupBy("host").agg(F.max("pages").alias("most"))
    low = tree.filter((F.col("pages") >= PAGES) & (F.col("importance") < LOW)).join(most, "host")
    return low.select("host", "node", (F.col("pages") * RARE < F.col("most")).alias("rare"))


def low_nodes(tree: DataFrame) -> DataFrame:
    """host, low: the low nodes that aren't rare, at most RARE times as many as a page has nodes."""
    return _low(tree).filter(~F.col("rare")).groupBy("host").agg(F.collect_list("node").alias("low"))


def rare_low_nodes(rows: DataFrame, rare: DataFrame) -> DataFrame:
    """host, hash, rare: the nodes of rare (host, node) that a page has, for the pages of rows (host, hash, html) that have any."""

    def nodes(r: dict) -> dict:
        return {"host": r["host"], "hash": r["hash"], "nodes": [sorted({e for e, _ in parse(h).nodes}) for h in r["html"]]}

    asked = rows.select("host", "hash", "html").join(rare.select("host").distinct(), "host", "left_semi")
    of = per_batch(asked, "host long, hash long, nodes array<long>", nodes).select("host", "hash", F.explode("nodes").alias("node"))
    return of.join(rare, ["host", "node"]).groupBy("host", "hash").agg(F.collect_set("node").alias("rare"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text of every page."""
    tree = stored(style_tree(pages, url_col, html_col))
    low, rare = stored(low_nodes(tree)), stored(_low(tree).filter("rare").select("host", "node"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"))
    if rare.head(1):
        rows = rows.withColumn("hash", F.xxhash64("html"))
        found = stored(rare_low_nodes(rows, rare))
        near, rest = split_by(rows, found, ["host", "hash"])  # pages without such a node stay where they are
        rows = near.join(found, ["host", "hash"], "left").unionByName(rest.withColumn("rare", F.lit(None).cast("array<long>")))
    else:
        rows = rows.withColumn("rare", F.lit(None).cast("array<long>"))

    def f(columns: dict) -> dict:
        text = [text_of(parse(h), frozenset(x or ()).union(y or ())) for h, x, y in zip(columns["html"], columns["low"], columns["rare"], strict=True)]
        return {"id": columns["id"], "url": columns["url"], "text": text}

    out = per_batch(rows.join(low, "host", "left").select("id", "url", "html", "low", "rare"), "id long, url string, text string", f)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
