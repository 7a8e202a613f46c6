"""Main text of HTML pages by a site style tree.

The DOMs of all pages of a host are merged: elements of one path (block tags with their classes)
are one node of the host's tree. A node's importance is high where its contents differ from page
to page and low where they return, by the entropy of each content over the pages that show it,
with a small share for the variety of layouts it stands in. Tags and classes with a fixed role
(menus, footers, adverts, forms, ...) weigh a node down, which also covers hosts of one page; names
say nothing about html, body, a page's own article or main element, or what these stand in;
branches of an article or main element are weighed up a little, so those go that return on nearly
all pages. Branches below the threshold go. A page whose article would lose all its text is a copy
of others, not boilerplate, and keeps it.

The counts are summed by host, path and content before they are shuffled, so a host with a third
of all pages is no larger than its distinct contents; the low paths of a host are joined back to
its pages, and Spark splits that join where a host is large.

Nulls and odd input: null or empty html gives an empty text; a null url belongs to the empty
host; markup may be unclosed or cut off anywhere; equal pages count like others; an empty table
gives an empty result. Nothing is dropped or cut but what the tree judges unimportant.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from clauseflow.llm.words import column
from clauseflow.session import cut_lineage

#: Share of layouts in a node's importance; least weighted importance of what stays.
LAYOUT_SHARE, THRESHOLD = 0.1, 0.4
#: Weight of nodes whose tag or class names a role other than content.
ROLE_WEIGHT = 0.25
#: Share of what an article's or main element's branches lack in importance that is made up.
MAIN_SHARE = 0.2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
ROLE_TAGS = frozenset(
    "head script style title textarea noscript template iframe svg object canvas select button "
    "form nav menu aside footer dialog xmp noembed noframes".split()
)
ROLE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent "
    "notice popup modal overlay newsletter subscribe signup login share sharing social related "
    "recommended comment comments disqus respond reply replies pagination pager widget toolbar "
    "masthead search complementary contentinfo alert".split()
)
#: Words before a role word that turn it round, and words behind one that leave its sense.
TURNS = frozenset("no not non without with has hide".split())
PARTS = frozenset("list box section area wrap wrapper container block form bar inner outer item items row".split())
#: A role only outside an article.
OUTER = frozenset(["header", "banner"])
MAIN = frozenset(["article", "main"])
#: An opened tag of the key closes these, up to the nearest of the stops.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table html body article main section div td th blockquote".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


@dataclass
class Node:
    tag: str
    label: str
    path: int
    weight: float
    main: bool
    #: the weight by tags alone
    tagged: float
    children: int = 0


def _says(name: str, words: frozenset) -> bool:
    """Whether a class name is a role word, ends in one (site-footer), or adds only a part to one
    (comment-list); no-sidebar and with-nav say the contrary, comment-status-open something else."""
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    if not parts or TURNS & set(parts):
        return False
    return parts[-1] in words or (len(parts) > 1 and parts[-1] in PARTS and parts[-2] in words)


def _role(attributes: str, main: bool) -> tuple[str, bool]:
    """(class part of the label, whether class, id or role name something but content)."""
    names, role = "", False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = entities.unescape(value.strip("\"'"))
        if name == "class":
            names = ".".join(sorted(value.split()))
        if name in ("class", "id", "role"):
            role |= any(_says(t, ROLE_WORDS if main else ROLE_WORDS | OUTER) for t in value.lower().split())
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            role = True
        elif name == "style" and re.search(r"display\s*:\s*none", value.lower()):
            role = True
    return names, role


def blocks(source: str) -> Iterator[tuple[Node, int, str]]:
    """(node, layout of its parent, text) for each block with text, in page order."""
    stack = [Node("", "", 0, 1.0, False, 1.0)]
    pieces: list[str] = []

    def block():
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        return text

    def push(tag: str, attributes: str) -> None:
        up = stack[-1]
        main = up.main or tag in MAIN
        names, role = _role(attributes, main) if attributes.strip() else ("", False)
        by_tag = tag in ROLE_TAGS or (tag in OUTER and not main)
        own = tag in MAIN and not up.main
        weight = tagged = min(up.tagged, ROLE_WEIGHT) if by_tag else up.tagged
        if not own:
            named = role and tag not in ("html", "body")
            weight = min(up.weight, ROLE_WEIGHT) if named or by_tag else up.weight
        label = f"{tag}.{names}" if names else tag
        # html and body may be left out of a page, so they are no part of a path
        path = up.path if tag in ("html", "body") else xxhash.xxh3_64_intdigest(f"{up.path:x}/{label}")
        up.children = xxhash.xxh3_64_intdigest(f"{up.children:x},{label}")
        stack.append(Node(tag, label, path, weight, main, tagged))

    def pop_to(tags, stops=frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    at = 0
    while at < len(source):
        m = TOKEN.match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                pieces.append(text)
            continue
        tag = tag.lower()
        if tag in INLINE or tag == "wbr":
            continue
        if tag in VOID:
            pieces.append(" ")
            if tag != "hr":
                continue
        text = block()
        if text:
            yield stack[-1], stack[-2].children if len(stack) > 1 else 0, text
        if tag in VOID:
            continue
        if m[1]:
            pop_to((tag,))
            continue
        if tag in CLOSES:
            pop_to(CLOSES[tag], STOPS)
        elif any(n.tag == "p" for n in stack[-2:]):
            pop_to(("p",), STOPS)  # a block cannot stand inside a paragraph
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if not m[3].rstrip().endswith("/") or tag in ("p", "div"):
            push(tag, m[3].rstrip().rstrip("/"))
    text = block()
    if text:
        yield stack[-1], stack[-2].children if len(stack) > 1 else 0, text


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


FEATURES = "host string, path bigint, kind int, value bigint"
CONTENT, LAYOUT, PAGE = 0, 1, 2


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for host, source in zip(*(c.to_pylist() for c in batch.columns)):
            seen = set()
            for node, layout, text in blocks(source or ""):
                path = _signed(node.path)
                seen.add((host, path, CONTENT, _signed(xxhash.xxh3_64_intdigest(text))))
                seen.add((host, path, LAYOUT, _signed(layout)))
                seen.add((host, path, PAGE, 0))
            out += seen
        cols = list(zip(*out)) if out else [[], [], [], []]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "path", "kind", "value"]
        )


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, importance) of the nodes with text in the hosts' style trees.

    ``pages`` has host and html. A content shown on c of a node's m pages has entropy log_m c;
    a node's content importance is one less the mean entropy of its contents, its layout
    importance the entropy of its layouts. A node of one page has importance 1.
    """
    counts = (
        pages.select("host", "html")
        .mapInArrow(_features, FEATURES)
        .groupBy("host", "path", "kind", "value")
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    content, layout = F.col("kind") == CONTENT, F.col("kind") == LAYOUT
    sums = counts.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == PAGE, F.col("c"))).alias("m"),
        F.avg(F.when(content, F.ln("c"))).alias("shown"),
        F.sum(F.when(layout, F.col("c"))).alias("n"),
        F.sum(F.when(layout, F.col("c") * F.ln("c"))).alias("nn"),
    )
    log_m = F.ln("m")
    by_content = 1 - F.col("shown") / log_m
    by_layout = (F.ln("n") - F.col("nn") / F.col("n")) / log_m
    value = F.when(F.col("m") <= 1, F.lit(1.0)).otherwise(
        (1 - LAYOUT_SHARE) * by_content + LAYOUT_SHARE * by_layout
    )
    return sums.select("host", "path", value.alias("importance"))


def main_text(source: str, importance_of: dict[int, float], least: float) -> str:
    """Blocks whose weighted importance reaches ``least``, joined by line feeds."""
    found = []
    for node, _, text in blocks(source):
        value = importance_of.get(_signed(node.path), 1.0)
        if node.main:
            value += MAIN_SHARE * (1 - value)
        found.append((node, text, node.weight * value >= least))
    copied = not any(stays for node, _, stays in found if node.main)
    kept = [
        text
        for node, text, stays in found
        if stays or (copied and node.main and node.weight >= least)
    ]
    return "\n".join(kept)


def extract(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD
) -> DataFrame:
    """All rows with main_text string, never null."""
    kept = [c for c in pages.columns if c != "main_text"]
    source = pages.select(
        host_of(column(pages, url_col)).alias("host"), column(pages, html_col).cast("string").alias("html")
    )
    # only nodes below the threshold change anything; stored, so that a join with pages of a
    # large host can be split
    low = cut_lineage(
        importance(source)
        .where(F.col("importance") < threshold)
        .groupBy("host")
        .agg(F.collect_list(F.struct("path", "importance")).alias("low"))
    )
    rows = pages.select(
        F.struct(*[column(pages, c) for c in kept]).alias("row"),
        host_of(column(pages, url_col)).alias("host"),
    )

    @F.arrow_udf("string")
    def run(sources: pa.Array, low: pa.Array) -> pa.Array:
        out = []
        for text, paths in zip(sources.to_pylist(), low.to_pylist()):
            known = {p["path"]: p["importance"] for p in paths or ()}
            out.append(main_text(text or "", known, threshold))
        return pa.array(out, pa.string())

    joined = rows.join(low, "host", "left")
    return joined.select(
        *[F.col("row")[c].alias(c) for c in kept],
        run(F.col("row")[html_col].cast("string"), F.col("low")).alias("main_text"),
    )


