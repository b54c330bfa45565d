"""Main text of pages by site style trees.

All pages of a host are merged into one tree. A node is its parent and a label - the tag with its whole class list and
id, digits alike - and is known by a hash of both, so it has the same size at any depth; an element right inside one of the
same label is the same node, and so is whatever lies deeper than ``DEEPEST`` elements. For every node the tree knows how many pages have it, with which sequences of child tags
(presentation) and with which texts below it (content). A text found on df of the node's m pages
carries 1 - log(df) / log(m) of importance: text that repeats on all pages of a site is noise, text of
one page is not. A node's content importance is the mean over the distinct texts below it, its
presentation importance the entropy of its child sequences to the base m; the two are combined
like in a tree of depth one, the more presentation counts the more sequences there are. Branches
of low importance are cut from every page.

What few pages can tell is little, so tags and names give a prior: navigation, footers, asides,
forms, adverts, notices, comments and the like are cut; inside of ``article`` and ``main`` only
what hardly varies is; elsewhere the threshold is higher, and single pages are kept. The prior gives way
where it would take the article itself. On a page without an unmarked ``article`` or ``main``, a ``main``
overrules any mark around it, and a branch marked by a tag or name of layout (a form, header, aside, sidebar, banner, share
and the like) stands if it holds an ``article`` or more than half of the page's distinct text.

Equal pages of a host count once, so copies of an article do not look like boilerplate. The tree's
numbers are partial sums per (host, node); pages are read twice and joined with the few nodes that
are cut on their host. Null html is empty; a null url is a host of its own. Repeated rows and pages come out as often as they
come in. Markup of any depth is read in one pass; formulas, drawings and, inside the article, ``noscript`` keep their text.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declara.runtime import stage

# Tags of the HTML standard by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe".split())  # and noscript outside of the article
FOREIGN = frozenset(("svg", "math"))  # their elements stand in a line
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
ALONE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NOISE_TAGS = frozenset("head nav footer aside form button select input dialog menu object embed canvas audio video".split())
CONTENT_TAGS = frozenset(("article", "main"))
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promoted promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar side rail footer foot masthead topbar toolbar cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments reply replies disqus respond pagination pager skip widget disclaimer copyright".split()
)

# Marks of layout, which give way to an article or most of the text.
LAYOUT_TAGS = frozenset("form header aside".split())
LAYOUT_NAMES = frozenset(
    "sidebar side rail banner promo promoted promotion share sharing social related recommended recommendations notice masthead topbar toolbar "
    "menu widget overlay modal skip copyright".split()
)
DEEPEST = 512
SEEN = 200_000  # rows of one page that are held at once

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


class _Mark:
    """Why a branch may be noise, and what speaks against it."""

    __slots__ = ("layout", "main", "article", "chars")

    def __init__(self, layout):
        self.layout, self.main, self.article, self.chars = layout, False, False, 0


class _Node:
    __slots__ = ("tag", "label", "id", "chain", "marks", "content", "children")

    def __init__(self, tag, label, id, chain, marks, content):
        """``content``: the place in the chain from which on the nodes lie in the article, or None."""
        self.tag, self.label, self.id, self.chain, self.marks, self.content, self.children = tag, label, id, chain, marks, content, []


def _mark(tag: str, attributes: str, parent: _Node) -> tuple[str, _Mark | None]:
    """The label of an element and its mark, if its tag or names make one."""
    label, strong = tag, False
    layout = tag in LAYOUT_TAGS and not (tag == "header" and parent.content is not None)
    strong = tag in NOISE_TAGS and tag not in LAYOUT_TAGS
    if attributes:
        for name, value in _NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" and not value or name == "aria-hidden" and value == "true":
                strong = True
            elif name in ("class", "id") and value:
                if tag not in ("html", "body", "article", "main"):
                    names = NOISE_NAMES.intersection(_WORDS.findall(value))
                    layout |= bool(names)
                    strong |= bool(names - LAYOUT_NAMES)
                label += ("." if name == "class" else "#") + " ".join(sorted(set(_DIGITS.sub("0", value).split())))
            elif name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"):
                strong = True
    return label, _Mark(not strong) if layout or strong else None


def _open(tag: str, attributes: str, parent: _Node, deep: bool) -> _Node:
    label, mark = _mark(tag, attributes, parent)
    # the same element again, or one too deep to be told apart, adds nothing to what stands around it
    marks = (*parent.marks, mark) if mark and not (parent.marks and (deep or label == parent.label)) else parent.marks
    content = parent.content
    if tag in CONTENT_TAGS and content is None:
        for m in marks:
            m.main |= tag == "main"
            m.article |= tag == "article"
    if deep or label == parent.label:
        id, chain = parent.id, parent.chain
    else:
        id = _hash(f"{parent.id}:{label}")
        chain = (*parent.chain, id) if parent.label not in ("", "html") else (id,)
    if tag in CONTENT_TAGS and content is None:
        content = max(0, len(chain) - 1)
    return _Node(tag, label, id, chain, marks, content)


def blocks(page: str) -> tuple[list[tuple[tuple, str, bool, int | None]], dict[int, tuple[str, bool]]]:
    """(nodes from the second level down, text, noise by name, place of the first node in the article) of every block in page order, and (child
    tags, inside the article) of every node. Reads the markup as browsers do: unclosed and misnested tags close where they must."""
    root = _Node("", "", 0, (), (), None)
    stack, solid, open_at = [root], [0], {}  # the elements, places of those that are blocks, places by tag
    out, pieces, sequences, endless, met = [], [], {}, set(), set()

    def flush():
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            node, marks = stack[solid[-1]], stack[-1].marks
            if text not in met:
                met.add(text)
                for m in marks:
                    m.chars += len(text)
            out.append((node.chain or (node.id,), text, marks, node.content))

    def push(node: _Node):
        open_at.setdefault(node.tag, []).append(len(stack))
        if node.tag not in INLINE and not foreign():
            solid.append(len(stack))
        stack.append(node)

    def pop():
        node = stack.pop()
        open_at[node.tag].pop()
        if solid[-1] == len(stack):
            solid.pop()
        if node.children:
            sequences.setdefault(node.id, (" ".join(dict.fromkeys(node.children)), node.content is not None, node.marks))

    def close(to: int):
        while len(stack) > to:
            if solid[-1] == len(stack) - 1:
                flush()
            pop()

    def last(tag: str) -> int:
        places = open_at.get(tag)
        return places[-1] if places else 0

    def foreign() -> bool:
        return bool(open_at.get("svg") or open_at.get("math"))

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            pieces.append(page[at:])
            break
        if found.start() > at:
            pieces.append(page[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), found[1] or found[4]
        if closing:
            inside = last(tag)
            if tag in INLINE and solid[-1] > inside:
                continue  # closed by its block already
            if inside:
                close(inside)
            continue
        alone = (found[3] or "").rstrip().endswith("/")
        if tag in RAW or (tag == "noscript" and stack[-1].content is None):
            stop = None if alone or tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if not stop and not alone:
                endless.add(tag)
            at = stop.end() if stop else (end if tag in ("script", "style") and not alone else at)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE and tag not in FOREIGN and not foreign():
            flush()
            if tag in CLOSES_P and (p := last("p")):
                close(p)
            if tag in ALONE:
                same = max(map(last, ("dt", "dd"))) if tag in ("dt", "dd") else last(tag)
                if same > max(map(last, ALONE[tag])):
                    close(same)
            while stack[-1].tag in INLINE:  # an inline tag left open does not swallow blocks
                pop()
            stack[-1].children.append(tag)
        if tag not in VOID and not alone:
            push(_open(tag, found[3] or found[6] or "", stack[-1], len(stack) > DEEPEST))
    flush()
    close(1)
    clean = any(content is not None and not marks for _, _, marks, content in out)
    most = sum(map(len, met)) / 2

    def noise(marks) -> bool:
        return any(clean or not (m.main or (m.layout and (m.article or m.chars > most))) for m in marks)

    known: dict[tuple, bool] = {}
    for marks in {marks for _, _, marks, _ in out} | {marks for _, _, marks in sequences.values()}:
        known[marks] = noise(marks)
    return (
        [(chain, text, known[marks], content) for chain, text, marks, content in out],
        {node: (children, content) for node, (children, content, marks) in sequences.items() if not known[marks]},
    )


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def tree_rows(pages: DataFrame) -> DataFrame:
    """(host, node, content, kind, value, page): texts (kind 0) below and child sequences (kind 1) of all nodes
    that no name marks as noise, and whether they lie in an article; one row per page digest."""

    def scan(batches):
        for b in batches:
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                digest, seen = _hash(page), set()
                found, sequences = blocks(page)
                seen.update((node, content, 1, _hash(s)) for node, (s, content) in sequences.items())
                for chain, text, noise, content in found:
                    if not noise:
                        value = _hash(text)
                        seen.update((node, content is not None and i >= content, 0, value) for i, node in enumerate(chain))
                        if len(seen) > SEEN:  # rows met again are one after the shuffle
                            yield rows(host, digest, seen)
                            seen = set()
                if seen:
                    yield rows(host, digest, seen)

    def rows(host, digest, seen):
        node, content, kind, value = zip(*seen)
        return pa.RecordBatch.from_arrays(
            [pa.array([host] * len(seen), pa.string()), pa.array(node, pa.int64()), pa.array(content, pa.bool_()), pa.array(kind, pa.int32()),
             pa.array(value, pa.int64()), pa.array([digest] * len(seen), pa.int64())],
            names=["host", "node", "content", "kind", "value", "page"])

    return pages.select("host", "html").mapInArrow(scan, "host string, node long, content boolean, kind int, value long, page long").distinct()


def importance(rows: DataFrame) -> DataFrame:
    """(host, node, content, pages, importance) of the merged trees."""
    seen = rows.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("df"), F.max("content").alias("content"))
    sums = seen.groupBy("host", "node").agg(
        F.max("content").alias("content"),
        F.sum(F.when(F.col("kind") == 0, F.log("df"))).alias("log_df"), F.sum(F.when(F.col("kind") == 0, 1)).alias("texts"),
        F.sum(F.when(F.col("kind") == 1, F.col("df") * F.log("df"))).alias("df_log_df"),
        F.sum(F.when(F.col("kind") == 1, F.col("df"))).alias("drawn"), F.sum(F.when(F.col("kind") == 1, 1)).alias("styles"),
    )
    pages = rows.groupBy("host", "node", "page").agg(F.lit(1).alias("_")).groupBy("host", "node").agg(F.count("*").alias("pages"))
    log_m = F.log(F.col("pages"))
    content = 1 - F.col("log_df") / F.col("texts") / log_m
    style = F.coalesce((F.log("drawn") - F.col("df_log_df") / F.col("drawn")) / log_m, F.lit(0.0))
    share = F.pow(F.lit(0.9), F.coalesce("styles", F.lit(0)))
    return sums.join(pages, ["host", "node"]).where("texts > 0").select(
        "host", "node", "content", "pages",
        F.when(F.col("pages") == 1, 1.0).otherwise((1 - share) * F.greatest(style, content) + share * content).alias("importance"),
    )


def extract(pages: DataFrame, cut_below: float = 0.3, cut_content_below: float = 0.02, least_pages: int = 3) -> DataFrame:
    """(id, url, text, n_chars) of ``pages`` (id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "(?s)://([^/?#]*)", 1))
    rows = pages.select("id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    noise = stage(
        importance(tree_rows(rows)).where(F.col("pages") >= least_pages)
        .where(F.col("importance") < F.when(F.col("content"), cut_content_below).otherwise(cut_below))
        .groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("cut"))
    )
    kind = pages.schema["id"].dataType.simpleString()

    def scan(batches):
        for b in batches:
            texts = []
            for page, cut in zip(b.column("html").to_pylist(), b.column("cut").to_pylist()):
                cut = frozenset(cut or ())
                texts.append("\n".join(
                    text for chain, text, named, _ in blocks(page)[0] if not named and (not cut or cut.isdisjoint(chain))
                ))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    return rows.join(noise, "host", "left").select("id", "url", "html", "cut").mapInArrow(scan, f"id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url", "html")
    return extract(pages).withColumnRenamed("id", "page_id")
