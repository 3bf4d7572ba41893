"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by path: an element's tags, classes and
ids from the root down. Of each path in the tree the pages give

* presentation: which sequences of child tags its elements have in how many pages;
  the entropy of that distribution is the node's presentation importance;
* content: which block texts stand directly below it, each in how many of its
  m pages; a text in k of them has entropy log k / log m, and the content
  importance is 1 less the mean over its texts.

A path that says the same on every page has importance 0 and is a template's
part; one with a text of its own on each page has 1. A leaf counts with the
larger of its content importance and a share of its presentation importance.
Importance is composed up the tree as by a walk that goes on with probability
``GOES_ON``: a branch has the mean of what is below it, by pages, nearer nodes
counting more. A path in under ``MIN_PAGES`` pages of its host is too rare to
judge and has the importance of the nearest branch above it that is not. Copies
of a page count once.

The tree also tells where a host's text is: its main branch is the deepest one
below which half of the host's text stands, by characters, importance and prior.

A block stays if its path's importance, times a prior, times ``OUTSIDE`` for what
is not in the main branch, reaches ``min_importance``. This goes for blocks in and
out of articles alike. The prior is ``NAMED_NOISE`` below elements that name
themselves as something else than text (navigation, footers, asides, forms; a
class, id or role that is made of such names only, as in "ad-box" but not in
"social-history"), unless they hold the main branch. On pages without the main
branch, and on hosts of too few pages for a tree, an article element, or else a
main element, takes its place.

What is gathered are counts per (host, path, text hash), and the ancestors of
each path; no task holds a host's pages. What comes back per host are the paths
of lower importance and the main branch, broadcast only below a checked size.

Defined cases: a null or empty html gives the empty text; pages without a url
form one host; broken markup is read as far as it goes; repeated rows and ids
give a row each (and count as copies); an empty table gives an empty table;
other columns are ignored. A main branch of which nothing would be left stays.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import map_batches, written

MIN_IMPORTANCE = 0.3
MIN_PAGES = 5
#: What a node's presentation adds to its importance.
PRESENTATION = 0.5
#: What a block outside of the main branch, and one below an element that names itself as noise, counts.
OUTSIDE, NAMED_NOISE = 0.4, 0.2
#: How likely the walk goes on to a child.
GOES_ON = 0.9
#: The part of a host's text that stands below its main branch.
MAIN_SHARE = 0.5
#: Paths of at least this importance stay whatever else is so.
SURE = MIN_IMPORTANCE / OUTSIDE
#: Paths that a task remembers as told.
TOLD = 1 << 18
BROADCAST_BYTES = 16 << 20

# Element names of HTML by what they are.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math textarea title xmp noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = RAW | set("head nav footer aside form button select input label fieldset dialog menu audio video canvas map datalist".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words that a class or id names a part with which is not the article, and words that say nothing about it.
CUES = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup sidebar sidenav menu nav navbar navigation topnav breadcrumb "
    "breadcrumbs masthead footer comment comments commentlist disqus reply replies respond share sharing social related recommended "
    "recommendations widget toolbar pagination pager login search copyright disclaimer skip".split()
)
CUES_OUTSIDE = {"header", "legal", "alert"}
PLAIN = set(
    "area article articles bar block bottom box button buttons col column container content first global grid group icon icons inner item items label large "
    "last left link links list main mobile module outer page panel post posts primary right row secondary section site slot small stories story text "
    "title top unit widget wrap wrapper zone".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
#: A start tag closes open elements up to these only.
SCOPE = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "body", "html", "main", "td", "th", "aside", "nav", "blockquote"}

TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<bogus>[!?/][^a-zA-Z][^>]*|[!?][^>]*)(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CUE_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    path: int
    noise: bool
    core: str = ""  # "article" or "main" if the element is one
    holds: bool = False  # it, or one below it, is
    kids: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]


def _cued(name: str, about: dict[str, str]) -> bool:
    if name in DROPPED or "hidden" in about or about.get("role", "").lower() in ROLES:
        return True
    for token in f"{about.get('class', '')} {about.get('id', '')}".split():
        said = {w.lower() for w in CUE_WORDS.findall(token)}
        cues = said & CUES or (name not in HEADINGS and name != "header" and said & CUES_OUTSIDE)
        if cues and said <= CUES | CUES_OUTSIDE | PLAIN:
            return True
    return False


def parse(text: str | None) -> Page:
    """Elements with their paths, and blocks (element, text) in page order."""
    root = Node("", -1, 0, False)
    nodes, stack = [root], [0]
    blocks: list[tuple[int, str]] = []
    piece: list[str] = []
    at, source = 0, text or ""

    def flush() -> None:
        nonlocal piece
        if piece:
            words = " ".join("".join(piece).split())
            if words:
                # the block belongs to the innermost block element
                k = stack[-1]
                while k and nodes[k].tag not in BLOCK and not nodes[k].noise:
                    k = nodes[k].parent
                blocks.append((k, words))
            piece = []

    def close(depth: int) -> None:
        if any(nodes[k].tag in BLOCK or nodes[k].noise for k in stack[depth:]):
            flush()
        del stack[depth:]

    while at < len(source):
        m = TAG.search(source, at)
        if not m:
            piece.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            piece.append(html.unescape(source[at : m.start()]))
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == name:
                    close(depth)
                    break
            continue
        if name == "br":
            piece.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCK:
            # an open paragraph ends here, and of lists and tables what can't hold this element
            shut = CLOSED_BY.get(name, set()) | {"p"}
            least = 0
            for depth in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[depth]].tag
                if tag in shut:
                    least = depth
                elif tag in SCOPE:
                    break
            if least:
                close(least)
            flush()
        about = {a.lower(): html.unescape(b or c or d) for a, b, c, d in ATTR.findall(m["attrs"])} if m["attrs"].strip() else {}
        up = nodes[stack[-1]]
        style = f"{name}.{' '.join(sorted(about.get('class', '').split()))}#{re.sub(r'[0-9]+', '0', about.get('id', ''))}"
        noise = name not in ("html", "body", "article", "main") and _cued(name, about) or name == "article" and _cued("div", about)
        if noise:
            flush()
        node = Node(name, stack[-1], xxhash.xxh64_intdigest(f"{up.path} {style}"), noise)
        up.kids.append(style)
        nodes.append(node)
        stack.append(len(nodes) - 1)
        if not noise:
            if name == "article" or about.get("itemprop") == "articleBody":
                node.core = "article"
            elif name == "main" or about.get("role", "").lower() == "main":
                node.core = "main"
        k = len(nodes) - 1 if node.core else 0
        while k and not nodes[k].holds:
            nodes[k].holds = True
            k = nodes[k].parent
    flush()
    return Page(nodes, blocks)


def priors(page: Page, main: int | None = None) -> tuple[list[float], list[bool] | None]:
    """Per element its prior, and whether it is in the main branch (None on a page without one): the path ``main``,
    or else an article, or else a main element."""
    nodes = page.nodes
    branch = main is not None and any(n.path == main for n in nodes)
    core = None if branch else next((c for c in ("article", "main") if any(n.core == c and _says(nodes, k) for k, n in enumerate(nodes))), None)
    inside, holds = [False] * len(nodes), [False] * len(nodes)
    for k, n in enumerate(nodes):
        top = n.path == main if branch else core is not None and n.core == core
        inside[k] = top or k > 0 and inside[n.parent]
        while top and k >= 0 and not holds[k]:
            holds[k], k = True, nodes[k].parent
    prior = [1.0] * len(nodes)
    for k, n in enumerate(nodes[1:], 1):
        noise = (n.noise or n.tag == "header" and not inside[k]) and not holds[k]
        prior[k] = min(prior[n.parent], NAMED_NOISE if noise else 1.0)
    return prior, inside if branch or core else None


def _says(nodes: list[Node], k: int) -> bool:
    """Whether an article or main element can be the page's: not inside noise that isn't there to hold it."""
    k = nodes[k].parent
    while k > 0:
        if nodes[k].noise and not nodes[k].holds:
            return False
        k = nodes[k].parent
    return True


def main_text(text: str | None, low: dict[int, float] | None = None, main: int | None = None, min_importance: float = MIN_IMPORTANCE) -> str:
    """The page's blocks that reach ``min_importance``, joined by empty lines. ``low``: importance by path where it is
    below 1; ``main``: the path of the host's main branch."""
    page, low = parse(text), low or {}
    prior, inside = priors(page, main)
    left, framed = [], []
    for k, t in page.blocks:
        known = prior[k] * (1.0 if inside is None or inside[k] else OUTSIDE)
        if known * low.get(page.nodes[k].path, 1.0) >= min_importance:
            left.append(t)
        elif inside is not None and inside[k] and prior[k] == 1.0:
            framed.append(t)
    return "\n\n".join(left or framed)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


TREE = "host string, path long, kind int, feature long, page long, size int"
#: Kinds of TREE's rows.
CHILDREN, TEXT, ANCESTOR, PRIOR = range(4)


def style_rows(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """TREE: per page and path its sequence of child tags and its block texts, hashed, with their lengths; per path its
    ancestors with their distances, and its prior in hundredths. Copies of a page and repeats within one give one row."""

    def rows(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"host": [], "path": [], "kind": [], "feature": [], "page": [], "size": []}
        for name, text in zip(part["host"], part["html"], strict=True):
            page = parse(text)
            mark = signed(xxhash.xxh64_intdigest((text or "").encode()))
            prior, _ = priors(page)
            seen: set[tuple[int, int, int, int, int]] = set()
            looks: dict[int, set[str]] = {}
            for k, n in enumerate(page.nodes[1:], 1):
                looks.setdefault(n.path, set()).add(" ".join(a for a, b in zip(n.kids, [None, *n.kids], strict=False) if a != b))
                if (name, n.path) not in told:
                    if len(told) >= TOLD:
                        told.clear()
                    told[name, n.path] = True
                    seen.add((n.path, PRIOR, 0, 0, round(100 * prior[k])))
                    up, far = n.parent, 1
                    while up > 0:
                        seen.add((n.path, ANCESTOR, page.nodes[up].path, 0, far))
                        up, far = page.nodes[up].parent, far + 1
            for path, kids in looks.items():  # one row, so that rows of a path are its pages
                seen.add((path, CHILDREN, xxhash.xxh64_intdigest("\n".join(sorted(kids))), mark, 0))
            for k, t in page.blocks:
                seen.add((page.nodes[k].path, TEXT, xxhash.xxh64_intdigest(t), mark, len(t)))
            for path, kind, feature, where, size in seen:
                for key, v in zip(out, (name, signed(path), kind, signed(feature), where, size), strict=True):
                    out[key].append(v)
        return out

    told: dict[tuple[str, int], bool] = {}
    return map_batches(pages.select(host(url_col).alias("host"), F.col(html_col).alias("html")), rows, TREE).distinct()


def importance(rows: DataFrame) -> DataFrame:
    """The style tree: host, path, pages, presentation, content (null where a path has no text of its own), chars of its
    texts over all pages, prior."""
    counts = rows.where(F.col("kind") != ANCESTOR).groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("k"), F.max("size").alias("size"))
    k, style, content = F.col("k").cast("double"), F.col("kind") == CHILDREN, F.col("kind") == TEXT
    sums = counts.groupBy("host", "path").agg(
        F.sum(F.when(style, F.col("k"))).alias("pages"),
        F.sum(F.when(style, k * F.ln(k))).alias("klogk"),
        F.sum(F.when(content, F.ln(k))).alias("logs"),
        F.count(F.when(content, 1)).alias("texts"),
        F.sum(F.when(content, k * F.col("size"))).alias("chars"),
        (F.max(F.when(F.col("kind") == PRIOR, F.col("size"))) / 100).alias("prior"),
    )
    m = F.col("pages").cast("double")
    one = F.col("pages") < 2
    return sums.select(
        "host",
        "path",
        "pages",
        F.when(one, 1.0).otherwise(F.greatest(F.lit(0.0), F.try_divide(F.ln(m) - F.try_divide(F.col("klogk"), m), F.ln(m)))).alias("presentation"),
        F.when(F.col("texts") == 0, None).when(one, 1.0).otherwise(1 - F.try_divide(F.try_divide(F.col("logs"), F.col("texts")), F.ln(m))).alias("content"),
        F.coalesce("chars", F.lit(0.0)).alias("chars"),
        F.coalesce("prior", F.lit(1.0)).alias("prior"),
    )


def composed(tree: DataFrame, above: DataFrame) -> DataFrame:
    """Per branch (host, path): depth, composed (importance of what is below it, by a walk), mass (its text by characters,
    importance and prior), whole (that of the host). ``above``: host, path, up, far: each path's ancestors."""
    leaf = tree.where("content is not null").withColumn("own", own())
    walk = F.pow(F.lit(GOES_ON), F.col("far")) * F.col("pages")
    mass = F.col("chars") * F.col("own") * F.col("prior")
    below = leaf.join(above, ["host", "path"]).groupBy("host", "up").agg((F.sum(walk * F.col("own")) / F.sum(walk)).alias("composed"), F.sum(mass).alias("mass"))
    whole = leaf.groupBy("host").agg(F.sum(mass).alias("whole"))
    depth = above.groupBy("host", "path").agg(F.max("far").alias("depth"))
    branch = below.withColumnRenamed("up", "path").join(whole, "host").join(depth, ["host", "path"], "left")
    return branch.withColumn("depth", F.coalesce("depth", F.lit(0)))


def own() -> Column:
    """A leaf's importance by itself."""
    return F.greatest(F.col("content"), F.col("presentation") * PRESENTATION)


def verdicts(rows: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, low (paths of an importance under SURE, with it), main (the path of the main branch, or null)."""
    above = rows.where(F.col("kind") == ANCESTOR).select("host", "path", F.col("feature").alias("up"), F.col("size").alias("far"))
    tree = importance(rows)
    branch = composed(tree, above).join(tree.select("host", "path", "pages"), ["host", "path"])
    judged = branch.where(F.col("pages") >= min_pages)
    main = judged.where(F.col("mass") >= MAIN_SHARE * F.col("whole")).groupBy("host").agg(F.max(F.struct("depth", "mass", "path")).alias("m")).select("host", F.col("m.path").alias("main"))
    leaves = tree.where("content is not null").withColumn("own", own())
    # a rare path has the importance of the nearest branch that is not rare, if there is one
    nearest = leaves.where(F.col("pages") < min_pages).select("host", "path").join(above, ["host", "path"])
    nearest = nearest.join(judged.select("host", F.col("path").alias("up"), "composed"), ["host", "up"]).groupBy("host", "path").agg(F.min_by("composed", "far").alias("score"))
    scored = leaves.where(F.col("pages") >= min_pages).select("host", "path", F.col("own").alias("score")).unionByName(nearest)
    low = scored.where(F.col("score") < SURE).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "score"))).alias("low"))
    return low.join(main, "host", "full")


def extract(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_importance: float = MIN_IMPORTANCE,
    min_pages: int = MIN_PAGES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per row: id, url, text, n_chars (code points)."""
    tree = written(style_rows(pages, url_col, html_col), "tree")
    found = written(verdicts(tree, min_pages), "verdicts")
    size = found.agg(F.sum(F.octet_length("host") + 16 * F.coalesce(F.size("low"), F.lit(0)) + 48)).first()[0] or 0
    found = F.broadcast(found) if size <= broadcast_bytes else found.hint("merge")
    kinds = {n: pages.schema[n].dataType.simpleString() for n in (id_col, url_col)}
    rows_in = (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"))
        .join(found, "host", "left")
        .select("id", "url", "html", "low", "main")
    )
    whole = (1 << 64) - 1

    def rows(part: dict[str, list]) -> dict[str, list]:
        texts = []
        for t, low, main in zip(part["html"], part["low"], part["main"], strict=True):
            texts.append(main_text(t, {x["path"] & whole: x["score"] for x in low or ()}, None if main is None else main & whole, min_importance))
        return {id_col: part["id"], url_col: part["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(rows_in, rows, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long")
