"""Operator 8, HTML extraction: site template removal.

Each page becomes a tree; every block element's subtree is hashed from its tags and text.  Spark counts, for each host, on
how many different pages a hash stands (copies of a page are one page); a subtree that recurs across many pages of its
host is template and is deleted.  Sites print the same article on many pages, so inside the marked article prose counts as
template only where it recurs in many different articles of its host.  Besides, elements that are never article text by
their nature go: menus, forms, scripts, and those with a class or id that names nothing but furniture (``ad``,
``comment-list``, ``site-header``).  A name that says more (``article-header``, ``share-price``) deletes nothing.

What is left becomes text: character references decoded, white space inside a block one blank, blocks in page order joined
by one line end.  Null and empty html give the empty text; null ids and urls are carried (a page without url belongs to the
host ''); repeated rows are extracted each, and counted once; of equally long articles the first is the page's; an empty
table gives an empty result; other columns are not read.  Trees are walked with stacks of their own, so pages of any length
and depth are read whole; a page's tree takes some 30 times its length in memory.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element and attribute names of HTML, and words that sites mark their furniture with
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head title script style noscript template iframe textarea xmp noembed noframes nav footer aside form button select option input datalist svg canvas object embed audio video dialog menu map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar social share sharing related recommended popup modal overlay pagination pager comment comments disqus reply replies respond".split())
PLAIN = frozenset("area bar block bottom box button buttons container content form group icons inner items left link links list main module outer page panel posts primary right row secondary section site slot stories text thread top unit wrap wrapper".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
CLOSED_BY_BLOCK = "p"
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = frozenset("html body article main section div table td th ul ol dl aside nav header footer form blockquote figure".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*)([^>]*)>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


@dataclass
class Node:
    tag: str
    marked: bool = False
    comments: bool = False
    role: str = ""
    hidden: bool = False
    children: list = field(default_factory=list)  # nodes and strings


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def parse(html: str) -> Node:
    """The tree of a page.  End tags that are left out are supplied, end tags without a start are skipped."""
    root = Node("html")
    stack = [root]
    open_: Counter[str] = Counter()  # elements by name that are on the stack
    at, n = 0, len(html)

    def cut(i: int) -> None:
        for x in stack[i:]:
            open_[x.tag] -= 1
        del stack[i:]

    while at < n:
        m = _TAG.search(html, at)
        if not m:
            stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, rest = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in SCOPE and tag not in BLOCK:
                    break
            continue
        if tag == "html" or tag == "body" and open_["body"]:
            continue
        if tag in BLOCK and open_["p"]:
            cut(_closed(stack, (CLOSED_BY_BLOCK,)))
        if tag in CLOSES:
            cut(_closed(stack, CLOSES[tag]))
        node = _node(tag, rest)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not rest.rstrip().endswith("/"):
            stack.append(node)
            open_[tag] += 1
    return root


def _closed(stack: list[Node], tags: tuple[str, ...]) -> int:
    """From which place on the open elements close: the outermost of these names that no other container encloses."""
    i, cut = len(stack) - 1, len(stack)
    while i > 0 and (stack[i].tag in tags or stack[i].tag not in SCOPE):
        if stack[i].tag in tags:
            cut = i
        i -= 1
    return cut


def _node(tag: str, rest: str) -> Node:
    if not rest or rest == "/":
        return Node(tag)
    marked = comments = hidden = False
    role = ""
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), unescape((m[2] or "").strip("\"'"))
        if key in ("class", "id"):
            for name in value.split():
                words = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
                if all(w in MARKS or w in PLAIN or w.isdigit() for w in words):
                    marked = marked or any(w in MARKS for w in words)
                    comments = comments or any(w in COMMENTS for w in words)
        elif key == "role":
            role = value.strip().lower()
        elif key == "itemprop" and value.lower() == "articlebody":
            role = "main"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return Node(tag, marked, comments, role, hidden)


def is_furniture(node: Node, in_article: bool) -> bool:
    """Whether an element is no article text by its name, its role, or a class or id that names furniture alone."""
    if node.hidden or node.tag in NEVER or node.role in ROLES:
        return True
    if node.tag in ("html", "body", "main"):
        return False
    if node.tag == "article":
        return node.comments
    if node.tag == "header":
        return not in_article
    return node.marked and not re.fullmatch("h[1-6]", node.tag)


def _within(top: Node, enter=lambda node: True) -> Iterator[Node | str]:
    """All strings and elements below ``top`` in page order; elements that ``enter`` refuses are given but not entered."""
    stack = [iter(top.children)]
    while stack:
        for x in stack[-1]:
            yield x
            if isinstance(x, Node) and enter(x):
                stack.append(iter(x.children))
                break
        else:
            stack.pop()


def _text(node: Node) -> str:
    return "".join(x if isinstance(x, str) else " " if x.tag in ("script", "style") else "" for x in _within(node, lambda x: x.tag not in ("script", "style")))


def subtree_hashes(top: Node, found: dict[int, int]) -> bytes:
    """The hash of a subtree; ``found`` gets, for each block element with text below ``top``, its node's id and 64-bit hash."""
    hasher = lambda node: blake2b(node.tag.encode(), digest_size=8)
    stack = [(top, iter(top.children), hasher(top), [False])]
    while True:
        node, rest, h, some = stack[-1]
        for x in rest:
            if isinstance(x, str):
                if words := " ".join(x.split()):
                    h.update(b"\0" + words.encode("utf-8", "replace"))
                    some[0] = True
            elif x.tag not in ("script", "style"):
                stack.append((x, iter(x.children), hasher(x), [False]))
                break
        else:
            stack.pop()
            digest = h.digest()
            if some[0] and node.tag in BLOCK and node.tag not in ("html", "body"):
                found[id(node)] = int.from_bytes(digest, "little", signed=True)
            if not stack:
                return digest
            stack[-1][2].update(b"\1" + digest)
            stack[-1][3][0] |= some[0]


def extract(html: str, template: frozenset[int] | set[int] = frozenset(), inner: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's text, without furniture and the subtrees whose hashes are in ``template`` or, inside a marked article, ``inner``."""
    if not html:
        return ""
    root = parse(html)
    hashes: dict[int, int] = {}
    if template or inner:
        subtree_hashes(root, hashes)
    region = _region(root)
    if region is None:
        return "\n".join(_blocks(root, hashes, template, frozenset(), False))
    return "\n".join(_blocks(region, hashes, template, inner, True))


def _region(root: Node) -> Node | None:
    """The longest article, else the longest main element, if the page marks one."""
    found = [x for x in _within(root, lambda x: x.tag != "article" and not is_furniture(x, False)) if isinstance(x, Node) and not is_furniture(x, False)]
    for kind in (lambda x: x.tag == "article", lambda x: x.tag == "main" or x.role == "main"):
        if own := [x for x in found if kind(x)]:
            return own[0] if len(own) == 1 else max(own, key=lambda x: len(_text(x)))
    return None


def _blocks(top: Node, hashes: dict[int, int], template, inner, in_article: bool) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    # (rest of the children, whether the subtree is kept whole, whether it is a block)
    stack = [(iter(top.children), False, True)]
    while stack:
        rest, kept, block = stack[-1]
        for x in rest:
            if isinstance(x, str):
                run.append(x)
            elif x.tag == "br" or is_furniture(x, in_article):
                run.append(" ")
            else:
                below = kept
                if not kept and (h := hashes.get(id(x))) is not None:
                    if h in inner:
                        below = _is_prose(x, False)
                    elif h in template:
                        below = _is_prose(x, in_article)  # an article that recurs is kept whole
                    if not below and (h in inner or h in template):
                        flush()
                        continue
                if x.tag in BLOCK:
                    flush()
                stack.append((iter(x.children), below, x.tag in BLOCK))
                break
        else:
            stack.pop()
            if block:
                flush()
    return out


def _is_prose(node: Node, in_article: bool) -> bool:
    """Whether a recurring subtree is article text: inside a marked article anything not made of links, elsewhere a long text with sentences."""
    text = " ".join(_text(node).split())
    links = sum(len(_text(x)) for x in _within(node, lambda x: x.tag != "a") if isinstance(x, Node) and x.tag == "a")
    if in_article:
        return links < 0.5 * len(text)
    return len(text) >= 600 and links < 0.2 * len(text) and len(re.findall(r"[.!?]", text)) >= 4


_PAGE_HASHES = "page_id long, host string, hash long, inside boolean, whole long"


def _select(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def page_hashes(pages: DataFrame) -> DataFrame:
    """(page_id, host, hash, inside, whole): the distinct subtree hashes of each page, and null once, for the host's total.

    ``whole`` is the page's id (its hash, if it has none), or, for the hashes inside its marked article, which come a second time,
    that article's hash: copies of an article are one article.
    """
    out = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("hash", pa.int64()), ("inside", pa.bool_()), ("whole", pa.int64())])
    number = lambda digest: int.from_bytes(digest, "little", signed=True)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows: list[tuple] = []
                for p in batch.slice(at, 200).to_pylist():
                    host = host_of(p["url"])
                    root = parse(p["html"] or "")  # kept while its nodes' ids are in use
                    region = _region(root)
                    for top, inside in ((root, False), (region, True)):
                        if top is not None:
                            found: dict[int, int] = {}
                            whole = number(subtree_hashes(top, found))
                            if inside:
                                found.pop(id(top), None)
                            elif p["page_id"] is not None:
                                whole = p["page_id"]
                            rows += [(p["page_id"], host, h, inside, whole) for h in {*found.values(), None}]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return _select(pages).mapInArrow(run, _PAGE_HASHES)


def templates(pages: DataFrame, share: float = 0.1, least: int = 4, inner_share: float = 0.5) -> DataFrame:
    """(host, hash, inside) of the subtrees on at least ``share`` of their host's pages, ``least`` at least.

    ``inside`` are those in at least ``inner_share`` of the host's different marked articles, ``least`` at least.
    """
    from .common import discard, materialise

    # both steps combine before they shuffle, so a host with a third of all pages is no hot key
    counts = page_hashes(pages).groupBy("host", "hash", "inside", "whole").agg(F.count("*").alias("c")).groupBy("host", "hash", "inside").agg(F.count("*").alias("n"))
    counts = materialise(counts.filter((F.col("n") >= least) | F.col("hash").isNull()), "template-counts")
    totals = counts.filter(F.col("hash").isNull()).select("host", "inside", F.col("n").alias("pages"))
    found = counts.filter(F.col("hash").isNotNull()).join(totals, ["host", "inside"])
    found = found.filter(F.col("n") >= F.col("pages") * F.when(F.col("inside"), inner_share).otherwise(share)).select("host", "hash", "inside")
    found = materialise(found, "templates")
    discard(counts)
    return found


def extract_pages(pages: DataFrame, share: float = 0.1, least: int = 4, broadcast_rows: int = 200_000, inner_share: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    Up to ``broadcast_rows`` template hashes go to every executor; more are joined to the pages that hold them.
    """
    from .common import discard

    found = templates(pages, share, least, inner_share)
    spark = pages.sparkSession
    schema = "page_id long, url string, text string, n_chars long"
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        by_host: dict[str, tuple[set[int], set[int]]] = {}
        for row in found.toLocalIterator():
            by_host.setdefault(row.host, (set(), set()))[row.inside].add(row.hash)
        discard(found)
        held = spark.sparkContext.broadcast(by_host)
        return _select(pages).mapInArrow(lambda batches: _extracted(batches, lambda p: held.value.get(host_of(p["url"]), (frozenset(), frozenset()))), schema)
    own = page_hashes(pages).join(found, ["host", "hash", "inside"], "left_semi")
    own = own.groupBy("page_id", "host").agg(F.collect_set(F.when(~F.col("inside"), F.col("hash"))).alias("template"), F.collect_set(F.when(F.col("inside"), F.col("hash"))).alias("inner"))
    own = own.withColumnRenamed("page_id", "k")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    joined = _select(pages).withColumn("h", host).join(own, F.col("page_id").eqNullSafe(F.col("k")) & (F.col("h") == F.col("host")), "left")
    return joined.select("page_id", "url", "html", "template", "inner").mapInArrow(lambda batches: _extracted(batches, lambda p: (frozenset(p["template"] or ()), frozenset(p["inner"] or ()))), schema)


def _extracted(batches, template_of) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200).to_pylist()
            texts = [extract(p["html"] or "", *template_of(p)) for p in part]
            yield pa.RecordBatch.from_arrays([pa.array([p["page_id"] for p in part], pa.int64()), pa.array([p["url"] for p in part], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
