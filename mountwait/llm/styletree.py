"""Main text of pages by a site style tree.

Every page is parsed into block elements; a node of the tree is the path of
tags and classes from the root.  The pages of one host share one tree: for
each node it counts, over the host's pages, the contents (the text below the
node) and the presentations (the order of its child elements).  The entropy
of each, over the logarithm of the number of pages, is its importance: 0 if
all pages agree, 1 if all differ.  A node's importance is the larger of the
two; a host with few pages leans on the tree of all hosts, and a node on few
pages at all is taken as important.  Pages of one main content count once for a
node's content (see ``main_node``).  Branches below ``THRESHOLD`` are removed
from each page, but never the html, body, article or main element nor what is
around a page's main content.  Inside an article or main element importance
counts double, as a page's own words are expected there.

Elements that by their tag, role or class name should hold no article text
(menus, headers, footers, forms, adverts, comments, ...) have importance zero
as long as they hold little of the text: where such an element holds more than
half of the text on most pages of the host, importance decides as for any other.
Scripts and the like and ``hidden`` elements are never text.  Where most of the
text left is inside article or main elements, the blocks outside go as well.

Counts travel as rows (host, node, signature, page) and then as partial sums,
so a host with a third of all pages spreads over all tasks.
"""

from __future__ import annotations

import html as html_lib
import itertools
import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mountwait.session import cut_lineage

THRESHOLD = 0.6
EVIDENCE = 20  # pages with a node at which its entropy weighs as much as the benefit of the doubt
BROADCAST_BYTES = 16 << 20
TEMPLATE = 0.1  # share of a node's pages below which the pages left are too few: their "main content" is the template's
SHRINK = 200  # pages of a host at which its own tree weighs as much as that of all hosts

RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "title", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir",
         "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section",
         "select", "summary", "table", "caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th", "ul"}
NO_TEXT = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "option", "dialog", "label",
           "object", "audio", "video", "canvas", "map", "datalist", "fieldset", "search", "dir"}
NO_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form",
           "menu", "menubar", "toolbar"}
NO_CLASS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
            "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead",
            "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "banner", "popup", "modal",
            "overlay", "newsletter", "subscribe", "signup", "login", "comment", "comments", "reply", "replies", "respond",
            "disqus", "social", "share", "sharing", "related", "recommended", "pagination", "pager", "toolbar", "widget",
            "search", "skip", "hidden", "form"}
# Words that may stand beside a listed one in a name that speaks against article text (comment-list, but not share-price).
LAYOUT = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "cards", "col", "column", "container",
          "content", "count", "entry", "fixed", "global", "grid", "group", "holder", "icon", "icons", "inner", "item", "items",
          "js", "left", "link", "links", "list", "local", "main", "module", "outer", "page", "panel", "policy", "post", "posts",
          "primary", "region", "right", "row", "section", "secondary", "site", "slot", "story", "stories", "strip", "sticky",
          "thread", "title", "top", "unit", "user", "wrap", "wrapper", "zone"}
MAIN = {"article", "main"}
NEVER_LOW = {"html", "body", *MAIN}
# Start tags that end an open element: tag -> (elements ended, elements that bound the search).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
P_BOUND = {"button", "table", "td", "th", "caption", "html", "body", "article", "section", "div", "main"}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)|<[A-Za-z][^>]*+\Z", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_seen: dict[tuple[str, str], tuple[str, int]] = {}
HINT, HIDDEN = 1, 2
_PRIME, _BASE = (1 << 61) - 1, 0x1D8AF066F1A2B3C5 % ((1 << 61) - 1)
HEAVY = 4  # kind of the rows that count on how many pages a hinted element holds most of the text


def _style(tag: str, attrs: str) -> tuple[str, int]:
    """(name of the element in the tree, HINT if its names speak against article text, HIDDEN if it is not shown)."""
    key = tag, attrs
    if (known := _seen.get(key)) is not None:
        return known
    names, none, hidden, had = [], tag in NO_TEXT, False, set()
    for m in _ATTR.finditer(attrs) if attrs else ():
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind not in ("class", "id", "role", "hidden") or kind in had:
            continue
        had.add(kind)
        if kind == "hidden":
            hidden = True
        elif kind == "role":
            none |= value.lower() in NO_ROLE
        else:
            tokens = [set(_WORDS.findall(_CAMEL.sub(" ", t).lower())) for t in value.split()]
            none |= tag not in ("html", "body") and any(t & NO_CLASS and t <= NO_CLASS | LAYOUT for t in tokens)
            if kind == "class":
                names = sorted(set().union(*tokens))
    if len(_seen) > 50_000:
        _seen.clear()
    out = _seen[key] = f"{tag}.{'.'.join(names)}", HIDDEN if hidden else HINT * none
    return out


class Node:
    """An element; its blocks are those from ``first`` to before ``last`` in the page's order."""
    __slots__ = ("tag", "name", "path", "hint", "none", "main", "children", "up", "chars", "first", "last", "depth", "low")

    def __init__(self, tag, name, path, hint, main, up=None, first=0):
        self.tag, self.name, self.path, self.hint, self.main, self.children = tag, name, path, hint, main, []
        self.up, self.none, self.chars, self.first, self.last, self.low = up, False, 0, first, first, False
        self.depth = up.depth + 1 if up else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parse(page: str, heavy: set[int] | None = None) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(blocks, elements) of a page, both in page order; a block is (element, text, possibly empty).

    ``none`` of an element tells that it holds no article text.  Hints of elements
    whose path is in ``heavy`` do not count; without it, those of elements with more
    than half of the page's text.  Time and memory grow with the page, however deep it nests.
    """
    root = Node("", "", 0, 0, False)
    stack = [root]
    elements, run = [], []
    open_tags: dict[str, int] = {}
    found: list[tuple[Node, str, str]] = []  # with the text without and with hinted inline elements
    hinted: list[tuple[int, str]] = []  # text of hinted inline elements and its place in the run

    def clean(parts):
        return _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()

    def flush():
        if run or hinted:
            text = whole = clean(run)
            if hinted:
                parts, at = [], 0
                for k, t in hinted:
                    parts += [*run[at:k], t]
                    at = k
                whole = clean(parts + run[at:])
                hinted.clear()
            run.clear()
            if whole:
                found.append((stack[-1], text, whole))

    def outside(text):
        if not none_inline:
            run.append(text)
        elif max(h for _, h in none_inline) < HIDDEN:
            hinted.append((len(run), text))

    def pop_to(k: int):
        flush()
        for n in stack[k:]:
            n.last = len(found)
            open_tags[n.tag] -= 1
        del stack[k:]

    def some_open(tags) -> bool:
        return any(open_tags.get(t) for t in tags)

    at = 0
    none_inline: list[tuple[str, int]] = []  # open inline elements with hints against article text, and those inside
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            outside(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        closing = (m[1] or m[4]) == "/"
        attrs = m[3] if m[2] else m[6]
        if closing:
            if none_inline and tag == none_inline[-1][0]:
                none_inline.pop()
            elif tag in BLOCK and open_tags.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        none_inline.clear()
                        pop_to(k)
                        break
            continue
        if tag in RAW:
            if tag in ("svg", "math") and attrs.rstrip().endswith("/"):
                continue
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in BLOCK:
            none_inline.clear()
            flush()
            if tag in ENDS:
                ends, bound = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1) if some_open(ends) else ():
                    if stack[k].tag in ends:
                        pop_to(k)
                        break
                    if stack[k].tag in bound:
                        break
            elif tag != "hr":
                for k in range(len(stack) - 1, 0, -1) if some_open(("p",)) else ():
                    if stack[k].tag == "p":
                        pop_to(k)
                        break
                    if stack[k].tag in P_BOUND:
                        break
                if tag == "body" and some_open(("head",)):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == "head":
                            pop_to(k)
            if tag in VOID or attrs.endswith("/") and tag == "hr":
                continue
            name, none = _style(tag, attrs)
            top = stack[-1]
            path = _signed(xxhash.xxh64_intdigest(name, top.path & ((1 << 64) - 1)))
            node = Node(tag, name, path, none, tag in MAIN or top.main, top, len(found))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            top.children.append(name)
            stack.append(node)
            elements.append(node)
        elif tag not in VOID:
            name, none = _style(tag, attrs)
            if none or none_inline:
                none_inline.append((tag, none))
    if at < len(page):
        outside(page[at:])
    pop_to(1)
    # Inline elements that hold more than half of the text are text after all.
    which = 2 if 2 * sum(len(f[1]) for f in found) < sum(len(f[2]) for f in found) else 1
    blocks = [(f[0], f[which]) for f in found]
    total = sum(len(t) for _, t in blocks)
    for n, t in blocks:
        n.chars += len(t)
    for n in reversed(elements):
        n.up.chars += n.chars
    for n in elements:
        n.none = n.up.none or n.hint == HIDDEN or n.hint == HINT and not (
            2 * n.chars > total if heavy is None else n.path in heavy)
    return blocks, elements


def main_node(blocks: list[tuple[Node, str]], elements: list[Node]) -> Node | None:
    """An element of the deepest path that holds more than half of the text; None if none does.

    The text is that inside article and main elements where most of it is there.
    """
    own = [0 if n.none else len(t) for n, t in blocks]
    inside = [w if n.main else 0 for (n, _), w in zip(blocks, own)]
    if 2 * sum(inside) >= sum(own):
        own = inside
    upto = list(itertools.accumulate(own, initial=0))
    held: dict[int, int] = {}
    for n in elements:
        held[n.path] = held.get(n.path, 0) + upto[n.last] - upto[n.first]
    best = None
    for n in elements:
        if 2 * held[n.path] > upto[-1] and upto[n.last] > upto[n.first] and (best is None or n.depth > best.depth):
            best = n
    return best


def signatures(host: str, page: str) -> tuple[int, list[tuple[int, int, int]]]:
    """(hash of the main content, (path, kind, signature) once per node of the page).

    Kind 0 is content, 1 presentation; 2 and 3 are the same inside an article
    or main element.  Kind 4 tells of an element with a hint against article
    text whether it holds more than half of the page's text.
    """
    blocks, elements = parse(page)
    digest = xxhash.xxh64_intdigest
    # A run of blocks hashes as a polynomial of its blocks' hashes, so an element's is a difference of prefixes.
    prefix, count, power = [0], [0], [1]
    for n, t in blocks:
        if n.none or not t:
            prefix.append(prefix[-1])
            count.append(count[-1])
            continue
        t = t.lower().replace(host, "@") if host else t.lower()
        prefix.append((prefix[-1] * _BASE + digest(t)) % _PRIME)
        count.append(count[-1] + 1)
        power.append(power[-1] * _BASE % _PRIME)
    content: dict[int, tuple[int, int]] = {}
    style: dict[int, list[str]] = {}
    inside, never = set(), set()
    for n in elements:
        if k := count[n.last] - count[n.first]:
            h, c = content.get(n.path, (0, 0))
            content[n.path] = (h * power[k] + prefix[n.last] - prefix[n.first] * power[k]) % _PRIME, c + k
        if not n.none:
            style.setdefault(n.path, []).extend(["(", *n.children])
        if n.main:
            inside.add(n.path)
        if n.tag in NEVER_LOW:
            never.add(n.path)
    out = []
    main = main_node(blocks, elements)
    own = content[main.path] if main else (prefix[-1], count[-1])
    for p, run in content.items():
        if p in never:
            continue
        kind = 2 * (p in inside)
        out.append((p, kind, _signed(digest("%x.%d" % run))))
        out.append((p, kind + 1, _signed(digest(" ".join(style.get(p, ()))))))
    total = sum(len(t) for _, t in blocks)
    heavy: dict[int, int] = {}
    for n in elements:
        if n.hint == HINT and total:
            heavy[n.path] = heavy.get(n.path, 0) or int(2 * n.chars > total)
    out += [(p, HEAVY, h) for p, h in heavy.items()]
    return _signed(digest("%x.%d" % own)), out


def main_text(page: str, low: set[int], heavy: set[int]) -> str:
    """The page's text without branches that hold a path of ``low``; elements around the main content stay.

    Hints count but for elements whose path is in ``heavy``.
    """
    blocks, elements = parse(page, heavy)
    around = set()
    if low and (n := main_node(blocks, elements)):
        while n := n.up:
            around.add(n.path)
    for n in elements:
        n.low = n.up.low or n.path in low and n.path not in around
    kept = [(n, t) for n, t in blocks if t and not n.none and not n.low]
    inside = [(n, t) for n, t in kept if n.main]
    if 2 * sum(len(t) for _, t in inside) >= sum(len(t) for _, t in kept):
        kept = inside
    return " ".join(t for _, t in kept)


def _importance(counts: DataFrame, *by: str) -> DataFrame:
    """Entropy of the signatures of each node over the log of its pages; for the kind HEAVY the share of signature 1.

    A page is a main content; where those are below ``TEMPLATE`` of the whole
    pages, most pages would have the same one, and the whole pages count.
    """
    def n_log_n(c):
        n = F.col(c).cast("double")
        return F.sum(n * F.log(n))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("pages"), n_log_n("n").alias("s"),
                                   F.sum("m").alias("mains"), n_log_n("m").alias("t"), F.sum("n").alias("all"),
                                   F.sum(F.when(F.col("sig") == 1, F.col("n")).otherwise(0)).alias("heavy"))
    few = F.col("mains") < TEMPLATE * F.col("pages")
    sums = sums.withColumn("s", F.when(few, F.col("s")).otherwise(F.col("t"))).withColumn(
        "pages", F.when(few, F.col("pages")).otherwise(F.col("mains")))
    pages = F.col("pages").cast("double")
    return sums.withColumn("imp", F.when(F.col("kind") == HEAVY, F.col("heavy") / F.col("all")).when(
        F.col("pages") < 2, 1.0).otherwise((F.log(pages) - F.col("s") / pages) / F.log(pages))
    ).drop("s", "t", "mains", "heavy", "all")


def low_branches(pages: DataFrame, url_col: str, html_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(host, low, heavy), one row per host that has any.

    ``low`` are paths of little importance, ``heavy`` paths with a hint against
    article text that hold more than half of the text on most pages.
    """
    def run(batches):
        for b in batches:
            seen: set[tuple] = set()
            for u, h in zip(b.column(0).to_pylist(), b.column(1)):
                host, page = host_of(u), h.as_py() or ""
                whole = _signed(xxhash.xxh64_intdigest(page))
                main, found = signatures(host, page)
                seen.update((host, p, k, s, main, whole) for p, k, s in found)
            if seen:
                hosts, paths, kinds, sigs, mains, pages_ = zip(*seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(kinds, pa.int32()),
                     pa.array(sigs, pa.int64()), pa.array(mains, pa.int64()), pa.array(pages_, pa.int64())],
                    names=["host", "node", "kind", "sig", "main", "page"])
    rows = (pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
            .mapInArrow(run, "host string, node long, kind int, sig long, main long, page long"))
    # Copies say nothing about the template: each page (n) and each main content (m) counts once.
    own = (rows.distinct().groupBy("host", "node", "kind", "sig", "main").agg(F.count(F.lit(1)).alias("n"))
           .groupBy("host", "node", "kind", "sig").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")))
    every = own.groupBy("node", "kind", "sig").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    site = _importance(own, "host", "node", "kind")
    trust = F.col("pages") / (F.col("pages") + EVIDENCE)
    corpus = _importance(every, "node", "kind").select(
        "node", "kind", F.when(F.col("kind") == HEAVY, F.col("imp")).otherwise(trust * F.col("imp") + (1 - trust)).alias("imp_all"))
    share = F.col("pages") / (F.col("pages") + SHRINK)
    both = site.join(corpus, ["node", "kind"]).withColumn(
        "imp", (share * F.col("imp") + (1 - share) * F.col("imp_all")) * F.when(F.col("kind").isin(2, 3), 2.0).otherwise(1.0))
    hint = F.col("kind") == HEAVY
    nodes = both.groupBy("host", "node").agg(F.max(F.when(~hint, F.col("imp"))).alias("imp"), F.max(F.when(hint, F.col("imp"))).alias("share"))
    low, heavy = F.col("imp") < threshold, F.col("share") > 0.5
    return (nodes.where(low | heavy).groupBy("host")
            .agg(F.collect_list(F.when(low, F.col("node"))).alias("low"), F.collect_list(F.when(heavy, F.col("node"))).alias("heavy")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    Null and empty html give an empty text; a null or odd url counts to the
    host without a name.  Repeated rows are repeated pages of their host; an
    empty table gives no rows.  Other columns are not read.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html"))

    def hosts(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string())],
                                             names=["page_id", "url", "html", "host"])

    def run(batches):
        for b in batches:
            texts, sets = [], {}
            for host, low, heavy, h in zip(b.column(2).to_pylist(), b.column(3), b.column(4), b.column(5)):
                if host not in sets:
                    sets[host] = set(low.as_py() or ()), set(heavy.as_py() or ())
                texts.append(main_text(h.as_py() or "", *sets[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])
    # Written down and measured: a small table goes to the pages; else both sides are plain exchanges,
    # in which a hot host's pages can be split.
    low = cut_lineage(low_branches(pages, url_col, html_col, threshold))
    size = low.agg(F.sum(F.octet_length("host") + 8 * F.size("low") + 8 * F.size("heavy") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        low = F.broadcast(low)
    left = src.mapInArrow(hosts, "page_id long, url string, html string, host string")
    return (left.join(low, "host", "left").select("page_id", "url", "host", "low", "heavy", "html")
            .mapInArrow(run, "page_id long, url string, text string")
            .withColumn("n_chars", F.char_length("text").cast("long")))
