"""Main text of web pages by differencing pages of neighbouring URLs.

A page becomes lines, one for each block of text. Pages of one host are put in
the order of their URL paths, and each is paired with the neighbour whose path
shares more with its own. The lines of a pair are aligned by their longest
common subsequence: what both pages say is the site's frame and is deleted,
what only one says is its text.

Markup breaks ties. Lines inside elements that HTML (or a telling class, id or
role) marks as menu, header, footer, sidebar, notice, advert, form, comment or
code are never text. Where a page marks its own article (``article`` or
``main``), lines outside of it are frame, and a shared line in it is frame if
the partner marks its article too and has the line outside only: paragraphs
that two articles repeat are text. Differencing alone decides all others. Two pages that leave next to nothing of
either unmatched, beside what is marked as frame, are copies of one page and no
partners: a run of copies takes the nearest pages around the run.

Neighbours are found on a narrow table of URLs and line hashes, sorted over the
whole cluster by ranges, so one host with most of the pages is spread like many.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import in_bitmap, membership_bitmap
from partita.session import shuffle_partitions, stage_table

# Elements by what they do to text.
_RAW = {"script", "style", "textarea", "title", "template", "iframe", "svg", "object", "canvas", "noembed", "noframes", "annotation", "annotation-xml"}
_FRAME = {"head", "nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "fieldset", "label", "option", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr", "input", "picture", "source"} | {
    "math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "munderover", "semantics"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
_MARKS = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "widget", "comment", "comments", "disqus",
    "respond", "replies", "pagination", "pager", "toolbar", "disclaimer", "search",
}
_HEADS = {"header", "heading", "topbar"}
#: What a mark is called beside its kind: "ad-slot-2" is one, "search-results" or "share-price" isn't.
_PARTS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "center", "container", "content", "count", "desktop", "fixed", "form", "global", "group", "icon", "icons",
    "inner", "item", "items", "js", "label", "layer", "left", "link", "links", "list", "main", "message", "mobile", "module", "outer", "page", "panel", "primary", "region", "right",
    "secondary", "section", "side", "site", "slot", "thread", "title", "top", "unit", "web", "wrap", "wrapper", "us", "media", "articles", "posts", "stories", "reading", "policy",
}
#: One-word names such as "sitefooter", "leftmenu" or "commentlist".
_MARK = re.compile(r"(?:site|page|main|top|left|right|bottom|side|global)?(?:nav|menu|footer|banner|sidebar|cookie|advert|newsletter|breadcrumb|comment|sponsor)s?(?:bar|list|box|area|block|section|form|wrap|wrapper|container)?")
_BODY = {"article", "main"}
#: "has-sidebar" or "no-banner" says what the page looks like, not what the element is.
_LAYOUT = {"has", "no", "with", "without"}
_THREADS = {"comment", "comments", "disqus", "respond", "replies", "related", "recommended"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BLANK = re.compile(r"\s+")


def _marks(attributes: str, in_body: bool) -> str | None:
    """What attributes say of an element: ``hidden``, ``thread`` (comments, further reading), ``frame`` or nothing."""
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), _CAMEL.sub("-", m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or kind == "aria-hidden" and value.strip() == "true":
            return "hidden"
        if kind == "role" and value.strip() in _ROLES:
            return "frame"
        if kind in ("class", "id"):
            for whole in value.split():
                names = re.split(r"[-_]+", whole)
                parts = set(names)
                if names[0] in _LAYOUT:
                    continue
                said = {x for x in parts if x in _MARKS or _MARK.fullmatch(x)}
                own = parts & {"article", "entry", "post", "story"}
                other = {x for x in parts - said - own - _PARTS if x and not x.isdigit()}
                # "article-header" belongs to the article, "page-footer" doesn't; comments and adverts never do.
                if said and not other and (not own or said & {"comment", "comments", "share", "related", "newsletter", "ad", "ads"}):
                    return "thread" if parts & _THREADS else "frame"
                if parts & _HEADS and not other - _HEADS and not in_body and not own and "section" not in parts:
                    return "frame"
    return None


class _Extents:
    """Where the elements of a page end, where its articles stand and how much text each stretch holds."""

    def __init__(self, page: str):
        self.end: dict[int, int] = {}
        self.ends: list[int] = []
        self.sums: list[int] = []
        self.articles: list[int] = []
        self.mains: list[int] = []
        open_: dict[str, list[int]] = {}
        at = total = 0
        while at < len(page):
            tag = _TAG.search(page, at)
            total += len("".join(page[at : tag.start() if tag else len(page)].split()))
            self.ends.append(tag.start() if tag else len(page))
            self.sums.append(total)
            if tag is None:
                break
            at, name = tag.end(), (tag[2] or tag[5] or "").lower()
            if not name or name in _VOID:
                continue
            if tag[1] or tag[4]:
                if open_.get(name):
                    self.end[open_[name].pop()] = tag.start()
                continue
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            open_.setdefault(name, []).append(tag.start())
            if name == "main":
                self.mains.append(tag.start())
            elif name == "article" and not _marks(tag[3] or "", True):
                self.articles.append(tag.start())
        self.whole = len(page)

    def _text(self, at: int) -> int:
        k = bisect_right(self.ends, at)
        return self.sums[k - 1] if k else 0

    def holds_page(self, start: int, thread: bool) -> bool:
        """Whether an element wraps the page's ``main``, all its articles, or more than half of its text."""
        end = self.end.get(start, self.whole)
        within = lambda places: bool(places) and places[0] > start and places[-1] < end
        if within(self.mains) or within(self.articles):
            return True
        return not thread and 2 * (self._text(end) - self._text(start)) > self.sums[-1]


def _is_frame(name: str, attributes: str, in_body: bool, forms: bool, holds_page: Callable[[bool], bool]) -> bool:
    """Elements that only a name marks are frames unless they wrap the page: those are left to differencing."""
    if name == "form" and not forms:
        return False
    if name in _FRAME or name in _RAW or (name in ("header", "noscript") and not in_body):
        return True
    if not attributes or name in _BODY or name in ("html", "body"):
        return False
    said = _marks(attributes, in_body)
    return said == "hidden" or said is not None and not holds_page(said == "thread")


def page_lines(page: str) -> list[tuple[str, bool]]:
    """The text blocks outside of frames in page order, and whether each stands in the page's own article.

    Where forms hold all the text, they wrap the page and aren't frames.
    """
    return _blocks(page, True) or (_blocks(page, False) if re.search("<form", page, re.I) else [])


def _blocks(page: str, forms: bool) -> list[tuple[str, bool]]:
    out: list[tuple[str, bool]] = []
    pieces: list[str] = []
    depth_body = 0
    skip: str | None = None
    skip_depth = 0

    def close() -> None:
        if pieces:
            line = _BLANK.sub(" ", html.unescape("".join(pieces))).strip()
            if line:
                out.append((line, depth_body > 0))
            pieces.clear()

    extents: _Extents | None = None

    def holds_page(thread: bool) -> bool:
        nonlocal extents
        extents = extents or _Extents(page)
        return extents.holds_page(tag.start(), thread)

    at = 0
    while at < len(page):
        tag = _TAG.search(page, at)
        text = page[at : tag.start() if tag else len(page)]
        if skip is None and text:
            pieces.append(text)
        if tag is None:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing = bool(tag[1] or tag[4])
        if skip is not None:
            if name == skip:
                skip_depth += -1 if closing else 1
                if skip_depth == 0:
                    skip = None
            elif closing and name in ("body", "html") or closing and name in _BODY and depth_body > 0:
                skip = None  # an unclosed frame ends with what holds it
                if name in _BODY:
                    depth_body -= 1
            continue
        attributes = tag[3] or ""
        if not closing and name not in _VOID and _is_frame(name, attributes, depth_body > 0, forms, holds_page):
            close()
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif not attributes.rstrip().endswith("/"):
                skip, skip_depth = name, 1
            continue
        if name in _INLINE:
            if name in ("br", "td", "th", "wbr"):
                pieces.append("" if name == "wbr" else " ")
            continue
        close()
        if name in _BODY:
            depth_body = max(0, depth_body + (-1 if closing else 1))
    close()
    return out


def lcs_mask(mine: list[int], other: list[int]) -> list[bool]:
    """Which of ``mine`` a longest common subsequence with ``other`` holds (rows of bits, one big integer each)."""
    held = [False] * len(mine)
    low = 0
    while low < min(len(mine), len(other)) and mine[low] == other[low]:
        held[low] = True
        low += 1
    high_m, high_o = len(mine), len(other)
    while high_m > low and high_o > low and mine[high_m - 1] == other[high_o - 1]:
        high_m, high_o = high_m - 1, high_o - 1
        held[high_m] = True
    common = set(mine[low:high_m]) & set(other[low:high_o])
    a = [k for k in range(low, high_m) if mine[k] in common]
    b = [other[k] for k in range(low, high_o) if other[k] in common]
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    # Bit j of a row is 0 where the best length up to other[j] is one more than up to other[j - 1].
    # Of the rows only some are kept, and those between two of them made again: memory grows with lines to the power 1.5.
    full = (1 << len(b)) - 1
    stride = max(1, math.isqrt(len(a)))

    def step(v: int, k: int) -> int:
        u = v & where[mine[k]]
        return ((v + u) | (v - u)) & full

    kept, row = [full], full
    for i, k in enumerate(a, 1):
        row = step(row, k)
        if i % stride == 0:
            kept.append(row)
    j = len(b)
    for part in range((len(a) - 1) // stride, -1, -1):
        first = part * stride
        rows = [kept[part]]
        for k in a[first : first + stride]:
            rows.append(step(rows[-1], k))
        for i in range(len(rows) - 1, 0, -1):
            length = _zeros(rows[i], j)
            if length == _zeros(rows[i - 1], j):
                continue
            while j > 0 and _zeros(rows[i], j - 1) == length:
                j -= 1
            held[a[first + i - 1]] = True
            j -= 1
    return held


def _zeros(row: int, j: int) -> int:
    return j - (row & ((1 << j) - 1)).bit_count()


def url_key(url: str | None) -> tuple[str, str]:
    """Host without ``www.`` and ``m.``, and path without query, fragment, ending and last slash."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", re.split(r"[?#]", url or "")[0]
    host = re.sub(r"^(?:www|m)\.", "", m[1].lower().rpartition("@")[2].partition(":")[0])
    return host, re.sub(r"(?:/|\.x?html?|\.php)$", "", m[2])


def closeness(a: str, b: str) -> tuple[int, int]:
    """Shared leading path segments, then shared leading characters."""
    x, y = a.split("/"), b.split("/")
    segments = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    letters = next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    return segments, letters


def _key(url: str | None, page: str | None) -> int:
    return xxhash.xxh3_64_intdigest(f"{url}\0{page}".encode()) - (1 << 63)


def _hashes(lines: list[tuple[str, bool]]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) for x, _ in lines]


#: Two pages are copies of one page if each has at most this share of its characters in lines that the other lacks.
COPY_REST = 0.02

_URLS = "host string, path string, key long, hashes array<long>, sizes array<int>, body array<boolean>, open boolean"


def _rest(page: dict, held: list[bool]) -> bool:
    """Whether lines that aren't held are more than next to nothing of a page."""
    return sum(n for n, k in zip(page["sizes"], held, strict=True) if not k) > COPY_REST * sum(page["sizes"])


def copies(a: dict, b: dict) -> bool:
    """Whether two pages (``hashes`` and ``sizes`` of lines) are copies of one page."""
    for x, y in ((a, b), (b, a)):
        other = set(y["hashes"])
        if _rest(x, [h in other for h in x["hashes"]]):
            return False
    return not _rest(a, lcs_mask(a["hashes"], b["hashes"])) and not _rest(b, lcs_mask(b["hashes"], a["hashes"]))

_TEXTS = "page_id long, url string, text string"


def _urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = page_lines(page or "")
            rows.append((*url_key(url), _key(url, page), _hashes(lines), [len(x) for x, _ in lines], [body for _, body in lines], bool(lines)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.bool_()))], ["host", "path", "key", "hashes", "sizes", "body", "open"])


def _texts(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, named: bool) -> Iterator[pa.RecordBatch]:
    """Texts of the pages that no mask concerns (``named`` false), or key and lines of the others."""
    for batch in batches:
        out = []
        for page_id, url, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            key = _key(url, page)
            if bool(in_bitmap(bitmap, np.array([key], np.int64))[0]) != named:
                continue
            lines = page_lines(page or "")
            if any(body for _, body in lines):
                lines = [x for x in lines if x[1]]
            out.append((page_id, url, key, [x for x, _ in lines]))
        ids, urls = pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())
        if named:
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.list_(pa.string()))], ["page_id", "url", "key", "lines"])
        else:
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(["\n".join(r[3]) for r in out], pa.string())], ["page_id", "url", "text"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row whether it begins a run, that is, isn't a copy of the row before it."""
    for batch in batches:
        names, head = batch.schema.names, []
        for me, before in zip(batch.column(names.index("me")).to_pylist(), batch.column(names.index("before")).to_pylist(), strict=True):
            head.append(not before or before["host"] != me["host"] or not copies(me, before))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.bool_())], [*names, "head"])


def neighbours(urls: DataFrame) -> DataFrame:
    """Each row of ``(host, path, key, hashes, sizes, body, open)`` with ``before`` and ``after``: the next rows in path order that aren't of its run of copies.

    Rows are sorted by ranges over the cluster; what a range needs of the
    ranges around it comes through a table of one row for each range.
    """
    spark = urls.sparkSession
    me = F.struct("host", "path", "hashes", "sizes", "body").alias("me")
    ranged = urls.repartitionByRange(shuffle_partitions(spark), "host", "path", "key").select("host", "path", "key", "open", me, F.spark_partition_id().alias("part"))
    ranged = stage_table(ranged, "ranges")
    order = ("host", "path", "key")
    inside, across = Window.partitionBy("part").orderBy(*order), Window.orderBy("part")
    ends = ranged.groupBy("part").agg(F.max(F.struct(*order, "me")).alias("last"))
    ends = ends.select("part", F.lag("last.me").over(across).alias("prev"))
    near = ranged.withColumn("before", F.lag("me").over(inside)).join(F.broadcast(ends), "part")
    near = near.select(*order, "open", "me", "part", F.coalesce("before", "prev").alias("before"))
    runs = stage_table(near.mapInArrow(_heads, f"{near._jdf.schema().toDDL()}, head boolean"), "runs")
    # A run's rows share what its first row has before it and the first row of the next run after it.
    started, begun = F.when(F.col("head"), F.struct("before")), F.when(F.col("head"), F.col("me"))
    place = F.struct(*order)
    edge = runs.where("head").groupBy("part").agg(F.max_by(F.struct("before"), place).alias("last"), F.min_by("me", place).alias("first"))
    edge = runs.select("part").distinct().join(edge, "part", "left")
    edge = edge.select("part", F.last("last", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"), F.first("first", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    back, ahead = inside.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("part").orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    near = runs.withColumn("started", F.last(started, True).over(back)).withColumn("following", F.last(begun, True).over(ahead))
    near = near.join(F.broadcast(edge), "part")
    return near.select("key", "open", "me", F.coalesce("started", "prev")["before"].alias("before"), F.coalesce("following", "next").alias("after"))


def deleted(me: dict, partner: dict) -> list[bool]:
    """Which lines of a page (of its article, if it marks one) are frame by its partner."""
    shared = lcs_mask(me["hashes"], partner["hashes"])
    if not any(me["body"]):
        return shared
    theirs = {h for h, body in zip(partner["hashes"], partner["body"], strict=True) if body}
    return [s and bool(theirs) and h not in theirs for s, h, body in zip(shared, me["hashes"], me["body"], strict=True) if body]


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page with lines, which of those that may be text its partner makes frame; only pages that have such lines."""
    for batch in batches:
        keys, masks = [], []
        for key, me, *around in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            near = [x for x in around if x and x["host"] == me["host"] and x["path"] != me["path"]]
            for partner in sorted(near, key=lambda x: closeness(me["path"], x["path"]), reverse=True):
                if copies(me, partner):
                    continue
                mask = deleted(me, partner)
                if any(mask):
                    keys.append(key)
                    masks.append(mask)
                break
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(masks, pa.list_(pa.bool_()))], ["key", "mask"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for every row of ``pages``.

    Null or empty html has an empty text. A null URL or one without a host
    belongs to the host ``""``. Pages of one path (versions of a page) and
    repeated rows are never partners, nor are copies; a page without a partner
    keeps its lines.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    # One page stands for each path in the order, so that its versions don't hide its neighbours.
    urls = stage_table(narrow.mapInArrow(_urls, _URLS), "urls")
    one = urls.groupBy("host", "path").agg(F.min_by(F.struct("key", "hashes", "sizes", "body"), "key").alias("x"), F.max("open").alias("open"))
    near = neighbours(one.select("host", "path", "x.key", "x.hashes", "x.sizes", "x.body", "open"))
    open_ = near.where("open").select(F.col("me.host").alias("host"), F.col("me.path").alias("path"), "before", "after")
    each = urls.where("open").select("host", "path", "key", "hashes", "sizes", "body").join(open_, ["host", "path"])
    each = each.select("key", F.struct("host", "path", "hashes", "sizes", "body").alias("me"), "before", "after")
    masks = stage_table(each.mapInArrow(_masks, "key long, mask array<boolean>").dropDuplicates(["key"]), "masks")
    bitmap = spark.sparkContext.broadcast(membership_bitmap(masks, "key"))
    plain = narrow.mapInArrow(lambda batches: _texts(batches, bitmap.value, False), _TEXTS)
    named = narrow.mapInArrow(lambda batches: _texts(batches, bitmap.value, True), "page_id long, url string, key long, lines array<string>")
    kept = F.when(F.col("mask").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, k: ~F.get("mask", k)))
    cut = named.join(masks, "key", "left").select("page_id", "url", F.array_join(kept, "\n").alias("text"))
    return plain.unionByName(cut)
