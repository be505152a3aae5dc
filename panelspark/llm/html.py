"""HTML extraction: markup to text lines, and page differencing against the nearest URL.

A page's markup is read to blocks (lines), leaving out what is never content
by its element (navigation, headers, footers, forms, scripts ...) or by its
marks (adverts, notices, menus, comments ...): a whole class token or role, or
outside an article a whole id.  Inside an article such a mark counts on
containers only, not on headings or inline elements.  Left out elements whose
end tag is missing end where HTML implies it.

Every page is then differenced: the pages of a host are put in order of their
URL path, each is paired with the neighbour whose path is nearest (longest
common beginning) among those whose lines are not all the same as its own,
the two are aligned by longest common subsequence of their lines, and shared
lines are deleted as boilerplate.  Lines inside an article element are
aligned but not deleted, since a copied article shares all its lines and
"nothing else" may go.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.frames import col, cut_lineage, prepare
from panelspark.llm.urls import host_and_path
from panelspark.session import sized_broadcast

# Elements by what they are (public HTML element names).
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
SKIP = {"nav", "header", "footer", "aside", "form", "noscript", "template", "button", "select", "svg", "canvas", "object", "dialog", "menu", "head"}
ARTICLE = {"article", "main"}
BLOCK = {"address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption",
         "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "option", "p", "pre", "section", "summary",
         "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINER = BLOCK - {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "br", "hr", "html", "body"}
NESTING = (BLOCK | SKIP | {"optgroup"}) - {"br", "hr"}   # elements whose nesting is followed
# Start tags that end an open element of the kinds named first, unless one of the kinds named second lies between.
_CELL, _ROW, _GROUP = {"td", "th"}, {"td", "th", "tr"}, {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}), "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
           "td": (_CELL, {"table"}), "th": (_CELL, {"table"}), "tr": (_ROW, {"table"}), "tbody": (_GROUP, {"table"}), "thead": (_GROUP, {"table"}),
           "tfoot": (_GROUP, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"})}
ENDS_P = (BLOCK | {"nav", "header", "footer", "aside", "form", "menu", "dialog"}) - {"br", "body", "html", "caption", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
SCOPE = {"table", "td", "th", "caption", "object", "template"}   # end tags of other elements do not reach out of these
IN_HEAD = {"head", "base", "link", "meta", "noscript", "template", "html"} | RAW
# Class tokens that mark adverts, notices, menus, headers, footers, sidebars and reader comments, in an article too.
LEFT_OUT = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored", "cookie", "cookies", "consent", "notice", "notices",
            "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "comment", "comments"}
# Roles of headers, menus, sidebars, footers, notices and forms.
ROLES = {"banner", "navigation", "menu", "menubar", "complementary", "contentinfo", "alert", "alertdialog", "dialog", "form", "search"}
# Outside an article more class tokens and ids say that something is not content.
NOT_CONTENT = LEFT_OUT | ROLES | {"sponsor", "promo", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "aside", "widget",
                                  "pagination", "pager", "toolbar", "copyright", "disqus", "reply", "replies", "respond", "share", "sharing",
                                  "social", "related", "recommended", "skip"}
# A quote opens a value only behind "="; what is not closed runs to the end of the page.
_VALUE = r"=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=\s*[^\s>\"'][^\s>]*"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:{_VALUE}|[^>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
_MARKS = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")


def _not_content(name: str, attributes: str, inside: bool) -> bool:
    if not _MARKS.search(attributes):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if kind == "hidden" and value.strip() != "until-found" or kind == "aria-hidden" and value.strip() == "true" or kind == "style" and _NO_DISPLAY.search(value):
            return True
        marks = NOT_CONTENT if not inside else LEFT_OUT if kind == "class" else ROLES
        if kind in ("class", "role") and (not inside or name in CONTAINER) and not marks.isdisjoint(value.split()):
            return True
        if kind == "id" and not inside and value.strip() in NOT_CONTENT:
            return True
    return False


def page_lines(page: str | None) -> list[tuple[str, bool]]:
    """Lines that may be content, each with whether an article encloses it."""
    page = page or ""
    lines: list[tuple[str, bool]] = []
    part: list[str] = []
    nest: list[str] = []        # open elements
    held: dict[str, int] = {}   # how many of each kind are open
    skip = -1                   # place in ``nest`` of the element that is left out
    inside = 0                  # open article elements
    at = 0

    def end_block() -> None:
        text = "".join(part)
        part.clear()
        if "&" in text:
            text = _html.unescape(text)
        text = " ".join(text.split())
        if text:
            lines.append((text, inside > 0))

    def close(place: int) -> None:
        """Ends the open element at ``place`` and those in it."""
        nonlocal skip, inside
        if skip < 0:
            end_block()
        for x in nest[place:]:
            inside -= x in ARTICLE
            held[x] -= 1
        del nest[place:]
        if skip >= place:
            skip = -1

    def find(kinds, bars) -> int:
        """Place of the innermost open element of these kinds, -1 without one or with a bar before it."""
        if not any(held.get(x) for x in kinds):
            return -1
        for i in range(len(nest) - 1, -1, -1):
            if nest[i] in kinds:
                return i
            if nest[i] in bars:
                return -1
        return -1

    pos = 0
    while True:
        m = _TAG.search(page, pos)
        stop = m.start() if m else len(page)
        if skip < 0 and stop > at:
            part.append(page[at:stop])
        if not m:
            break
        pos = at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(m.group(1)), m.group(3)
        if not closing and name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, pos)
            pos = at = end.end() if end else len(page)
            continue
        left_out = nest[skip] if skip >= 0 else None
        if closing:
            if skip < 0 and name in BLOCK:
                end_block()
            if held.get(name):
                bars = () if name in ARTICLE or name in ("body", "html", "head") else {"table", "template"} if name in _GROUP or name == "table" else SCOPE
                place = find((name,), bars if name in NESTING else () if name == left_out else NESTING)
                if place >= 0:
                    close(place)
            continue
        if left_out == "head" and name not in IN_HEAD:
            close(skip)
        if name in ENDS_P and held.get("p"):
            place = find(("p",), SCOPE | {"button"})
            if place >= 0:
                close(place)
        if name in IMPLIED:
            kinds, bars = IMPLIED[name]
            while (place := find(kinds, bars)) >= 0:
                close(place)
        marked = name not in VOID and name not in ("html", "body") and _not_content(name, attributes, inside > 0)
        if skip >= 0 and name in ARTICLE and not marked:
            close(skip)         # an unclosed menu must not swallow the article
        if skip < 0 and name in BLOCK:
            end_block()
        if name in VOID or _CLOSED.search(attributes):
            continue
        if skip < 0 and (marked or name in SKIP):
            end_block()
            skip = len(nest)
        elif not (name in NESTING or skip >= 0 and name == nest[skip]):
            continue
        nest.append(name)
        held[name] = held.get(name, 0) + 1
        inside += name in ARTICLE
    end_block()
    return lines


def shared_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski, ends first)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    where: dict[object, list[int]] = {}
    for j in range(len(b) - hi - 1, lo - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    last: list[tuple[int, tuple | None]] = []
    for i in range(lo, len(a) - hi):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            node = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(node)
            else:
                ends[k], last[k] = j, node
    middle, node = [], last[-1] if last else None
    while node:
        middle.append(node[0])
        node = node[1]
    return [*range(lo), *reversed(middle), *range(len(a) - hi, len(a))]


def outline(lines: list[tuple[str, bool]]) -> tuple[bytes, bytes, list[int], list[int]]:
    """(digest of the lines, digest of lines and marks, hash of each line, places outside an article)."""
    coded = [text.encode("utf-8", "replace") for text, _ in lines]
    text = hashlib.blake2b(b"\n".join(coded), digest_size=16).digest()
    marks = hashlib.blake2b(text + bytes(own for _, own in lines), digest_size=16).digest()
    hashes = [int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "little", signed=True) for c in coded]
    return text, marks, hashes, [i for i, (_, own) in enumerate(lines) if not own]


def _neighbours(pages: DataFrame) -> DataFrame:
    """(host, path, page, hashes, outside, other): ``other`` are the hashes of the nearest page that is no copy, null without one.

    ``pages`` has one row per host, path and page digest.  They are range-sorted
    by host and path, so that a host of any size is dealt over many tasks.  In
    this order the nearest page that is no copy lies before or after the run of
    copies that a page is in.  Of each range the two first and two last runs
    are enough to carry on into the ranges next to it.
    """
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = cut_lineage(pages.repartitionByRange(n, "host", "path", "digest", "page").withColumn("pid", F.spark_partition_id()), "html-order")
    me = F.struct("host", "path", "digest", "page", "hashes")
    up = Window.partitionBy("pid").orderBy("host", "path", "digest", "page")
    down = Window.partitionBy("pid").orderBy(*(F.col(c).desc() for c in ("host", "path", "digest", "page")))
    other = lambda c: ~(F.col(f"{c}.host").eqNullSafe(F.col("host")) & F.col(f"{c}.digest").eqNullSafe(F.col("digest")))
    x = x.withColumns({"before": F.lag(me).over(up), "after": F.lead(me).over(up)})
    x = x.withColumns({"starts": other("before"), "stops": other("after")})
    x = x.withColumns({"before": F.when(F.col("starts"), F.col("before")), "after": F.when(F.col("stops"), F.col("after"))})
    rows = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({"run": F.sum(F.col("starts").cast("long")).over(rows(up)), "rest": F.sum(F.col("stops").cast("long")).over(rows(down)),
                       "before": F.last("before", ignorenulls=True).over(rows(up)), "after": F.last("after", ignorenulls=True).over(rows(down))})
    # the outer runs of each range, at most four rows a range
    edge = (x.filter((F.col("run") <= 2) | (F.col("rest") <= 2)).filter("starts or stops").groupBy("pid", "run", "host", "digest")
            .agg(F.min(me).alias("first"), F.max(me).alias("last")))
    ranges = Window.orderBy("pid", "run")
    edge = edge.withColumn("new", ~(F.lag("host").over(ranges).eqNullSafe(F.col("host")) & F.lag("digest").over(ranges).eqNullSafe(F.col("digest"))))
    edge = edge.withColumn("chain", F.sum(F.col("new").cast("long")).over(rows(ranges)))
    chains = edge.groupBy("chain").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    order = Window.orderBy("chain")
    chains = chains.select("chain", F.lag("last").over(order).alias("tail"), F.lead("first").over(order).alias("head"))
    bounds = (edge.join(chains, "chain").groupBy("pid")
              .agg(F.min_by("tail", "run").alias("tail"), F.max_by("head", "run").alias("head")))
    x = x.join(sized_broadcast(bounds), "pid").withColumns({"before": F.coalesce("before", "tail"), "after": F.coalesce("after", "head")})
    mine = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.col(c))
    x = x.withColumns({"before": mine("before"), "after": mine("after")})
    depth = lambda c: F.coalesce(F.aggregate(  # noqa: E731  length of the common beginning of the paths
        F.zip_with(F.split("path", ""), F.split(F.col(f"{c}.path"), ""), lambda p, q: p == q),
        F.struct(F.lit(True).alias("go"), F.lit(0).alias("n")),
        lambda s, e: F.struct((s["go"] & F.coalesce(e, F.lit(False))).alias("go"),
                              (s["n"] + F.when(s["go"] & F.coalesce(e, F.lit(False)), 1).otherwise(0)).alias("n")), lambda s: s["n"]), F.lit(-1))
    near = F.when(depth("after") > depth("before"), F.col("after.hashes")).otherwise(F.coalesce("before.hashes", "after.hashes"))
    return x.select("host", "path", "page", "hashes", "outside", near.alias("other"))


def _boilerplate(src: DataFrame) -> DataFrame:
    """(host, path, page, gone): the places of the lines outside an article that a page shares with its neighbour."""
    kinds = {"digest": T.BinaryType(), "page": T.BinaryType(), "hashes": T.ArrayType(T.LongType()), "outside": T.ArrayType(T.IntegerType())}
    named = [T.StructField("host", T.StringType()), T.StructField("path", T.StringType())]

    def read(batches):
        for b in batches:
            got = list(zip(*[outline(page_lines(x)) for x in b.column(2).to_pylist()])) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got[0], pa.binary()), pa.array(got[1], pa.binary()),
                                              pa.array(got[2], pa.list_(pa.int64())), pa.array(got[3], pa.list_(pa.int32()))], names=["host", "path", *kinds])

    def differ(batches):
        for b in batches:
            mine, outside, other = (b.column(i).to_pylist() for i in (3, 4, 5))
            gone = [sorted(set(shared_lines(x, z)) & set(y)) if z else [] for x, y, z in zip(mine, outside, other)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(gone, pa.list_(pa.int32()))], names=["host", "path", "page", "gone"])

    pages = src.select("host", "path", "html").mapInArrow(read, T.StructType([*named, *(T.StructField(k, v) for k, v in kinds.items())]))
    pages = pages.filter(F.size("hashes") > 0).dropDuplicates(["host", "path", "page"])
    gone = _neighbours(pages).mapInArrow(differ, T.StructType([*named, T.StructField("page", T.BinaryType()), T.StructField("gone", T.ArrayType(T.IntegerType()))]))
    return cut_lineage(gone.filter(F.size("gone") > 0), "html-gone")


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Per page row: its key, ``url``, the main ``text`` (lines joined by a line feed) and ``n_chars``.

    A null or empty page, or one without content, has an empty text.  A null
    url has no host and is paired with others of that kind.  Repeated rows
    each get a row.  Markup that ends early is read as far as it goes.
    Columns other than the three named are not read.

    The markup is read twice, so that only hashes of the lines are put in
    order and the texts move only where a page loses lines.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path(col(url).cast("string"))
    src = pages.select(col(key).alias("key"), col(url).cast("string").alias("url"), host.alias("host"), path.alias("path"), col(html).cast("string").alias("html"))
    kept = [T.StructField("key", pages.schema[key].dataType), T.StructField("url", T.StringType())]
    named = [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("page", T.BinaryType())]

    def read(batches):
        for b in batches:
            got = [page_lines(x) for x in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([outline(g)[1] for g in got], pa.binary()),
                                              pa.array([[t for t, _ in g] for g in got], pa.list_(pa.string()))],
                                             names=["key", "url", "host", "path", "page", "lines"])

    lines = src.mapInArrow(read, T.StructType([*kept, *named, T.StructField("lines", T.ArrayType(T.StringType()))]))
    gone = _boilerplate(src)
    if gone.limit(1).count():
        rest = F.filter("lines", lambda s, i: ~F.array_contains("gone", i))
        lines = (lines.join(gone, ["host", "path", "page"], "left")
                 .withColumn("lines", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(rest)))
    text = F.concat_ws("\n", "lines")
    return lines.select(F.col("key").alias(key), "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
