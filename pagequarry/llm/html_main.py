"""Main text of pages by nearest-URL page differencing.

A page's html becomes blocks of text (``page_blocks``): character references
decoded, white space collapsed, with what the markup says of each block: whether
it lies in an element that is no content by its tag, role or name (menus, page
headers, footers, sidebars, forms, adverts, notices, comments), whether it lies
in the page's article, and whether it is running text (paragraph, heading, list
item, quote).

The distinct pages of a host (equal html counts once) are put in order of URL
path, and each is aligned with the next by the longest common subsequence of
their blocks (as hashes). What two neighbours share is template: it is deleted
unless it is running text inside an article, where two pages may well quote the
same passage. Two pages are copies of one page and say nothing of the template
where nine tenths of the longer are shared and one has fewer than two blocks of
its own; each page of a run of copies is compared with the pages before and
after the run. Blocks that the markup names as no content
go as well, and so does what lies outside the article on pages that have one.

The order within a host is made by range partitioning, so a host with a third of
all pages is spread over tasks; what lies beyond a partition's ends comes from
one row of each partition.

Nulls: null html has no blocks and an empty text; a null url is a host of its
own. Rows of a host with equal html get equal texts. Broken markup (unclosed
elements, references without semicolon, scripts with tags in strings) is read as
browsers do, as far as text goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import broadcast_if_small, written

#: Fixed values of the HTML standard: elements without end tag, and elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
#: Elements that do not break a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr br input".split())
NO_CONTENT = frozenset("nav footer aside form menu button select template dialog svg canvas audio video object fieldset head".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption tr".split())
#: Names in class or id of what is no content, and words that such a name may be joined with (site-header, ad-slot).
LABELS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal newsletter subscribe signup "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead header footer comment comments disqus respond reply share sharing social related recommended recommendations "
    "toolbar pagination pager widget login search skip".split()
)
JOINED = frozenset("site page main global top bottom left right upper lower primary secondary inner outer box bar block container wrapper wrap area section slot unit list links link item items button buttons form row col panel group js the to content".split())
#: Fixed values of the ARIA standard: landmarks that are no content.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
#: Share of the longer page's blocks from which a pair counts as copies of one page, unless both have so many own blocks.
COPIES = 0.9
OWN_BLOCKS = 2
BROADCAST_ROWS = 200_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""", re.DOTALL)
_LABELLED = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")


def _labels(attributes: str) -> set[tuple[str, str]]:
    """(attribute, name) of each name in class, id, role and itemprop, in lower case; camel case counts as joined by hyphens."""
    if "=" not in attributes:
        return set()
    named = ((m[1].lower(), m[2] or m[3] or m[4] or "") for m in _LABELLED.finditer(attributes))
    return {(k, re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) for k, value in named for name in value.split()}


def _no_content(labels: set[tuple[str, str]]) -> bool:
    """Whether a role or the whole of a name says so; a name with a word of another kind (post-header, share-price) does not."""
    for k, name in labels:
        if k == "role" and name in ROLES:
            return True
        if k in ("class", "id"):
            parts = _PARTS.findall(name)
            if any(x in LABELS for x in parts) and all(x in LABELS or x in JOINED for x in parts):
                return True
    return False


def _end_of(html: str, tag: str, at: int) -> int:
    """Where the element of this name that was opened before ``at`` ends, elements of its name inside it counted; ``at`` if it is not closed."""
    depth = 1
    for m in re.compile(f"<(/?){re.escape(tag)}(?=[\\s/>])[^>]*>", re.IGNORECASE).finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def page_blocks(html: str | None) -> list[tuple[str, bool, bool, bool]]:
    """(text, named no content, in an article, running text) of each block of a page, in order."""
    html = html or ""
    out: list[tuple[str, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, no content, article
    dropped = article = 0
    buffer: list[str] = []
    tag_of_block = ""
    at = 0

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((text, dropped > 0, article > 0, tag_of_block in PROSE))

    def close(k: int) -> None:
        nonlocal dropped, article
        for _, no_content, is_article in stack[k:]:
            dropped -= no_content
            article -= is_article
        del stack[k:]

    lower = None
    while True:
        m = _TAG.search(html, at)
        while m is None and (k := html.find("<", at)) >= 0 and re.match(r"</?[a-zA-Z!?]", html[k : k + 3]) and ">" not in html[k:]:
            buffer.append(html[at:k])  # an unfinished tag ends the page
            at = len(html)
            break
        if m is None:
            buffer.append(html[at:])
            break
        if m.start() > at:
            buffer.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if tag in VOID:
            if tag == "br":
                buffer.append(" ")
            elif tag == "hr":
                flush()
            continue
        labels = _labels(m[3]) if not ending else set()
        named = not ending and _no_content(labels)
        if not ending and tag in RAW:
            lower = html.lower() if lower is None or len(lower) != len(html) else lower
            end = (lower if len(lower) == len(html) else html).find("</" + tag, at)
            at = len(html) if end < 0 else end
            continue
        if tag in INLINE:
            if tag in ("td", "th"):
                buffer.append(" ")
            elif not ending and named and not m[3].rstrip().endswith("/"):
                at = _end_of(html, tag, at)  # a named inline element leaves its paragraph
            continue
        flush()
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            tag_of_block = stack[-1][0] if stack else ""
            continue
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in ("li", "dd", "dt", "tr"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("ul", "ol", "dl", "table", "menu"):
                    break
                if stack[k][0] in ("li", "dd", "dt", "tr"):
                    close(k)
                    break
        is_article = tag in ("article", "main") or not labels.isdisjoint({("itemprop", "article-body"), ("itemprop", "articlebody"), ("role", "main"), ("role", "article")})
        no_content = tag in NO_CONTENT or named or (tag == "header" and not article)
        no_content = no_content and tag not in ("html", "body")
        stack.append((tag, no_content, is_article))
        dropped += no_content
        article += is_article
        tag_of_block = tag
    flush()
    return out


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence: rows of a dynamic program as bits of whole numbers."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    both = set(a[start:]) & set(b[start:])
    x, y = [i for i in range(start, len(a)) if a[i] in both], [j for j in range(start, len(b)) if b[j] in both]
    places: dict = {}
    for k, j in enumerate(y):
        places[b[j]] = places.get(b[j], 0) | 1 << k
    ones = (1 << len(y)) - 1
    v, rows = ones, [ones]
    for i in x:
        u = v & places[a[i]]
        v = ((v + u) | (v - u)) & ones
        rows.append(v)
    found = []
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append((x[i], y[j]))
    return [(k, k) for k in range(start)] + found[::-1]


ORDER = ("host", "path", "page", "hh")


def _url_part(url: Column, part: int) -> Column:
    """The authority (1) or the path (2) of a URL; empty where it has none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", part)


def _key(df: DataFrame) -> DataFrame:
    """df with hh and host: a page is what has these equal."""
    return df.withColumns({"hh": F.xxhash64("html"), "host": F.lower(_url_part(F.col("url").cast("string"), 1))})


def _parsed(pages: DataFrame) -> DataFrame:
    """(host, hh, path, page, hashes, free) of each distinct page, at its first path, without texts; free[k] says that block k goes if it is shared."""
    schema = "host string, hh long, path string, page string, hashes array<long>, free array<boolean>"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for host, hh, path, page, html in zip(pdf["host"], pdf["hh"], pdf["path"], pdf["page"], pdf["html"], strict=True):
                blocks = page_blocks(html)
                hashes = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t, *_ in blocks], np.uint64).view(np.int64)
                out.append((host, hh, path, page, hashes, [not (art and prose) for _, _, art, prose in blocks]))
            yield pd.DataFrame(out, columns=["host", "hh", "path", "page", "hashes", "free"])

    keyed = _key(pages).select("host", "hh", _url_part(F.col("url").cast("string"), 2).alias("path"), F.col("page_id").cast("long").cast("string").alias("page"), F.col("html").cast("string"))
    # Ids travel as strings: beside a null, pandas would make floats of them.
    parsed = keyed.mapInPandas(rows, schema).withColumn("page", F.col("page").cast("long"))
    once = parsed.groupBy("host", "hh").agg(F.min(F.struct("path", "page")).alias("at"), F.first("hashes").alias("hashes"), F.first("free").alias("free"))
    return once.select("host", "hh", "at.*", "hashes", "free")


def _ordered(rows: DataFrame) -> DataFrame:
    """(host, path, page, hh, part) in ranges of ORDER."""
    ranged = rows.select(*ORDER).distinct().repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id())
    return written(ranged, "html-order")


def _beyond(rows: DataFrame, value: Column, after: bool) -> DataFrame:
    """rows (ORDER, part) with ``found``: the nearest value that is not null before a row, or after it, of any partition."""
    rows = rows.withColumn("__pq_v", value)
    # "After" is "before" in descending order: frames that grow at their end take one pass.
    way = lambda c: F.col(c).desc() if after else F.col(c).asc()
    near = F.last("__pq_v", ignorenulls=True).over(Window.partitionBy("part").orderBy(*map(way, ORDER)).rowsBetween(Window.unboundedPreceding, -1))
    end = (F.min_by if after else F.max_by)("__pq_v", F.struct(*ORDER))
    ends = rows.where("__pq_v is not null").groupBy("part").agg(end.alias("end"))
    parts = rows.select("part").distinct().join(ends, "part", "left")  # one row per partition
    carried = F.last("end", ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy(way("part")).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", carried.alias("carried"))
    return rows.withColumn("near", near).join(F.broadcast(parts), "part").withColumn("found", F.coalesce("near", "carried")).drop("near", "carried", "__pq_v")


def _before(order: DataFrame) -> DataFrame:
    """(host, page, hh, page0, hh0): each page with the one before it in its host."""
    found = _beyond(order, F.struct("host", "page", "hh"), after=False).where(F.col("found.host") == F.col("host"))
    return found.select("host", "page", "hh", F.col("found.page").alias("page0"), F.col("found.hh").alias("hh0"))


def neighbours(rows: DataFrame) -> DataFrame:
    """(page, hh, page0, hh0): each page with the one before it in its host, by path, then page and hash."""
    return _before(_ordered(rows)).drop("host")


@F.pandas_udf(T.StructType().add("copy", T.BooleanType()).add("a", T.ArrayType(T.IntegerType())).add("b", T.ArrayType(T.IntegerType())))
def _shared_blocks(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Whether a and b are copies, and if not, the positions in a and in b of the blocks that align."""

    def aligned(x: np.ndarray, y: np.ndarray) -> tuple:
        pairs = common_subsequence(x.tolist(), y.tolist())
        if len(pairs) >= COPIES * max(len(x), len(y)) and min(len(x), len(y)) - len(pairs) < OWN_BLOCKS:
            return (True, [], [])
        return (False, [i for i, _ in pairs], [j for _, j in pairs])

    return pd.DataFrame([aligned(x, y) for x, y in zip(a, b, strict=True)], columns=["copy", "a", "b"])


def _aligned(pairs: DataFrame, parsed: DataFrame) -> DataFrame:
    """pairs (host, hh, hh0) with s, what their blocks share."""
    mine = parsed.select("host", "hh", F.col("hashes").alias("x"))
    other = parsed.select("host", F.col("hh").alias("hh0"), F.col("hashes").alias("y"))
    return pairs.join(mine, ["host", "hh"]).join(other, ["host", "hh0"]).select("host", "hh", "hh0", _shared_blocks("x", "y").alias("s"))


def shared_blocks(pages: DataFrame) -> DataFrame:
    """(host, hh, gone): the positions of a page's blocks that a neighbour shares and that are no running text of an article."""
    parsed = written(_parsed(pages), "html-blocks")
    order = _ordered(parsed)
    first = written(_aligned(_before(order).select("host", "hh", "hh0"), parsed), "html-aligned")
    # A page starts a run unless it is a copy of the one before it; its copies have the same pages before and after the run.
    copies = first.where("s.copy").select("host", "hh", F.lit(True).alias("copy"))
    runs = order.join(copies, ["host", "hh"], "left").select(*ORDER, "part", F.col("copy").isNull().alias("starts"))
    page = F.struct("host", "hh")
    runs = written(_beyond(runs, page, after=False).withColumnRenamed("found", "last"), "html-runs")
    left = _beyond(runs, F.when(F.col("starts"), F.struct("last")), after=False).where("NOT starts AND found.last.host = host")
    right = _beyond(runs, F.when(F.col("starts"), page), after=True).where("found.host = host")
    more = left.select("host", "hh", F.col("found.last.hh").alias("hh0")).union(right.select("host", F.col("found.hh").alias("hh"), F.col("hh").alias("hh0")))
    more = more.distinct().join(first.select("host", "hh", "hh0"), ["host", "hh", "hh0"], "left_anti")
    every = first.union(_aligned(more, parsed)).where("NOT s.copy")
    sides = F.explode(F.array(F.struct("hh", F.col("s.a").alias("at")), F.struct(F.col("hh0").alias("hh"), F.col("s.b").alias("at"))))
    found = every.select("host", sides.alias("x")).select("host", "x.*").where(F.size("at") > 0)
    found = found.groupBy("host", "hh").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    gone = F.array_sort(F.filter("at", lambda k: F.get("free", k)))
    return found.join(parsed.select("host", "hh", "free"), ["host", "hh"]).select("host", "hh", gone.alias("gone")).where(F.size("gone") > 0)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_shared) of each row of pages (page_id, url, html).

    text joins the blocks that stay, in page order, by an empty line; n_shared
    counts those deleted because neighbours have them.
    """
    gone = shared_blocks(pages)
    gone = broadcast_if_small(written(gone, "html-shared"), BROADCAST_ROWS)
    keyed = _key(pages).select("host", "hh", F.col("page_id").cast("long").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))
    joined = keyed.join(gone, ["host", "hh"], "left").select("page_id", "url", "html", "gone")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, url, html, shared in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["gone"], strict=True):
                blocks = page_blocks(html)
                lost = set() if shared is None else {int(k) for k in shared}
                has_article = any(art and not named for _, named, art, _ in blocks)
                kept = [t for k, (t, named, art, _) in enumerate(blocks) if k not in lost and not named and (art or not has_article)]
                text = "\n\n".join(kept)
                out.append((page_id, url, text, len(text), len(blocks), len(lost)))
            yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars", "n_blocks", "n_shared"])

    made = joined.mapInPandas(rows, "page_id string, url string, text string, n_chars long, n_blocks long, n_shared long")
    return made.withColumn("page_id", F.col("page_id").cast("long"))
