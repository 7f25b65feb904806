"""Search-relevant facts of pages: a parser for trees, expressions for counts.

``parse_pages`` reads each page once (stdlib parser, Arrow batches) into the
parsed-page struct; links, images and structured-data nodes are its exploded
arrays. Everything that is a count of patterns stays an expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagequarry.functions.schemas import struct

IMAGE = "struct<src:string,alt:string,width:string,height:string,loading:string,lazy_method:string>"
LINK = "struct<href:string,text:string,rel:array<string>>"
PARSED = (
    "title string, meta_description string, meta_robots string, canonical string, h1 array<string>, h2 array<string>, h3 array<string>, "
    "h1_suspicious array<string>, h2_suspicious array<string>, h3_suspicious array<string>, "
    f"images array<{IMAGE}>, links_internal array<{LINK}>, links_external array<{LINK}>, schema array<string>, "
    "open_graph map<string,string>, twitter_card map<string,string>, hreflang array<struct<lang:string,href:string>>, word_count bigint"
)
# Attributes and classes of lazy loaders, in order of detection.
LAZY = (
    ("perfmatters", ("data-perfmatters-src", "data-perfmatters-srcset"), {"perfmatters-lazy", "perfmatters-lazy-loaded"}),
    ("ewww", ("data-ewww-src", "data-eio"), {"lazyload-eio", "lazyloaded-eio"}),
    ("js-generic", ("data-src", "data-lazy-src", "data-original", "data-srcset"), {"lazyload", "lazyloaded", "lazy", "lazy-loaded"}),
)
# Bounds on structured data.
MOST_BLOCKS, MOST_BLOCK_BYTES, MOST_BYTES, MOST_NODES, MOST_DEPTH, MOST_TYPES = 50, 256 * 1024, 1024 * 1024, 10_000, 40, 100
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text is read.
_WITH_TEXT = {"title", "h1", "h2", "h3", "a", "script"}
_UNCOUNTED = frozenset(("script", "style", "nav", "footer", "header"))


def lazy_method(attributes: dict[str, str | None]) -> str:
    """How an image is loaded late: native, one of the known loaders, or none."""
    if (attributes.get("loading") or "").lower() == "lazy":
        return "native"
    classes = set((attributes.get("class") or "").split())
    for name, keys, marks in LAZY:
        if classes & marks or any(attributes.get(k) for k in keys):
            return name
    return "none"


def _suspicious(heading: str) -> bool:
    """Very short, or only digits and separators."""
    return len(heading) <= 3 or re.sub(r"[,.+\-%\s]", "", heading).isdigit()


class _Page(HTMLParser):
    """Collects one page's facts; elements close their open descendants when they end."""

    def __init__(self, url: str | None):
        super().__init__(convert_charrefs=True)
        self.url = url
        self.out: dict = {k: None for k in ("title", "meta_description", "meta_robots", "canonical")}
        for k in ("h1", "h2", "h3", "images", "links_internal", "links_external", "schema", "hreflang"):
            self.out[k] = []
        self.out |= {"open_graph": {}, "twitter_card": {}}
        self.open: list[tuple[str, int, dict]] = []
        self.texts: list[str] = []  # an open element's text is what came since it began
        self.words: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k.lower(): v for k, v in attrs}
        rel = (a.get("rel") or "").lower().split()
        if tag == "meta":
            name, content = (a.get("name") or "").lower(), a.get("content") or ""
            prop = (a.get("property") or "").lower()
            if name in ("description", "robots"):
                self.out["meta_" + name] = content
            if prop.startswith("og:"):
                self.out["open_graph"][prop] = content
            if name.startswith("twitter:"):
                self.out["twitter_card"][name] = content
        elif tag == "link":
            if "canonical" in rel and not self.out.get("_canonical"):
                self.out["canonical"], self.out["_canonical"] = a.get("href"), True
            if "alternate" in rel and a.get("hreflang"):
                self.out["hreflang"].append({"lang": a["hreflang"], "href": a.get("href")})
        elif tag == "img":
            src = a.get("src") or ""
            src = urljoin(self.url, src) if self.url and src else src
            self.out["images"].append({"src": src, **{k: a.get(k) for k in ("alt", "width", "height", "loading")}, "lazy_method": lazy_method(a)})
        if tag not in _VOID:
            self.open.append((tag, len(self.texts), a))
            self.hidden += tag in _UNCOUNTED

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.texts.append(data)
        if not self.hidden:
            self.words.append(data)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is not None:
            while len(self.open) > at:
                self._end(*self.open.pop())

    def close(self) -> None:
        super().close()
        while self.open:
            self._end(*self.open.pop())

    def _end(self, tag: str, start: int, a: dict) -> None:
        self.hidden -= tag in _UNCOUNTED
        if tag not in _WITH_TEXT:
            return
        text = "".join(self.texts[start:]).strip()
        if tag == "title" and self.out["title"] is None:
            self.out["title"] = text
        elif tag in ("h1", "h2", "h3") and text:
            self.out[tag].append(text)
        elif tag == "a" and self.url:
            self._link(a, text)
        elif tag == "script" and (a.get("type") or "").strip().lower() == "application/ld+json":
            self._schema(text)

    def _link(self, a: dict, text: str) -> None:
        href = (a.get("href") or "").strip()
        if not href or href.startswith(("#", "javascript:")):
            return
        full = urljoin(self.url, href)
        inside = urlsplit(full).netloc == urlsplit(self.url).netloc
        self.out["links_internal" if inside else "links_external"].append({"href": full, "text": text[:100], "rel": (a.get("rel") or "").split()})

    def _schema(self, text: str) -> None:
        try:
            data = json.loads(text)
        except (ValueError, RecursionError):
            return
        if isinstance(data, dict) and isinstance(data.get("@graph"), list):
            nodes = [x for x in data["@graph"] if isinstance(x, dict)]
        else:
            nodes = [x for x in data if isinstance(x, dict)] if isinstance(data, list) else [data]
        self.out["schema"] += [json.dumps(x, ensure_ascii=False) for x in nodes]


#: A script, style or comment, where references are text, or the start of a reference without its semicolon.
_UNENDED = re.compile(r"(<(script|style)\b.*?</\2\s*>|<!--.*?-->)|&(?!(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);)", re.IGNORECASE | re.DOTALL)


def parse_page(html: str | None, url: str | None = None, ended_only: bool = False) -> dict:
    """The parsed-page record of one page; null html is an empty page.

    Browsers also decode some references without their semicolon (``&amp``); with ``ended_only`` these stay as they are written.
    """
    page = _Page(url)
    page.feed(_UNENDED.sub(lambda m: m[1] or "&amp;", html or "") if ended_only else html or "")
    page.close()
    out = {k: v for k, v in page.out.items() if k[0] != "_"}
    for h in ("h1", "h2", "h3"):
        out[f"{h}_suspicious"] = [x for x in out[h] if _suspicious(x)]
    out["word_count"] = len(re.findall(r"\b\w+\b", " ".join(page.words)))
    return out


#: Pages that a Python worker holds as objects at once; a batch of many more stays in Arrow's buffers.
PAGES_AT_ONCE = 64


def parse_pages(pages: DataFrame, html: str = "html", url: str = "url", ended_only: bool = False) -> DataFrame:
    """pages with a struct column ``parsed``; ``ended_only`` as in parse_page.

    A batch is parsed and handed on in slices, so a worker's memory goes by the slice and the batch's bytes, not by its pages' facts.
    """
    kind = T.StructType.fromDDL(PARSED)
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def parse(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for h, u in batches:
            for at in range(0, len(h), PAGES_AT_ONCE):
                some = zip(h.slice(at, PAGES_AT_ONCE).to_pylist(), u.slice(at, PAGES_AT_ONCE).to_pylist(), strict=True)
                facts = [parse_page(x, y, ended_only) for x, y in some]
                yield pa.array([f | {m: list(f[m].items()) for m in ("open_graph", "twitter_card")} for f in facts], arrow)

    return pages.withColumn("parsed", parse(html, url))


def links_of(parsed: DataFrame, key: str = "url") -> DataFrame:
    """One row per link: page, href, text, rel, whether it is internal, and its place (external links first)."""
    outer = F.transform("parsed.links_external", lambda x: F.struct(x.alias("link"), F.lit(False).alias("is_internal")))
    inner = F.transform("parsed.links_internal", lambda x: F.struct(x.alias("link"), F.lit(True).alias("is_internal")))
    return parsed.select(F.col(key).alias("page_url"), F.posexplode(F.concat(outer, inner)).alias("pos", "x")).select("page_url", "pos", "x.link.href", "x.link.text", "x.link.rel", "x.is_internal")


def images_of(parsed: DataFrame, key: str = "url") -> DataFrame:
    """One row per image, with the audit of its text alternative and dimensions."""
    rows = parsed.select(F.col(key).alias("page_url"), F.posexplode("parsed.images").alias("pos", "image")).select("page_url", "pos", "image.*")
    alt = F.when(F.col("alt").isNull(), "missing").when(F.trim("alt") == "", "decorative").when(F.length("alt") < 10, "short").when(F.length("alt") > 125, "long").otherwise("ok")
    return rows.withColumns({"alt_status": alt, "has_dimensions": F.col("width").isNotNull() & F.col("height").isNotNull()})


def schema_types(data: object) -> tuple[list[str], bool]:
    """Sorted @type values of a JSON value, walked without recursion and within bounds; whether it was cut."""
    found, stack, seen = set(), [(data, 0)], 0
    while stack:
        value, depth = stack.pop()
        seen += 1
        if seen > MOST_NODES or depth > MOST_DEPTH:
            return sorted(found)[:MOST_TYPES], True
        if isinstance(value, dict):
            kind = value.get("@type")
            found |= {k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str)}
            stack += [(v, depth + 1) for v in value.values()]
        elif isinstance(value, list):
            stack += [(v, depth + 1) for v in value]
    return sorted(found)[:MOST_TYPES], len(found) > MOST_TYPES


_LD = re.compile(r"""<script\b[^>]*\btype\s*=\s*["']?\s*application/ld\+json\s*["']?[^>]*>(.*?)</script\s*>""", re.IGNORECASE | re.DOTALL)


def json_ld_blocks(html: str | None) -> list[dict]:
    """The structured-data blocks of a page within the bounds: index, size, valid (null: over the block limit), types, cut."""
    out, total = [], 0
    for k, m in enumerate(_LD.finditer(html or "")):
        raw = m[1].strip()
        size = len(raw.encode("utf-8", "replace"))
        total += size
        if k >= MOST_BLOCKS or total > MOST_BYTES:
            break
        entry = {"index": k + 1, "size_bytes": size, "valid": None, "types": [], "types_truncated": False}
        if size <= MOST_BLOCK_BYTES:
            try:
                entry["types"], entry["types_truncated"] = schema_types(json.loads(raw))
                entry["valid"] = True
            except (ValueError, RecursionError):
                entry["valid"] = False
        out.append(entry)
    return out


@F.pandas_udf(T.ArrayType(struct("index int, size_bytes int, valid boolean, types strings, types_truncated boolean")))
def json_ld(html: pd.Series) -> pd.Series:
    return html.map(json_ld_blocks)


# Shells of single-page applications, site-builder markers, and script-rendered pages.
SHELLS = ('<div id="root"></div>', '<div id="__next">', '<div id="app"></div>', '<div id="__nuxt">', "data-svelte-h=", "<astro-island ", "you need to enable javascript", "please enable javascript")
BUILDERS = (("wix-warmup-data", "static.parastorage.com", 'content="wix.com'), ("data-wf-page", "data-wf-site"), ('content="squarespace', "static1.squarespace.com"))
RENDERED = ('<div id="root"', '<div id="app"', '<div id="__next"', "__next_data__", "__nuxt", "ng-app=", "ng-version=", "react-root", "data-reactroot", "_reactlistening")
SPARSE_BUILDER, SPARSE_BODY = 400, 100


def _any(low: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(low, F.lit(m))
    return out


def visible_text(html: Column) -> Column:
    """Text between the first <body and the last </body>, in lower case; '' without a body."""
    body = F.regexp_extract(F.lower(html), r"(?s)<body(.*)</body>", 1)
    plain = F.regexp_replace(F.regexp_replace(F.concat(F.lit("<body"), body), r"(?s)<(script|style|template|noscript)\b[^>]*>.*?</\1>", " "), "<[^>]+>", " ")
    return F.when(body == "", F.lit("")).otherwise(F.btrim(F.regexp_replace(plain, r"\s+", " ")))


def needs_browser(html: Column) -> Column:
    """Whether a page is a shell that scripts fill: a marker, sparse text with two markers of one builder, or hardly any body text."""
    low = F.lower(html)
    text = visible_text(html)
    built = F.lit(False)
    for group in BUILDERS:
        built = built | (sum((F.contains(low, F.lit(m)).cast("int") for m in group), F.lit(0)) >= 2)
    has_body = low.rlike(r"(?s)<body.*</body>")
    thin = (has_body & (F.length(text) < SPARSE_BODY)) | (built & (F.length(text) < SPARSE_BUILDER))
    return F.coalesce(html, F.lit("")).eqNullSafe(F.lit("")) | F.coalesce(_any(low, SHELLS) | thin, F.lit(False))


def script_rendered(html: Column, word_count: Column) -> Column:
    """Whether a fetched page's links cannot be trusted to be in its markup."""
    return _any(F.lower(html), RENDERED) | ((F.length(html) > 5000) & (word_count < 50))


def _count(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern)).cast("long")


def loading_signals(pages: DataFrame) -> DataFrame:
    """(url, speculation, preload_links, prerender_links, high_priority, lcp_hint, unload_listener, no_store, score): four signals of 25 points.

    pages may have headers (map); their names are compared in lower case.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    if "headers" in pages.columns:
        headers = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
        rules, cached = F.map_contains_key(headers, "speculation-rules"), F.lower(F.coalesce(F.try_element_at(headers, F.lit("cache-control")), F.lit("")))
    else:
        rules, cached = F.lit(False), F.lit("")
    df = pages.select(
        "url",
        (html.rlike(r"""(?is)<script\b[^>]*\btype\s*=\s*["']speculationrules["'][^>]*>.*?</script>""") | rules).alias("speculation"),
        _count(html, r"""(?i)<link\b[^>]*\brel\s*=\s*["']preload["'][^>]*>""").alias("preload_links"),
        _count(html, r"""(?i)<link\b[^>]*\brel\s*=\s*["']prerender["'][^>]*>""").alias("prerender_links"),
        _count(html, r"""(?i)\bfetchpriority\s*=\s*["']high["']""").alias("high_priority"),
        html.rlike(r"""(?i)<(?:img|video|source)\b[^>]*\bfetchpriority\s*=\s*["']high["']""").alias("lcp_hint"),
        html.rlike(r"""(?i)\b(?:addEventListener|on)\s*\(\s*["']?unload["']?""").alias("unload_listener"),
        F.contains(cached, F.lit("no-store")).alias("no_store"),
    )
    points = F.col("speculation").cast("int") + F.col("lcp_hint").cast("int") + (~F.col("no_store") & ~F.col("unload_listener")).cast("int") + (F.col("prerender_links") == 0).cast("int")
    return df.withColumn("score", (points * 25).cast("long"))


def control_counts(html: Column) -> dict[str, Column]:
    """Counts of what an agent can operate: buttons, anchors, clickable divs, landmarks, inputs without ARIA name, inputs without label."""
    html = F.coalesce(html, F.lit(""))
    ids = F.regexp_extract_all(html, F.lit(r"""(?i)<input\b[^>]*\bid\s*=\s*["']([^"']+)["']"""), F.lit(1))
    labelled = F.regexp_extract_all(html, F.lit(r"""(?i)<label\b[^>]*\bfor\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return {
        "real_buttons": _count(html, r"(?i)<button\b"),
        "real_anchors": _count(html, r"(?i)<a\b[^>]*\bhref\s*="),
        "div_onclick_widgets": _count(html, r"""(?i)<div\b[^>]*\bonclick\s*=\s*["'][^"']+["']"""),
        "semantic_landmarks": _count(html, r"(?i)<(?:nav|main|article|section|aside|header|footer)\b"),
        "inputs_without_aria": _count(html, r"(?i)<input\b(?![^>]*\baria-label\s*=)(?![^>]*\baria-labelledby\s*=)[^>]*>"),
        "inputs_without_label": F.size(F.filter(ids, lambda i: ~F.array_contains(labelled, i))).cast("long"),
    }


def agent_score(controls: dict[str, Column], unnamed: Column | None = None, generic_share: Column | None = None) -> Column:
    """100 less capped deductions for what agents stumble over, never below 0."""
    zero = F.lit(0)
    lost = (
        F.least(F.lit(20), controls["div_onclick_widgets"] * 5)
        + F.when(controls["semantic_landmarks"] < 2, 10).otherwise(0)
        + F.least(F.lit(20), controls["inputs_without_label"] * 4)
        + F.least(F.lit(20), F.coalesce(unnamed, zero) * 3 if unnamed is not None else zero)
        + (F.when(generic_share > 0.5, 10).otherwise(0) if generic_share is not None else zero)
    )
    return F.greatest(zero, 100 - lost).cast("long")


INTERACTIVE = frozenset("button link textbox checkbox radio combobox menuitem tab".split())


def tree_counts(tree: str | None) -> dict:
    """Node counts of an accessibility tree given as JSON, of any depth."""
    out = dict.fromkeys(("total_nodes", "interactive_nodes", "role_button", "role_link", "role_generic", "unnamed_interactive"), 0)
    root = json.loads(tree) if tree else None
    stack = [root] if root else []
    while stack:
        node = stack.pop()
        role = (node.get("role") or "").lower()
        out["total_nodes"] += 1
        if f"role_{role}" in out:
            out[f"role_{role}"] += 1
        if role in INTERACTIVE:
            out["interactive_nodes"] += 1
            out["unnamed_interactive"] += not (node.get("name") or "").strip()
        stack += [c for c in node.get("children") or [] if c]
    return {"tree_present": root is not None, **out}


@F.pandas_udf(struct("tree_present boolean, total_nodes int, interactive_nodes int, role_button int, role_link int, role_generic int, unnamed_interactive int"))
def accessibility_counts(trees: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tree_counts(t) for t in trees])


# Features of business profiles that are gone.
CHAT = r"(?i)\bmessage\s+us\s+(?:on|via|through)\s+google\b|\bchat\s+(?:on|via|with)\s+google\s+(?:business|maps)\b|\bgoogle\s+business\s+chat\b|\bgoogle[-\s]?business[-\s]?messages?\b"
OLD_SITE = r"""(?i)https?://[^/\s"']+\.business\.site(?:/[^\s"']*)?"""


def retired_profile_features(pages: DataFrame) -> DataFrame:
    """(url, severity, feature, match): one row per distinct reference to a retired business-profile feature."""
    html = F.coalesce(F.col("html"), F.lit(""))
    found = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(p), F.lit(0))))
    rows = lambda p, severity, feature: F.transform(found(p), lambda m: F.struct(F.lit(severity).alias("severity"), F.lit(feature).alias("feature"), F.left(m, F.lit(200)).alias("match")))
    return pages.select("url", F.explode(F.concat(rows(CHAT, "Critical", "gbp-chat"), rows(OLD_SITE, "Medium", "business-site-url"))).alias("x")).select("url", "x.*")
