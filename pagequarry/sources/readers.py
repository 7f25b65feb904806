"""Readers of saved responses and files, as DataFrames with declared schemas."""

from __future__ import annotations

import codecs
import re
import xml.etree.ElementTree as ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Byte order marks, longest first.
MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
# Extensions of images.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff")
_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.IGNORECASE)
_CHARSET = re.compile(r"""charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.IGNORECASE)


def decode_page(content: bytes | None, content_type: str | None) -> str | None:
    """Page bytes as text: by byte order mark, Content-Type, <meta charset> in the first 4096 bytes, else UTF-8; bad bytes are replaced."""
    if content is None:
        return None
    for mark, name in MARKS:
        if content.startswith(mark):
            return content.decode(name, "replace")
    said = [m[1] for m in [_CHARSET.search(content_type or "")] if m] + [m[1].decode("ascii") for m in [_META.search(content[:4096])] if m]
    for name in [*said, "utf-8"]:
        try:
            return content.decode(name, "replace")
        except LookupError:
            continue
    return None


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decode_page(None if c is None else bytes(c), t) for c, t in zip(content, content_type, strict=True)])


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of HTML files; url is the file's path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.htm*").load(path)
    return files.select(F.col("path").alias("url"), decoded("content", F.lit(None).cast("string")).alias("html"))


RANKS = "harmonic_pos bigint, harmonic_val double, pagerank_pos bigint, pagerank_val double, host_rev string, n_hosts bigint"


def domain_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Ranks of a web graph's domains from (gzipped) tab-separated files with reversed host names; comment lines are skipped."""
    raw = spark.read.schema(RANKS).option("sep", "\t").option("comment", "#").csv(path)
    return raw.withColumn("domain", F.array_join(F.reverse(F.split("host_rev", r"\.")), "."))


def authority(ranks: DataFrame, domains: DataFrame) -> DataFrame:
    """domains (domain) with their ranks, by equality; a domain that is not ranked says so."""
    found = domains.join(ranks.drop("host_rev"), "domain", "left")
    return found.withColumn("in_rankings", F.col("harmonic_pos").isNotNull())


ENVELOPE = "struct<tasks:array<struct<status_code:int,result:array<struct<items:array<{item}>>>>>>"


def envelope_items(rows: DataFrame, item: str, body: str = "body", pos: str = "item_pos") -> DataFrame:
    """The items of vendor responses, one row each; tasks that failed and results that are null are passed over."""
    tasks = rows.withColumn("__body", F.from_json(body, ENVELOPE.format(item=item))).withColumn("__task", F.explode("__body.tasks")).where("__task.status_code = 20000")
    results = tasks.withColumn("__result", F.explode_outer("__task.result")).where("__result.items is not null")
    return results.select(*rows.columns, F.posexplode("__result.items").alias(pos, "item")).drop(body)


def metric_points(rows: DataFrame, metric: str = "metric", weeks: str = "weeks", values: str = "p75s") -> DataFrame:
    """Parallel arrays of weeks and values as one row per week; nulls stay."""
    rows = rows.select("url", metric, F.posexplode(weeks).alias("pos", "week"), values)
    return rows.select("url", metric, "week", F.get(values, F.col("pos")).alias("p75"))


def last_months(volumes: Column, n: int = 12) -> Column:
    """The last n values of an array, or all of a shorter one."""
    return F.slice(volumes, F.greatest(F.size(volumes) - (n - 1), F.lit(1)), F.lit(n))


def labelled_field(text: Column, labels: list[str]) -> Column:
    """The first non-empty value of a "Label: value" line, labels in order of preference and in any case."""
    found = [F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^[ \t]*{re.escape(label)}[ \t]*:[ \t]*(\S[^\r\n]*)$", 1)), F.lit("")) for label in labels]
    return F.coalesce(*found)


# Where sitemaps usually lie.
COMMON_SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml")
MOST_DECLARED, MOST_LINES = 16, 50_000


def robots_sitemaps(text: Column) -> Column:
    """The sitemaps that a robots.txt declares, in order and without repetition."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)\s*$"), F.lit(1)))


def sitemap_candidates(sites: DataFrame) -> DataFrame:
    """(origin, pos, url, declared) for each site (origin, robots): declared sitemaps, then the usual places."""
    declared = F.slice(robots_sitemaps(F.coalesce("robots", F.lit(""))), 1, MOST_DECLARED)
    usual = F.transform(F.array(*[F.lit(p) for p in COMMON_SITEMAPS]), lambda p: F.concat("origin", p))
    rows = sites.withColumn("__declared", declared).select("origin", "__declared", F.posexplode(F.array_distinct(F.concat("__declared", usual))).alias("pos", "url"))
    return rows.select("origin", "pos", "url", F.array_contains("__declared", F.col("url")).alias("declared"))


def sitemap_kind_of(body: str | None) -> str:
    """What a response is as a sitemap: urlset, sitemapindex, rss, feed, text, empty, refused (it has a DOCTYPE) or invalid."""
    text = (body or "").strip()
    if not text:
        return "empty"
    if re.search(r"<!DOCTYPE|<!ENTITY", text[:2048], re.IGNORECASE):
        return "refused"
    if text.startswith("<"):
        try:
            root = ElementTree.fromstring(text).tag.rsplit("}", 1)[-1].lower()
        except ElementTree.ParseError:
            return "invalid"
        return root if root in ("urlset", "sitemapindex", "rss", "feed") else "invalid"
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return "text" if len(lines) <= MOST_LINES and all(re.fullmatch(r"https?://[^\s/]+\S*", x) for x in lines) else "invalid"


@F.pandas_udf(T.StringType())
def sitemap_kind(body: pd.Series) -> pd.Series:
    return body.map(sitemap_kind_of)


def update_feed(spark: SparkSession, path: str) -> DataFrame:
    """(date, name, kind, source, notes, pos) of an update feed in JSON."""
    schema = "updates array<struct<date:string,name:string,kind:string,source:string,notes:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("updates").alias("pos", "u")).select("u.*", "pos").withColumn("date", F.to_date("date"))


def updates_since(feed: DataFrame, since: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Updates from a year, month or day on, of some kinds, newest first; the feed's order breaks ties."""
    out = feed if since is None else feed.where(F.col("date") >= F.lit(since + "-01-01"[: 10 - len(since)] if len(since) == 4 else since + "-01" if len(since) == 7 else since).cast("date"))
    return (out if kinds is None else out.where(F.col("kind").isin(kinds))).orderBy(F.desc("date"), "pos")


def batch_plan(spark: SparkSession, path: str, ratio: str = "16:9", resolution: str = "1K", model: str = "default") -> tuple[DataFrame, DataFrame]:
    """(valid rows with defaults, rejected rows) of a CSV plan that must have a prompt column."""
    rows = spark.read.option("header", "true").csv(path)
    if "prompt" not in rows.columns:
        raise ValueError("the plan has no prompt column")
    given = lambda name, default: F.coalesce(F.nullif(F.trim(name), F.lit("")) if name in rows.columns else F.lit(None).cast("string"), F.lit(default)).alias(name)
    prompt = F.nullif(F.trim("prompt"), F.lit(""))
    return rows.where(prompt.isNotNull()).select(prompt.alias("prompt"), given("ratio", ratio), given("resolution", resolution), given("model", model)), rows.where(prompt.isNull())


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """The image files below a folder with their length and extension; their bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).where(F.col("extension").isin(*IMAGE_EXTENSIONS))
