"""Readers of saved search-console, link-vendor and language responses: JSON strings in, typed rows out.

Each takes a DataFrame with a column ``body`` of responses and keeps its other columns. A body
that is null or no JSON gives no rows where a response lists items, else a row of nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that a link response may hold, and moderation kept above this confidence.
MOST_LINK_ROWS = 50
LEAST_MODERATION = 0.5
#: Fixed value: inspections of a property a day.
INSPECTIONS_A_DAY = 2000


def _items(rows: DataFrame, schema: str, path: str, body: str = "body") -> DataFrame:
    """The items of an array of the responses, in column ``item``, with their position ``pos``."""
    keys = [c for c in rows.columns if c != body]
    parsed = rows.select(*keys, F.from_json(body, schema).alias("__pq_body"))
    return parsed.select(*keys, F.posexplode(f"__pq_body.{path}").alias("pos", "item"))


def _shaped(items: DataFrame, columns: dict[str, Column]) -> DataFrame:
    keys = [c for c in items.columns if c not in ("pos", "item")]
    return items.select(*keys, *[c.alias(n) for n, c in columns.items()])


def _or(name: str, default: object) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def sitemap_status(rows: DataFrame) -> DataFrame:
    """Submitted sitemaps with their state; what contents say of indexing is left out, as it is not kept up to date."""
    schema = "sitemap array<struct<path:string,lastSubmitted:string,isPending:boolean,isSitemapsIndex:boolean,type:string,warnings:bigint,errors:bigint,contents:array<map<string,string>>>>"
    contents = F.transform(_or("item.contents", F.array()), lambda m: F.map_filter(m, lambda k, _: k != "indexed"))
    return _shaped(_items(rows, schema, "sitemap"), {
        "path": F.col("item.path"), "last_submitted": F.col("item.lastSubmitted"), "is_pending": F.col("item.isPending"), "is_index": F.col("item.isSitemapsIndex"),
        "type": F.col("item.type"), "warnings": _or("item.warnings", 0), "errors": _or("item.errors", 0), "contents": contents,
    })


def properties(rows: DataFrame) -> DataFrame:
    """Verified properties and what one may do with them."""
    return _shaped(_items(rows, "siteEntry array<struct<siteUrl:string,permissionLevel:string>>", "siteEntry"), {"url": F.col("item.siteUrl"), "permission": F.col("item.permissionLevel")})


def inspections(rows: DataFrame) -> DataFrame:
    """One row per inspection response; rows with an ``error`` (a column of rows, if there is one) keep it and have no verdict.

    canonical_match is null unless both canonicals are given.
    """
    index = "verdict:string,coverageState:string,robotsTxtState:string,indexingState:string,pageFetchState:string,lastCrawlTime:string,crawledAs:string,referringUrls:array<string>,googleCanonical:string,userCanonical:string"
    mobile = "verdict:string,issues:array<struct<issueType:string,message:string>>"
    rich = "verdict:string,detectedItems:array<struct<richResultType:string,items:array<struct<name:string,issues:array<struct<issueMessage:string,severity:string>>>>>>"
    schema = f"inspectionResult struct<indexStatusResult:struct<{index}>,mobileUsabilityResult:struct<{mobile}>,richResultsResult:struct<{rich}>>"
    keys = [c for c in rows.columns if c != "body"]
    parsed = rows.select(*keys, F.from_json("body", schema).alias("__pq_body")).select(*keys, F.col("__pq_body.inspectionResult").alias("r"))
    at = lambda name: F.col(f"r.indexStatusResult.{name}")
    verdict = F.coalesce(at("verdict"), F.lit("VERDICT_UNSPECIFIED"))
    said = lambda name: F.when(at(name) != "", at(name))
    out = parsed.select(
        *keys, (F.when(F.col("error").isNull(), verdict) if "error" in keys else verdict).alias("verdict"), at("coverageState").alias("coverage_state"), at("robotsTxtState").alias("robots_txt_state"),
        at("indexingState").alias("indexing_state"), at("pageFetchState").alias("page_fetch_state"), at("lastCrawlTime").alias("last_crawl_time"), at("crawledAs").alias("crawled_as"),
        F.coalesce(at("referringUrls"), F.array().cast("array<string>")).alias("referring_urls"), at("googleCanonical").alias("chosen_canonical"), at("userCanonical").alias("user_canonical"),
        (said("googleCanonical") == said("userCanonical")).alias("canonical_match"), F.col("r.mobileUsabilityResult").alias("mobile"), F.col("r.richResultsResult").alias("rich"),
    )
    found = F.transform("rich.detectedItems", lambda x: F.struct(x["richResultType"].alias("type"), x["items"].alias("items")))
    return out.withColumns({"mobile_verdict": F.col("mobile.verdict"), "mobile_issues": F.col("mobile.issues"), "rich_verdict": F.col("rich.verdict"), "rich_items": found}).drop("mobile", "rich")


def within_quota(requests: DataFrame, number: str = "pos", quota: int = INSPECTIONS_A_DAY) -> DataFrame:
    """The requests that a day's quota serves: those with a position (from 0 in each property) below it, and an address."""
    return requests.where((F.col(number) < quota) & (F.trim("url") != ""))


def inspection_summary(found: DataFrame, by: list[str]) -> DataFrame:
    """Inspections by outcome: errors, passed, failed, and all others as neutral."""
    failed = F.col("error").isNotNull() if "error" in found.columns else F.lit(False)
    outcome = F.when(failed, "error").when(F.col("verdict") == "PASS", "pass").when(F.col("verdict") == "FAIL", "fail").otherwise("neutral")
    counts = [F.count_if(outcome == name).alias(name) for name in ("pass", "fail", "neutral", "error")]
    return found.groupBy(*by).agg(F.count("*").alias("total"), *counts)


def url_metrics(rows: DataFrame) -> DataFrame:
    """The metrics of the first result of each response; counts that are missing are 0, other values null."""
    keys = [c for c in rows.columns if c != "body"]
    fields = "domain_authority:double,page_authority:double,spam_score:double,external_pages_to_root_domain:bigint,root_domains_to_root_domain:bigint,last_crawled:string"
    first = rows.select(*keys, F.get(F.from_json("body", f"results array<struct<{fields}>>")["results"], F.lit(0)).alias("item"))
    links = _or("item.external_pages_to_root_domain", 0)
    return first.select(
        *keys, "item.domain_authority", "item.page_authority", "item.spam_score", links.alias("links"), links.alias("external_links"),
        _or("item.root_domains_to_root_domain", 0).alias("linking_root_domains"), "item.last_crawled",
    )


def _link_rows(rows: DataFrame, fields: str, columns: dict[str, Column], most: int) -> DataFrame:
    items = _items(rows, f"results array<struct<{fields}>>", "results")
    return _shaped(items.where(F.col("pos") < min(most, MOST_LINK_ROWS)), columns)


def linking_domains(rows: DataFrame, most: int = MOST_LINK_ROWS) -> DataFrame:
    """The first referring domains of each response, as the vendor ordered them."""
    fields = "root_domain:string,domain_authority:double,spam_score:double,to_target:struct<pages:bigint>"
    return _link_rows(rows, fields, {
        "domain": _or("item.root_domain", ""), "domain_authority": F.col("item.domain_authority"), "page_authority": F.lit(None).cast("double"),
        "spam_score": F.col("item.spam_score"), "links_to_target": _or("item.to_target.pages", 1),
    }, most)


def anchor_texts(rows: DataFrame, most: int = MOST_LINK_ROWS) -> DataFrame:
    """The first anchors of each response."""
    fields = "anchor_text:string,external_pages:bigint,external_root_domains:bigint"
    return _link_rows(rows, fields, {"anchor_text": _or("item.anchor_text", ""), "external_links": _or("item.external_pages", 0), "linking_domains": _or("item.external_root_domains", 0)}, most)


def top_pages(rows: DataFrame, most: int = MOST_LINK_ROWS) -> DataFrame:
    """The first pages of each response."""
    fields = "page:string,page_authority:double,external_pages_to_page:bigint,root_domains_to_page:bigint"
    return _link_rows(rows, fields, {
        "url": _or("item.page", ""), "page_authority": F.col("item.page_authority"), "links": _or("item.external_pages_to_page", 0), "linking_domains": _or("item.root_domains_to_page", 0),
    }, most)


def entities(rows: DataFrame) -> DataFrame:
    """Entities of each response with their rank by salience (ties in the response's order)."""
    schema = "entities array<struct<name:string,type:string,salience:double,sentiment:struct<score:double,magnitude:double>,mentions:array<struct<type:string>>,metadata:map<string,string>>>"
    keys = [c for c in rows.columns if c != "body"]
    listed = rows.select(*keys, F.from_json("body", schema)["entities"].alias("__pq_all"))
    # Sorted inside the response, by position: maps have no order, and no entity meets those of another text.
    order = F.array_sort(F.transform("__pq_all", lambda x, k: F.struct((-F.round(F.coalesce(x["salience"], F.lit(0.0)), 4)).alias("down"), k.alias("k"))))
    items = listed.select(*keys, "__pq_all", F.posexplode(order).alias("pos", "at"))
    items = items.select(*keys, "pos", F.struct(F.col("at.down").alias("down"), F.get("__pq_all", F.col("at.k")).alias("x")).alias("e"))
    return items.select(
        *keys, (F.col("pos") + 1).alias("rank"), _or("e.x.name", "").alias("name"), _or("e.x.type", "UNKNOWN").alias("type"), F.abs("e.down").alias("salience"),
        F.col("e.x.sentiment.score").alias("sentiment_score"), F.col("e.x.sentiment.magnitude").alias("sentiment_magnitude"),
        F.greatest(F.coalesce(F.size("e.x.mentions"), F.lit(0)), F.lit(0)).alias("mention_count"), F.col("e.x.metadata").alias("metadata"),
    )


def sentiments(rows: DataFrame) -> DataFrame:
    """Tone of each response that has a document sentiment: positive above 0.25, negative below -0.25; sentence scores at both ends."""
    feeling = "struct<score:double,magnitude:double>"
    schema = f"documentSentiment {feeling}, sentences array<struct<sentiment:{feeling}>>"
    keys = [c for c in rows.columns if c != "body"]
    parsed = rows.select(*keys, F.from_json("body", schema).alias("b")).where("b.documentSentiment is not null")
    score, magnitude = _or("b.documentSentiment.score", 0.0), _or("b.documentSentiment.magnitude", 0.0)
    scores = F.transform("b.sentences", lambda s: F.coalesce(s["sentiment"]["score"], F.lit(0.0)))
    return parsed.select(
        *keys, F.round(score, 3).alias("score"), F.round(magnitude, 3).alias("magnitude"), F.when(score > 0.25, "positive").when(score < -0.25, "negative").otherwise("neutral").alias("tone"),
        F.when(magnitude > 2, "high").when(magnitude > 0.5, "moderate").otherwise("low").alias("emotion"),
        F.size(scores).alias("sentence_count"), F.array_max(scores).alias("most_positive"), F.array_min(scores).alias("most_negative"),
    )


def _rated(rows: DataFrame, path: str) -> DataFrame:
    items = _items(rows, f"{path} array<struct<name:string,confidence:double>>", path)
    return _shaped(items, {"name": _or("item.name", ""), "confidence": _or("item.confidence", 0.0)})


def categories(rows: DataFrame) -> DataFrame:
    """Content categories with their confidence."""
    return _rated(rows, "categories").withColumn("confidence", F.round("confidence", 4))


def moderation(rows: DataFrame) -> DataFrame:
    """Moderation categories of more than LEAST_MODERATION confidence."""
    return _rated(rows, "moderationCategories").where(F.col("confidence") > LEAST_MODERATION).withColumn("confidence", F.round("confidence", 4))


def fresh(rows: DataFrame, fetched: str = "fetched_at", days: int = 90, now: Column | None = None) -> DataFrame:
    """The cached rows that were fetched within so many days."""
    return rows.where(F.col(fetched) > (now if now is not None else F.current_timestamp()) - F.expr(f"interval {days} days"))
