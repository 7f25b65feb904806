"""Site-wide rules: locale parity, sitemap quality, page-count gates, report checks, capability profiles."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions.schemas import struct
from pagequarry.functions.urls import host_of, is_fetchable_url

# Acceptable word-count ratios against the English page, by language.
RATIOS = {"de": (1.10, 1.50), "fr": (1.00, 1.40), "es": (1.00, 1.40), "ja": (0.60, 1.00), "zh": (0.55, 0.95)}


def locale_parity(pages: DataFrame, source_lang: str = "en") -> DataFrame:
    """(page_key, lang, problem, severity) of translations against their source.

    pages: page_key, lang, sections, faq_items, images, words. Missing translations are
    those of a language that the site has and a page group lacks.
    """
    src = pages.where(F.col("lang") == source_lang).select("page_key", *[F.col(c).alias(f"src_{c}") for c in ("sections", "faq_items", "images", "words")])
    langs = pages.where(F.col("lang") != source_lang).select("lang").distinct()
    wanted = src.select("page_key").crossJoin(F.broadcast(langs))  # a site's languages: a few codes
    missing = wanted.join(pages.select("page_key", "lang"), ["page_key", "lang"], "left_anti").select("page_key", "lang", F.lit("page-existence").alias("problem"), F.lit("High").alias("severity"))
    both = pages.where(F.col("lang") != source_lang).join(src, "page_key")
    ratio = F.col("words") / F.col("src_words")
    outside = F.lit(False)
    for code, (lo, hi) in RATIOS.items():
        outside = outside | ((F.col("lang") == code) & ~ratio.between(lo, hi))
    checks = F.array(
        F.when(F.abs(F.col("sections") - F.col("src_sections")) > 1, F.struct(F.lit("sections").alias("problem"), F.lit("Medium").alias("severity"))),
        F.when(F.abs(F.col("faq_items") - F.col("src_faq_items")) > 2, F.struct(F.lit("faq-items").alias("problem"), F.lit("Medium").alias("severity"))),
        F.when(F.col("images") != F.col("src_images"), F.struct(F.lit("images").alias("problem"), F.lit("Medium").alias("severity"))),
        F.when((F.col("src_words") > 0) & outside, F.struct(F.lit("word-ratio").alias("problem"), F.lit("Low").alias("severity"))),
    )
    found = both.select("page_key", "lang", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("x")).select("page_key", "lang", "x.problem", "x.severity")
    return missing.union(found)


def freshness(pages: DataFrame, source_lang: str = "en") -> DataFrame:
    """(page_key, lang, days, status) of each translation: days by which the source page is newer."""
    source = F.max(F.when(F.col("lang") == source_lang, F.col("updated"))).over(Window.partitionBy("page_key"))
    days = F.greatest(F.lit(0), F.date_diff("source", "updated"))
    status = F.when(F.col("days") <= 7, "fresh").when(F.col("days") <= 30, "aging").when(F.col("days") <= 90, "stale").otherwise("outdated")
    return pages.withColumn("source", source).where((F.col("lang") != source_lang) & F.col("source").isNotNull()).withColumn("days", days).select("page_key", "lang", "days", status.alias("status"))


# Limits of sitemap files.
MOST_URLS, MOST_BYTES, MOST_IMAGES, MOST_NEWS, NEWS_DAYS = 50_000, 50 * 1024 * 1024, 1000, 1000, 2


def sitemap_quality(entries: DataFrame, files: DataFrame, as_of: Column) -> DataFrame:
    """(sitemap, problem, severity).

    entries: sitemap, url, lastmod, status_code, noindex, has_ignored_tags, images, news_date;
    files: sitemap, bytes.
    """
    per = entries.groupBy("sitemap").agg(
        F.count("*").alias("urls"), F.count_if(F.col("url").startswith("http://")).alias("insecure"), F.count_if(F.col("noindex")).alias("noindexed"),
        F.count_if(F.col("status_code").between(300, 399)).alias("redirected"), F.count_if((F.col("status_code") >= 400)).alias("broken"),
        F.count_if(F.col("has_ignored_tags")).alias("ignored"), F.count_if(F.col("images") > MOST_IMAGES).alias("crowded"), F.count("news_date").alias("news"),
        F.count_if(F.date_diff(as_of, F.col("news_date")) > NEWS_DAYS).alias("old_news"), F.min("lastmod").alias("first"), F.max("lastmod").alias("last"), F.count("lastmod").alias("dated"),
    ).join(files, "sitemap", "left")
    rule = lambda hit, name, severity: F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(name).alias("problem"), F.lit(severity).alias("severity")))
    c = F.col
    checks = F.array(
        rule(c("urls") > MOST_URLS, "too-many-urls", "Critical"), rule(c("bytes") > MOST_BYTES, "too-large", "Critical"), rule(c("news") > MOST_NEWS, "too-many-news", "Critical"),
        rule(c("broken") > 0, "not-ok-urls", "High"), rule(c("noindexed") > 0, "noindexed-urls", "High"), rule(c("redirected") > 0, "redirected-urls", "Medium"),
        rule(c("insecure") > 0, "http-urls", "Medium"), rule(c("old_news") > 0, "old-news", "Medium"), rule(c("crowded") > 0, "too-many-images", "Medium"),
        rule((c("dated") > 1) & (c("dated") == c("urls")) & (c("first") == c("last")), "identical-lastmod", "Low"), rule(c("ignored") > 0, "ignored-tags", "Info"),
    )
    return per.select("sitemap", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("x")).select("sitemap", "x.*")


def page_gates(pages: DataFrame, kind: str = "location") -> DataFrame:
    """(template, pages, thin_pages, verdict) of generated pages; pages: template, uniqueness_pct, words.

    Location pages warn at 30 and stop at 50, programmatic ones at 100 and 500; a
    template whose pages are less than 30 % unique on average stops, under 40 % warns.
    """
    warn, stop = (30, 50) if kind == "location" else (100, 500)
    by = pages.groupBy("template").agg(F.count("*").alias("pages"), F.round(F.avg("uniqueness_pct"), 2).alias("mean_uniqueness"), F.count_if((F.col("words") < 300) | (F.col("uniqueness_pct") < 40)).alias("thin_pages"))
    n, u = F.col("pages"), F.col("mean_uniqueness")
    return by.withColumn("verdict", F.when((n >= stop) | (u < 30), "stop").when((n >= warn) | (u < 40), "warning").otherwise("ok"))


# Social hosts, whose pages scripts render.
SOCIAL = ("instagram.com", "facebook.com", "twitter.com", "x.com", "tiktok.com", "linkedin.com", "pinterest.com", "youtube.com")


def report_issues(results: DataFrame, declared: DataFrame, score: DataFrame) -> DataFrame:
    """(report, severity, field, detail) of backlink reports that contradict themselves.

    results: report, source_url, status, http_status; declared: report, status, count (the
    report's own summary); score: report, factors_with_data, score.
    """
    counted = results.groupBy("report", F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("actual"))
    wrong = counted.join(declared, ["report", "status"], "left").where(F.coalesce("count", F.lit(0)) != F.col("actual"))
    a = wrong.select("report", F.lit("error").alias("severity"), F.lit("summary").alias("field"), F.concat_ws(" ", "status", F.coalesce("count", F.lit(0)).cast("string"), F.col("actual").cast("string")).alias("detail"))
    host = host_of(F.col("source_url"))
    social = F.lit(False)
    for s in SOCIAL:
        social = social | F.contains(host, F.lit(s))
    b = results.where((F.col("status") == "link_removed") & (F.col("http_status") == 200) & social).select("report", F.lit("error"), F.lit("verification"), F.col("source_url"))
    c = score.where((F.col("factors_with_data") < 4) & F.col("score").isNotNull()).select("report", F.lit("error"), F.lit("health_score"), F.col("factors_with_data").cast("string"))
    return a.union(b).union(c)


def schema_claims(blocks: DataFrame) -> DataFrame:
    """(report, severity, field, detail) of a report's structured-data blocks (report, pos, block, JSON texts).

    not-an-object, unflattened-graph (valid, but to be flattened), missing-type, and howto, whose rich result is gone; a list of types is fine.
    """
    keys = F.json_object_keys("block")
    kind = F.get_json_object("block", "$['@type']")
    has = lambda k: F.array_contains(keys, k)
    found = (
        F.when(keys.isNull(), F.struct(F.lit("warning").alias("severity"), F.lit("not-an-object").alias("detail")))
        .when(~has("@type") & has("@graph"), F.struct(F.lit("error").alias("severity"), F.lit("unflattened-graph").alias("detail")))
        .when(~has("@type"), F.struct(F.lit("warning").alias("severity"), F.lit("missing-type").alias("detail")))
        .when(kind == "HowTo", F.struct(F.lit("error").alias("severity"), F.lit("howto").alias("detail")))
    )
    return blocks.select("report", F.concat(F.lit("schema["), F.col("pos").cast("string"), F.lit("]")).alias("field"), found.alias("f")).where("f is not null").select("report", "f.severity", "field", "f.detail")


def heading_claims(headings: DataFrame) -> DataFrame:
    """The reports all of whose first-level headings (report, text, suspicious) are suspicious: the page may have no real one."""
    all_ = headings.groupBy("report").agg(F.min(F.coalesce("suspicious", F.lit(False))).alias("all")).where("all")
    return all_.select("report", F.lit("warning").alias("severity"), F.lit("h1").alias("field"), F.lit("all-suspicious").alias("detail"))


def crawl_claims(domains: DataFrame) -> DataFrame:
    """What a report (report, in_crawl, in_rankings) may say of a domain that has no rank: not crawled, or below the ranking threshold."""
    said = F.when(~F.col("in_crawl") & ~F.col("in_rankings"), "not-crawled").when(F.col("in_crawl") & ~F.col("in_rankings"), "below-threshold")
    return domains.select("report", F.lit("info").alias("severity"), F.lit("crawl").alias("field"), said.alias("detail")).where("detail is not null")


def reciprocal_claims(outbound: DataFrame, results: DataFrame) -> DataFrame:
    """The domains that a report's page links to (report, href) and that link back (results: report, source_url, status verified)."""
    bare = lambda c: F.regexp_replace(host_of(F.col(c)), r"^www\.", "")
    out = outbound.select("report", bare("href").alias("domain")).where("domain <> ''").distinct()
    back = results.where("status = 'verified'").select("report", bare("source_url").alias("domain")).where("domain <> ''").distinct()
    return out.join(back, ["report", "domain"]).select("report", F.lit("warning").alias("severity"), F.lit("reciprocal").alias("field"), F.col("domain").alias("detail"))


# Urls of a batch and letters of a key.
MOST_SUBMITTED, KEY_LENGTH = 10_000, (8, 128)


def submission_problems(batches: DataFrame, urls: DataFrame) -> DataFrame:
    """(batch, urls, problem) of batches (batch, host, key) of urls (batch, url) to be submitted; problem is the first that holds, or null.

    empty, too-many, bad-key, foreign-url (on neither the host nor a subdomain of it), refused-url (an address that is not public or
    no web address). A batch with very many urls is counted in parts.
    """
    named = lambda c: F.regexp_replace(F.lower(F.regexp_replace(host_of(F.when(F.contains(c, F.lit("://")), c).otherwise(F.concat(F.lit("x://"), c))), r"\.$", "")), r":\d*$", "")
    declared = batches.select("batch", named(F.col("host")).alias("__host"))
    rows = urls.join(declared, "batch").withColumn("__own", named(F.col("url")))
    foreign = ~((F.col("__own") == F.col("__host")) | F.endswith("__own", F.concat(F.lit("."), F.col("__host"))))
    counted = rows.groupBy("batch").agg(F.count("*").alias("urls"), F.count_if(F.coalesce(foreign, F.lit(True))).alias("foreign"), F.count_if(~F.coalesce(is_fetchable_url("url"), F.lit(False))).alias("refused"))
    n = F.coalesce("urls", F.lit(0))
    size = F.length(F.coalesce("key", F.lit("")))
    problem = F.when(n == 0, "empty").when(n > MOST_SUBMITTED, "too-many").when(~size.between(*KEY_LENGTH), "bad-key").when(F.col("foreign") > 0, "foreign-url").when(F.col("refused") > 0, "refused-url")
    return batches.join(counted, "batch", "left").select("batch", n.alias("urls"), problem.alias("problem"))


def report_verdict(issues: DataFrame, reports: DataFrame) -> DataFrame:
    """(report, verdict): FAIL with an error, REVIEW with a warning, else PASS."""
    worst = issues.groupBy("report").agg(F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)).alias("w"))
    return reports.join(worst, "report", "left").select("report", F.when(F.col("w") == 2, "FAIL").when(F.col("w") == 1, "REVIEW").otherwise("PASS").alias("verdict"))


# Capabilities that a commerce profile may name.
CAPABILITIES = tuple(f"dev.ucp.shopping.{x}" for x in ("checkout", "fulfillment", "discount", "cart", "catalog", "order", "returns"))


def profile_issues(payload: str | None) -> dict:
    """Structure of a capability profile: validity, version, issues, unknown capabilities."""
    out: dict = {"valid_json": False, "version": None, "issues": [], "unknown_capabilities": []}
    try:
        data = json.loads(payload or "")
    except ValueError:
        out["issues"].append("invalid-json")
        return out
    if not isinstance(data, dict):
        out["issues"].append("profile-not-object")
        return out
    out["valid_json"] = True
    version, merchant, capabilities = data.get("version"), data.get("merchant"), data.get("capabilities")
    if isinstance(version, str):
        out["version"] = version
    else:
        out["issues"].append("missing-version" if version is None else "version-not-string")
    if not isinstance(merchant, dict):
        out["issues"].append("missing-merchant" if merchant is None else "merchant-not-object")
    elif not merchant.get("name"):
        out["issues"].append("merchant-name-empty")
    if not isinstance(capabilities, list):
        out["issues"].append("missing-capabilities" if capabilities is None else "capabilities-not-array")
        return out
    for k, c in enumerate(capabilities):
        if not isinstance(c, dict):
            out["issues"].append(f"capability-{k}-not-object")
            continue
        out["issues"] += [f"capability-{k}-missing-{field}" for field in ("id", "version", "endpoint") if not c.get(field)]
        if c.get("id") and c["id"] not in CAPABILITIES:
            out["unknown_capabilities"].append(c["id"])
    return out


@F.pandas_udf(struct("valid_json boolean, version string, issues strings, unknown_capabilities strings"))
def check_profile(payloads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([profile_issues(p) for p in payloads])
