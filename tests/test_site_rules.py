"""Site-wide rules on small fixtures."""

import json

from pyspark.sql import functions as F

from pagequarry.operators import site_rules


def test_locale_parity_and_freshness(spark):
    rows = [("p", "en", 5, 4, 2, 1000, "2024-03-01"), ("p", "de", 5, 4, 2, 1200, "2024-02-25"), ("p", "fr", 3, 1, 1, 900, "2023-11-01"), ("q", "en", 1, 0, 0, 100, "2024-01-01"), ("q", "de", 1, 0, 0, 200, "2024-02-01")]
    pages = spark.createDataFrame(rows, "page_key string, lang string, sections int, faq_items int, images int, words int, updated string").withColumn("updated", F.to_date("updated"))
    found = {(r.page_key, r.lang, r.problem) for r in site_rules.locale_parity(pages).collect()}
    assert found == {("q", "fr", "page-existence"), ("p", "fr", "sections"), ("p", "fr", "faq-items"), ("p", "fr", "images"), ("p", "fr", "word-ratio"), ("q", "de", "word-ratio")}
    assert {(r.page_key, r.lang): r.status for r in site_rules.freshness(pages).collect()} == {("p", "de"): "fresh", ("p", "fr"): "outdated", ("q", "de"): "fresh"}


def test_sitemap_quality(spark):
    rows = [("a", "http://x/1", "2024-01-01", 200, False, False, 0, None), ("a", "https://x/2", "2024-01-01", 301, True, True, 1001, None), ("b", "https://x/3", "2024-01-01", 200, False, False, 0, "2024-01-01")]
    entries = spark.createDataFrame(rows, "sitemap string, url string, lastmod string, status_code int, noindex boolean, has_ignored_tags boolean, images int, news_date string").withColumn("news_date", F.to_date("news_date"))
    files = spark.createDataFrame([("a", 60 * 1024 * 1024), ("b", 10)], "sitemap string, bytes long")
    found = {(r.sitemap, r.problem) for r in site_rules.sitemap_quality(entries, files, F.lit("2024-01-05").cast("date")).collect()}
    assert found == {("a", x) for x in ("too-large", "noindexed-urls", "redirected-urls", "http-urls", "too-many-images", "identical-lastmod", "ignored-tags")} | {("b", "old-news")}


def test_gates(spark):
    rows = [("city", 70.0, 500)] * 30 + [("swap", 20.0, 500)] * 3 + [("ok", 80.0, 200)]
    got = {r.template: (r.verdict, r.thin_pages) for r in site_rules.page_gates(spark.createDataFrame(rows, "template string, uniqueness_pct double, words int")).collect()}
    assert got == {"city": ("warning", 0), "swap": ("stop", 3), "ok": ("ok", 1)}


def test_report_issues(spark):
    results = spark.createDataFrame([("r", "https://www.facebook.com/x", "link_removed", 200), ("r", "https://a.example/", "verified", 200), ("s", "https://a.example/", "verified", 200)], "report string, source_url string, status string, http_status int")
    declared = spark.createDataFrame([("r", "link_removed", 1), ("r", "verified", 3), ("s", "verified", 1)], "report string, status string, count long")
    score = spark.createDataFrame([("r", 3, 71.0), ("s", 3, None)], "report string, factors_with_data int, score double")
    issues = site_rules.report_issues(results, declared, score)
    assert {(r.report, r.field) for r in issues.collect()} == {("r", "summary"), ("r", "verification"), ("r", "health_score")}
    assert {r.report: r.verdict for r in site_rules.report_verdict(issues, score.select("report")).collect()} == {"r": "FAIL", "s": "PASS"}


def test_profiles(spark):
    good = {"version": "1", "merchant": {"name": "m"}, "capabilities": [{"id": "dev.ucp.shopping.cart", "version": "1", "endpoint": "e"}]}
    df = spark.createDataFrame([(json.dumps(good),), ("[]",), ("{",), (json.dumps({**good, "capabilities": [{"id": "new"}, 3]}),)], "p string")
    got = [(r.x.valid_json, r.x.issues, r.x.unknown_capabilities) for r in df.select(site_rules.check_profile("p").alias("x")).collect()]
    assert got == [(True, [], []), (False, ["profile-not-object"], []), (False, ["invalid-json"], []), (True, ["capability-0-missing-version", "capability-0-missing-endpoint", "capability-1-not-object"], ["new"])]
