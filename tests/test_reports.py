"""Saved speed responses, report claims, submissions, traffic, scorecards and concentration on small fixtures."""

import json

from pyspark.sql import functions as F

from pagequarry.operators import clusters, html, links, metrics, site_rules
from pagequarry.sources import speed


def test_lab_runs(spark):
    run = {
        "analysisUTCTimestamp": "2026-01-01T00:00:00Z",
        "lighthouseResult": {
            "categories": {"performance": {"score": 0.425}, "seo": {"score": None}},
            "audits": {
                "largest-contentful-paint": {"numericValue": 2512.5, "displayValue": "2.5 s", "score": 0.91}, "interactive": {"score": 0.2}, "unused-css-rules": {"score": 0.3, "details": {"type": "opportunity", "overallSavingsMs": 300}},
                "uses-http2": {"score": 0.3, "details": {"type": "opportunity", "overallSavingsMs": 0}}, "manual": {"score": None},
            },
        },
        "loadingExperience": {"metrics": {"CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 12, "category": "AVERAGE"}, "LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 2100, "category": "FAST"}, "OTHER": {"percentile": 1}}},
        "originLoadingExperience": {"metrics": {"INTERACTION_TO_NEXT_PAINT": {"category": "SLOW"}, "CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 1}}},
    }
    runs = speed.lab_runs(spark.createDataFrame([("a", json.dumps(run)), ("b", "no json"), ("c", None), ("d", "{}")], "url string, body string"))
    assert {tuple(x) for x in speed.lab_scores(runs, ["url"]).collect()} == {("a", "performance", 42), ("a", "seo", 0)}
    assert {(x.audit, x.kind, x.value) for x in speed.lab_audits(runs, ["url"]).collect()} == {
        ("largest-contentful-paint", "metric", 2512.5), ("largest-contentful-paint", "passed", None), ("interactive", "failed", None), ("unused-css-rules", "opportunity", 300.0), ("uses-http2", "failed", None)
    }
    assert {tuple(x)[1:] for x in speed.lab_field_metrics(runs, ["url"]).collect()} == {
        ("url", "cumulative_layout_shift", 0.12, "average"), ("url", "largest_contentful_paint", 2100.0, "fast"), ("origin", "cumulative_layout_shift", 1.0, "none")
    }


def test_field_data_of_a_url_or_its_origin(spark):
    def body(lcp, cls="0.08"):
        period = {"firstDate": {"year": 2026, "month": 1, "day": 2}, "lastDate": {"year": 2026, "month": 1, "day": 29}}
        metric = lambda v: {"percentiles": {"p75": v}, "histogram": [{"density": 0.71234}, {"density": 0.2}, {}]}
        return json.dumps({"record": {"collectionPeriod": period, "metrics": {"largest_contentful_paint": metric(lcp), "cumulative_layout_shift": {"percentiles": {"p75": cls}}, "empty": {}, "round_trip_time": metric(90)}}})

    rows = [("https://a/x", 200, body(2500)), ("https://a", 200, body(9000)), ("https://a/y", 404, None), ("https://b/z", 404, None), ("https://b", 404, None), ("https://a/limit", 429, None), ("https://c/1", 404, None), ("https://c", 200, body(4000.5, "bad"))]
    got = speed.field_or_origin(spark.createDataFrame([(u,) for u in ("https://a/x", "https://a/y", "https://b/z", "https://a/limit", "https://c/1", "https://c/2", None)], "url string"), spark.createDataFrame(rows, "target string, status_code int, body string")).collect()
    assert {(x.url, x.level, x.label, x.p75, x.rating) for x in got if x.label in ("LCP", "CLS")} == {
        ("https://a/x", "url", "LCP", 2500.0, "good"), ("https://a/x", "url", "CLS", 0.08, "good"), ("https://a/y", "origin", "LCP", 9000.0, "poor"), ("https://a/y", "origin", "CLS", 0.08, "good"),
        ("https://c/1", "origin", "LCP", 4000.5, "poor"), ("https://c/1", "origin", "CLS", 0.0, "good"),
    }
    one = next(x for x in got if x.url == "https://a/x" and x.label == "LCP")
    assert (one.good_pct, one.needs_improvement_pct, one.poor_pct, str(one.first_day), str(one.last_day)) == (71.2, 20.0, 0.0, "2026-01-02", "2026-01-29")
    assert {x.rating for x in got if x.metric == "round_trip_time"} == {"unknown"}


def test_report_claims(spark):
    blocks = [("r", k, b) for k, b in enumerate(["[]", "nothing", None, '{"@graph":[]}', '{"a":1}', "{}", '{"@type":"HowTo"}', '{"@type":["HowTo"]}', '{"@type":"Product","@graph":1}'])]
    got = {x.field: (x.severity, x.detail) for x in site_rules.schema_claims(spark.createDataFrame(blocks, "report string, pos int, block string")).collect()}
    odd, bare = ("warning", "not-an-object"), ("warning", "missing-type")
    assert got == {"schema[0]": odd, "schema[1]": odd, "schema[2]": odd, "schema[3]": ("error", "unflattened-graph"), "schema[4]": bare, "schema[5]": bare, "schema[6]": ("error", "howto")}
    headings = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), ("c", None)], "report string, suspicious boolean")
    assert [x.report for x in site_rules.heading_claims(headings).collect()] == ["a"]
    crawl = spark.createDataFrame([("a", False, False), ("b", True, False), ("c", True, True), ("d", None, False)], "report string, in_crawl boolean, in_rankings boolean")
    assert {(x.report, x.detail) for x in site_rules.crawl_claims(crawl).collect()} == {("a", "not-crawled"), ("b", "below-threshold")}
    out = spark.createDataFrame([("a", "https://www.X.example/1"), ("a", "https://y.example"), ("a", None), ("b", "https://x.example")], "report string, href string")
    back = spark.createDataFrame([("a", "http://x.example/b", "verified"), ("a", "http://y.example", "link_removed"), ("c", "http://x.example", "verified")], "report string, source_url string, status string")
    assert [(x.report, x.detail) for x in site_rules.reciprocal_claims(out, back).collect()] == [("a", "x.example")]


def test_submission_problems(spark):
    batches = spark.createDataFrame([(b, "Example.com.", k) for b, k in (("ok", "k" * 8), ("none", "k" * 8), ("key", "short"), ("key2", "k" * 129), ("host", "k" * 8), ("near", "k" * 8), ("ip", "k" * 8), ("many", "k" * 8))], "batch string, host string, key string")
    urls = [("ok", "https://example.com/a"), ("ok", "https://www.EXAMPLE.com:443/b"), ("key", "https://example.com/"), ("key2", "https://example.com/"), ("host", "https://example.com/"), ("host", "https://example.org/"), ("near", "https://notexample.com/"), ("ip", "ftp://example.com/")]
    many = spark.range(10_001).select(F.lit("many").alias("batch"), F.concat(F.lit("https://example.com/"), F.col("id").cast("string")).alias("url"))
    got = {x.batch: x.problem for x in site_rules.submission_problems(batches, spark.createDataFrame(urls, "batch string, url string").union(many)).collect()}
    assert got == {"ok": None, "none": "empty", "key": "bad-key", "key2": "bad-key", "host": "foreign-url", "near": "foreign-url", "ip": "refused-url", "many": "too-many"}


def test_traffic_scorecard_and_concentration(spark):
    facts = spark.createDataFrame([("Organic Search", "x", 3, 2, 1, 2), ("Organic Search", "x", 1, 1, 0, 0), ("Organic Search", "y", 0, 0, 0, 0), ("Direct", "x", 9, 9, 9, 9)], "channel string, page string, sessions long, users long, bounced long, engaged long")
    assert {tuple(x) for x in metrics.traffic_by(facts, ["page"]).collect()} == {("x", 4, 3, 25.0, 50.0), ("y", 0, 0, None, None)}
    assert [x.page for x in metrics.traffic_by(facts, ["page"], most=1).collect()] == ["x"]
    posts = [("p", "c", True, True, "k", 1000, 1), ("a", "c", False, True, "A ", 500, 0), ("b", "c", False, True, "a", 700, 2), ("z", "c", False, False, "a", 0, 0), ("q", "d", True, True, None, 10, 0), ("w", "e", True, False, "w", None, None)]
    edges = [("p", "a"), ("a", "p"), ("a", "p"), ("p", "p"), ("q", "p"), ("z", "p"), ("p", "nowhere")]
    got = {x.cluster: tuple(x)[1:] for x in clusters.plan_scorecard(spark.createDataFrame(posts, "url string, cluster string, is_pillar boolean, written boolean, primary_keyword string, words int, images int"), spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("p", "a"), ("b", "q"), ("q", "p")], "src string, dst string")).collect()}
    assert got == {"c": (75.0, 1, 1.0, 1, 50.0, 50.0, 50.0, 2, 66.7, 733.3), "d": (100.0, 0, 0.0, 1, None, None, 100.0, 0, 0.0, 10.0), "e": (0.0, 1, None, 0, None, None, None, 0, None, None)}
    rows = [("s", d, n) for d, n in [("a", True)] * 3 + [("b", False)] * 3 + [(None, None)] * 4] + [("t", f"d{k}", False) for k in range(30)] + [("u", f"d{k % 15}", False) for k in range(30)]
    got = {x.site: tuple(x)[1:] for x in links.concentration(spark.createDataFrame(rows, "site string, domain string, nofollow boolean"), "site").collect()}
    assert got == {"s": (10, 3, None, 40.0, "critical", 70.0), "t": (30, 30, "d0", 3.33, None, 100.0), "u": (30, 15, "d0", 6.67, "watch", 100.0)}


def test_text_of_open_elements():
    page = html.parse_page("<title> T x</title><h1>One <i>two</i><h2>three</h2></h1>" + "<div>" * 3000 + "<a href='/x'>go <b>on</b></a>deep", "https://a/")
    assert (page["title"], page["h1"], page["h2"]) == ("T x", ["One twothree"], ["three"])
    assert page["links_internal"] == [{"href": "https://a/x", "text": "go on", "rel": []}]
