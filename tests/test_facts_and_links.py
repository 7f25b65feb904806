"""Facts, drift, links, clusters, sinks and streams on small fixtures; all queries run on the smallest tables."""

import json

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import values
from pagequarry.operators import clusters, drift, links, metrics
from pagequarry.plans import registry
from pagequarry.sources import readers, sinks
from pagequarry.streaming import monitors


def test_medians_and_quartiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", None)], "g string, price double").withColumns({"rating": F.lit(0.0), "reviews": F.lit(2)})
    a = metrics.price_statistics(df, ["g"], "price").where("g = 'a'").first()
    assert (a.p25, a.median, a.p75, a["count"]) == (1.75, 2.5, 4.75, 4)
    s = {r.g: r for r in metrics.search_summary(df, ["g"], "price", "rating", "reviews").collect()}
    assert s["a"].price_median == 3.0 and s["a"].avg_rating is None and s["b"].price_median is None


@pytest.mark.parametrize("series,trend", [([100.0] * 7, "insufficient_data"), ([100.0] * 4 + [104.0] * 4, "stable"), ([100.0] * 4 + [106.0] * 4, "degrading"), ([100.0] * 4 + [None] + [90.0] * 4, "improving"), ([0.0] * 4 + [5.0] * 4, "stable")])
def test_trends(spark, series, trend):
    df = spark.createDataFrame([("u", k, v) for k, v in enumerate(series)], "url string, week int, p75 double")
    assert metrics.trends(df, ["url"], "week", "p75").first().trend == trend


def test_spend_guard_and_risk(spark):
    costs = spark.createDataFrame([("serp", 0.1), ("big", 0.6)], "endpoint string, cost double")
    calls = spark.createDataFrame([("serp", 0.0), ("big", 0.0), ("big", 9.9), ("other", 0.0), ("serp", 9.95)], "endpoint string, spent_before double")
    got = [r.status for r in metrics.spend_guard(calls, costs, 10.0, 0.5).orderBy("endpoint", "spent_before").collect()]
    assert got == ["needs_approval", "blocked", "needs_approval", "approved", "blocked"]
    ages = spark.createDataFrame([(1.0, True), (3.0, True), (6.0, True), (1.0, False), (0.5, False), (None, True), (None, None)], "age double, shift boolean")
    assert [r.r for r in ages.select(metrics.domain_risk(F.col("age"), F.col("shift")).alias("r")).collect()] == ["high", "medium", "high", "low", "unknown", "medium", "unknown"]


def test_totals_prefer_the_source(spark):
    detail = spark.createDataFrame([(0, 500), (0, 428)], "clicks long, impressions long")
    total = spark.createDataFrame([(24, 2734)], "clicks long, impressions long")
    a, b = metrics.site_totals(detail, total).first(), metrics.site_totals(detail, None).first()
    assert (a.clicks, a.impressions, a.totals_source) == (24, 2734, "aggregate")
    assert (b.impressions, b.totals_source, b.totals_complete, b.ctr) == (928, "partial_row_sum", False, 0.0)


def test_values(spark):
    df = spark.createDataFrame([("$1,299.00", "usd", "In stock"), ("abc", "$", "OutOfStock"), (None, None, None)], "p string, c string, a string")
    got = [tuple(r) for r in df.select(values.price(F.col("p")), values.currency(F.coalesce("c", F.lit(""))), values.availability(F.col("a"))).collect()]
    assert got == [(1299.0, "USD", "in_stock"), (None, "USD", "out_of_stock"), (None, "USD", "unknown")]
    dates = spark.createDataFrame([("2020-01-02T03:04:05Z",), ("02-Jan-2020",), ("2020.01.02",), ("soon",)], "d string")
    assert [str(r.d) for r in dates.select(values.parsed_date(F.col("d")).alias("d")).collect()] == ["2020-01-02"] * 3 + ["None"]


def test_scores_need_enough_factors(spark):
    df = spark.createDataFrame([(80.0, None, 60.0), (None, None, 50.0)], "a double, b double, c double")
    got = metrics.weighted_score(df, {"a": 0.5, "b": 0.3, "c": 0.2}, 2).collect()
    assert (got[0].score, got[0].factors) == (74.29, 2) and got[1].score is None


def snapshot(spark, **changes):
    base = {
        "url_hash": "h", "url": "u", "id": 1, "title": "Title", "meta_description": "About", "robots": "index", "canonical": "c", "h1": "Red shoes for running", "h1_count": 1, "h2": ["a", "b"],
        "schema": ['{"@type": "https://schema.org/Article"}'], "open_graph": {"og:title": "x"}, "status_code": 200, "html_hash": "x" * 64, "performance_score": 90.0, "p75": {"url_largest_contentful_paint": 2000.0},
    }
    schema = drift.SNAPSHOT.replace("captured_at timestamp, ", "")
    return spark.createDataFrame([tuple((base | changes)[c.split()[0]] for c in schema.split(", ") if c.split()[0] in base)], schema)


@pytest.mark.parametrize(
    "changes,rules",
    [
        ({}, set()),
        ({"schema": []}, {"schema_removed"}),
        ({"canonical": ""}, {"canonical_changed", "canonical_removed"}),
        ({"canonical": None}, {"canonical_removed"}),
        ({"robots": "NoIndex"}, {"noindex_added"}),
        ({"h1": None, "h1_count": 0}, {"h1_removed"}),
        ({"h1": "zzzz"}, {"h1_changed"}),
        ({"h1": "Red shoes for walking"}, set()),
        ({"title": ""}, {"title_removed"}),
        ({"title": "Title "}, set()),
        ({"title": "Other"}, {"title_changed"}),
        ({"meta_description": "Else"}, {"meta_description_changed"}),
        ({"status_code": 400}, {"status_code_error"}),
        ({"status_code": 399}, set()),
        ({"p75": {"largest_contentful_paint": 2400.0}}, set()),
        ({"p75": {"origin_largest_contentful_paint": 2401.0}}, {"cwv_regressed"}),
        ({"performance_score": 80.0}, {"perf_score_dropped"}),
        ({"performance_score": 81.0}, set()),
        ({"open_graph": {}}, {"og_tags_removed"}),
        ({"schema": ['{"@type": "https://schema.org/Article", "name": "n"}']}, {"schema_modified"}),
        ({"h2": ["b", "a"]}, {"h2_structure_changed"}),
        ({"html_hash": "y" * 64}, {"content_hash_changed"}),
    ],
)
def test_drift_rules(spark, changes, rules):
    found = drift.compare(snapshot(spark, **changes), snapshot(spark)).where("triggered").collect()
    assert {r.rule for r in found} == rules


def test_drift_takes_the_latest_and_knows_retired_types(spark):
    old = snapshot(spark, id=1, title="Old").union(snapshot(spark, id=2, schema=['{"@type": "FAQPage"}']))
    found = {r.rule: r for r in drift.compare(snapshot(spark, schema=[]), old).where("triggered").collect()}
    assert set(found) == {"schema_removed"} and found["schema_removed"].severity == "WARNING" and found["schema_removed"].baseline_id == 2
    assert drift.summary(drift.compare(snapshot(spark, schema=[]), old)).first().status == "WARNING"
    assert drift.without_baseline(snapshot(spark, url_hash="new"), old).count() == 1
    assert "WARNING" in sinks.drift_report(drift.compare(snapshot(spark, schema=[]), old))


def test_backlinks(spark):
    pages = spark.createDataFrame([("s1", 200, False), ("s2", 200, True), ("s3", 404, False), ("s4", 200, False)], "url string, status_code int, script_rendered boolean")
    found = spark.createDataFrame([("s1", 0, "https://blog.t.example/x", " a ", ["nofollow"]), ("s1", 1, "https://T.example/p/?q=1", "b", []), ("s4", 0, "https://nott.example/", "c", [])], "page_url string, pos int, href string, text string, rel array<string>")
    targets = spark.createDataFrame([("s1", "https://t.example/p"), ("s1", "https://blog.t.example/other"), ("s2", "https://t.example/p"), ("s3", "https://t.example/p"), ("s4", "https://t.example/p"), ("s9", "https://t.example/p")], "source_url string, target_url string")
    got = {(r.source_url, r.target_url[8:12]): (r.status, r.match_type) for r in links.verify_backlinks(pages, found, targets).collect()}
    assert got == {
        ("s1", "t.ex"): ("verified", "subdomain_match"), ("s1", "blog"): ("verified", "domain_match"), ("s2", "t.ex"): ("unverifiable_js", None), ("s3", "t.ex"): ("source_unavailable", None),
        ("s4", "t.ex"): ("link_removed", None), ("s9", "t.ex"): ("error", None),
    }


def test_hreflang(spark):
    tags = spark.createDataFrame([("a", "en", "a"), ("a", "de", "b"), ("b", "de", "b"), ("c", "fr", "a")], "page_url string, lang string, href string")
    assert {(r.page_url, r.href, r.problem) for r in links.return_tags(tags).collect()} == {("a", "b", "missing-return-tag"), ("c", "a", "missing-return-tag"), ("c", None, "missing-self-reference")}
    codes = spark.createDataFrame([("en",), ("en-GB",), ("x-default",), ("zh-Hans-CN",), ("es-419",), ("eng",), ("en-uk",), ("EU",), ("english",)], "l string")
    assert [r.p for r in codes.select(links.code_problem(F.col("l")).alias("p")).collect()] == [None] * 5 + ["invalid-code"] * 3 + ["malformed-code"]


def test_overlap_bands_and_clusters(spark):
    rows = [("a", f"u{k}") for k in range(10)] + [("b", f"u{k}") for k in range(6, 16)] + [("c", f"u{k}") for k in range(12, 22)] + [("d", "u0"), ("d", "z")]
    results = spark.createDataFrame(rows, "keyword string, url string")
    overlap = clusters.result_overlap(results)
    assert {(r.k1, r.k2): (r.shared, r.band) for r in overlap.collect()} == {("a", "b"): (4, "same-cluster"), ("b", "c"): (4, "same-cluster"), ("a", "d"): (1, "separate")}
    assert {r.keyword: r.cluster for r in clusters.keyword_clusters(results, overlap).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def by_sql(sql, sf):
    import re

    import duckdb

    con = duckdb.connect()
    for name in ("lineitem", "orders", "part", "supplier", "customer"):
        if re.search(rf"\b{name}\b", sql):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con.execute(sql).fetchall()


@pytest.mark.parametrize("name", ["g04_clicks_whole", "g05_orphans_whole", "j12_return_tags_whole", "j15_result_overlap_whole", "j18_within_radius_whole"])
def test_whole_tables_match_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    got, wanted = registry.QUERIES[name](spark, sf).collect(), by_sql(registry.ORACLE_SQL[name], sf)
    key = lambda row: tuple(str(v) for v in row[:2])
    assert [tuple(r)[:2] for r in sorted(got, key=key)] == [r[:2] for r in sorted(wanted, key=key)]
    for a, b in zip(sorted(got, key=key), sorted(wanted, key=key), strict=True):
        assert tuple(a) == pytest.approx(b, abs=2e-4) if name.startswith("j18") else tuple(a) == b


def test_keyword_clusters_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    urls = {}
    for k, u in by_sql("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem", sf):
        urls.setdefault(k, set()).add(u)
    label = {k: k for k in urls}
    for _ in urls:
        for a in urls:
            for b in urls:
                if len(urls[a] & urls[b]) >= clusters.SAME_CLUSTER:
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.keyword: r.cluster for r in registry.QUERIES["g03_keyword_clusters"](spark, sf).collect()} == label


def test_overlap_of_frequent_urls_and_groups(spark):
    n = 3 * clusters.PAIR_BLOCK
    results = spark.range(n).select(F.col("id").alias("keyword"), F.lit("u").alias("url"))
    overlap = clusters.result_overlap(results)
    assert overlap.agg(F.count("*"), F.min("shared"), F.max("shared"), F.count_if(F.expr("k1 < k2"))).first() == (n * (n - 1) // 2, 1, 1, n * (n - 1) // 2)
    grouped = spark.createDataFrame([("a", "u", "x"), ("b", "u", "x"), ("a", "u", "y"), ("b", "u", "y"), ("c", "u", "y")], "keyword string, url string, g string")
    assert sorted((r.k1, r.k2, r.shared) for r in clusters.result_overlap(grouped, "g").collect()) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1)]


def test_clusters_of_a_long_chain(spark):
    chain = [1, *range(42, 1, -1)]
    overlap = spark.createDataFrame([(min(a, b), max(a, b), 4) for a, b in zip(chain, chain[1:], strict=False)], "k1 long, k2 long, shared long")
    keywords = spark.createDataFrame([(k,) for k in [*chain, 99]], "keyword long")
    assert {r.keyword: r.cluster for r in clusters.keyword_clusters(keywords, overlap).collect()} == {**dict.fromkeys(chain, 1), 99: 99}


def test_readers(spark, tmp_path):
    body = json.dumps({"tasks": [{"status_code": 20000, "result": [{"items": [{"title": "x"}, {"title": "y"}]}, None]}, {"status_code": 40000, "result": [{"items": [{"title": "z"}]}]}, {"status_code": 20000, "result": None}]})
    assert [r.item.title for r in readers.envelope_items(spark.createDataFrame([(1, body)], "id long, body string"), "struct<title:string>").collect()] == ["x", "y"]
    (tmp_path / "feed.json").write_text(json.dumps({"updates": [{"date": "2024-03-05", "name": "a", "kind": "core"}, {"date": "2024-03-05", "name": "b", "kind": "spam"}, {"date": "2023-01-01", "name": "c", "kind": "core"}]}))
    feed = readers.update_feed(spark, str(tmp_path / "feed.json"))
    assert [r.name for r in readers.updates_since(feed, "2024").collect()] == ["a", "b"] and [r.name for r in readers.updates_since(feed, None, ["core"]).collect()] == ["a", "c"]
    (tmp_path / "plan.csv").write_text("prompt,ratio\nhello,\n  ,1:1\n")
    good, bad = readers.batch_plan(spark, str(tmp_path / "plan.csv"))
    assert [tuple(r) for r in good.collect()] == [("hello", "16:9", "1K", "default")] and bad.count() == 1
    (tmp_path / "ranks.tsv").write_text("#h\n1\t9.5\t2\t0.1\tcom.example\t3\n")
    ranks = readers.domain_ranks(spark, str(tmp_path / "ranks.tsv"))
    assert [(r.domain, r.in_rankings) for r in readers.authority(ranks, spark.createDataFrame([("example.com",), ("x.org",)], "domain string")).orderBy("domain").collect()] == [("example.com", True), ("x.org", False)]


def test_sinks(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 2.345, "a|b")], "k int, v double, s string")
    assert sinks.markdown_table(df, most=1).splitlines()[2:] == ["| 1 | 2 | -- |", "", "_Shown: the first 1 rows._"]
    parts = sinks.sitemap_parts(spark.range(60_000).select(F.lit("h").alias("host"), F.concat(F.lit("https://h.example/"), F.col("id")).alias("url")))
    assert {r.part: r.n for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()} == {0: 50_000, 1: 10_000}
    findings = spark.createDataFrame([("s", "technical", "High", "m1"), ("s", "technical", "Critical", "m0")], "site string, category string, severity string, message string")
    envelope = json.loads(sinks.audit_envelope(findings, spark.createDataFrame([("s", 71.5)], "site string, score double")).first().envelope)
    assert envelope["summary"]["critical"] == 1 and [f["message"] for f in envelope["categories"][0]["findings"]] == ["m0", "m1"]


def run_stream(spark, df, build, name, mode="append"):
    query = build(df).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "x", 1.0), (1, "2024-01-01 00:10:00", "x", 2.0), (1, "2024-01-01 02:00:00", "y", 4.0), (2, "2024-01-09 00:00:00", "x", 1.0)]
    spark.createDataFrame(rows, "user_id long, t string, event_type string, value double").select("user_id", F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("user_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    spend = run_stream(spark, source(), monitors.spend_per_day, "spend", "complete")
    assert sorted((str(r.day), r.endpoint, r.cost) for r in spend.collect()) == [("2024-01-01", "x", 3.0), ("2024-01-01", "y", 4.0), ("2024-01-09", "x", 1.0)]
    sessions = run_stream(spark, source(), monitors.activity_sessions, "sessions", "append")
    assert sorted((r.user_id, r.events) for r in sessions.collect()) == [(1, 1), (1, 2)]
    assert monitors.activity_sessions(spark.read.parquet(str(tmp_path / "in"))).count() == 3


def test_drift_stream(spark, tmp_path):
    rows = [("h", 1, "a", "x"), ("h", 2, "b", "x"), ("h", 1, "zzz", "q"), ("g", 1, "t", "x")]
    spark.createDataFrame(rows, "url_hash string, version long, title string, html_hash string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("url_hash string, version long, title string, html_hash string").parquet(str(tmp_path / "in"))
    got = run_stream(spark, source, monitors.drift_monitor, "changes").collect()
    assert [(r.url_hash, r.version, r.changed, r.old_value, r.new_value) for r in got] == [("h", 2, "title", "a", "b")]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_query_has_a_stable_schema(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns == list(dict.fromkeys(df.columns)) and df.limit(1).count() <= 1


def test_entry_survives_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(entry)
        assert set(bare.queries()) == set(registry.QUERIES) and set(bare.oracle_sql()) <= set(bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
