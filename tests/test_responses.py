"""Readers of responses, stores, detection and velocities on small fixtures."""

from pyspark.sql import functions as F

from pagequarry.operators import detection, drift, metrics
from pagequarry.sources import readers, responses, store


def test_responses_of_no_use(spark):
    rows = spark.createDataFrame([(1, None), (2, "{"), (3, "{}"), (4, '{"results": null}')], "id int, body string")
    for read in (responses.sitemap_status, responses.properties, responses.linking_domains, responses.anchor_texts, responses.top_pages, responses.entities, responses.sentiments, responses.moderation, responses.categories):
        assert read(rows).count() == 0
    assert [(r.id, r.links, r.domain_authority) for r in responses.url_metrics(rows).orderBy("id").collect()] == [(k, 0, None) for k in (1, 2, 3, 4)]
    assert {r.verdict for r in responses.inspections(rows).collect()} == {"VERDICT_UNSPECIFIED"}


def test_inspection_details(spark):
    body = """{"inspectionResult": {"indexStatusResult": {"verdict": "PASS", "googleCanonical": "a", "userCanonical": ""},
        "mobileUsabilityResult": {"verdict": "FAIL", "issues": [{"issueType": "TAP", "message": "m"}]},
        "richResultsResult": {"verdict": "PASS", "detectedItems": [{"richResultType": "FAQ", "items": [{"name": "n"}]}]}}}"""
    r = responses.inspections(spark.createDataFrame([(body, None), (None, "denied")], "body string, error string")).collect()
    assert (r[0].verdict, r[0].canonical_match, r[0].mobile_issues[0].issueType, r[0].rich_items[0].type, r[0].referring_urls) == ("PASS", None, "TAP", "FAQ", [])
    assert (r[1].verdict, r[1].error, r[1].mobile_verdict) == (None, "denied", None)
    asked = spark.createDataFrame([("p", 0, "u"), ("p", 1, " "), ("p", 2, "v"), ("q", 0, "w")], "property string, pos int, url string")
    assert sorted(x.url for x in responses.within_quota(asked, quota=2).collect()) == ["u", "w"]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    assert store.snapshots(spark, path).count() == 0
    pages = spark.createDataFrame([("h", "t", 200), ("g", None, None)], "url_hash string, title string, status_code int")
    store.append_snapshots(pages, path)
    store.append_snapshots(pages.withColumn("title", F.lit("new")), path)
    stored = store.snapshots(spark, path)
    ids = {r.url_hash: r.ids for r in stored.groupBy("url_hash").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()}
    assert len({x for v in ids.values() for x in v}) == 4 and max(v[0] for v in ids.values()) < min(v[1] for v in ids.values())
    first = drift.chosen(stored, spark.createDataFrame([("h", ids["h"][0]), ("h", 10**12)], "url_hash string, id long"))
    assert [r.title for r in first.collect()] == ["t"]
    where = str(tmp_path / "comparisons")
    store.append_comparisons(drift.compare(drift.latest(stored), first), where)
    assert [(r.url_hash, r.critical, r.warning) for r in store.comparisons(spark, where).collect()] == [("h", 0, 1)]


def test_ledger_stream_appends_each_entry_once(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "serp", 0.5, "x"), ("2024-01-02 10:00:00", "serp", 0.25, None)], "t string, endpoint string, cost double, detail string").select(F.col("t").cast("timestamp").alias("timestamp"), "endpoint", "cost", "detail")
    source, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    rows.write.parquet(source)
    for _ in range(2):
        store.ledger_stream(spark.readStream.schema(rows.schema).parquet(source), path, str(tmp_path / "check")).awaitTermination(60)
    assert sorted((str(r.day), r.cost) for r in store.ledger(spark, path).collect()) == [("2024-01-01", 0.5), ("2024-01-02", 0.25)]


def test_page_types_of_markup(spark):
    pages = {
        "Local": "<address>x</address><iframe src='https://google.com/maps/embed?x'>", "Comparison": "<table></table> A vs B", "Product": "<b itemprop='price'>1</b><button>Add to cart</button>",
        "Landing Page": "<a >Get started</a><b>Sign up</b><b>Buy now</b>", "Service Page": "Our process <h2>Case studies</h2>", "Hybrid": "A guide. <b>Subscribe</b>" + "<a href=x>" * 11, "Blog Post": "words",
    }
    df = spark.createDataFrame([*pages.items(), ("Blog Post", None)], "name string, html string")
    assert all(r.name == r.t for r in df.select("name", detection.page_type(detection.page_type_signals(F.col("html"))).alias("t")).collect())


def test_business_types_and_trades(spark):
    pages = spark.createDataFrame([("a", "/docs/x", "sign up"), ("a", "/docs", None), ("a", "/Blog", ""), ("b", None, None)], "site string, path string, text string")
    assert [tuple(r) for r in detection.business_type(pages).collect()] == [("a", "SaaS", 2, "Publisher", False)]
    trade = spark.createDataFrame([("x", "/menu", "Our lawyer and attorney serve takeout")], "site string, path string, text string")
    assert [tuple(r) for r in detection.business_type(trade, detection.TRADE_SIGNALS).collect()] == [("x", "Restaurant", 2, "Legal", True)]


def test_link_velocity(spark):
    days = ["2024-01-01", "2024-01-08", "2024-03-04"] + ["2024-08-05"] * 12
    df = spark.createDataFrame([("t", "com", d, None if k else "2024-02-02") for k, d in enumerate(days)], "target string, tld string, f string, l string")
    links = df.select("target", "tld", F.col("f").cast("timestamp").alias("first_seen"), F.col("l").cast("timestamp").alias("lost_at"))
    got = sorted((r.flag, str(r.period), r.n) for r in detection.link_velocity(links, F.lit("2024-09-30").cast("date")).collect())
    # 31 weeks before the last one had 3 links
    assert got == [("losses", "2024-02-01", 1), ("quiet", "2024-04-01", 4), ("same-tld", "2024-08-05", 12), ("spike", "2024-08-05", 12)]


def test_reviews_and_prices(spark):
    df = spark.createDataFrame([("b", 5.0, "2024-01-01", True), ("b", 4.0, "2024-01-30", None), ("b", None, "2024-02-05", False)], "business string, rating double, t string, answered boolean").withColumn("ts", F.col("t").cast("timestamp"))
    r = detection.review_velocity(df, F.lit("2024-02-10").cast("date")).first()
    assert (r.reviews, r.per_month, round(r.response_rate, 3), r.stars_5, r.stars_4, r.longest_gap, r.ranking_risk) == (3, 0.5, 0.333, 0.5, 0.5, 29, True)
    items = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 3.0), ("g", None, 9.0), ("h", 1.0, 1.0)], "g string, p double, r double")
    assert {x.g: (x.n, x.correlation) for x in detection.price_rating(items, ["g"], "p", "r").collect()} == {"g": (2, 1.0), "h": (1, None)}


def test_locale_markers_leave_english_alone(spark):
    df = spark.createDataFrame([(1, "en-GB", "Walmart CCPA $5"), (2, "de-DE", "Preis: 5 miles, US$ 3, Read more"), (3, "ja", None), (4, None, "CCPA")], "page_id int, lang string, text string")
    assert sorted((r.page_id, r.marker, r.n) for r in detection.locale_markers(df).collect()) == [(2, "currency-or-unit", 2), (2, "untranslated", 1)]


def test_image_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.JPG", "sub/b.webp", "c.txt", "noext"):
        (tmp_path / name).write_bytes(b"12")
    got = sorted((r.path.rsplit("/", 1)[-1], r.length, r.extension) for r in readers.image_files(spark, str(tmp_path)).collect())
    assert got == [("a.JPG", 2, ".jpg"), ("b.webp", 2, ".webp")]


def test_running_sums_over_split_keys(spark):
    texts = [(k, "x" * (k * 37 % 91)) for k in range(400)]
    upto, want = 0, []
    for k, t in texts:
        upto += len(t)
        if upto > 350:
            break
        want.append((k, upto))
    got = metrics.within_budget(spark.createDataFrame(texts, "k int, t string"), "k", "t", tokens=100, spread=5)
    assert sorted((r.k, r.upto_chars) for r in got.collect()) == want
    calls = [(k, f"2024-01-0{1 + k // 40} 10:0{k // 13 % 4}:{k % 13:02d}", 1.0 + k % 3) for k in range(80)] + [(99, None, 1.0)]
    ledger = spark.createDataFrame(calls, "event_id int, t string, cost double").withColumn("timestamp", F.col("t").cast("timestamp"))
    rows = {r.event_id: (r.spent_before, r.allowed) for r in metrics.budget_to_date(ledger, 30.0).collect()}
    for k, t, cost in calls[:-1]:
        before = sum(c for _, u, c in calls[:-1] if u[:10] == t[:10] and u < t)
        assert rows[k] == (before, before + cost <= 30.0)
    assert rows[99] == (0.0, True)
