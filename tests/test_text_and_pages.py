"""Text quality, page trees and URLs on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.operators import html, schema_org, sections, text_quality
from pagequarry.sources import readers


def analysed(spark, text):
    return text_quality.analyse(spark.createDataFrame([(text,)], "text string")).first()


def test_empty_and_filler_texts(spark):
    for text in (None, "", "  \n"):
        r = analysed(spark, text)
        assert (r.flags, r.overall_quality, r.tokens) == (["empty-input"], 0, 0)
    padded = "It's important to note that in the world of search, at the end of the day, when it comes to content, let's dive in. Moreover, we delve into a rich tapestry of ideas. Ultimately, this is a testament to change."
    r = analysed(spark, padded)
    assert r.filler_score >= 50 and r.ai_pattern_score >= 40 and r.overall_quality < 40
    assert {"filler", "ai-patterns", "thin-content"} <= set(r.flags)


def test_dense_text_scores_higher(spark):
    dense = "In 2021 Acme Widgets shipped 4,200 units to Blue Harbor Logistics and 1,350 units to North Ridge Supply. Revenue grew 14% to 9.2 million. " * 4
    r = analysed(spark, dense)
    assert r.information_density > 0.2 and "filler" not in r.flags and r.entities >= 12


def test_repetition_counts_distinct_bigrams(spark):
    df = spark.createDataFrame([("a b a b c d",), ("one two three",), ("x x x x",)], "text string")
    got = [r.r for r in df.select(text_quality.repeated_bigrams(text_quality.tokens_of(F.col("text"))).alias("r")).collect()]
    assert got == [pytest.approx(1 / 4), 0.0, 1.0]


def test_uniqueness(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d d a")], "doc_id long, text string")
    assert {r.doc_id: r.uniqueness_pct for r in text_quality.uniqueness(df).collect()} == {1: 0.0, 2: 0.0, 3: 66.67}


@pytest.mark.parametrize(
    "tag,method",
    [
        ({"loading": "lazy", "data-src": "x"}, "native"), ({"loading": "eager"}, "none"), ({}, "none"), ({"data-perfmatters-src": "x"}, "perfmatters"),
        ({"class": "perfmatters-lazy", "data-src": "x"}, "perfmatters"), ({"data-ewww-src": "x"}, "ewww"), ({"data-lazy-src": "x"}, "js-generic"), ({"class": "a lazyloaded"}, "js-generic"),
    ],
)
def test_lazy_methods(tag, method):
    assert html.lazy_method(tag) == method


PAGE = """<html><head><title> A &amp; B </title><meta name="Description" content="first"><meta name="description" content="last"><meta property="OG:title" content="t">
<link rel="canonical" href="/c"><link rel="alternate" hreflang="de" href="/de"><script type="application/ld+json">{"@graph": [{"@type": "Article"}, 3]}</script><script type="application/ld+json">{bad</script>
<script>var t="</p>";</script></head><body><nav>menu words</nav><h1>Main <b>title</b></h1><h2>12</h2><h2></h2><p>one two<p>three &eacute;t&eacute; <a href="/in">inner</a><a href="https://other.example/x" rel="nofollow ugc">out</a>
<a href="#x">skip</a><a href="mailto:a@b.c">mail</a><img src="a.png" alt=""><img src="b.png"></body></html>"""


def test_parsed_page():
    p = html.parse_page(PAGE, "https://site.example/dir/")
    assert (p["title"], p["meta_description"], p["canonical"]) == ("A & B", "last", "/c")
    assert p["h1"] == ["Main title"] and p["h2"] == p["h2_suspicious"] == ["12"]
    assert [x["href"] for x in p["links_internal"]] == ["https://site.example/in"]
    assert [(x["href"], x["rel"]) for x in p["links_external"]] == [("https://other.example/x", ["nofollow", "ugc"]), ("mailto:a@b.c", [])]
    assert [(x["src"], x["alt"]) for x in p["images"]] == [("https://site.example/dir/a.png", ""), ("https://site.example/dir/b.png", None)]
    assert [json.loads(x) for x in p["schema"]] == [{"@type": "Article"}]
    assert p["open_graph"] == {"og:title": "t"} and p["hreflang"] == [{"lang": "de", "href": "/de"}]
    assert p["word_count"] == 13


def test_parsed_page_as_rows(spark):
    df = spark.createDataFrame([(PAGE, "https://site.example/dir/"), (None, None)], "html string, url string")
    parsed = html.parse_pages(df)
    assert [r.href for r in html.links_of(parsed).orderBy("pos").collect()] == ["https://other.example/x", "mailto:a@b.c", "https://site.example/in"]
    assert sorted((r.alt_status) for r in html.images_of(parsed).collect()) == ["decorative", "missing"]
    assert parsed.where("url is null").select("parsed.*").first().word_count == 0


def test_needs_browser(spark):
    long_ = "<html><body><p>" + "word " * 60 + "</p></body></html>"
    sparse = '<html><body data-wf-page="1" data-wf-site="2"><p>' + "w " * 80 + "</p></body></html>"
    script = "<html><body><script>" + "x" * 900 + "</script><p>hi</p></body></html>"
    rows = [("", True), (None, True), (long_, False), ('<body><div id="root"></div></body>', True), (sparse, True), (script, True), ("no body at all " * 9, False)]
    df = spark.createDataFrame(rows, "html string, expected boolean")
    assert all(r.got == r.expected for r in df.withColumn("got", html.needs_browser(F.col("html"))).collect())


def test_json_ld_bounds():
    blocks = html.json_ld_blocks('<script type="application/ld+json">{"@type": ["A", "B"], "x": {"@type": "C"}}</script><script type="application/ld+json">{</script>' * 30)
    assert len(blocks) == html.MOST_BLOCKS and blocks[0]["types"] == ["A", "B", "C"] and blocks[1]["valid"] is False
    deep = "[" * 60 + "]" * 60
    assert html.schema_types(json.loads(deep)) == ([], True)


def test_loading_signals(spark):
    page = '<link rel="preload" href="x"><link rel="prerender" href="y"><img fetchpriority="high"><script type="speculationrules">{"prefetch": []}</script><script>window.addEventListener("unload", f)</script>'
    df = spark.createDataFrame([("a", page, {"Cache-Control": "No-Store"}), ("b", '<img fetchpriority="high">', {"Speculation-Rules": "x"})], "url string, html string, headers map<string,string>")
    a, b = html.loading_signals(df).orderBy("url").collect()
    assert (a.score, a.prerender_links, a.no_store, a.unload_listener) == (50, 1, True, True) and b.score == 100


def test_controls_and_tree(spark):
    page = '<nav></nav><main></main><button>x</button><button>y</button><a href="/">z</a><div onclick="f()">w</div><input id="a"><input id="b" aria-label="x"><label for="b">B</label>'
    df = spark.createDataFrame([(page,)], "html string")
    counts = html.control_counts(F.col("html"))
    r = df.select(*[c.alias(k) for k, c in counts.items()], html.agent_score(counts).alias("score")).first()
    assert (r.real_buttons, r.real_anchors, r.div_onclick_widgets, r.semantic_landmarks, r.inputs_without_aria, r.inputs_without_label, r.score) == (2, 1, 1, 2, 1, 1, 91)
    tree = {"role": "generic", "children": [{"role": "button", "name": "a"}, {"role": "button"}, {"role": "link", "name": "l"}, {"role": "generic", "children": [None]}]}
    assert html.tree_counts(json.dumps(tree)) == {"tree_present": True, "total_nodes": 5, "interactive_nodes": 3, "role_button": 2, "role_link": 1, "role_generic": 2, "unnamed_interactive": 1}
    assert html.tree_counts(None)["tree_present"] is False


def test_section_risk(spark):
    rows = [("https://s.example/deals/a", 0, 5, 12), ("https://s.example/deals/b", 0, 6, 14), ("https://s.example/blog/c", 0, 0, 0), ("https://s.example/", 2, 0, 0)]
    df = spark.createDataFrame(rows, "url string, third_party_hits long, commerce_hits long, affiliate_link_hits long")
    got = {r.section: (r.risk, r.flags) for r in sections.section_risk(df).collect()}
    assert got["/deals/"] == ("high", ["commercial-intent-skew", "affiliate-density", "commercial-intent-drift"])
    assert got["/blog/"] == ("low", []) and got["/"] == ("high", ["third-party-authorship-density"])


@pytest.mark.parametrize(
    "url,fetchable",
    [
        ("https://example.com/a", True), ("http://8.8.8.8/", True), ("ftp://example.com", False), ("http://user@example.com", False), ("http://127.0.0.1/", False), ("http://2130706433/", False),
        ("http://0x7f.1/", False), ("http://0177.0.0.1/", False), ("http://10.1.2.3", False), ("http://[::1]/", False), ("http://localhost/", False), ("http://exa%6dple.com/", False),
        ("http://example.com\\@evil.com/", False), ("http://169.254.169.254/", False), ("", False), (None, False), ("https://intranet.local/", False),
    ],
)
def test_fetchable_urls(url, fetchable):
    assert urls.fetchable_url(url) is fetchable


@pytest.mark.parametrize(
    "url,expected",
    [
        ("HTTPS://Example.com:443/a/?b=2&a=1&utm_source=x#f", "https://example.com/a?a=1&b=2"), ("http://example.com", "http://example.com/"), ("http://example.com:8080/x//", "http://example.com:8080/x"),
        ("http://e.com/?k=&j=1&k=2", "http://e.com/?j=1&k=&k=2"), ("http://e.com/?utm_id=1", "http://e.com/?utm_id=1"),
    ],
)
def test_snapshot_urls(url, expected):
    assert urls.snapshot_url(url) == expected


PRODUCT = {"@context": "https://schema.org", "@type": "Product", "name": "n", "image": "i", "description": "d", "offers": [{"@type": "Offer", "price": 1, "priceCurrency": "EUR", "availability": "x"}]}


def rules(payload, **options):
    return [f["rule"] for f in schema_org.product_findings(json.dumps(payload), **options)]


def test_product_findings(spark):
    assert rules(PRODUCT) == ["missing-return-policy", "missing-shipping-details", "missing-member-program", "no-product-group"]
    assert "missing-product-name" in rules({**PRODUCT, "name": ""}) and "recommended-product-description" in rules({**PRODUCT, "description": None})
    assert "merchant-listing-offer-type" in rules({**PRODUCT, "offers": {"@type": "AggregateOffer"}})
    assert "deprecated-type" in rules([PRODUCT, {"@type": "ClaimReview"}]) and rules({"@type": "Article"}) == ["missing-product"]
    assert "missing-eu-energy-class" in rules(PRODUCT, eu=True)
    assert "return-policy-returnPolicyCategory" in rules({**PRODUCT, "hasMerchantReturnPolicy": {"applicableCountry": "DE"}})
    df = spark.createDataFrame([(json.dumps(PRODUCT),), ("{",), (None,)], "payload string")
    assert [(r.ok, r.medium, r.critical) for r in schema_org.validate_products(df).collect()] == [(True, 3, 0), (False, 0, 1), (False, 0, 1)]


def test_markup_errors():
    wrap = lambda x: f'<script type="application/ld+json">{x}</script>'
    assert schema_org.markup_errors(wrap('{"@context": "https://schema.org", "@type": "FAQPage"}')) == []
    assert len(schema_org.markup_errors(wrap("{") + wrap('{"@type": "HowTo", "name": "[City]"}'))) == 4


def test_generators_leave_nulls_out(spark):
    df = spark.createDataFrame([("r1", None, "2024")], "n string, who string, at string")
    got = json.loads(df.select(schema_org.reservation("FoodEstablishmentReservation", F.col("n"), F.col("who"), F.col("at")).alias("j")).first().j)
    assert got == {"@context": "https://schema.org", "@type": "FoodEstablishmentReservation", "reservationId": "r1", "reservationStatus": "https://schema.org/ReservationConfirmed", "startTime": "2024"}


def test_decoding_and_sitemaps(spark):
    assert readers.decode_page("é".encode("utf-16"), None) == "é" and readers.decode_page("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert readers.decode_page(b'<meta charset="windows-1252">\xe9', None).endswith("é") and readers.decode_page(b"\xff", "x; charset=nonsense") == "�"
    kinds = {"": "empty", "<!DOCTYPE x><urlset/>": "refused", "<urlset xmlns='a'/>": "urlset", "<html></html>": "invalid", "<urlset": "invalid", "https://a.example/x\nhttp://b.example/": "text", "hello": "invalid", "<rss/>": "rss"}
    assert {k: readers.sitemap_kind_of(k) for k in kinds} == kinds
    sites = spark.createDataFrame([("https://a.example", "User-agent: *\nSitemap: https://a.example/s.xml\n sitemap :https://a.example/s.xml")], "origin string, robots string")
    rows = readers.sitemap_candidates(sites).orderBy("pos").collect()
    assert [r.declared for r in rows] == [True, False, False, False, False] and rows[1].url == "https://a.example/sitemap.xml"
