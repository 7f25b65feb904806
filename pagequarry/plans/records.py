"""Queries over saved responses, structured data and site-wide rules, whole tables throughout.

The inputs are made of the driver's tables, so that how often each rule holds is known from the keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagequarry.functions.stored import shared_dir
from pagequarry.functions.values import overlaps, truncated
from pagequarry.operators import claims, drift, links, schema_org, site_rules
from pagequarry.sources import readers, sinks

from ._sql import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _counts(rules: dict[str, str], name: str, source: str) -> str:
    """SQL of (name, n): how many rows of source meet each condition; conditions that none meets are left out."""
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{rule}' AS {name}, count(*) FILTER (WHERE {test}) AS n FROM ({source})" for rule, test in rules.items()) + ") WHERE n > 0"


_PRODUCT_RULES = {
    "invalid-json": "k % 13 = 0", "deprecated-type": "k % 13 > 0 AND k % 11 = 0", "missing-product-image": "k % 13 > 0 AND k % 2 = 1", "recommended-product-description": "k % 13 > 0 AND k % 6 = 0",
    "merchant-listing-offer-type": "k % 13 > 0 AND k % 3 = 0", "recommended-offer-price": "k % 13 > 0 AND k % 5 = 0", "missing-return-policy": "k % 13 > 0 AND k % 7 > 0",
    "return-policy-returnPolicyCategory": "k % 13 > 0 AND k % 7 = 0", "missing-shipping-details": "k % 13 > 0", "missing-member-program": "k % 13 > 0 AND k % 4 > 0", "no-product-group": "k % 13 > 0",
}


def _products(spark, sf):
    k = F.col("p_partkey")
    offer = F.struct(F.when(k % 3 == 0, "AggregateOffer").otherwise("Offer").alias("@type"), F.when(k % 5 > 0, F.col("p_retailprice")).alias("price"), F.lit("EUR").alias("priceCurrency"), F.lit("InStock").alias("availability"))
    product = F.to_json(F.struct(
        F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.when(k % 2 == 0, "a.png").alias("image"), F.when(k % 6 > 0, F.col("p_type")).alias("description"), offer.alias("offers"),
        F.when(k % 7 == 0, F.struct(F.lit("DE").alias("applicableCountry"))).alias("hasMerchantReturnPolicy"), F.when(k % 4 == 0, F.struct(F.lit("club").alias("name"))).alias("hasMemberProgram"),
    ))
    both = F.concat(F.lit("["), product, F.lit(', {"@type": "ClaimReview"}]'))
    return table(spark, sf, "part").select(k, F.when(k % 13 == 0, "{").when(k % 11 == 0, both).otherwise(product).alias("payload"))


@query("v02_product_findings", _counts(_PRODUCT_RULES, "rule", "SELECT p_partkey AS k FROM part"))
def v02(spark, sf):
    found = schema_org.validate_products(_products(spark, sf)).select(F.explode("findings").alias("f"))
    return found.groupBy(F.col("f.rule").alias("rule")).agg(F.count("*").alias("n"))


@query("v03_product_verdicts", "SELECT p_partkey, p_partkey % 13 > 0 AND p_partkey % 11 > 0 AND p_partkey % 2 = 0 AND p_partkey % 3 > 0 AS ok, CAST(CASE WHEN p_partkey % 13 = 0 OR p_partkey % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS critical, CAST(CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE (p_partkey % 2 = 1)::INT + (p_partkey % 3 = 0)::INT END AS BIGINT) AS high FROM part")
def v03(spark, sf):
    return schema_org.validate_products(_products(spark, sf)).select("p_partkey", "ok", "critical", "high")


@query("v01_markup_errors", "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS errors FROM part")
def v01(spark, sf):
    """Pages without an error, with broken JSON, without context and with a placeholder, and of a retired type."""
    k = F.col("p_partkey")
    body = F.when(k % 4 == 0, '{"@context": "https://schema.org", "@type": "Article"}').when(k % 4 == 1, "{").when(k % 4 == 2, '{"@type": "Article", "name": "[City]"}').otherwise('{"@context": "https://schema.org", "@type": "HowTo"}')
    page = F.concat(F.lit('<p>x</p><script type="application/ld+json">'), body, F.lit("</script>"))
    return table(spark, sf, "part").select(k, F.size(schema_org.check_markup(page)).cast("long").alias("errors"))


@query("k12_reservations", """SELECT o_orderkey, '{"@context":"https://schema.org","@type":"LodgingReservation","reservationId":"' || o_orderkey || '","reservationStatus":"https://schema.org/ReservationConfirmed",' || CASE WHEN o_orderkey % 2 = 0 THEN '"underName":{"@type":"Person","name":"n"},' ELSE '' END || '"startTime":"2024"}' AS j FROM orders""")
def k12(spark, sf):
    k = F.col("o_orderkey")
    made = schema_org.reservation("LodgingReservation", k.cast("string"), F.when(k % 2 == 0, "n"), F.lit("2024"))
    return table(spark, sf, "orders").select(k, made.alias("j"))


@query("v14_profiles", "SELECT p_partkey, p_partkey % 4 <> 3 AS valid_json, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'missing-version' WHEN 2 THEN 'capability-0-missing-endpoint' ELSE 'invalid-json' END AS issues, CASE WHEN p_partkey % 4 = 2 THEN 'new' ELSE '' END AS unknown FROM part")
def v14(spark, sf):
    k = F.col("p_partkey")
    good = '"merchant": {"name": "m"}, "capabilities": [{"id": "dev.ucp.shopping.cart", "version": "1", "endpoint": "e"}]}'
    payload = F.when(k % 4 == 0, '{"version": "1", ' + good).when(k % 4 == 1, "{" + good).when(k % 4 == 2, '{"version": "1", "merchant": {"name": "m"}, "capabilities": [{"id": "new", "version": "1"}]}').otherwise("{")
    rows = table(spark, sf, "part").select(k, site_rules.check_profile(payload).alias("x"))
    return rows.select("p_partkey", "x.valid_json", F.array_join("x.issues", ",").alias("issues"), F.array_join("x.unknown_capabilities", ",").alias("unknown"))


@query(
    "j07_verified_backlinks",
    "SELECT 'https://s' || c_custkey || '.example/p' AS source_url, CASE WHEN c_custkey % 11 = 0 THEN 'error' WHEN c_custkey % 7 = 0 THEN 'source_unavailable' WHEN c_custkey % 4 < 3 THEN 'verified' WHEN c_custkey % 5 = 0 THEN 'unverifiable_js' ELSE 'link_removed' END AS status, CASE c_custkey % 4 WHEN 0 THEN 'exact_url' WHEN 1 THEN 'domain_match' WHEN 2 THEN 'subdomain_match' END AS match_type, CASE WHEN c_custkey % 4 < 3 THEN 'anchor ' || c_custkey END AS anchor_text FROM customer",
)
def j07(spark, sf):
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example/p"))
    rows = table(spark, sf, "customer")
    pages = rows.where("c_custkey % 11 > 0").select(url.alias("url"), F.when(k % 7 == 0, 404).otherwise(200).alias("status_code"), (k % 5 == 0).alias("script_rendered"))
    href = F.when(k % 4 == 0, "https://target.example/page").when(k % 4 == 1, "https://target.example/other").when(k % 4 == 2, "https://blog.target.example/").otherwise("https://target.example.org/")
    found = rows.select(url.alias("page_url"), F.lit(1).alias("pos"), href.alias("href"), F.concat(F.lit(" anchor "), k.cast("string")).alias("text"), F.array(F.lit("nofollow")).alias("rel"))
    other = rows.select(url.alias("page_url"), F.lit(0).alias("pos"), F.lit("https://else.example/").alias("href"), F.lit("else").alias("text"), F.array(F.lit("nofollow")).alias("rel"))
    targets = rows.select(url.alias("source_url"), F.lit("https://target.example/page").alias("target_url"))
    return links.verify_backlinks(pages, found.union(other), targets).select("source_url", "status", "match_type", "anchor_text")


def _translations(spark, sf):
    k = F.col("p_partkey")
    row = lambda lang, sections, images, words, late: F.struct(F.lit(lang).alias("lang"), sections.alias("sections"), F.lit(0).alias("faq_items"), images.alias("images"), words.alias("words"), F.date_sub(F.lit("2024-03-31").cast("date"), late).alias("updated"))
    five, two, none = F.lit(5), F.lit(2), F.lit(0)
    en, fr = row("en", five, two, F.lit(1000).cast("long"), none), row("fr", five, (k % 2 + 1).cast("int"), 1000 + k % 7 * 100, (k % 120).cast("int"))
    de = row("de", F.when(k % 5 == 0, 8).otherwise(5), two, F.lit(1200).cast("long"), none)
    rows = table(spark, sf, "part").select(k.alias("page_key"), F.explode(F.when(k % 3 > 0, F.array(en, fr, de)).otherwise(F.array(en, fr))).alias("x"))
    return rows.select("page_key", "x.*")


@query(
    "j13_locale_parity",
    "SELECT p_partkey AS page_key, 'de' AS lang, 'page-existence' AS problem FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'de', 'sections' FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'fr', 'images' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'fr', 'word-ratio' FROM part WHERE p_partkey % 7 > 4",
)
def j13(spark, sf):
    return site_rules.locale_parity(_translations(spark, sf)).select("page_key", "lang", "problem")


@query("w09_freshness", "SELECT p_partkey AS page_key, CASE WHEN p_partkey % 120 <= 7 THEN 'fresh' WHEN p_partkey % 120 <= 30 THEN 'aging' WHEN p_partkey % 120 <= 90 THEN 'stale' ELSE 'outdated' END AS status FROM part")
def w09(spark, sf):
    return site_rules.freshness(_translations(spark, sf)).where("lang = 'fr'").select("page_key", "status")


_ENTRIES = "SELECT l_suppkey AS sitemap, l_orderkey % 97 = 0 AS insecure, l_orderkey % 101 = 0 AS noindexed, CASE WHEN l_orderkey % 103 = 0 THEN 301 WHEN l_orderkey % 107 = 0 THEN 404 ELSE 200 END AS status, l_orderkey % 109 = 0 AS ignored, l_suppkey % 5 = 0 AS same FROM lineitem"
_SITEMAP = (
    ("not-ok-urls", "count(*) FILTER (WHERE status = 404) > 0"), ("noindexed-urls", "count(*) FILTER (WHERE noindexed) > 0"), ("redirected-urls", "count(*) FILTER (WHERE status = 301) > 0"),
    ("http-urls", "count(*) FILTER (WHERE insecure) > 0"), ("identical-lastmod", "bool_and(same) AND count(*) > 1"), ("ignored-tags", "count(*) FILTER (WHERE ignored) > 0"), ("too-large", "sitemap % 9 = 0"),
)


@query("v18_sitemap_quality", " UNION ALL ".join(f"SELECT sitemap, '{name}' AS problem FROM ({_ENTRIES}) GROUP BY sitemap HAVING {test}" for name, test in _SITEMAP))
def v18(spark, sf):
    o = F.col("l_orderkey")
    entries = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sitemap"), F.concat(F.when(o % 97 == 0, "http://x/").otherwise("https://x/"), o.cast("string")).alias("url"), F.when(F.col("l_suppkey") % 5 == 0, "2024-01-01").alias("lastmod"),
        F.when(o % 103 == 0, 301).when(o % 107 == 0, 404).otherwise(200).alias("status_code"), (o % 101 == 0).alias("noindex"), (o % 109 == 0).alias("has_ignored_tags"), F.lit(0).alias("images"), F.lit(None).cast("date").alias("news_date"),
    )
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sitemap"), F.when(F.col("s_suppkey") % 9 == 0, 60 * 1024 * 1024).otherwise(1000).alias("bytes"))
    return site_rules.sitemap_quality(entries, files, F.lit("2024-01-05").cast("date")).select("sitemap", "problem")


@query(
    "v20_page_gates",
    "SELECT *, CASE WHEN pages >= 50 OR u < 30 THEN 'stop' WHEN pages >= 30 OR u < 40 THEN 'warning' ELSE 'ok' END AS verdict FROM (SELECT l_suppkey % 7 * 1000 + l_partkey AS template, count(*) AS pages, count(*) FILTER (WHERE l_linenumber * 100 < 300 OR l_quantity * 2 < 40) AS thin_pages, round(avg(l_quantity * 2), 2) AS u FROM lineitem GROUP BY 1)",
)
def v20(spark, sf):
    pages = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 7 * 1000 + F.col("l_partkey")).alias("template"), (F.col("l_quantity") * 2).alias("uniqueness_pct"), (F.col("l_linenumber") * 100).alias("words"))
    return site_rules.page_gates(pages).select("template", "pages", "thin_pages", F.col("mean_uniqueness").alias("u"), "verdict")


@query(
    "a12_report_issues",
    "SELECT o_custkey AS report, 'summary' AS field, count(DISTINCT o_orderstatus) AS n FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, 'verification', count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 = 0 GROUP BY 1 UNION ALL SELECT c_custkey, 'health_score', 1 FROM customer WHERE c_custkey % 6 < 4 AND c_custkey % 2 = 0",
)
def a12(spark, sf):
    """Reports whose own summary is off by one, whose removed links stand on a social host, and that have a score from too few factors."""
    status = F.when(F.col("o_orderstatus") == "O", "link_removed").otherwise(F.col("o_orderstatus"))
    url = F.when(F.col("o_orderkey") % 5 == 0, "https://www.facebook.com/x").otherwise("https://a.example/")
    results = table(spark, sf, "orders").select(F.col("o_custkey").alias("report"), url.alias("source_url"), status.alias("status"), F.lit(200).alias("http_status"))
    declared = results.groupBy("report", "status").agg(F.count("*").alias("n")).select("report", "status", (F.col("n") + (F.col("report") % 3 == 0).cast("int")).alias("count"))
    k = F.col("c_custkey")
    score = table(spark, sf, "customer").select(k.alias("report"), (k % 6).cast("int").alias("factors_with_data"), F.when(k % 2 == 0, 70.0).alias("score"))
    return site_rules.report_issues(results, declared, score).groupBy("report", "field").agg(F.count("*").alias("n"))


@query("s07_envelope_items", "SELECT p_partkey, unnest([0, 1]) AS item_pos, unnest([p_name, p_brand]) AS title FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 5 > 0")
def s07(spark, sf):
    k = F.col("p_partkey")
    items = F.array(F.struct(F.col("p_name").alias("title")), F.struct(F.col("p_brand").alias("title")))
    task = F.struct(F.when(k % 4 == 0, 40000).otherwise(20000).alias("status_code"), F.when(k % 5 > 0, F.array(F.struct(items.alias("items")))).alias("result"))
    rows = table(spark, sf, "part").select(k, F.to_json(F.struct(F.array(task).alias("tasks"))).alias("body"))
    return readers.envelope_items(rows, "struct<title:string>").select("p_partkey", "item_pos", F.col("item.title").alias("title"))


@query("s14_metric_points", "SELECT 'u' || p_partkey AS url, 'LCP' AS metric, unnest(['a', 'b', 'c']) AS week, unnest([CAST(p_size AS DOUBLE), NULL, CAST(p_size + 1 AS DOUBLE)]) AS p75 FROM part")
def s14(spark, sf):
    size = F.col("p_size").cast("double")
    rows = table(spark, sf, "part").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.lit("LCP").alias("metric"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("weeks"), F.array(size, F.lit(None).cast("double"), size + 1).alias("p75s"))
    return readers.metric_points(rows)


@query("s17_last_months", "SELECT p_partkey, CAST(list_sum(range(greatest(p_size - 12, 0), p_size)) AS BIGINT) AS total FROM part")
def s17(spark, sf):
    volumes = F.sequence(F.lit(0).cast("long"), (F.col("p_size") - 1).cast("long"))
    return table(spark, sf, "part").select("p_partkey", F.aggregate(readers.last_months(volumes), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("s20_labelled_fields", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'second' END AS name FROM supplier")
def s20(spark, sf):
    k = F.col("s_suppkey")
    text = F.concat(F.lit("% comment\r\nOrg: second\r\n"), F.when(k % 3 == 0, F.concat(F.lit(" REGISTRANT : "), "s_name")).when(k % 3 == 1, "Registrant:   ").otherwise("x"), F.lit("\r\nEnd: x"))
    text = F.when(k % 3 == 2, F.replace(text, F.lit("Org:"), F.lit("Orx:"))).otherwise(text)
    return table(spark, sf, "supplier").select(k, readers.labelled_field(text, ["Registrant", "Org"]).alias("name"))


@query(
    "s21_sitemap_candidates",
    "SELECT origin, url, declared FROM (SELECT s_suppkey, 'https://s' || s_suppkey || '.example' AS origin, unnest(['/mine.xml', '/sitemap.xml', '/sitemap_index.xml', '/sitemap-index.xml', '/wp-sitemap.xml']) AS path, origin || path AS url, path = '/mine.xml' OR (path = '/sitemap.xml' AND s_suppkey % 3 = 0) AS declared FROM supplier) WHERE path <> '/mine.xml' OR s_suppkey % 2 = 0",
)
def s21(spark, sf):
    k = F.col("s_suppkey")
    origin = F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example"))
    robots = F.concat(F.lit("User-agent: *\n"), F.when(k % 2 == 0, F.concat(F.lit("Sitemap: "), origin, F.lit("/mine.xml\n"))).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit(" sitemap :"), origin, F.lit("/sitemap.xml"))).otherwise(""))
    return readers.sitemap_candidates(table(spark, sf, "supplier").select(origin.alias("origin"), robots.alias("robots"))).select("origin", "url", "declared")


@query("s23_sitemap_kinds", "SELECT o_orderkey, ['empty', 'refused', 'urlset', 'invalid', 'text', 'sitemapindex', 'rss'][1 + o_orderkey % 7] AS kind FROM orders")
def s23(spark, sf):
    k = F.col("o_orderkey")
    bodies = ("  ", "<!DOCTYPE x><urlset/>", "<urlset xmlns='a'/>", "<urlset", "https://a.example/x\nhttp://b.example/", "<sitemapindex></sitemapindex>", "<rss/>")
    body = F.get(F.array(*[F.lit(b) for b in bodies]), (k % 7).cast("int"))
    return table(spark, sf, "orders").select(k, readers.sitemap_kind(body).alias("kind"))


@query("s02_decoded_pages", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN '<meta charset=\"windows-1252\">' ELSE '' END || 'é' || p_name AS html FROM part")
def s02(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(F.lit("é"), "p_name")
    content = F.when(k % 4 == 0, F.encode(text, "UTF-8")).when(k % 4 == 1, F.encode(text, "ISO-8859-1")).when(k % 4 == 2, F.encode(F.concat(F.lit('<meta charset="windows-1252">'), text), "ISO-8859-1")).otherwise(F.encode(text, "UTF-16"))
    kind = F.when(k % 4 == 1, "text/html; charset=ISO-8859-1")
    return table(spark, sf, "part").select(k, readers.decoded(content, kind).alias("html"))


@query("p23_updates", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderstatus IN ('F', 'P')")
def p23(spark, sf):
    feed = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("pos"))
    return readers.updates_since(feed, "1997-03", ["F", "P"]).select(F.col("pos").alias("o_orderkey"))


@query("s25_batch_plan", "SELECT p_name AS prompt, CASE WHEN p_partkey % 3 = 0 THEN '1:1' ELSE '16:9' END AS ratio, '1K' AS resolution FROM part WHERE p_partkey % 5 > 0")
def s25(spark, sf):
    """A CSV plan written and read back; rows without a prompt are rejected."""
    k = F.col("p_partkey")
    path = f"{shared_dir(spark)}/pagequarry/plan-{uuid.uuid4().hex}"
    table(spark, sf, "part").select(F.when(k % 5 > 0, F.col("p_name")).alias("prompt"), F.when(k % 3 == 0, "1:1").alias("ratio")).write.option("header", "true").csv(path)
    return readers.batch_plan(spark, path)[0].select("prompt", "ratio", "resolution")


@query("k09_disavow_lines", "SELECT 'domain:s' || s_suppkey || '.example' AS line FROM supplier")
def k09(spark, sf):
    found = links.disavow_lines(table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("domain")))
    return found.select(F.col(found.columns[0]).alias("line")).where("line LIKE 'domain:%'")


@query("k10_sitemap_parts", "SELECT l_returnflag AS host, count(*) AS urls FROM lineitem GROUP BY 1")
def k10(spark, sf):
    """All URLs of a host in parts of bounded size: the parts' sums."""
    urls = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("host"), F.concat_ws("/", F.lit("https:/"), F.col("l_returnflag"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("url"), F.lit("2024-01-01").alias("lastmod"))
    parts = sinks.sitemap_parts(urls).groupBy("host", "part").agg(F.count("*").alias("n"))
    return parts.where("n <= 50000").groupBy("host").agg(F.sum("n").alias("urls"))


@query("v19_language_codes", "SELECT s_suppkey, s_suppkey % 4 < 2 AS fine FROM supplier")
def v19(spark, sf):
    code = F.get(F.array(*[F.lit(c) for c in ("de", "en-US", "xx-toolong-code", "e")]), (F.col("s_suppkey") % 4).cast("int"))
    return table(spark, sf, "supplier").select("s_suppkey", links.code_problem(code).isNull().alias("fine"))


@query("p19_overlaps", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN false ELSE o_orderdate <= TIMESTAMP '1996-06-30' AND o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1996-01-01' END AS during, CASE WHEN length(o_orderpriority) > 5 THEN left(o_orderpriority, 5) || '...' ELSE o_orderpriority END AS short FROM orders")
def p19(spark, sf):
    start = F.col("o_orderdate")
    end = F.when(F.col("o_orderkey") % 5 > 0, start + F.expr("INTERVAL 30 DAY"))
    window = [F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1996-06-30")]
    return table(spark, sf, "orders").select("o_orderkey", overlaps(start, end, *window).alias("during"), truncated(F.col("o_orderpriority"), 5).alias("short"))


@query(
    "a19_drift_summary",
    "SELECT page_id, CAST((page_id % 5 = 0)::INT AS BIGINT) AS critical, CAST((page_id % 4 = 0)::INT AS BIGINT) AS warning, CAST((page_id % 3 = 0)::INT AS BIGINT) AS info FROM pages",
)
def a19(spark, sf):
    row = lambda rule, severity, n: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.col("page_id") % n == 0).alias("triggered"))
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("url_hash"), F.explode(F.array(row("a", "CRITICAL", 5), row("b", "WARNING", 4), row("c", "INFO", 3))).alias("x")).select("url_hash", "x.*")
    return drift.summary(rows).select(F.col("url_hash").alias("page_id"), F.col("critical").cast("long"), F.col("warning").cast("long"), F.col("info").cast("long"))


def _claiming(spark, sf):
    k = F.col("o_orderkey")
    parts = [F.when(k % 3 == 0, "According to a Great Lakes study."), F.lit("About 45% of users left."), F.when(k % 2 == 0, "It began in 2020."), F.when(k % 7 == 0, "Sales reached $5 million."), F.when(k % 5 == 0, "[1]")]
    return table(spark, sf, "orders").select(k.alias("doc_id"), F.concat_ws(" ", *parts).alias("text"))


@query(
    "t07_claims_of_known_texts",
    """SELECT doc_id, kind, t AS text FROM (SELECT o_orderkey AS doc_id, unnest(['authority', 'statistic', 'temporal', 'quantity']) AS kind, unnest(['According to a Great Lakes study', '45% of users left', 'in 2020', '$5 million']) AS t,
unnest([o_orderkey % 3 = 0, true, o_orderkey % 2 = 0, o_orderkey % 7 = 0]) AS there FROM orders) WHERE there AND kind <> 'authority'""",
)
def t07_known(spark, sf):
    return claims.claims(_claiming(spark, sf)).where("kind <> 'authority'").select("doc_id", "kind", "text")


@query(
    "t09_claims_and_citations",
    "SELECT o_orderkey AS doc_id, n AS claim_count, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 0 ELSE n END AS uncited_count FROM (SELECT o_orderkey, CAST(1 + (o_orderkey % 2 = 0)::INT + (o_orderkey % 7 = 0)::INT AS BIGINT) AS n FROM orders)",
)
def t09_known(spark, sf):
    """A citation mark, or an authority that is named, stands near every claim of a text that has one."""
    return claims.claim_summary(_claiming(spark, sf)).select("doc_id", "claim_count", "uncited_count")


@query(
    "t10_rewriting_of_known_texts",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Explore' ELSE 'We see' END || ' the data' || CASE WHEN o_orderkey % 3 = 0 THEN ', at modern labs.' ELSE '.' END || CASE WHEN o_orderkey % 5 = 0 THEN ' It holds.' ELSE '' END AS cleaned, CAST((o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT AS BIGINT) AS change_count FROM orders",
)
def t10_known(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(F.when(k % 2 == 0, "Delve into").otherwise("We see"), F.lit("  the data"), F.when(k % 3 == 0, " , at cutting-edge labs.").otherwise("."), F.when(k % 5 == 0, " Moreover, It holds.").otherwise(""))
    made = claims.rewrite(table(spark, sf, "orders").select(k, text.alias("text")))
    return made.select("o_orderkey", "cleaned", "change_count")
