"""Queries over search-console, link and language responses, stores, detection and velocities.

Inputs are made of the driver's tables, so that the keys tell what each rule gives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagequarry.functions.stored import shared_dir
from pagequarry.operators import detection, drift
from pagequarry.sources import responses, store

from ._sql import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def _json(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _named(**fields):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


@query(
    "s10_sitemap_status",
    """SELECT p_partkey, 'https://a.example/' || p_partkey || '.xml' AS path, p_partkey % 2 = 0 AS is_pending, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 3 END AS BIGINT) AS warnings,
CAST(p_partkey % 5 AS BIGINT) AS errors, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'submitted,type' END AS kept, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_partkey AS VARCHAR) END AS submitted FROM part WHERE p_partkey % 13 > 0""",
)
def s10(spark, sf):
    """Responses of one sitemap each; every thirteenth is no JSON."""
    k = F.col("p_partkey")
    contents = F.when(k % 7 > 0, F.array(_named(type=F.lit("web"), submitted=k.cast("string"), indexed=F.lit("0"))))
    sitemap = _named(path=F.concat(F.lit("https://a.example/"), k.cast("string"), F.lit(".xml")), isPending=k % 2 == 0, warnings=F.when(k % 3 > 0, k % 3), errors=k % 5, contents=contents)
    found = responses.sitemap_status(table(spark, sf, "part").select(k, F.when(k % 13 > 0, _json(sitemap=F.array(sitemap))).otherwise("{").alias("body")))
    first = F.get("contents", F.lit(0))
    return found.select("p_partkey", "path", "is_pending", "warnings", "errors", F.coalesce(F.array_join(F.array_sort(F.map_keys(first)), ","), F.lit("")).alias("kept"), first["submitted"].alias("submitted"))


@query(
    "s10_properties",
    "SELECT n_nationkey, 'sc-domain:' || lower(n_name) AS url, CASE WHEN n_nationkey % 2 = 0 THEN 'siteOwner' END AS permission FROM nation",
)
def s10_properties(spark, sf):
    k = F.col("n_nationkey")
    entry = _named(siteUrl=F.concat(F.lit("sc-domain:"), F.lower("n_name")), permissionLevel=F.when(k % 2 == 0, "siteOwner"))
    return responses.properties(table(spark, sf, "nation").select(k, _json(siteEntry=F.array(entry)).alias("body")))


def _inspected(spark, sf):
    k = F.col("o_orderkey")
    canonical = F.concat(F.lit("https://a.example/"), k.cast("string"))
    index = _named(verdict=F.when(k % 4 == 0, "PASS").when(k % 4 == 1, "FAIL").when(k % 4 == 2, "NEUTRAL"), coverageState=F.lit("Submitted"), googleCanonical=canonical, userCanonical=F.when(k % 3 == 0, canonical).when(k % 3 == 1, "https://b.example/"))
    body = _json(inspectionResult=_named(indexStatusResult=index))
    rows = table(spark, sf, "orders").select(k, (F.col("o_custkey") % 10).alias("property"), F.when(k % 11 == 0, "denied").alias("error"), F.when(k % 11 > 0, body).alias("body"))
    return responses.inspections(rows)


@query(
    "s11_inspections",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'PASS' WHEN o_orderkey % 4 = 1 THEN 'FAIL' WHEN o_orderkey % 4 = 2 THEN 'NEUTRAL' ELSE 'VERDICT_UNSPECIFIED' END AS verdict,
CASE WHEN o_orderkey % 11 > 0 THEN 'Submitted' END AS coverage_state, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 3 = 2 THEN NULL ELSE o_orderkey % 3 = 0 END AS canonical_match FROM orders""",
)
def s11(spark, sf):
    return _inspected(spark, sf).select("o_orderkey", "verdict", "coverage_state", "canonical_match")


@query(
    "s11_inspection_summary",
    """SELECT o_custkey % 10 AS property, count(*) AS total, count(*) FILTER (WHERE k % 11 > 0 AND k % 4 = 0) AS pass, count(*) FILTER (WHERE k % 11 > 0 AND k % 4 = 1) AS fail,
count(*) FILTER (WHERE k % 11 > 0 AND k % 4 > 1) AS neutral, count(*) FILTER (WHERE k % 11 = 0) AS error FROM (SELECT o_orderkey AS k, o_custkey FROM orders) GROUP BY 1""",
)
def s11_summary(spark, sf):
    return responses.inspection_summary(_inspected(spark, sf), ["property"])


@query(
    "s15_url_metrics",
    """SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN CAST(p_partkey % 100 AS DOUBLE) END AS domain_authority, CAST(CASE WHEN p_partkey % 9 = 0 OR p_partkey % 2 = 1 THEN 0 ELSE p_partkey END AS BIGINT) AS links,
CAST(CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size END AS BIGINT) AS linking_root_domains FROM part""",
)
def s15_metrics(spark, sf):
    """Every ninth response has no result, every second no count of links."""
    k = F.col("p_partkey")
    result = _named(domain_authority=k % 100, external_pages_to_root_domain=F.when(k % 2 == 0, k), root_domains_to_root_domain=F.col("p_size"))
    body = F.when(k % 9 > 0, _json(results=F.array(result))).otherwise('{"results": []}')
    return responses.url_metrics(table(spark, sf, "part").select(k, body.alias("body"))).select("p_partkey", "domain_authority", "links", "linking_root_domains")


@query(
    "s15_linking_domains",
    """SELECT target, 'd' || o_orderkey AS domain, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 10 ELSE 1 END AS BIGINT) AS links_to_target
FROM (SELECT o_custkey % 40 AS target, o_orderkey FROM orders) QUALIFY row_number() OVER (PARTITION BY target ORDER BY o_orderkey) <= 50""",
)
def s15_domains(spark, sf):
    """Responses of more domains than are kept, ordered by the vendor."""
    k = F.col("o_orderkey")
    pages = F.when(k % 2 == 0, _named(pages=k % 10))
    listed = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("target")).agg(F.array_sort(F.collect_list(F.struct(k, pages.alias("to_target")))).alias("x"))
    results = F.transform("x", lambda x: F.struct(F.concat(F.lit("d"), x["o_orderkey"].cast("string")).alias("root_domain"), x["to_target"].alias("to_target")))
    return responses.linking_domains(listed.select("target", _json(results=results).alias("body"))).select("target", "domain", "links_to_target")


@query(
    "s15_anchor_texts",
    "SELECT p_partkey, p_name AS anchor_text, CAST(p_size AS BIGINT) AS external_links, CAST(0 AS BIGINT) AS linking_domains FROM part UNION ALL SELECT p_partkey, '', 1, CAST(p_partkey % 6 AS BIGINT) FROM part",
)
def s15_anchors(spark, sf):
    k = F.col("p_partkey")
    one = _named(anchor_text=F.col("p_name"), external_pages=F.col("p_size"), external_root_domains=F.lit(None).cast("long"))
    two = _named(anchor_text=F.lit(None).cast("string"), external_pages=F.lit(1), external_root_domains=k % 6)
    return responses.anchor_texts(table(spark, sf, "part").select(k, _json(results=F.array(one, two)).alias("body")))


@query(
    "s15_top_pages",
    "SELECT p_partkey, 'https://a.example/' || p_partkey AS url, CAST(p_size AS DOUBLE) AS page_authority, CAST(p_partkey % 17 AS BIGINT) AS links, CAST(0 AS BIGINT) AS linking_domains FROM part",
)
def s15_pages(spark, sf):
    k = F.col("p_partkey")
    page = _named(page=F.concat(F.lit("https://a.example/"), k.cast("string")), page_authority=F.col("p_size"), external_pages_to_page=k % 17)
    return responses.top_pages(table(spark, sf, "part").select(k, _json(results=F.array(page)).alias("body")))


def _language(spark, sf):
    k = F.col("p_partkey")
    entity = lambda name, salience, mentions: _named(name=F.lit(name), type=F.when(k % 2 == 0, "PERSON"), salience=salience, mentions=mentions)
    mention = F.array_repeat(_named(type=F.lit("PROPER")), (k % 3).cast("int"))
    found = F.array(entity("a", (k % 5) / 10, mention), entity("b", F.lit(0.25), F.lit(None).cast("array<struct<type:string>>")), entity("c", F.lit(None).cast("double"), mention))
    feeling = lambda score: _named(score=score, magnitude=k % 4)
    sentences = F.array(_named(sentiment=feeling(F.lit(0.5))), _named(sentiment=feeling((k % 9 - 6) / 8)))
    scored = F.when(k % 10 > 0, feeling((k % 21 - 10) / 10))
    judged = F.array(_named(name=F.lit("Toxic"), confidence=(k % 8) / 8), _named(name=F.lit("Insult"), confidence=F.lit(0.5)))
    body = _json(entities=found, documentSentiment=scored, sentences=sentences, moderationCategories=judged, categories=F.array(_named(name=F.lit("/News"), confidence=(k % 8) / 8)))
    return table(spark, sf, "part").select(k, body.alias("body"))


@query(
    "s19_entities",
    """SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY salience DESC, name) AS INTEGER) AS rank, name, CASE WHEN p_partkey % 2 = 0 THEN 'PERSON' ELSE 'UNKNOWN' END AS type, salience, n AS mention_count
FROM (SELECT p_partkey, 'a' AS name, (p_partkey % 5) / 10 AS salience, CAST(p_partkey % 3 AS INTEGER) AS n FROM part UNION ALL SELECT p_partkey, 'b', 0.25, 0 FROM part UNION ALL SELECT p_partkey, 'c', 0, CAST(p_partkey % 3 AS INTEGER) FROM part)""",
)
def s19_entities(spark, sf):
    return responses.entities(_language(spark, sf)).select("p_partkey", "rank", "name", "type", "salience", "mention_count")


@query(
    "s19_sentiments",
    """SELECT p_partkey, round(s, 3) AS score, CASE WHEN s > 0.25 THEN 'positive' WHEN s < -0.25 THEN 'negative' ELSE 'neutral' END AS tone, CASE p_partkey % 4 WHEN 3 THEN 'high' WHEN 0 THEN 'low' ELSE 'moderate' END AS emotion,
CAST(2 AS INTEGER) AS sentence_count, greatest(0.5, (p_partkey % 9 - 6) / 8) AS most_positive, least(0.5, (p_partkey % 9 - 6) / 8) AS most_negative FROM (SELECT p_partkey, (p_partkey % 21 - 10) / 10 AS s FROM part WHERE p_partkey % 10 > 0)""",
)
def s19_sentiments(spark, sf):
    return responses.sentiments(_language(spark, sf)).drop("magnitude")


@query("s19_moderation", "SELECT p_partkey, 'Toxic' AS name, (p_partkey % 8) / 8 AS confidence FROM part WHERE p_partkey % 8 > 4")
def s19_moderation(spark, sf):
    return responses.moderation(_language(spark, sf))


@query("s29_fresh_cache", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-08-02' - INTERVAL 90 DAY")
def s29(spark, sf):
    return responses.fresh(table(spark, sf, "orders"), "o_orderdate", now=F.lit("1998-08-02").cast("timestamp")).select("o_orderkey")


def _new_store(spark, name: str) -> str:
    return f"{shared_dir(spark)}/pagequarry/{name}-{uuid.uuid4().hex}"


def _snapshot_store(spark, sf) -> str:
    """Two appends of all customers; the second changes the titles of every third."""
    path, k = _new_store(spark, "snapshots"), F.col("c_custkey")
    pages = table(spark, sf, "customer").select(k.cast("string").alias("url_hash"), F.concat(F.lit("https://a.example/"), k.cast("string")).alias("url"), F.lit("a").alias("title"), F.lit(200).alias("status_code"), k.alias("unknown_column"))
    store.append_snapshots(pages, path)
    store.append_snapshots(pages.withColumn("title", F.when(F.col("url_hash").cast("long") % 3 == 0, "b").otherwise("a")), path)
    return path


@query("k02_snapshot_store", "SELECT CAST(c_custkey AS VARCHAR) AS url_hash, CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'a' END AS title, CAST(2 AS BIGINT) AS versions FROM customer")
def k02(spark, sf):
    stored = store.snapshots(spark, _snapshot_store(spark, sf))
    return drift.latest(stored).join(stored.groupBy("url_hash").agg(F.count_distinct("id").alias("versions")), "url_hash").select("url_hash", "title", "versions")


@query(
    "k03_comparison_store",
    "SELECT CAST(c_custkey AS VARCHAR) AS url_hash, CAST(0 AS BIGINT) AS critical, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS warning, CAST(0 AS BIGINT) AS info, CAST(17 AS INTEGER) AS results FROM customer",
)
def k03(spark, sf):
    """The latest snapshots against the first ones, chosen by id, appended and read back."""
    stored, path = store.snapshots(spark, _snapshot_store(spark, sf)), _new_store(spark, "comparisons")
    first = drift.chosen(stored, stored.groupBy("url_hash").agg(F.min("id").alias("id")))
    store.append_comparisons(drift.compare(drift.latest(stored), first), path, F.lit("2024-01-01").cast("timestamp"))
    rows = store.comparisons(spark, path)
    return rows.select("url_hash", "critical", "warning", "info", F.json_array_length("results").alias("results"))


@query("k08_ledger_store", "SELECT CAST(ts AS DATE) AS day, count(*) AS entries, round(sum(value), 4) AS spent FROM events GROUP BY 1")
def k08(spark, sf):
    """All events as entries, in two appends."""
    path = _new_store(spark, "ledger")
    entries = table(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("endpoint"), F.col("value").alias("cost"), F.col("props").alias("detail"))
    early = F.col("timestamp") < "2024-01-15"
    store.append_ledger(entries.where(early), path)
    store.append_ledger(entries.where(~early), path)
    return store.ledger(spark, path).groupBy("day").agg(F.count("*").alias("entries"), F.round(F.sum("cost"), 4).alias("spent"))


@query(
    "h18_page_types",
    """SELECT k AS p_partkey, CASE WHEN k % 11 = 0 THEN 'Tool' WHEN k % 2 = 0 AND k % 3 = 0 THEN 'Local' WHEN k % 5 = 0 AND k % 2 = 0 THEN 'Comparison' WHEN k % 3 = 1 AND k % 5 = 1 THEN 'Product'
WHEN k % 7 = 0 AND k % 2 = 1 THEN 'Landing Page' WHEN k % 4 = 0 AND k % 7 = 1 THEN 'Service Page' WHEN k % 13 = 0 AND k % 2 = 0 THEN 'Hybrid' ELSE 'Blog Post' END AS page_type FROM (SELECT p_partkey AS k FROM part)""",
)
def h18(spark, sf):
    k = F.col("p_partkey")
    even = k % 2 == 0
    signals = {
        "tool": k % 11 == 0, "address": even, "map": k % 3 == 0, "comparison_table": k % 5 == 0, "versus": even, "price": k % 3 == 1, "buy_button": k % 5 == 1, "many_calls": k % 7 == 0,
        "little_navigation": ~even, "process": k % 4 == 0, "case_studies": k % 7 == 1, "educational": k % 13 == 0, "calls": even,
    }
    return table(spark, sf, "part").select(k, detection.page_type(signals).alias("page_type"))


_SIGNALS = "(0, 'SaaS', 'pricing'), (0, 'SaaS', 'trial'), (1, 'E-commerce', 'cart'), (1, 'E-commerce', 'add'), (2, 'Publisher', 'blog'), (2, 'Publisher', 'on'), (3, 'Agency', 'portfolio'), (3, 'Agency', 'work'), (4, 'Local Service', 'phone'), (4, 'Local Service', 'address'), (5, 'Publisher', 'blog'), (5, 'SaaS', 'trial')"
_KINDS = "('SaaS', 0), ('Local Service', 1), ('E-commerce', 2), ('Publisher', 3), ('Agency', 4)"


@query(
    "h19_business_types",
    f"""WITH met AS (SELECT DISTINCT p_partkey // 3 AS site, kind, signal FROM part JOIN (VALUES {_SIGNALS}) s(r, kind, signal) ON p_partkey % 7 = r), counts AS (SELECT site, kind, count(*) AS n FROM met GROUP BY 1, 2),
ranked AS (SELECT site, kind, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, o) AS k FROM counts JOIN (VALUES {_KINDS}) t(kind, o) USING (kind))
SELECT a.site, a.kind, a.n AS n_signals, b.kind AS second, coalesce(a.n = b.n, false) AS ambiguous FROM ranked a LEFT JOIN ranked b ON a.site = b.site AND b.k = 2 WHERE a.k = 1""",
)
def h19(spark, sf):
    k = F.col("p_partkey")
    paths, texts = ("/pricing", "/cart", "/blog/x", "/portfolio", "/", "/blog", "/"), ("Free trial today", "Add to cart", "Published on Monday", "Our work", "Phone and address", "free trial", "nothing")
    of = lambda values: F.get(F.array(*map(F.lit, values)), (k % 7).cast("int"))
    pages = table(spark, sf, "part").select(F.floor(k / 3).alias("site"), of(paths).alias("path"), of(texts).alias("text"))
    return detection.business_type(pages)


@query(
    "t20_locale_markers",
    """SELECT p_partkey AS page_id, lang, marker, severity, CAST(n AS INTEGER) AS n FROM (SELECT p_partkey, p_partkey % 6 AS r, CASE p_partkey % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'ja' ELSE 'fr-FR' END AS lang FROM part)
JOIN (VALUES (0, 'foreign-brand', 'Medium', 1), (1, 'foreign-statistics', 'Medium', 1), (2, 'aggressive-call', 'Low', 1), (3, 'foreign-law', 'High', 1), (4, 'currency-or-unit', 'High', 2), (5, 'untranslated', 'Medium', 2)) m(r, marker, severity, n) USING (r)
WHERE lang <> 'en' AND (marker <> 'aggressive-call' OR lang IN ('de', 'ja')) AND (marker <> 'currency-or-unit' OR lang <> 'ja')""",
)
def t20(spark, sf):
    k = F.col("p_partkey")
    texts = ("Walmart und andere", "Wie 80% of Americans sagen", "BUY NOW!", "nach CCPA", "nur $5 je 3 miles", "Read more, learn more")
    lang = F.when(k % 4 == 0, "de").when(k % 4 == 1, "en").when(k % 4 == 2, "ja").otherwise("fr-FR")
    return detection.locale_markers(table(spark, sf, "part").select(k.alias("page_id"), lang.alias("lang"), F.get(F.array(*map(F.lit, texts)), (k % 6).cast("int")).alias("text")))


@query(
    "a24_link_velocity",
    """WITH links AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE -(o_custkey % 20) END AS target, CASE WHEN o_orderkey % 3 = 0 THEN 'com' ELSE 'org' END AS tld, o_orderdate AS first_seen,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + CAST(o_orderkey % 5 AS INTEGER) * INTERVAL 40 DAY END AS lost_at FROM orders),
weeks AS (SELECT target, CAST(date_trunc('week', first_seen) AS DATE) AS period, count(*) AS n, count(DISTINCT tld) AS tlds FROM links GROUP BY 1, 2),
earlier AS (SELECT *, sum(n) OVER w AS before, date_diff('day', min(period) OVER w, period) / 7 AS since FROM weeks WINDOW w AS (PARTITION BY target ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gained AS (SELECT target, CAST(date_trunc('month', first_seen) AS DATE) AS period, count(*) AS g FROM links GROUP BY 1, 2),
gone AS (SELECT target, CAST(date_trunc('month', lost_at) AS DATE) AS period, count(*) AS l FROM links WHERE lost_at IS NOT NULL GROUP BY 1, 2),
months AS (SELECT target, period, coalesce(g, 0) AS g, coalesce(l, 0) AS l FROM gained FULL JOIN gone USING (target, period)),
alive AS (SELECT target, period, l, sum(g - l) OVER (PARTITION BY target ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS alive FROM months),
gaps AS (SELECT target, period, date_diff('month', period, coalesce(lead(period) OVER (PARTITION BY target ORDER BY period), DATE '2001-09-01')) - 1 AS n FROM gained)
SELECT target, 'spike' AS flag, period, n FROM earlier WHERE n * since >= before * 10
UNION ALL SELECT target, 'same-tld', period, n FROM weeks WHERE n >= 5 AND tlds = 1
UNION ALL SELECT target, 'losses', period, l FROM alive WHERE alive > 0 AND l >= alive * 0.5
UNION ALL SELECT target, 'quiet', CAST(period + INTERVAL 1 MONTH AS DATE), n FROM gaps WHERE n >= 3""",
)
def a24_links(spark, sf):
    """Orders as links, of half of the customers each for itself and of the others in few groups."""
    k, c, seen = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    lost = F.when(k % 3 == 0, seen + F.make_dt_interval(((k % 5) * 40).cast("int")))
    links = table(spark, sf, "orders").select(F.when(c % 2 == 0, c).otherwise(-(c % 20)).alias("target"), F.when(k % 3 == 0, "com").otherwise("org").alias("tld"), seen.alias("first_seen"), lost.alias("lost_at"))
    return detection.link_velocity(links, F.lit("2001-08-01").cast("date"))


@query(
    "a25_review_rates",
    """WITH r AS (SELECT user_id AS business, event_id % 5 + 1 AS rating, CAST(ts AS DATE) AS day, event_id % 4 = 0 AS answered FROM events),
gaps AS (SELECT business, max(date_diff('day', day, following)) AS longest_gap FROM (SELECT business, day, coalesce(lead(day) OVER (PARTITION BY business ORDER BY day), DATE '2024-01-31') AS following FROM (SELECT DISTINCT business, day FROM r)) GROUP BY 1)
SELECT business, count(*) AS reviews, round(count(*) / 6, 4) AS per_month, round(avg(answered::INT), 4) AS response_rate, round(count(*) FILTER (WHERE rating = 5) / count(*), 4) AS stars_5, round(count(*) FILTER (WHERE rating = 1) / count(*), 4) AS stars_1,
CAST(any_value(longest_gap) AS INTEGER) AS longest_gap, any_value(longest_gap) > 21 AS ranking_risk FROM r JOIN gaps USING (business) GROUP BY 1""",
)
def a25_rates(spark, sf):
    reviews = table(spark, sf, "events").select(F.col("user_id").alias("business"), (F.col("event_id") % 5 + 1).alias("rating"), "ts", (F.col("event_id") % 4 == 0).alias("answered"))
    rates = detection.review_velocity(reviews, F.lit("2024-01-31").cast("date"))
    return rates.select("business", "reviews", *[F.round(c, 4).alias(c) for c in ("per_month", "response_rate", "stars_5", "stars_1")], "longest_gap", "ranking_risk")


@query("a27_price_rating", "SELECT p_brand, count(*) AS n, round(corr(p_retailprice, p_size), 6) AS correlation FROM part GROUP BY 1")
def a27_rating(spark, sf):
    return detection.price_rating(table(spark, sf, "part"), ["p_brand"], "p_retailprice", "p_size").withColumn("correlation", F.round("correlation", 6))


@query(
    "g07_heat_rows",
    """WITH points AS (SELECT p_partkey // 49 AS keyword, p_partkey % 49 // 7 AS "row", p_partkey % 7 AS col, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 25 + 1 END AS rank FROM part),
sized AS (SELECT *, max("row") OVER (PARTITION BY keyword) AS rows_, max(col) OVER (PARTITION BY keyword) AS cols_ FROM points)
SELECT keyword, "row", string_agg(CASE WHEN "row" * 2 = rows_ AND col * 2 = cols_ THEN '[' || s || ']' ELSE s END, ' ' ORDER BY col) AS line
FROM (SELECT *, CASE WHEN rank <= 9 THEN CAST(rank AS VARCHAR) WHEN rank = 10 THEN '9' WHEN rank <= 20 THEN '+' ELSE '-' END AS s FROM sized) GROUP BY 1, 2""",
)
def g07(spark, sf):
    k = F.col("p_partkey")
    points = table(spark, sf, "part").select(F.floor(k / 49).alias("keyword"), F.floor(k % 49 / 7).alias("row"), (k % 7).alias("col"), F.when(k % 5 > 0, k % 25 + 1).alias("rank"))
    return detection.heat_rows(points)
