"""Queries over the audits, whole tables throughout.

The driver's tables stand in for saved responses: parts for vendor records and images, orders and line items for
links and listings, events for reviews. Vendor records are written as JSON and read back, the SQL works on the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import audits

from ._sql import listed, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _records(spark, sf, **fields):
    """part as (p_partkey, raw): JSON of the fields; those that are null are left out."""
    return table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("raw"))


@query(
    "p14_merchant_items",
    """SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS price, CASE WHEN p_partkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'shop ' || p_brand END AS seller, CASE WHEN p_partkey % 4 = 3 THEN 0.0 ELSE (p_size % 50) / 10.0 END AS rating, CAST(p_size AS BIGINT) AS reviews_count,
CASE p_partkey % 4 WHEN 0 THEN 'in_stock' WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'preorder' ELSE 'unknown' END AS availability, CASE WHEN p_partkey % 7 = 0 THEN 'A' || p_partkey END AS asin, CASE WHEN p_partkey % 7 = 0 THEN p_size > 25 END AS is_prime FROM part""",
)
def p14(spark, sf):
    k = F.col("p_partkey")
    stars = (F.col("p_size") % 50) / 10.0
    raw = table(spark, sf, "part").select(
        "p_partkey",
        F.to_json(F.struct(
            F.col("p_name").alias("title"), F.when(k % 5 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.format_number("p_retailprice", 2))).alias("price"), F.when(k % 3 == 0, " euro").alias("currency"),
            F.when(k % 2 == 0, F.col("p_brand")).alias("seller"), F.concat(F.lit("shop "), "p_brand").alias("seller_name"),
            F.when(k % 4 == 0, F.struct(stars.alias("value"))).alias("rating"), F.col("p_size").cast("string").alias("reviews_count"),
            F.when(k % 4 == 0, "In Stock now").when(k % 4 == 1, "Out of stock").when(k % 4 == 2, "Pre-order").alias("availability"),
            F.when(k % 7 == 0, F.concat(F.lit("A"), k.cast("string"))).alias("asin"), F.when(k % 7 == 0, F.col("p_size") > 25).alias("is_prime"),
        )).alias("raw"),
        F.to_json(F.struct(stars.alias("rating"))).alias("plain"),
    )
    # Half of the ratings stand alone: the first object's rating is taken out of it.
    alone = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("{"), F.substring("plain", 2, 100), F.lit(""))).alias("x")
    raw = raw.withColumn("x", alone).withColumn("raw", F.when(k % 4 == 1, F.concat(F.regexp_replace("x", r"\}$", ","), F.substring("raw", F.lit(2), F.length("raw")))).when(k % 4 == 2, F.concat(F.regexp_replace("plain", r"\}$", ","), F.substring("raw", F.lit(2), F.length("raw")))).otherwise(F.col("raw")))
    made = audits.merchant_items(raw.select("p_partkey", "raw"))
    return made.select("p_partkey", "title", "price", "currency", "seller", "rating", "reviews_count", "availability", "asin", "is_prime")


@query("p15_social_items", "SELECT p_partkey, 'u' || p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_brand ELSE 'unknown' END AS platform, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS BIGINT) AS engagement_count, CAST(p_size * 2 AS BIGINT) AS likes, 'neutral' AS sentiment FROM part")
def p15_social(spark, sf):
    k = F.col("p_partkey")
    raw = _records(spark, sf, url=F.concat(F.lit("u"), k.cast("string")), platform=F.when(k % 3 == 0, F.col("p_type")), source=F.when(k % 3 == 1, F.col("p_brand")), social_count=F.when(k % 2 == 0, F.col("p_size")), likes=F.col("p_size") * 2)
    return audits.social_items(raw).select("p_partkey", "url", "platform", "engagement_count", "likes", "sentiment")


@query("p15_review_items", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Anonymous' END AS author, round(p_size / 10.0, 1) AS rating, p_name AS text, p_partkey % 4 = 0 AS verified, CAST(p_size AS BIGINT) AS helpful_count FROM part")
def p15_reviews(spark, sf):
    k = F.col("p_partkey")
    raw = _records(spark, sf, profile_name=F.when(k % 2 == 0, F.col("p_brand")), rating=(F.col("p_size") / 10.0).cast("string"), review_text=F.col("p_name"), is_verified=F.when(k % 4 == 0, F.lit(True)), likes=F.col("p_size"))
    return audits.review_items(raw).select("p_partkey", "author", "rating", "text", "verified", "helpful_count")


@query("p16_sellers", "SELECT p_partkey, 'bazaar' AS marketplace, p_name AS title, p_brand AS seller_name, round(p_size / 10.0, 1) AS seller_rating, round(p_retailprice, 2) AS price FROM part")
def p16(spark, sf):
    raw = _records(spark, sf, title=F.col("p_name"), seller_name=F.col("p_brand"), seller_rating=F.col("p_size") / 10.0, price=F.col("p_retailprice"))
    products = audits.product_items(raw, "bazaar").select("p_partkey", "marketplace", "title")
    return products.join(audits.seller_items(raw).select("p_partkey", "seller_name", "seller_rating", "price"), "p_partkey")


@query(
    "h13_image_audit",
    """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'missing' WHEN p_partkey % 6 = 1 THEN 'decorative' WHEN length(a) < 10 THEN 'short' WHEN length(a) > 125 THEN 'long' ELSE 'ok' END AS alt_status, p_partkey % 4 > 0 AS has_dimensions,
p_partkey % 3 = 1 AS modern_format, CASE WHEN kb > hi THEN 'critical' WHEN kb > mid THEN 'warning' WHEN kb < lo THEN 'target' ELSE 'over-target' END AS size_tier
FROM (SELECT p_partkey, repeat(p_name, CAST(1 + p_size % 12 AS INTEGER)) AS a, p_size * 15.0 AS kb, [50, 100, 200][1 + p_partkey % 3] AS lo, [100, 200, 300][1 + p_partkey % 3] AS mid, [200, 500, 700][1 + p_partkey % 3] AS hi FROM part)""",
)
def h13(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "thumbnail").when(k % 3 == 1, "content").otherwise("hero")
    images = table(spark, sf, "part").select(
        "p_partkey", F.when(k % 3 == 1, "/a/b.WebP?v=1").otherwise("/a.png").alias("src"), F.when(k % 6 == 1, " ").when(k % 6 > 1, F.repeat(F.col("p_name"), (1 + F.col("p_size") % 12).cast("int"))).alias("alt"),
        F.when(k % 4 > 0, 10).alias("width"), F.when(k % 4 > 0, 10).alias("height"), (F.col("p_size") * 15 * 1024).alias("bytes"), name.alias("category"),
    )
    return audits.image_audit(images).select("p_partkey", "alt_status", "has_dimensions", "modern_format", "size_tier")


_GATES = " UNION ALL ".join(f"SELECT '{k}' AS page_type, {w} AS least, {u} AS own, {i} AS i" for i, (k, (w, u)) in enumerate(audits.PAGE_GATES.items()))


@query("t16_thin_content", f"SELECT p_partkey, p_size * 40 < least AS too_short, p_partkey % 101 < own AS too_alike FROM part LEFT JOIN ({_GATES}) ON p_partkey % 11 = i")
def t16(spark, sf):
    k = F.col("p_partkey")
    kind = F.get(F.array(*[F.lit(k) for k in audits.PAGE_GATES]), (k % 11).cast("int"))
    pages = table(spark, sf, "part").select("p_partkey", kind.alias("page_type"), (F.col("p_size") * 40).alias("words"), (k % 101).alias("unique_pct"))
    return audits.thin_content(pages).select("p_partkey", "too_short", "too_alike")


@query("h16_security_headers", "SELECT p_partkey, p_partkey % 2 = 0 AS csp, p_partkey % 3 = 0 AS hsts, p_partkey % 5 = 0 AS referrer_policy, CAST(5 - (p_partkey % 2 = 0)::INT - (p_partkey % 3 = 0)::INT - (p_partkey % 5 = 0)::INT AS BIGINT) AS missing FROM part")
def h16(spark, sf):
    k = F.col("p_partkey")
    some = lambda n, name: F.when(k % n == 0, F.create_map(F.lit(name), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    headers = F.map_concat(some(2, "Content-Security-Policy"), some(3, "STRICT-transport-security"), some(5, "referrer-policy"), F.create_map(F.lit("Server"), F.lit("x")))
    rows = audits.security_headers(table(spark, sf, "part").select("p_partkey", headers.alias("headers")))
    return rows.select("p_partkey", "csp", "hsts", "referrer_policy", F.size("missing_headers").cast("long").alias("missing"))


@query(
    "h17_crawler_matrix",
    f"""SELECT s_suppkey AS site, crawler, CASE WHEN crawler IN ({listed(audits.USER_TRIGGERED)}) THEN 'user-triggered' WHEN crawler = 'GPTBot' AND s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'partial' ELSE 'blocked' END
WHEN s_suppkey % 3 = 0 THEN 'partial' ELSE 'allowed' END AS status FROM supplier CROSS JOIN (SELECT unnest([{listed(audits.CRAWLERS)}]) AS crawler)""",
)
def h17(spark, sf):
    s = F.col("s_suppkey")
    sites = table(spark, sf, "supplier").select(s.alias("site"))
    line = lambda test, agent, directive, path: table(spark, sf, "supplier").where(test).select(s.alias("site"), F.lit(agent).alias("agent"), F.lit(directive).alias("directive"), F.lit(path).alias("path"))
    rules = line("s_suppkey % 2 = 0", "gptbot", "Disallow", "/").union(line("s_suppkey % 4 = 0", "GPTBot", "allow", "/")).union(line("s_suppkey % 3 = 0", "*", "disallow", "/private")).union(line("s_suppkey % 3 = 1", "*", "disallow", ""))
    return audits.crawler_matrix(sites, rules)


@query("t12_keyword_placement", "SELECT p_partkey, p_partkey % 2 = 0 AS in_title, p_partkey % 3 = 0 AS in_slug, p_partkey % 5 < 2 AS in_first_words, p_partkey % 7 = 0 AS in_alt, CAST((p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT + (p_partkey % 5 < 2)::INT + (p_partkey % 7 = 0)::INT AS INTEGER) AS placements FROM part")
def t12(spark, sf):
    k = F.col("p_partkey")
    word = F.concat(F.lit("Key "), k.cast("string"), F.lit("z"))
    far = F.concat(F.repeat(F.lit("w "), F.when(k % 5 == 0, 1).when(k % 5 == 1, 98).otherwise(99)), word)
    pages = table(spark, sf, "part").select(
        "p_partkey", word.alias("keyword"), F.when(k % 2 == 0, F.upper(word)).alias("title"), F.lit("other").alias("h1"), F.when(k % 3 == 0, F.concat(F.lit("/x/key-"), k.cast("string"), F.lit("z"))).alias("slug"),
        F.lit(None).cast("string").alias("meta"), far.alias("text"), F.array(F.lit("alt"), F.when(k % 7 == 0, word)).alias("alts"),
    )
    return audits.keyword_placement(pages).select("p_partkey", "in_title", "in_slug", "in_first_words", "in_alt", "placements")


@query("t11_reading_ease", "SELECT p_partkey, round(206.835 - 1.015 * (3.0 * (1 + p_size % 9)) / (1 + p_partkey % 3) - 84.6 * (4.0 * (1 + p_size % 9)) / (3 * (1 + p_size % 9)), 1) AS ease FROM part WHERE 1 + p_size % 9 >= 1 + p_partkey % 3 UNION ALL SELECT p_partkey, round(206.835 - 1.015 * (3.0 * (1 + p_size % 9)) / (1 + p_size % 9) - 84.6 * (4.0 * (1 + p_size % 9)) / (3 * (1 + p_size % 9)), 1) FROM part WHERE 1 + p_size % 9 < 1 + p_partkey % 3")
def t11(spark, sf):
    """Texts of 1 to 9 clauses of three words and four syllables, one to three of which end a sentence."""
    k = F.col("p_partkey")
    n, ends = 1 + F.col("p_size") % 9, F.least(1 + F.col("p_size") % 9, 1 + k % 3)
    text = F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit("the cat retold"), F.when(i > n - ends, ".").otherwise(","))), " ")
    return table(spark, sf, "part").select("p_partkey", audits.reading_ease(text).alias("ease"))


@query("t19_expanded_keywords", "SELECT s_suppkey, CAST(22 + 1 AS BIGINT) AS variants, 'best tool ' || s_suppkey AS best FROM supplier")
def t19(spark, sf):
    seeds = table(spark, sf, "supplier").select(F.concat(F.lit("The Tool "), F.col("s_suppkey").cast("string")).alias("seed"))
    found = audits.expanded_keywords(seeds).groupBy("seed").agg(F.count("*").alias("variants"), F.max(F.when(F.col("keyword").startswith("best"), F.col("keyword"))).alias("best"))
    return found.select(F.regexp_extract("seed", r"(\d+)", 1).cast("long").alias("s_suppkey"), "variants", "best")


_SCORED = "SELECT o_custkey AS page, o_orderkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN (o_orderkey % 11) / 10.0 END AS score, o_totalprice AS savings FROM orders"


def _scored(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("page"), k.alias("id"), F.when(k % 9 > 0, (k % 11) / 10.0).alias("score"), F.col("o_totalprice").alias("savings"))


@query("j09_category_audits", f"SELECT page, id, score, score >= 0.9 AS pass FROM ({_SCORED}) WHERE score IS NOT NULL AND id % 2 = 0")
def j09(spark, sf):
    rows = _scored(spark, sf)
    refs = rows.where("id % 2 = 0").select("page", F.lit("seo").alias("category"), "id")
    return audits.category_audits(refs, rows.select("page", "id", "score")).select("page", "id", "score", "pass")


@query("j10_failed_audits", f"SELECT page, id, score FROM ({_SCORED}) WHERE score < 0.9 AND id % 3 > 0")
def j10(spark, sf):
    rows = _scored(spark, sf)
    return audits.failed_audits(rows, rows.where("id % 3 = 0")).select("page", "id", "score")


@query("l03_opportunities", f"SELECT page, id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY savings DESC, id) AS place FROM ({_SCORED})) WHERE place <= 3")
def l03(spark, sf):
    return audits.top_per_page(_scored(spark, sf), [F.desc("savings"), F.col("id")], 3).select("page", "id", "place")


@query(
    "j14_keyword_gaps",
    """SELECT p_partkey AS keyword, CASE WHEN a AND b THEN 'both' WHEN a THEN 'organic-only' WHEN b THEN 'shopping-only' ELSE 'neither' END AS gap
FROM (SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47) AS a, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) AS b FROM part)""",
)
def j14(spark, sf):
    k = F.col("p_partkey")
    lines = table(spark, sf, "lineitem").withColumn("keyword", F.col("l_partkey"))
    return audits.keyword_gaps(lines.where("l_quantity > 47"), lines.where("l_discount > 0.09"), table(spark, sf, "part").select(k.alias("keyword")))


@query(
    "j16_listing_consistency",
    """SELECT c_custkey AS business, unnest(['name', 'address', 'phone']) AS field, unnest(['exact', CASE WHEN c_custkey % 4 = 0 THEN 'conflicting' WHEN c_custkey % 4 = 1 THEN 'partial' ELSE 'exact' END, CASE WHEN c_custkey % 3 = 0 THEN 'missing' ELSE 'exact' END]) AS status,
unnest([NULL, CASE WHEN c_custkey % 4 < 2 THEN 'High' END, CASE WHEN c_custkey % 3 = 0 THEN 'Medium' END]) AS severity FROM customer""",
)
def j16(spark, sf):
    k = F.col("c_custkey")
    source = lambda n: table(spark, sf, "customer").select(
        k.alias("business"), F.lit(n).alias("source"), F.col("c_name").alias("name"), F.concat(F.lit("Main St. "), (k if n == "a" else F.when(k % 4 == 0, k + 1).otherwise(k)).cast("string"), F.lit("" if n == "a" else "")).alias("address0"), F.when((k % 3 > 0) | F.lit(n == "a"), F.lit("555-0100")).alias("phone"),
    )
    rows = source("a").union(source("b")).withColumn("address", F.when((F.col("source") == "b") & (F.col("business") % 4 == 1), F.upper(F.replace("address0", F.lit("."), F.lit("")))).otherwise(F.col("address0")))
    return audits.listing_consistency(rows)


@query("j17_linked_missing_pages", "SELECT l_partkey AS url, count(*) AS links, count(DISTINCT l_suppkey) AS domains FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0) GROUP BY 1")
def j17(spark, sf):
    k = F.col("p_partkey")
    crawl = table(spark, sf, "part").select(k.alias("url"), F.when(F.col("p_size") % 5 == 0, 404).otherwise(200).alias("status_code"))
    return audits.linked_missing_pages(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("url"), F.col("l_suppkey").alias("domain")), crawl)


_COUNTS = "SELECT l_partkey AS url, l_orderkey * 10 + l_linenumber AS page, CAST(l_quantity AS BIGINT) AS n FROM lineitem"


def _counts(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page"), F.col("l_quantity").cast("long").alias("count"))


@query("a18_link_totals", f"SELECT count(*) AS targets, CAST(sum(n) AS BIGINT) AS links FROM (SELECT url, arg_max(n, page) AS n FROM ({_COUNTS}) GROUP BY url)")
def a18(spark, sf):
    return audits.link_totals(_counts(spark, sf))


@query("l05_top_targets", f"SELECT url, arg_max(n, page) AS count FROM ({_COUNTS}) GROUP BY url ORDER BY 2 DESC, 1 LIMIT 10")
def l05(spark, sf):
    return audits.top_targets(_counts(spark, sf))


@query("a11_verification_histogram", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS verified, count(*) FILTER (WHERE o_orderkey % 9 = 1) AS lost, count(*) FILTER (WHERE o_orderkey % 9 = 5) AS exists, count(*) FILTER (WHERE o_orderkey % 9 IN (6, 7, 8)) AS error FROM orders")
def a11(spark, sf):
    status = F.get(F.array(*[F.lit(v) for v in (*audits.VERIFIED, "timeout")]), (F.col("o_orderkey") % 9).cast("int"))
    return audits.verification_histogram(table(spark, sf, "orders").select(status.alias("status"))).select("total", "verified", "lost", "exists", "error")


@query(
    "v22_toxic_links",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey AS domain, CASE WHEN l_partkey % 5 = 0 THEN 'a' || l_partkey ELSE '' END AS anchor, CAST(l_quantity * l_quantity * 5 AS BIGINT) AS o, CAST(l_linenumber * 10 AS BIGINT) AS age, l_tax * 12 AS ratio, l_returnflag = 'R' AS nf FROM lineitem),
x AS (SELECT anchor, count(DISTINCT domain) AS n FROM l WHERE anchor <> '' GROUP BY 1), q AS (SELECT domain, bool_and(nf) AS only_nf FROM l GROUP BY 1)
SELECT tier, count(*) AS n FROM (SELECT CASE WHEN o >= 10000 OR (age < 30 AND o >= 100) OR coalesce(x.n, 0) >= 5 THEN 'spam' WHEN ratio > 0.9 OR o > 50 THEN 'likely' WHEN only_nf THEN 'monitor' END AS tier FROM l LEFT JOIN x USING (anchor) JOIN q USING (domain)) GROUP BY tier""",
)
def v22(spark, sf):
    links = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("domain"), F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("a"), F.col("l_partkey").cast("string"))).otherwise("").alias("anchor"),
        (F.col("l_quantity") * F.col("l_quantity") * 5).cast("long").alias("outbound_links"), (F.col("l_linenumber") * 10).alias("age_days"), (F.col("l_tax") * 12).alias("outbound_ratio"), (F.col("l_returnflag") == "R").alias("nofollow"),
    )
    return audits.toxic_links(links).groupBy("tier").agg(F.count("*").alias("n"))


@query(
    "v23_fake_review_flags",
    """WITH e AS (SELECT event_id, user_id AS business, event_id % 5 AS reviews, event_id % 4 = 0 AS away, CAST(1 + event_id % 5 AS INTEGER) AS rating, event_type || (event_id % 1000) AS t, ts FROM events),
h AS (SELECT business, date_trunc('hour', ts) AS hour, count(*) AS n FROM e GROUP BY ALL), d AS (SELECT business, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE rating = 5) AS fives FROM e GROUP BY ALL),
m AS (SELECT business, avg(n) AS mean, avg(fives) AS five FROM d GROUP BY 1), s AS (SELECT t, count(*) AS n FROM e GROUP BY 1)
SELECT event_id, CAST((h.n > 1)::INT + (reviews <= 1)::INT + away::INT + (rating = 5 AND d.fives > 1 AND d.fives >= 3.0 * m.five)::INT + (s.n > 1)::INT + (d.n > 1 AND d.n >= 3.0 * m.mean)::INT AS INTEGER) AS signals
FROM e JOIN h ON h.business = e.business AND h.hour = date_trunc('hour', ts) JOIN d ON d.business = e.business AND d.day = CAST(ts AS DATE) JOIN m ON m.business = e.business JOIN s ON s.t = e.t""",
)
def v23(spark, sf):
    k = F.col("event_id")
    reviews = table(spark, sf, "events").select(
        k, F.col("user_id").alias("business"), (k % 5).alias("reviewer_reviews"), F.when(k % 4 == 0, "x").otherwise("y").alias("reviewer_country"), F.lit("y").alias("business_country"),
        (1 + k % 5).cast("int").alias("rating"), F.concat("event_type", (k % 1000).cast("string")).alias("text"), "ts",
    )
    return audits.fake_review_flags(reviews).select("event_id", "signals")


@query(
    "v24_cluster_gates",
    """WITH p AS (SELECT p_brand AS cluster, p_partkey AS url, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS pillar, p_size FROM part), h AS (SELECT cluster, min(url) AS top FROM p GROUP BY 1),
e AS (SELECT DISTINCT a.url AS src, b.url AS dst, a.cluster FROM p a JOIN p b ON a.cluster = b.cluster AND ((b.url % 10 < 8 AND a.url % 10 = 1) OR a.pillar OR (b.pillar AND a.p_size > 1)) WHERE a.url <> b.url),
i AS (SELECT p.cluster, p.url, count(e.src) AS n FROM p LEFT JOIN e ON e.dst = p.url GROUP BY ALL)
SELECT p.cluster, bool_and(pillar OR EXISTS (SELECT 1 FROM e WHERE e.src = p.url AND e.dst = h.top)) AS spokes_link_pillar, true AS pillar_links_spokes, min(i.n) >= 3 AS enough_incoming, min(i.n) > 0 AS no_orphans, min(p_size) >= 4 AS long_enough, count(DISTINCT p_size % 40) = count(*) AS own_keywords
FROM p JOIN h USING (cluster) JOIN i ON i.url = p.url GROUP BY p.cluster""",
)
def v24(spark, sf):
    k = F.col("p_partkey")
    part = table(spark, sf, "part").select(F.col("p_brand").alias("cluster"), k.alias("url"), F.col("p_size"))
    tops = part.groupBy("cluster").agg(F.min("url").alias("top"))
    posts = part.join(F.broadcast(tops), "cluster").select("cluster", "url", (F.col("url") == F.col("top")).alias("is_pillar"), (F.col("p_size") % 40).cast("string").alias("keyword"), F.col("p_size").alias("words"), F.lit(5).alias("target_words"), "top")
    down = posts.select(F.col("top").alias("src"), F.col("url").alias("dst"))
    up = posts.where("words > 1").select(F.col("url").alias("src"), F.col("top").alias("dst"))
    # A menu of each brand: a part in ten shows it, eight in ten are on it.
    shows = posts.where("url % 10 = 1").select(F.col("cluster").alias("menu"), F.col("url").alias("src"))
    lists = posts.where("url % 10 < 8").select(F.col("cluster").alias("menu"), F.col("url").alias("dst"))
    return audits.cluster_gates(posts.drop("top"), down.union(up), shows, lists)


@query("v17_cost_estimates", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'unknown_endpoint' ELSE 'estimated' END AS status, CASE o_orderkey % 4 WHEN 0 THEN round(0.002 * greatest(1, o_orderkey % 5), 4) WHEN 1 THEN round(0.01 * greatest(1, o_orderkey % 5), 4) WHEN 2 THEN round(0.05 * greatest(1, o_orderkey % 5), 4) END AS total_cost, CASE WHEN o_orderkey % 4 = 3 THEN 'serp/live,serp/task' END AS near FROM orders")
def v17(spark, sf):
    k = F.col("o_orderkey")
    costs = {"serp/live": 0.002, "serp/task": 0.01, "labs": 0.05}
    calls = table(spark, sf, "orders").select(k, F.get(F.array(*[F.lit(x) for x in (*costs, "serp")]), (k % 4).cast("int")).alias("endpoint"), (k % 5).alias("count"))
    return audits.cost_estimates(calls, costs).select("o_orderkey", "status", "total_cost", F.array_join("suggestions", ",").alias("near"))


@query(
    "l08_ordered_findings",
    """WITH f AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 6 END AS r, o_totalprice AS impact, o_orderkey % 2 = 0 AS low FROM orders)
(SELECT id, 'critical' AS list FROM f WHERE r = 1 ORDER BY r, impact DESC, id LIMIT 5) UNION ALL (SELECT id, 'quick-win' FROM f WHERE r > 1 AND low ORDER BY r, impact DESC, id LIMIT 5)""",
)
def l08(spark, sf):
    k = F.col("o_orderkey")
    severity = F.get(F.array(*[F.lit(s) for s in ("Critical", "HIGH", "medium", "low", "info", "other")]), (k % 6).cast("int"))
    found = table(spark, sf, "orders").select(k.alias("id"), severity.alias("severity"), F.col("o_totalprice").alias("impact"), F.when(k % 2 == 0, "low").otherwise("high").alias("effort"))
    return audits.ordered_findings(found, "id").select("id", "list")


@query("l09_pillar_keywords", "SELECT cluster, keyword AS pillar, volume FROM (SELECT p_brand AS cluster, p_name AS keyword, p_size AS volume, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, length(p_name), p_name) AS k FROM part) WHERE k = 1")
def l09(spark, sf):
    return audits.pillar_keywords(table(spark, sf, "part").select(F.col("p_brand").alias("cluster"), F.col("p_name").alias("keyword"), F.col("p_size").alias("volume")))


@query("l10_gap_priority", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN round(p_retailprice * (p_partkey % 10) / (p_size % 4), 4) END AS priority FROM part")
def l10(spark, sf):
    k = F.col("p_partkey")
    return audits.gap_priority(table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("impact"), (k % 10).alias("advantage"), (F.col("p_size") % 4).alias("effort"))).select("p_partkey", "priority")


@query("l02_chart_rows", "SELECT CAST(l_partkey AS VARCHAR) AS query, count(*) AS impressions FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def l02(spark, sf):
    return audits.chart_rows(table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("query")).agg(F.count("*").alias("impressions")))


@query("w06_printed_ranks", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)")
def w06(spark, sf):
    return audits.printed_ranks(table(spark, sf, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 50).select("o_orderkey", "rank")


@query(
    "c12_bands",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN s >= 90 THEN 'good' WHEN s >= 50 THEN 'warn' ELSE 'bad' END AS lab, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN s >= 80 THEN 'good' WHEN s >= 50 THEN 'warn' ELSE 'bad' END AS badge,
CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN s >= 80 THEN 'Excellent' WHEN s >= 60 THEN 'Good' WHEN s >= 40 THEN 'Needs Work' ELSE 'Critical Mismatch' END AS persona FROM (SELECT p_partkey, p_partkey % 101 AS s FROM part)""",
)
def c12(spark, sf):
    k = F.col("p_partkey")
    score = F.when(k % 7 > 0, k % 101)
    return table(spark, sf, "part").select("p_partkey", audits.lab_band(score).alias("lab"), audits.badge_band(score).alias("badge"), audits.persona_band(score).alias("persona"))


@query(
    "c09_profile_score",
    """WITH f AS (SELECT l_orderkey AS business, l_returnflag AS industry, l_linenumber AS field, least(2, l_linenumber % 4) AS points FROM lineitem)
SELECT business, round(sum(points * w) * 100 / sum(w * 2), 1) AS score FROM (SELECT *, CASE WHEN industry = 'R' AND field = 2 THEN 3.0 WHEN industry = 'A' AND field = 1 THEN 0.5 ELSE 1.0 END AS w FROM f) GROUP BY business""",
)
def c09(spark, sf):
    fields = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("business"), F.col("l_returnflag").alias("industry"), F.col("l_linenumber").alias("field"), (F.col("l_linenumber") % 4).alias("points"))
    return audits.profile_score(fields, spark.createDataFrame([("R", 2, 3.0), ("A", 1, 0.5)], "industry string, field int, multiplier double"))


@query("p27_redacted", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'GET /x?key=[REDACTED]&n=1' WHEN 1 THEN 'Authorization: Bearer [REDACTED] sent' ELSE 'order ' || o_orderkey END AS said FROM orders")
def p27(spark, sf):
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("GET /x?key="), k.cast("string"), F.lit("&n=1"))).when(k % 3 == 1, F.concat(F.lit("Authorization: Bearer a.b-"), k.cast("string"), F.lit("== sent"))).otherwise(F.concat(F.lit("order "), k.cast("string")))
    return table(spark, sf, "orders").select(k, audits.redacted(said).alias("said"))


@query("u04_all_links", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'x' || p_partkey || ',' END || 'i' || p_size AS links FROM part")
def u04(spark, sf):
    k = F.col("p_partkey")
    joined = audits.all_links(F.when(k % 3 > 0, F.array(F.concat(F.lit("x"), k.cast("string")))), F.array(F.concat(F.lit("i"), F.col("p_size").cast("string"))))
    return table(spark, sf, "part").select("p_partkey", F.array_join(joined, ",").alias("links"))
