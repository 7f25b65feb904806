"""Queries over saved speed responses, report claims, submissions, traffic and scorecards, on rows that stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import clusters, drift, html, links, metrics, site_rules
from pagequarry.sources import sinks, speed

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


_RATED = "CASE WHEN p75 <= {0} THEN 'good' WHEN p75 <= {1} THEN 'needs-improvement' ELSE 'poor' END"


@query(
    "s13_field_or_origin",
    f"""WITH u AS (SELECT p_partkey AS k, p_partkey % 50 AS s, p_size AS z FROM part),
r AS (SELECT 'https://s' || s || '.example/' || k AS url, k, z, 'url' AS level FROM u WHERE k % 3 > 0 UNION ALL SELECT 'https://s' || s || '.example/' || k, s, s, 'origin' FROM u WHERE k % 6 = 0 AND s % 4 > 0),
m AS (SELECT url, level, 'largest_contentful_paint' AS metric, 'LCP' AS label, CAST(z * 120 AS DOUBLE) AS p75, k FROM r UNION ALL SELECT url, level, 'cumulative_layout_shift', 'CLS', z / 100.0, k FROM r)
SELECT url, level, metric, label, p75, CASE label WHEN 'LCP' THEN {_RATED.format(2500, 4000)} ELSE {_RATED.format(0.1, 0.25)} END AS rating, CAST(round((k % 10) * 10.0, 1) AS DOUBLE) AS good_pct, DATE '2024-03-01' + CAST(k % 28 AS INTEGER) AS last_day FROM m""",
)
def s13_field(spark, sf):
    """Parts as pages of fifty sites: two in three have field data of their own, of the rest every other one answers 404 and takes its site's."""
    k, s, z = F.col("k"), F.col("s"), F.col("z")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 50).alias("s"), F.col("p_size").alias("z"))
    url = F.concat(F.lit("https://s"), s.cast("string"), F.lit(".example/"), k.cast("string")).alias("url")
    bins = F.array(*[F.struct(d.alias("density")) for d in ((k % 10) / 10, F.lit(0.0), 1 - (k % 10) / 10)])
    p75 = lambda v: F.struct(bins.alias("histogram"), F.struct(v.alias("p75")).alias("percentiles"))
    values = F.struct(p75(z * 120).alias("largest_contentful_paint"), p75((z / 100).cast("string")).alias("cumulative_layout_shift"))
    last = F.date_add(F.lit("2024-03-01").cast("date"), (k % 28).cast("int"))
    period = F.struct(F.struct(F.year(last).alias("year"), F.month(last).alias("month"), F.dayofmonth(last).alias("day")).alias("lastDate"))
    body = F.to_json(F.struct(F.struct(values.alias("metrics"), period.alias("collectionPeriod")).alias("record")))
    own = rows.select(url.alias("target"), F.when(k % 3 > 0, 200).when(k % 6 == 0, 404).otherwise(429).alias("status_code"), body.alias("body"))
    sites = rows.select(s.alias("k"), s, s.alias("z")).distinct()
    above = sites.select(F.concat(F.lit("https://s"), s.cast("string"), F.lit(".example")).alias("target"), F.when(s % 4 > 0, 200).otherwise(404).alias("status_code"), body.alias("body"))
    return speed.field_or_origin(rows.select(url), own.union(above)).select("url", "level", "metric", "label", "p75", "rating", "good_pct", "last_day")


@query(
    "s13_lab_runs",
    """WITH p AS (SELECT p_partkey AS url, p_size AS z, p_retailprice AS r FROM part)
SELECT url, 'score' AS kind, 'performance' AS name, CAST(z AS DOUBLE) AS value FROM p UNION ALL SELECT url, 'metric', 'speed-index', r FROM p UNION ALL SELECT url, 'opportunity', 'unused-javascript', z * 10.0 FROM p WHERE z > 10
UNION ALL SELECT url, CASE WHEN z >= 45 THEN 'passed' ELSE 'failed' END, 'dom-size', NULL FROM p UNION ALL SELECT url, 'failed', 'unused-javascript', NULL FROM p WHERE z <= 10
UNION ALL SELECT url, 'url', 'cumulative_layout_shift', CASE WHEN z > 1 THEN z / 100.0 ELSE z END FROM p UNION ALL SELECT url, 'origin', 'interaction_to_next_paint', z * 10.0 FROM p""",
)
def s13_lab(spark, sf):
    """Parts as lab runs: scores, lab metrics, opportunities, passed and failed audits, and the field data that comes with them."""
    z = F.col("z")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("url"), F.col("p_size").alias("z"), F.col("p_retailprice").alias("r"))
    none = F.lit(None).cast("double")
    audit = lambda score, value=none, kind=None, saved=none: F.struct(score.alias("score"), value.alias("numericValue"), F.struct(F.lit(kind).cast("string").alias("type"), saved.alias("overallSavingsMs")).alias("details"))
    audits = F.create_map(
        F.lit("speed-index"), audit(none, F.col("r")), F.lit("dom-size"), audit(z / 50), F.lit("unused-javascript"), audit(F.lit(0.5), kind="opportunity", saved=F.when(z > 10, z * 10.0).otherwise(0.0)),
    )
    measured = lambda name, v: F.struct(F.create_map(F.lit(name), F.struct(v.alias("percentile"), F.lit("FAST").alias("category"))).alias("metrics"))
    lab = F.struct(F.create_map(F.lit("performance"), F.struct((z / 100).alias("score"))).alias("categories"), audits.alias("audits"))
    body = F.to_json(F.struct(lab.alias("lighthouseResult"), measured("CUMULATIVE_LAYOUT_SHIFT_SCORE", z).alias("loadingExperience"), measured("INTERACTION_TO_NEXT_PAINT", z * 10).alias("originLoadingExperience")))
    runs = speed.lab_runs(rows.select("url", body.alias("body")))
    scores = speed.lab_scores(runs, ["url"]).select("url", F.lit("score").alias("kind"), F.col("category").alias("name"), F.col("score").cast("double").alias("value"))
    found = speed.lab_audits(runs, ["url"]).select("url", "kind", F.col("audit").alias("name"), "value")
    field = speed.lab_field_metrics(runs, ["url"]).select("url", F.col("source").alias("kind"), F.col("metric").alias("name"), F.col("p75").alias("value"))
    return scores.union(found).union(field)


@query(
    "v11_schema_claims",
    """SELECT o_custkey AS report, CASE o_orderkey % 6 WHEN 0 THEN 'warning' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'error' END AS severity, CASE o_orderkey % 6 WHEN 0 THEN 'not-an-object' WHEN 1 THEN 'unflattened-graph' WHEN 2 THEN 'missing-type' ELSE 'howto' END AS detail, count(*) AS n
FROM orders WHERE o_orderkey % 6 < 4 GROUP BY ALL""",
)
def v11(spark, sf):
    """Orders as blocks of a customer's report: no object, a graph, no type, a retired type, a list of types, a sound one."""
    forms = ("[1]", '{"@graph": []}', '{"name": "x"}', '{"@type": "HowTo"}', '{"@type": ["Product", "HowTo"]}', '{"@type": "Product"}')
    k = F.col("o_orderkey")
    blocks = table(spark, sf, "orders").select(F.col("o_custkey").alias("report"), k.alias("pos"), F.get(F.array(*map(F.lit, forms)), (k % 6).cast("int")).alias("block"))
    return site_rules.schema_claims(blocks).groupBy("report", "severity", "detail").agg(F.count("*").alias("n"))


@query(
    "v12_report_claims",
    """WITH h AS (SELECT o_custkey AS report, min(o_orderkey % 4) > 0 AS bad FROM orders GROUP BY 1), o AS (SELECT DISTINCT o_custkey AS report, o_orderkey % 13 AS d FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS report, o_orderkey % 13 AS d FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 > 0)
SELECT report, 'warning' AS severity, 'h1' AS field, 'all-suspicious' AS detail FROM h WHERE bad UNION ALL SELECT c_custkey, 'info', 'crawl', CASE WHEN c_custkey % 3 = 0 THEN 'not-crawled' ELSE 'below-threshold' END FROM customer WHERE c_custkey % 3 < 2
UNION ALL SELECT report, 'warning', 'reciprocal', 'd' || d || '.example' FROM o JOIN b USING (report, d)""",
)
def v12_claims(spark, sf):
    """Customers as reports: headings, what may be said of the crawl, and domains linked both ways."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf, "orders")
    address = F.concat(F.lit("https://www.d"), (k % 13).cast("string"), F.lit(".example/x"))
    headings = site_rules.heading_claims(orders.select(c.alias("report"), (k % 4 > 0).alias("suspicious")))
    ranks = table(spark, sf, "customer").select(F.col("c_custkey").alias("report"), (F.col("c_custkey") % 3 > 0).alias("in_crawl"), (F.col("c_custkey") % 3 == 2).alias("in_rankings"))
    results = orders.where(k % 2 == 1).select(c.alias("report"), address.alias("source_url"), F.when(k % 3 > 0, "verified").otherwise("error").alias("status"))
    both = site_rules.reciprocal_claims(orders.where(k % 2 == 0).select(c.alias("report"), address.alias("href")), results)
    return headings.union(site_rules.crawl_claims(ranks)).union(both)


@query(
    "k13_submissions",
    """WITH u AS (SELECT o_custkey AS batch, count(*) AS urls, max(o_custkey % 5 = 1 AND o_orderkey % 7 = 0) AS f, max(o_custkey % 5 = 2 AND o_orderkey % 7 = 1) AS r FROM orders GROUP BY 1)
SELECT c_custkey AS batch, coalesce(urls, 0) AS urls, CASE WHEN urls IS NULL THEN 'empty' WHEN c_custkey % 11 = 0 THEN 'bad-key' WHEN f THEN 'foreign-url' WHEN r THEN 'refused-url' END AS problem FROM customer LEFT JOIN u ON batch = c_custkey""",
)
def k13(spark, sf):
    """Customers as hosts, their orders as urls to be submitted, some on other hosts or on a private address below the host's name."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    own = F.concat(F.lit("h"), c.cast("string"), F.lit(".example.com"))
    host = F.when((c % 5 == 1) & (k % 7 == 0), F.concat(F.lit("not"), own)).when(k % 2 == 0, F.concat(F.lit("www."), own)).otherwise(own)
    scheme = F.when((c % 5 == 2) & (k % 7 == 1), "ftp://").otherwise("https://")
    urls = table(spark, sf, "orders").select(c.alias("batch"), F.concat(scheme, host, F.lit("/"), k.cast("string")).alias("url"))
    n = F.col("c_custkey")
    batches = table(spark, sf, "customer").select(n.alias("batch"), F.concat(F.lit("H"), n.cast("string"), F.lit(".Example.com")).alias("host"), F.when(n % 11 == 0, "short").otherwise("0123456789abcdef").alias("key"))
    return site_rules.submission_problems(batches, urls)


_TRAFFIC = """SELECT CASE WHEN event_id % 4 > 0 THEN 'Organic Search' ELSE 'Direct' END AS channel, event_type AS device, 'c' || (user_id % 12) AS country, '/p' || (event_id % 90) AS page, 1 + event_id % 3 AS sessions, 1 AS users, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS bounced, CASE WHEN event_id % 7 > 2 THEN 1 ELSE 0 END AS engaged FROM events"""


def _traffic_sql(by: str) -> str:
    return f"SELECT '{by}' AS kind, {by} AS name, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(users) AS BIGINT) AS users, round(sum(bounced) * 100.0 / sum(sessions), 1) AS bounce_rate, round(sum(engaged) * 100.0 / sum(sessions), 1) AS engagement_rate FROM ({_TRAFFIC}) WHERE channel = 'Organic Search' GROUP BY {by}"


@query("s12_traffic_by", f"{_traffic_sql('device')} UNION ALL {_traffic_sql('country')} UNION ALL {_traffic_sql('page')}")
def s12_by(spark, sf):
    """Events as sessions: organic traffic by device, country and landing page."""
    e = F.col("event_id")
    facts = table(spark, sf, "events").select(
        F.when(e % 4 > 0, "Organic Search").otherwise("Direct").alias("channel"), F.col("event_type").alias("device"), F.concat(F.lit("c"), (F.col("user_id") % 12).cast("string")).alias("country"), F.concat(F.lit("/p"), (e % 90).cast("string")).alias("page"),
        (1 + e % 3).alias("sessions"), F.lit(1).cast("long").alias("users"), (e % 5 == 0).cast("long").alias("bounced"), (e % 7 > 2).cast("long").alias("engaged"),
    )
    one = lambda by: metrics.traffic_by(facts, [by]).select(F.lit(by).alias("kind"), F.col(by).alias("name"), "sessions", "users", "bounce_rate", "engagement_rate")
    return one("device").union(one("country")).union(one("page"))


@query(
    "a20_plan_scorecard",
    """WITH p AS (SELECT p_partkey AS url, p_size AS cluster, p_partkey = min(p_partkey) OVER (PARTITION BY p_size) AS pillar, p_partkey % 8 > 0 AS written, p_brand || '-' || (p_partkey % 31) AS kw, p_partkey % 700 AS words, p_partkey % 5 AS images FROM part),
w AS (SELECT * FROM p WHERE written), pil AS (SELECT cluster, min(url) AS pillar_url FROM p GROUP BY 1),
l AS (SELECT l_partkey AS src, (l_partkey * 7 + l_suppkey) % (SELECT max(p_partkey) + 1 FROM part) AS dst FROM lineitem UNION SELECT p.url, pillar_url FROM p JOIN pil USING (cluster) WHERE p.url % 3 > 0 UNION SELECT pillar_url, p.url FROM p JOIN pil USING (cluster) WHERE p.url % 4 > 1),
e AS (SELECT DISTINCT src, dst, a.cluster AS c1, a.pillar AS p1, b.cluster AS c2, b.pillar AS p2 FROM l JOIN w a ON a.url = src JOIN w b ON b.url = dst WHERE src <> dst),
q AS (SELECT DISTINCT p_partkey AS src, (p_partkey * 7 + 3) % (SELECT max(p_partkey) + 1 FROM part) AS dst FROM part), i AS (SELECT c2 AS cluster, count(*) AS n FROM e GROUP BY 1),
o AS (SELECT cluster, count(*) AS n FROM w WHERE url NOT IN (SELECT dst FROM e) GROUP BY 1), s AS (SELECT c1 AS cluster, count(DISTINCT CASE WHEN NOT p1 AND p2 THEN src END) AS up, count(DISTINCT CASE WHEN p1 AND NOT p2 THEN dst END) AS down FROM e WHERE c1 = c2 GROUP BY 1),
x AS (SELECT cluster, count(*) AS asked, count(e.src) AS made FROM q JOIN p ON p.url = q.src LEFT JOIN (SELECT DISTINCT src, dst FROM e) e ON e.src = q.src AND e.dst = q.dst WHERE q.src <> q.dst GROUP BY 1),
d AS (SELECT cluster, count(*) AS n FROM w WHERE lower(kw) IN (SELECT lower(kw) FROM w GROUP BY 1 HAVING count(*) > 1) GROUP BY 1),
g AS (SELECT cluster, count(*) AS planned, count(*) FILTER (WHERE written) AS posts, count(*) FILTER (WHERE written AND NOT pillar) AS spokes, count(*) FILTER (WHERE written AND images > 0) AS img, round(avg(CASE WHEN written THEN words END), 1) AS avg_words FROM p GROUP BY 1)
SELECT g.cluster, round(posts * 100.0 / planned, 1) AS coverage_pct, planned - posts AS gaps, CASE WHEN posts > 0 THEN round(coalesce(i.n, 0) / posts, 2) END AS link_density, coalesce(o.n, 0) AS orphans, CASE WHEN spokes > 0 THEN round(coalesce(up, 0) * 100.0 / spokes, 1) END AS to_pillar_pct, CASE WHEN spokes > 0 THEN round(coalesce(down, 0) * 100.0 / spokes, 1) END AS from_pillar_pct,
CASE WHEN asked > 0 THEN round(made * 100.0 / asked, 1) END AS cross_pct, coalesce(d.n, 0) AS cannibalized, CASE WHEN posts > 0 THEN round(img * 100.0 / posts, 1) END AS image_pct, avg_words
FROM g LEFT JOIN i USING (cluster) LEFT JOIN o USING (cluster) LEFT JOIN s USING (cluster) LEFT JOIN x USING (cluster) LEFT JOIN d USING (cluster)""",
)
def a20(spark, sf):
    """Parts as planned posts in clusters by size, the smallest as pillar."""
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    pillars = part.groupBy(F.col("p_size").alias("cluster")).agg(F.min("p_partkey").alias("pillar"))
    top = part.agg((F.max("p_partkey") + 1).alias("top"))
    posts = part.withColumnRenamed("p_size", "cluster").join(pillars, "cluster").select(
        k.alias("url"), "cluster", (k == F.col("pillar")).alias("is_pillar"), (k % 8 > 0).alias("written"), F.concat("p_brand", F.lit("-"), (k % 31).cast("string")).alias("primary_keyword"), (k % 700).alias("words"), (k % 5).alias("images"), "pillar"
    )
    far = table(spark, sf, "lineitem").crossJoin(F.broadcast(top)).select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("top")).alias("dst"))  # one row
    up, down = posts.where("url % 3 > 0").select("url", "pillar"), posts.where("url % 4 > 1").select("pillar", "url")
    asked = part.crossJoin(F.broadcast(top)).select(k.alias("src"), ((k * 7 + 3) % F.col("top")).alias("dst"))
    return clusters.plan_scorecard(posts.drop("pillar"), far.union(up).union(down), asked)


@query(
    "a23_concentration",
    """WITH l AS (SELECT o_custkey AS site, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % (o_custkey % 40 + 1) END AS domain, o_orderkey % 5 = 0 AS nofollow FROM orders), d AS (SELECT site, domain, count(*) AS n, count(*) FILTER (WHERE NOT nofollow) AS f FROM l GROUP BY ALL),
t AS (SELECT site, CAST(sum(n) AS BIGINT) AS links, count(*) AS domains, max(n) AS most, CAST(sum(f) AS BIGINT) AS f FROM d GROUP BY 1), x AS (SELECT d.site, d.domain, row_number() OVER (PARTITION BY d.site ORDER BY d.domain NULLS FIRST) AS k FROM d JOIN t ON d.site = t.site AND d.n = t.most)
SELECT t.site, links, domains, x.domain AS top_domain, round(most * 100.0 / links, 2) AS top_pct, CASE WHEN round(most * 100.0 / links, 2) > 25 THEN 'critical' WHEN round(most * 100.0 / links, 2) > 10 THEN 'risk' WHEN round(most * 100.0 / links, 2) > 5 THEN 'watch' END AS tier, round(f * 100.0 / links, 1) AS follow_pct FROM t JOIN x ON x.site = t.site AND k = 1""",
)
def a23(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(c.alias("site"), F.when(k % 4 > 0, k % (c % 40 + 1)).alias("domain"), (k % 5 == 0).alias("nofollow"))
    return links.concentration(rows, "site")


#: An image for each way of loading late, by the page's number.
_IMAGES = (
    '<img src="/a.png" loading="lazy" data-src="/b.png">', '<img src="/a.png" loading="eager">', '<img data-perfmatters-src="/a.png">', '<img class="big perfmatters-lazy" data-src="/a.png">',
    '<img data-ewww-src="/a.png">', '<img data-src="/a.png">', '<img src="/a.png" class="lazyloaded">', '<img src="/a.png">',
)
_METHODS = ("native", "none", "perfmatters", "perfmatters", "ewww", "js-generic", "js-generic", "none")
_METHOD_OF = " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_METHODS))


@query("h02_lazy_images", f"SELECT page_id, CASE page_id % 8 {_METHOD_OF} END AS lazy_method FROM pages")
def h02(spark, sf):
    """Pages with one more image at their beginning: how it is loaded late."""
    image = F.get(F.array(*map(F.lit, _IMAGES)), (F.col("page_id") % len(_IMAGES)).cast("int"))
    pages = table(spark, sf, "pages").withColumn("html", F.concat(image, F.coalesce("html", F.lit(""))))
    return html.parse_pages(pages).select("page_id", F.get("parsed.images", F.lit(0))["lazy_method"].alias("lazy_method"))


@query(
    "h08_accessibility_trees",
    """WITH c AS (SELECT o_custkey AS c, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS b, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS l, count(*) FILTER (WHERE o_orderkey % 4 = 2) AS g, count(*) FILTER (WHERE o_orderkey % 4 < 2 AND o_orderkey % 3 = 0) AS u FROM orders GROUP BY 1)
SELECT c_custkey AS page, c IS NOT NULL AS tree_present, CAST(coalesce(n + 1, 0) AS INTEGER) AS total_nodes, CAST(coalesce(b + l, 0) AS INTEGER) AS interactive_nodes, CAST(coalesce(b, 0) AS INTEGER) AS role_button, CAST(coalesce(l, 0) AS INTEGER) AS role_link, CAST(coalesce(g, 0) AS INTEGER) AS role_generic, CAST(coalesce(u, 0) AS INTEGER) AS unnamed_interactive
FROM customer LEFT JOIN c ON c = c_custkey""",
)
def h08(spark, sf):
    """Customers as pages, their orders as nodes of the page's accessibility tree."""
    k = F.col("o_orderkey")
    role = F.get(F.array(F.lit("button"), F.lit("Link"), F.lit("generic"), F.lit("heading")), (k % 4).cast("int"))
    nodes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.collect_list(F.struct(role.alias("role"), F.when(k % 3 > 0, "name").otherwise(" ").alias("name"))).alias("children"))
    trees = nodes.select("page", F.to_json(F.struct(F.lit("document").alias("role"), "children")).alias("tree"))
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("page")).join(trees, "page", "left")
    return pages.select("page", html.accessibility_counts("tree").alias("a")).select("page", "a.*")


@query("u07_chosen_baselines", "SELECT user_id AS url_hash, event_id AS id, event_type AS title FROM events WHERE (user_id, event_id) IN (SELECT user_id, min(event_id) FROM events WHERE event_type = 'click' GROUP BY 1)")
def u07(spark, sf):
    """The first click of each user as the baseline of one's choice."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("url_hash"), F.col("event_id").alias("id"), F.col("event_type").alias("title"))
    choices = rows.where("title = 'click'").groupBy("url_hash").agg(F.min("id").alias("id"))
    return drift.chosen(rows, choices)


@query(
    "k11_audit_envelopes",
    """WITH f AS (SELECT o_custkey AS site, ['technical', 'content', 'links'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS category, ['Critical', 'High', 'Medium', 'Info'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS severity FROM orders)
SELECT c_custkey AS site, CAST(c_custkey % 100 AS DOUBLE) AS score, CAST(count(*) FILTER (WHERE severity = 'Critical') AS BIGINT) AS critical, CAST(count(*) FILTER (WHERE severity = 'Info') AS BIGINT) AS info, CAST(count(DISTINCT category) AS INTEGER) AS categories, min(category) AS first_category,
CAST(sum(CASE WHEN category = first THEN 1 ELSE 0 END) AS BIGINT) AS first_n FROM customer LEFT JOIN (SELECT *, min(category) OVER (PARTITION BY site) AS first FROM f) f ON site = c_custkey GROUP BY c_custkey""",
)
def k11(spark, sf):
    """Customers as audited sites, orders as findings; the envelope is read back."""
    k, n = F.col("o_orderkey"), F.col("c_custkey")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    findings = table(spark, sf, "orders").select(F.col("o_custkey").alias("site"), pick(("technical", "content", "links")).alias("category"), pick(("Critical", "High", "Medium", "Info")).alias("severity"), F.concat(F.lit("m"), k.cast("string")).alias("message"))
    scores = table(spark, sf, "customer").select(n.alias("site"), (n % 100).cast("double").alias("score"))
    schema = "summary struct<score:double,critical:long,high:long,medium:long,info:long>, categories array<struct<category:string,n:long,findings:array<struct<severity:string,message:string>>>>"
    read = sinks.audit_envelope(findings, scores).select("site", F.from_json("envelope", schema).alias("e"))
    first = F.get("e.categories", F.lit(0))
    return read.select("site", "e.summary.score", "e.summary.critical", "e.summary.info", F.coalesce(F.greatest(F.size("e.categories"), F.lit(0)), F.lit(0)).alias("categories"), first["category"].alias("first_category"), F.coalesce(F.size(first["findings"]), F.lit(0)).cast("long").alias("first_n"))


@query(
    "p04_schema_types",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Article,Product' WHEN 2 THEN 'Offer' ELSE 'Product' END AS types, page_id % 4 = 1 AS same FROM pages""",
)
def p04(spark, sf):
    """Types of a page's JSON nodes without vocabulary and doubles, and whether two orders of keys give one canonical text."""
    k = F.col("page_id") % 4
    texts = lambda *xs: F.array(*map(F.lit, xs))
    one = F.when(k == 1, texts('{"@type": "https://schema.org/Product", "a": 1}', '{"@type": ["Article", "Product"]}')).when(k == 2, texts('{"@type": "x#Offer"}', "3")).when(k == 3, texts('{"@type": "Product", "name": "x"}', '{"b": 1}'))
    two = F.when(k == 1, texts('{"a": 1, "@type": "https://schema.org/Product"}', '{"@type": ["Article", "Product"]}')).when(k == 2, texts('{"@type": "x#Offer"}')).when(k == 3, texts('{"@type": "Product", "name": "y"}', '{"b": 1}'))
    rows = table(spark, sf, "pages").select("page_id", one.alias("one"), two.alias("two"))
    made = rows.select("page_id", drift.top_types("one").alias("types"), drift.canonical_json("one").alias("a"), drift.canonical_json("two").alias("b"))
    return made.select("page_id", F.array_join("types", ",").alias("types"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))
