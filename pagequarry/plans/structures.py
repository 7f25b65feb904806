"""Queries over sequences, sets, graphs, places and stores.

Where the driver's tables have no such data, rows of another table stand in: orders for requests,
customers for points of a map, events for snapshots.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagequarry.functions.stored import shared_dir
from pagequarry.operators import asof, clusters, links, locales, paged, reuse
from pagequarry.sources import places, snapshot_table, web_graph

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


@query(
    "t17_page_reuse",
    r"""WITH t AS (SELECT page_id, lower(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')) AS t FROM pages),
w AS (SELECT page_id, list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT page_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8),
f AS (SELECT page_id, i, array_to_string(w[i:i + 7], ' ') AS f FROM s),
d AS (SELECT f, page_id, row_number() OVER (PARTITION BY f ORDER BY page_id) AS k FROM (SELECT DISTINCT f, page_id FROM f)),
h AS (SELECT f, min(page_id) AS p1, max(page_id) AS p2 FROM d WHERE k <= 2 GROUP BY f HAVING min(page_id) <> max(page_id)),
hits AS (SELECT page_id, i, CASE WHEN page_id = p1 THEN p2 ELSE p1 END AS source FROM f JOIN h USING (f)),
c AS (SELECT page_id, count(DISTINCT p) AS shared FROM (SELECT page_id, unnest(range(i, i + 8)) AS p FROM hits) GROUP BY page_id),
b AS (SELECT page_id, source, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, source) AS k FROM (SELECT page_id, source, count(*) AS n FROM hits GROUP BY ALL)) WHERE k = 1),
p AS (SELECT w.page_id, len(w) AS words, coalesce(shared, 0) AS shared_words, CASE WHEN len(w) > 0 THEN round(coalesce(shared, 0) * 100.0 / len(w), 2) ELSE 0.0 END AS shared_pct, source AS best_source, n AS source_windows
FROM w LEFT JOIN c USING (page_id) LEFT JOIN b USING (page_id))
SELECT *, shared_pct >= 80 AS near_duplicate FROM p""",
)
def t17(spark, sf):
    """The share of every page's words that stands on other pages too, and the page that has most of it."""
    pages = table(spark, sf, "pages").select("page_id", reuse.plain_text(F.col("html")).alias("text"))
    return reuse.page_reuse(pages)


_ORDER_TIME = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes((o_orderkey * 37) % 43200)"


@query(
    "j04_as_of_join",
    f"""WITH l AS (SELECT o_orderkey, o_custkey % 200 AS k, {_ORDER_TIME} AS t FROM orders),
r AS (SELECT user_id AS k, ts, max(event_id) AS event_id FROM events GROUP BY ALL)
SELECT o_orderkey, r.event_id FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.ts""",
)
def j04_join(spark, sf):
    """Every order with its customer's latest event before it."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=((F.col("o_orderkey") * 37) % 43200).cast("int"))
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("user_id"), at.alias("t"))
    return asof.as_of_join(orders, table(spark, sf, "events"), "user_id", "t", "ts", ["event_id"], "event_id").select("o_orderkey", "event_id")


@query(
    "g04_crawl_depth",
    """WITH RECURSIVE n AS (SELECT max(p_partkey) + 1 AS n FROM part),
e AS (SELECT DISTINCT l_partkey AS src, (l_partkey * 3 + l_linenumber) % n AS dst FROM lineitem CROSS JOIN n WHERE l_linenumber > 4
  UNION SELECT n + p_partkey, CASE WHEN p_partkey % 12 < 11 THEN n + p_partkey + 1 ELSE p_partkey END FROM part CROSS JOIN n UNION SELECT p_partkey, n + p_partkey FROM part CROSS JOIN n WHERE p_partkey % 12 = 0),
d AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS clicks UNION SELECT dst, clicks + 1 FROM d JOIN e ON src = node WHERE clicks < 60)
SELECT CAST(node AS BIGINT) AS node, CAST(min(clicks) AS INTEGER) AS clicks FROM d GROUP BY node""",
)
def g04_depth(spark, sf):
    """Clicks from page 0 to every page of a site with rings, shortcuts and chains of twelve."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("p"))
    n = parts.agg((F.max("p") + 1).alias("n"))
    across = table(spark, sf, "lineitem").where("l_linenumber > 4").crossJoin(F.broadcast(n))  # one row
    across = across.select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % F.col("n")).alias("dst"))
    parts = parts.crossJoin(F.broadcast(n))
    down = parts.select((F.col("n") + F.col("p")).alias("src"), F.when(F.col("p") % 12 < 11, F.col("n") + F.col("p") + 1).otherwise(F.col("p")).alias("dst"))
    into = parts.where("p % 12 = 0").select(F.col("p").alias("src"), (F.col("n") + F.col("p")).alias("dst"))
    return links.clicks_from(spark.createDataFrame([(0,)], "node long"), across.union(down).union(into))


@query(
    "s28_bucketed_snapshots",
    """WITH l AS (SELECT user_id, max(event_id) AS id FROM events GROUP BY 1), o AS (SELECT user_id, max(event_id) AS id FROM events WHERE event_id % 10 < 9 GROUP BY 1)
SELECT coalesce(l.user_id, o.user_id) AS url_hash, a.event_type AS old_value, b.event_type AS new_value FROM l FULL JOIN o USING (user_id) LEFT JOIN events a ON a.event_id = o.id LEFT JOIN events b ON b.event_id = l.id WHERE a.event_type IS DISTINCT FROM b.event_type""",
)
def s28(spark, sf):
    """Two bucketed stores of snapshots, one of them made of two appends and compacted: pages whose newest snapshots differ."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("url_hash"), F.col("event_id").alias("id"), "event_type")
    folder, run = f"{shared_dir(spark)}/pagequarry/snapshots", uuid.uuid4().hex
    old, new = f"pagequarry_old_{run}", f"pagequarry_new_{run}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    snapshot_table.create_store(rows.where("id % 10 < 9"), old, folder, buckets)
    snapshot_table.create_store(rows.where("id % 10 < 9"), new, folder, buckets)
    snapshot_table.append(rows.where("id % 10 = 9"), new)
    snapshot_table.compact(spark, new, keep=3)
    return snapshot_table.changes(spark, old, new, "event_type")


_POINTS = "SELECT c_custkey AS id, 70 + (c_custkey % 97) / 10.0 AS lat, 170 + (c_custkey % 211) / 10.0 AS lon0 FROM customer"


@query(
    "s33_places",
    f"""WITH n AS (SELECT id, lat, CASE WHEN lon0 >= 180 THEN lon0 - 360 ELSE lon0 END AS lon FROM ({_POINTS})),
v AS (SELECT s_suppkey AS id, unnest([0, 1, 2, 3]) AS spot, s_suppkey, unnest([0, 0, 0.001, 0.001]) AS dy, unnest([0, 0.002, 0.003, 0]) AS dx FROM supplier),
c AS (SELECT id, 75 + (s_suppkey % 10) * 0.5 AS y0, 179.999 AS x0, spot, dy, dx FROM v),
x AS (SELECT id, any_value(y0) AS y0, any_value(x0) AS x0, sum(a.dx * b.dy - b.dx * a.dy) AS area, sum((a.dx + b.dx) * (a.dx * b.dy - b.dx * a.dy)) AS mx, sum((a.dy + b.dy) * (a.dx * b.dy - b.dx * a.dy)) AS my
  FROM c a JOIN (SELECT id, spot, dx, dy FROM c) b USING (id) WHERE b.spot = (a.spot + 1) % 4 GROUP BY id),
p AS (SELECT 'node/' || id AS place, lat, lon AS lng FROM n WHERE id % 2 = 0
  UNION ALL SELECT 'way/' || id, y0 + my / (3 * area), x0 + mx / (3 * area) - CASE WHEN x0 + mx / (3 * area) >= 180 THEN 360 ELSE 0 END FROM x),
q AS (SELECT s_suppkey AS centre, 75 + (s_suppkey % 10) * 0.5 AS clat, 179.99 AS clng FROM supplier WHERE s_suppkey < 10),
d AS (SELECT centre, place, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lng - clng) / 2), 2)))) AS km FROM q CROSS JOIN p)
SELECT centre, place, round(round(km, 6), 2) AS km FROM d WHERE km <= 40""",
)
def s33(spark, sf):
    """Saved map responses on both sides of the date line: points, buildings made of points, and what is within 40 km of ten centres."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    none = F.lit(None).cast("array<bigint>")
    tags = lambda key, value: F.create_map(F.lit(key), value)
    east = lambda x: F.when(x >= 180, x - 360).otherwise(x)
    element = lambda kind, id_, lat, lon, nodes, t: F.struct(F.lit(kind).alias("type"), id_.alias("id"), lat.alias("lat"), lon.alias("lon"), nodes.alias("nodes"), t.alias("tags"))
    number = F.lit(None).cast("double")
    points = table(spark, sf, "customer").select(element("node", k, 70 + (k % 97) / F.lit(10.0), east(170 + (k % 211) / F.lit(10.0)), none, F.when(k % 2 == 0, tags("amenity", F.lit("cafe")))).alias("e"))
    corner = lambda i: s * 4 + i + 10**9
    shape = [(0, 0.0, 0.0), (1, 0.0, 0.002), (2, 0.001, 0.003), (3, 0.001, 0.0)]
    suppliers = table(spark, sf, "supplier")
    way = element("way", s, number, number, F.array(*[corner(i) for i in (0, 1, 2, 3, 0)]), tags("shop", F.col("s_name")))
    corners = [element("node", corner(i), 75 + (s % 10) * 0.5 + dy, east(F.lit(179.999 + dx)), none, F.lit(None).cast("map<string,string>")) for i, dy, dx in shape]
    buildings = suppliers.select(F.explode(F.array(way, *corners)).alias("e"))
    responses = points.union(buildings).select(F.to_json(F.struct(F.array("e").alias("elements"))).alias("body"))
    found = places.places(places.elements(responses))
    centres = suppliers.where("s_suppkey < 10").select(s.alias("centre"), (75 + (s % 10) * 0.5).alias("lat"), F.lit(179.99).alias("lng"))
    return places.near(found, centres, 40.0).select("centre", "place", F.round("km", 2).alias("km"))


@query(
    "j18_around_the_globe",
    """WITH c AS (SELECT s_suppkey AS centre, -90 + (s_suppkey % 37) * 5.0 AS lat, -180 + (s_suppkey % 41) * 9.0 AS lng FROM supplier),
p AS (SELECT c_custkey AS place, -90 + (c_custkey % 181) * 1.0 AS plat, -180 + (c_custkey % 359) * 1.0 AS plng FROM customer),
d AS (SELECT centre, place, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plng - lng) / 2), 2)))) AS km FROM c CROSS JOIN p)
SELECT centre, place, round(round(km, 6), 2) AS km FROM d WHERE round(km, 6) <= 400""",
)
def j18_globe(spark, sf):
    """Places within 400 km of centres from pole to pole and across the date line."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    centres = table(spark, sf, "supplier").select(s.alias("centre"), (-90 + (s % 37) * F.lit(5.0)).alias("lat"), (-180 + (s % 41) * F.lit(9.0)).alias("lng"))
    found = table(spark, sf, "customer").select(c.alias("place"), (-90 + (c % 181) * F.lit(1.0)).alias("lat"), (-180 + (c % 359) * F.lit(1.0)).alias("lng"))
    return clusters.within_radius(centres, found, 400.0).select("centre", "place", F.round("km", 2).alias("km"))


#: Codes of the members of a customer's set of pages, by the order's number; the last two are no codes.
_CODES = ("en", "de", "fr", "en-GB", "zh-Hant", "x-default", "es-419", "en-uk", "jp")


@query(
    "v19_hreflang_sets",
    """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
m AS (SELECT *, CASE WHEN c % 5 = 0 AND i = 1 THEN 'http' ELSE 'https' END || '://site' || c || '.example/' || lpad(CAST(i AS VARCHAR), 4, '0') AS url,
  ['en', 'de', 'fr', 'en-GB', 'zh-Hant', 'x-default', 'es-419', 'en-uk', 'jp'][CAST(i % 9 AS INTEGER) + 1] AS lang FROM o),
s AS (SELECT c, min(url) AS set, n AS pages, CAST(CASE WHEN c % 3 = 0 AND n > 1 THEN n * n - (n - 1) ELSE n * n END AS BIGINT) AS alternates, max(lang IN ('en-uk', 'jp')) AS bad, c % 3 = 0 AND n > 1 AS no_return,
  c % 5 = 0 AND n > 1 AS mixed, max(lang = 'x-default') AS has_default, max(i) >= 9 AS several, c % 7 = 0 AS elsewhere, max(i) >= 14 AS two_defaults FROM m GROUP BY c, n)
SELECT set, CAST(pages AS BIGINT) AS pages, alternates, array_to_string(list_filter([CASE WHEN bad THEN 'bad-code' END, CASE WHEN no_return THEN 'missing-return' END, CASE WHEN mixed THEN 'mixed-protocol' END,
  CASE WHEN NOT has_default THEN 'no-default' END, CASE WHEN elsewhere THEN 'non-canonical' END, CASE WHEN two_defaults THEN 'several-defaults' END, CASE WHEN several THEN 'several-pages' END], lambda x: x IS NOT NULL), ',') AS problems FROM s""",
)
def v19_sets(spark, sf):
    """Customers as sites with a page in a language for each order: all pages name each other, but for faults that go by the customer's number."""
    from pyspark.sql.window import Window

    c = F.col("c")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))
    pages = orders.withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy("k")) - 1)
    scheme = F.when((c % 5 == 0) & (F.col("i") == 1), "http").otherwise("https")
    url = F.concat(scheme, F.lit("://site"), c.cast("string"), F.lit(".example/"), F.lpad(F.col("i").cast("string"), 4, "0"))
    pages = pages.select("c", "i", url.alias("url"), F.get(F.array(*map(F.lit, _CODES)), F.col("i") % len(_CODES)).alias("lang"))
    others = pages.select("c", F.col("i").alias("j"), F.col("url").alias("href"), "lang")
    # Of every third site the first page names only itself.
    tags = pages.select("c", "i", F.col("url").alias("page_url")).join(others, "c").where((c % 3 > 0) | (F.col("i") > 0) | (F.col("j") == 0))
    canonical = pages.select("url", F.when((c % 7 == 0) & (F.col("i") == 0), F.concat("url", F.lit("/"))).otherwise(F.col("url")).alias("canonical"))
    return locales.judged_sets(tags.select("page_url", "lang", "href"), canonical, locales.iso_codes(spark))


_PAGES = """SELECT l_suppkey AS site, l_linenumber - 1 AS page, CASE WHEN l_suppkey % 4 = 1 AND l_linenumber = 4 THEN 'error' WHEN l_suppkey % 10 = 3 AND l_linenumber = 1 THEN 'error' ELSE 'success' END AS status,
CASE WHEN l_suppkey % 4 = 2 THEN 3 WHEN l_suppkey % 4 = 3 THEN 9 ELSE 7 END AS total_pages, l_partkey AS url, CAST(max(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL"""


@query(
    "s16_paged_links",
    f"""WITH p AS ({_PAGES}), o AS (SELECT site, CASE WHEN site % 10 = 3 THEN 0 WHEN site % 4 = 1 THEN 3 WHEN site % 4 = 2 THEN 3 WHEN site % 4 = 3 THEN 7 ELSE 7 END AS fetched FROM (SELECT DISTINCT site FROM p)),
t AS (SELECT site, url, arg_max(n, page) AS n FROM p JOIN o USING (site) WHERE page < fetched GROUP BY ALL), s AS (SELECT site, count(*) AS targets, CAST(sum(n) AS BIGINT) AS links FROM t GROUP BY site),
r AS (SELECT site, CAST(fetched AS BIGINT) AS pages_fetched, CAST(CASE WHEN fetched = 0 THEN NULL WHEN site % 4 = 2 THEN 3 WHEN site % 4 = 3 THEN 9 ELSE 7 END AS BIGINT) AS total_pages FROM o)
SELECT site, CASE WHEN pages_fetched = 0 THEN 'error' WHEN pages_fetched >= total_pages THEN 'success' ELSE 'partial' END AS status, pages_fetched, total_pages, coalesce(targets, 0) AS targets, coalesce(links, 0) AS links,
pages_fetched > 0 AND coalesce(pages_fetched >= total_pages, false) AS complete FROM r LEFT JOIN s USING (site)""",
)
def s16(spark, sf):
    """Suppliers as sites with seven pages of links each, some of which fail or name more pages than there are."""
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").groupBy(s.alias("site"), (n - 1).alias("page"), F.col("l_partkey").cast("string").alias("url")).agg(F.max("l_quantity").cast("long").alias("count"))
    pages = rows.groupBy("site", "page").agg(F.collect_list(F.struct("url", "count")).alias("links"))
    bad = ((F.col("site") % 4 == 1) & (F.col("page") == 3)) | ((F.col("site") % 10 == 3) & (F.col("page") == 0))
    total = F.when(F.col("site") % 4 == 2, 3).when(F.col("site") % 4 == 3, 9).otherwise(7)
    return paged.paged_totals(pages.withColumns({"status": F.when(bad, "error").otherwise("success"), "total_pages": total}))


@query(
    "k14_daily_quota",
    """WITH r AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey, o_custkey FROM orders), b AS (SELECT o_custkey % 30 AS day, o_orderkey AS position, CASE WHEN o_orderkey % 17 > 0 THEN 'u' || o_custkey ELSE ' ' END AS url,
CASE WHEN (o_custkey % 30) % 3 = 0 AND o_orderkey % 101 = 100 THEN 'HTTP 429' WHEN o_orderkey % 23 = 0 THEN 'HTTP 500' END AS error FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY position, url) AS k FROM b), f AS (SELECT * FROM k WHERE k <= 200 AND trim(url) <> ''),
s AS (SELECT day, min(CASE WHEN error LIKE '%429%' THEN k END) AS stop FROM f GROUP BY day),
t AS (SELECT day, count(*) AS sent, count(*) FILTER (WHERE error IS NULL) AS success, count(error) AS errors, any_value(stop IS NOT NULL) AS stopped FROM f JOIN s USING (day) WHERE stop IS NULL OR k <= stop GROUP BY day)
SELECT a.day, asked, coalesce(sent, 0) AS sent, coalesce(success, 0) AS success, coalesce(errors, 0) AS errors, coalesce(stopped, false) AS stopped, CAST(greatest(0, 200 - coalesce(success, 0)) AS BIGINT) AS remaining
FROM (SELECT day, count(*) AS asked FROM b GROUP BY day) a LEFT JOIN t USING (day)""",
)
def k14(spark, sf):
    """Orders as requests of thirty days, in order: what the quota lets through, up to the day's first answer of 429."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    error = F.when((c % 30 % 3 == 0) & (k % 101 == 100), "HTTP 429").when(k % 23 == 0, "HTTP 500")
    rows = table(spark, sf, "orders").select((c % 30).alias("day"), k.alias("position"), F.when(k % 17 > 0, F.concat(F.lit("u"), c.cast("string"))).otherwise(" ").alias("url"), error.alias("error"))
    return paged.notified(rows)


@query(
    "s06_web_graph_lookup",
    """WITH g AS (SELECT row_number() OVER (ORDER BY p_partkey) AS harmonic_pos, p_retailprice AS harmonic_val, p_partkey + 7 AS pagerank_pos, CAST(p_size * 0.5 AS DOUBLE) AS pagerank_val, p_partkey AS k, p_size AS n_hosts FROM part WHERE p_partkey % 3 > 0),
a AS (SELECT c_custkey AS k FROM customer) SELECT 'https://www.d' || a.k || '.example.com/x' AS domain, g.k IS NOT NULL OR a.k % 3 = 0 AND a.k % 2 = 0 AND a.k IN (SELECT p_partkey FROM part) AS in_crawl, g.k IS NOT NULL AS in_rankings,
pagerank_val AS pagerank, pagerank_pos AS pagerank_rank, harmonic_val AS harmonic_centrality, harmonic_pos AS harmonic_centrality_rank, CAST(n_hosts AS BIGINT) AS n_hosts,
CASE WHEN g.k IS NOT NULL THEN 'ranked' WHEN a.k % 3 = 0 AND a.k % 2 = 0 AND a.k IN (SELECT p_partkey FROM part) THEN 'crawled' ELSE 'absent' END AS found FROM a LEFT JOIN g USING (k)""",
)
def s06(spark, sf):
    """Customers' domains in an index of ranks (two parts in three) and vertices (the even parts)."""
    from pyspark.sql.window import Window

    k = F.col("p_partkey")
    part = table(spark, sf, "part")
    host = F.concat(F.lit("com.example.d"), k.cast("string")).alias("host_rev")
    ranks = part.where(k % 3 > 0).select(F.row_number().over(Window.orderBy(k)).cast("long").alias("harmonic_pos"), F.col("p_retailprice").alias("harmonic_val"), (k + 7).alias("pagerank_pos"), (F.col("p_size") * 0.5).alias("pagerank_val"), host, F.col("p_size").cast("long").alias("n_hosts"))
    path = f"{shared_dir(spark)}/pagequarry/graph-{uuid.uuid4().hex}"
    web_graph.write_index(ranks, f"{path}/ranks", 4)
    web_graph.write_index(part.where(k % 2 == 0).select(host), f"{path}/vertices", 4)
    asked = table(spark, sf, "customer").select(F.concat(F.lit("https://www.d"), F.col("c_custkey").cast("string"), F.lit(".example.com/x")).alias("domain"))
    return web_graph.domain_metrics(spark, f"{path}/ranks", f"{path}/vertices", asked)


@query(
    "g03_intent_overlap",
    """WITH r AS (SELECT DISTINCT l_suppkey AS keyword, l_partkey AS url, l_suppkey % 4 AS intent FROM lineitem),
c AS (SELECT domain FROM (SELECT DISTINCT keyword, CASE WHEN url % 4 = 0 THEN 0 ELSE url % 1000 END AS domain FROM r) GROUP BY domain HAVING count(*) > (SELECT count(DISTINCT keyword) * 98 // 100 FROM r)), k AS (SELECT * FROM r WHERE CASE WHEN url % 4 = 0 THEN 0 ELSE url % 1000 END NOT IN (SELECT domain FROM c))
SELECT a.keyword AS k1, b.keyword AS k2, count(DISTINCT a.url) AS shared, CASE WHEN count(DISTINCT a.url) >= 7 THEN 'same-post' WHEN count(DISTINCT a.url) >= 4 THEN 'same-cluster' ELSE 'interlink' END AS band
FROM k a JOIN k b ON a.url = b.url AND a.intent = b.intent AND a.keyword < b.keyword GROUP BY 1, 2 HAVING count(DISTINCT a.url) >= 2""",
)
def g03_intents(spark, sf):
    """Overlaps of two results or more within an intent, without the domains that nearly every keyword has."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("keyword"), F.col("l_partkey").alias("url"), (F.col("l_suppkey") % 4).alias("intent"))
    most = rows.select("keyword").distinct().count() * 98 // 100
    return clusters.result_overlap(rows, "intent", most, least=clusters.INTERLINK, domain=F.when(F.col("url") % 4 == 0, 0).otherwise(F.col("url") % 1000))


@query(
    "u01_common_keywords",
    """WITH s AS (SELECT DISTINCT p_brand AS part, l_suppkey * 40 + l_linenumber AS key FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT part AS parts, 1 AS n_parts, count(*) AS shared FROM s GROUP BY 1),
b AS (SELECT x.part || ',' || y.part AS parts, 2 AS n_parts, count(*) AS shared FROM s x JOIN s y ON x.key = y.key AND x.part < y.part GROUP BY 1),
c AS (SELECT x.part || ',' || y.part || ',' || z.part AS parts, 3 AS n_parts, count(*) AS shared FROM s x JOIN s y ON x.key = y.key AND x.part < y.part JOIN s z ON x.key = z.key AND y.part < z.part GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def u01_sets(spark, sf):
    """Brands as domains, a supplier's lines as keyword numbers: what each set of up to three brands has in common."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return links.common_keys(rows.select("p_brand", (F.col("l_suppkey") * 40 + F.col("l_linenumber")).alias("key")), "p_brand", "key", 3)
