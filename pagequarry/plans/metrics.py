"""Queries over facts: prices, ledgers, traffic, trends, rankings, scores.

The driver's tables stand in for vendor data: lineitem and part for product
listings, events for a cost ledger and for traffic, orders for search facts.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions import values
from pagequarry.operators import metrics

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
    "a04_price_statistics",
    """SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS count, round(round(min(l_extendedprice), 6), 2) AS min, round(round(max(l_extendedprice), 6), 2) AS max,
round(round(avg(l_extendedprice), 6), 2) AS mean, round(round(quantile_cont(l_extendedprice, 0.25), 6), 2) AS p25, round(round(quantile_cont(l_extendedprice, 0.5), 6), 2) AS median,
round(round(quantile_cont(l_extendedprice, 0.75), 6), 2) AS p75, round(round(stddev_pop(l_extendedprice), 6), 2) AS std_dev FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def a04(spark, sf):
    return metrics.price_statistics(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query(
    "a05_search_summary",
    """WITH p AS (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, items, price_min, price_max, avg_rating, avg_reviews, price_median FROM (
SELECT p_brand, count(*) AS items, min(p_retailprice) AS price_min, max(p_retailprice) AS price_max,
round(avg(CASE WHEN p_size % 6 > 0 THEN CAST(p_size % 6 AS DOUBLE) END), 2) AS avg_rating, round(avg(p_size), 1) AS avg_reviews FROM part GROUP BY p_brand)
LEFT JOIN (SELECT p_brand, p_retailprice AS price_median FROM p WHERE k = n // 2) USING (p_brand)""",
)
def a05(spark, sf):
    items = table(spark, sf, "part").withColumn("rating", (F.col("p_size") % 6).cast("double"))
    return metrics.search_summary(items, ["p_brand"], "p_retailprice", "rating", "p_size")


@query("a06_top_per_marketplace", "SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 20")
def a06(spark, sf):
    return metrics.top_per_group(table(spark, sf, "part"), ["p_brand"], [F.col("p_partkey")], 20).select("p_brand", "p_partkey", "rank")


@query(
    "a07_seller_dominance",
    "SELECT l_suppkey, listings, first_seen, round(listings * 100.0 / total, 2) AS share_pct FROM (SELECT l_suppkey, count(*) AS listings, min(l_orderkey) AS first_seen, sum(count(*)) OVER () AS total FROM lineitem GROUP BY l_suppkey) ORDER BY listings DESC, first_seen, l_suppkey LIMIT 10",
)
def a07(spark, sf):
    return metrics.dominance(table(spark, sf, "lineitem"), "l_suppkey", "l_orderkey")


@query("a08_spend_by_day", "SELECT day, count(*) AS calls, round(sum(value), 4) AS total_cost, CAST(grouping(day) AS INTEGER) AS is_total FROM (SELECT CAST(ts AS DATE) AS day, value FROM events) GROUP BY ROLLUP (day)")
def a08(spark, sf):
    return metrics.spend_by_day(table(spark, sf, "events"), "ts", "value")


@query(
    "a09_spend_on_day",
    "SELECT event_type AS endpoint, count(*) AS calls, round(sum(value), 4) AS cost, round(greatest(0.0, 100000.0 - sum(sum(value)) OVER ()), 4) AS remaining FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-01' GROUP BY event_type",
)
def a09(spark, sf):
    return metrics.spend_on_day(table(spark, sf, "events"), "2024-01-01", 100000.0, "ts", "event_type", "value")


@query(
    "w05_budget_to_date",
    """SELECT event_id, round(coalesce(before, 0.0), 4) AS spent_before, round(coalesce(before, 0.0), 4) + value <= 500.0 AS allowed FROM (
SELECT event_id, value, sum(value) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)""",
)
def w05(spark, sf):
    return metrics.budget_to_date(table(spark, sf, "events"), 500.0, "ts", "value").select("event_id", "spent_before", "allowed")


@query(
    "v16_spend_guard",
    """WITH c AS (SELECT 'click' AS endpoint, 0.6 AS cost UNION ALL SELECT 'view', 0.1 UNION ALL SELECT 'purchase', 60.0)
SELECT event_id, CASE WHEN cost IS NULL THEN 'needs_approval' WHEN value + cost > 100 THEN 'blocked' WHEN cost >= 0.5 THEN 'needs_approval' ELSE 'approved' END AS status
FROM events LEFT JOIN c ON event_type = endpoint""",
)
def v16(spark, sf):
    costs = spark.createDataFrame([("click", 0.6), ("view", 0.1), ("purchase", 60.0)], "endpoint string, cost double")
    calls = table(spark, sf, "events").select("event_id", F.col("event_type").alias("endpoint"), F.col("value").alias("spent_before"))
    return metrics.spend_guard(calls, costs, 100.0, 0.5).select("event_id", "status")


_SEARCH = "SELECT o_orderpriority AS query, CAST(o_custkey % 40 AS BIGINT) AS page, count(*) AS impressions, count(*) FILTER (WHERE o_orderstatus = 'F') AS clicks, avg(o_orderkey % 30 + 1.0) AS position FROM orders GROUP BY 1, 2"


def _search(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("query"), (F.col("o_custkey") % 40).alias("page")).agg(
        F.count("*").alias("impressions"), F.count_if(F.col("o_orderstatus") == "F").alias("clicks"), F.avg(F.col("o_orderkey") % 30 + F.lit(1.0)).alias("position")
    )


@query(
    "a13_site_totals",
    f"""SELECT clicks, impressions, round(clicks * 100.0 / impressions, 2) AS ctr, source AS totals_source, source = 'aggregate' AS totals_complete FROM (
SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS clicks, count(*) AS impressions, 'aggregate' AS source FROM orders
UNION ALL SELECT CAST(sum(clicks) AS BIGINT), CAST(sum(impressions) AS BIGINT), 'partial_row_sum' FROM ({_SEARCH}) WHERE impressions > 10)""",
)
def a13(spark, sf):
    """True totals, and what is left of them when rows of few impressions are withheld."""
    detail = _search(spark, sf).where("impressions > 10")
    total = table(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("clicks"), F.count("*").alias("impressions"))
    return metrics.site_totals(detail, total).union(metrics.site_totals(detail, None))


@query("a16_position_buckets", f"SELECT count(*) FILTER (WHERE position <= 3) AS top3, count(*) FILTER (WHERE position <= 10) AS top10, count(*) FILTER (WHERE position > 10) AS beyond FROM ({_SEARCH})")
def a16(spark, sf):
    return metrics.position_buckets(_search(spark, sf))


_WINS = "SELECT *, CAST(o_orderkey % 1000 AS BIGINT) AS impressions, o_orderkey % 17 + 0.5 AS position FROM orders"


@query("l01_quick_wins", f"SELECT o_orderkey, impressions FROM (SELECT * FROM ({_WINS}) ORDER BY impressions DESC, o_orderkey LIMIT 200) WHERE position BETWEEN 4 AND 10 AND impressions > 50 ORDER BY impressions DESC, o_orderkey LIMIT 20")
def l01(spark, sf):
    rows = table(spark, sf, "orders").withColumns({"impressions": F.col("o_orderkey") % 1000, "position": F.col("o_orderkey") % 17 + F.lit(0.5)})
    return metrics.quick_wins(rows, "o_orderkey").select("o_orderkey", "impressions")


@query("l04_limit_then_sort", "SELECT p_partkey, p_retailprice FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 50) ORDER BY p_retailprice DESC, p_partkey")
def l04(spark, sf):
    """The first 50 in order of arrival, then by value."""
    return table(spark, sf, "part").orderBy("p_partkey").limit(50).orderBy(F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_retailprice")


@query(
    "l07_first_of_sorted",
    "SELECT o_custkey, array_to_string(list_slice(list_sort(list(DISTINCT o_orderpriority)), 1, 3), ',') AS shown, count(DISTINCT o_orderpriority) AS all_of_them FROM orders GROUP BY o_custkey",
)
def l07(spark, sf):
    """Per customer the first three priorities in order, and how many there are."""
    names = F.array_sort(F.collect_set("o_orderpriority"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.slice(names, 1, 3), ",").alias("shown"), F.size(names).cast("long").alias("all_of_them"))


_WEEKS = "SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS week, round(avg(value), 6) AS p75 FROM events GROUP BY 1, 2"


@query(
    "w02_trends",
    f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY week) AS up, row_number() OVER (PARTITION BY event_type ORDER BY week DESC) AS down FROM ({_WEEKS}) WHERE p75 IS NOT NULL),
g AS (SELECT event_type, count(*) AS points, avg(CASE WHEN up <= 4 THEN p75 END) AS early, avg(CASE WHEN down <= 4 THEN p75 END) AS late FROM v GROUP BY event_type),
c AS (SELECT *, CASE WHEN early <> 0 THEN (late - early) * 100.0 / early END AS change FROM g)
SELECT event_type, points, CASE WHEN points >= 8 THEN round(early, 3) END AS early_avg, CASE WHEN points >= 8 THEN round(late, 3) END AS late_avg,
CASE WHEN points >= 8 THEN round(change, 1) END AS change_pct,
CASE WHEN points < 8 THEN 'insufficient_data' WHEN change IS NULL OR abs(change) < 5 THEN 'stable' WHEN change < 0 THEN 'improving' ELSE 'degrading' END AS trend FROM c""",
)
def w02(spark, sf):
    points = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("week")).agg(F.round(F.avg("value"), 6).alias("p75"))
    return metrics.trends(points, ["event_type"], "week", "p75")


@query(
    "w08_gaps",
    "SELECT user_id, count(*) AS events, count(*) FILTER (WHERE gap > 1) AS long_gaps, max(gap) AS longest FROM (SELECT user_id, date_diff('day', lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id), CAST(ts AS DATE)) AS gap FROM events) GROUP BY user_id",
)
def w08(spark, sf):
    """Days between a user's events."""
    before = F.lag(F.to_date("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gaps = table(spark, sf, "events").select("user_id", F.date_diff(F.to_date("ts"), before).cast("long").alias("gap"))
    return gaps.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("gap") > 1).alias("long_gaps"), F.max("gap").alias("longest"))


@query(
    "a24_velocity",
    "SELECT event_type, day, n, n > 2 * avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS spike FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)",
)
def a24(spark, sf):
    """Days with more than twice the mean of the week before."""
    days = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    week = Window.partitionBy("event_type").orderBy("day").rowsBetween(-7, -1)
    return days.withColumn("spike", F.col("n") > 2 * F.avg("n").over(week))


@query(
    "a25_review_velocity",
    "SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS reviews, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 4) AS response_rate FROM events GROUP BY 1, 2",
)
def a25(spark, sf):
    month = F.trunc(F.to_date("ts"), "month").alias("month")
    return table(spark, sf, "events").groupBy("event_type", month).agg(F.count("*").alias("reviews"), F.round(F.avg((F.col("value") > 50).cast("double")), 4).alias("response_rate"))


@query(
    "a15_traffic_totals",
    "SELECT CAST(sum(s) AS BIGINT) AS sessions, CAST(sum(u) AS BIGINT) AS users, CAST(sum(n) AS BIGINT) AS pageviews, round(sum(s) / count(*), 1) AS avg_daily_sessions FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS u, count(DISTINCT user_id * 24 + hour(ts)) AS s FROM events GROUP BY 1)",
)
def a15(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("pageviews"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.col("user_id") * 24 + F.hour("ts")).alias("sessions"))
    return metrics.traffic_totals(days)


@query(
    "a17_verdicts",
    "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS pass, count(*) FILTER (WHERE o_orderstatus = 'O') AS fail, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS neutral, count(*) FILTER (WHERE o_orderstatus IS NULL) AS error FROM orders",
)
def a17(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").agg(F.count_if(s == "F").alias("pass"), F.count_if(s == "O").alias("fail"), F.count_if(~s.isin("F", "O")).alias("neutral"), F.count_if(s.isNull()).alias("error"))


@query(
    "a10_label_histogram",
    "SELECT label, coalesce(n, 0) AS n FROM (SELECT unnest(['click', 'view', 'never-seen', 'other']) AS label) LEFT JOIN (SELECT CASE WHEN event_type IN ('click', 'view', 'never-seen') THEN event_type ELSE 'other' END AS label, count(*) AS n FROM events GROUP BY 1) USING (label)",
)
def a10(spark, sf):
    return metrics.labelled_histogram(table(spark, sf, "events"), ["click", "view", "never-seen"], "event_type")


@query(
    "a27_price_outliers",
    """SELECT p_brand, p_partkey, p_retailprice, round(median, 2) AS median FROM part JOIN (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS median, stddev_pop(p_retailprice) AS d FROM part GROUP BY p_brand) USING (p_brand)
WHERE abs(p_retailprice - median) > 1.5 * d""",
)
def a27(spark, sf):
    return metrics.price_outliers(table(spark, sf, "part"), ["p_brand"], "p_partkey", "p_retailprice", 1.5)


@query("p17_rating", "SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value * 50 <= 2500 THEN 'good' WHEN value * 50 <= 4000 THEN 'needs-improvement' ELSE 'poor' END AS rating FROM events")
def p17(spark, sf):
    return table(spark, sf, "events").select("event_id", values.rating(F.lit("LCP"), F.col("value") * 50).alias("rating"))


@query(
    "p09_vendor_values",
    """SELECT p_partkey, round(TRY_CAST(replace(replace('$' || CAST(p_retailprice AS VARCHAR), '$', ''), ',', '') AS DOUBLE), 2) AS price,
CASE WHEN length(trim(left(p_type, 4))) >= 3 THEN left(upper(trim(left(p_type, 4))), 3) ELSE 'USD' END AS currency,
CASE WHEN p_size % 3 = 0 THEN 'in_stock' WHEN p_size % 3 = 1 THEN 'out_of_stock' ELSE 'preorder' END AS availability,
coalesce(TRY_CAST(p_name AS DOUBLE), 0.0) AS number, CAST(greatest(p_size - 25, 0) AS BIGINT) AS bounded FROM part""",
)
def p09(spark, sf):
    said = F.when(F.col("p_size") % 3 == 0, "In Stock").when(F.col("p_size") % 3 == 1, "currently unavailable").otherwise("Pre-Order")
    return table(spark, sf, "part").select(
        "p_partkey", values.price(F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))).alias("price"), values.currency(F.left("p_type", F.lit(4))).alias("currency"),
        values.availability(said).alias("availability"), values.number(F.col("p_name")).alias("number"), values.bounded(F.col("p_size") - 25).alias("bounded"),
    )


@query(
    "p20_registration_age",
    "SELECT o_orderkey, round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') / 365.25, 2) + 0.0 AS age, coalesce(CAST(o_orderdate AS DATE) <= DATE '1996-12-31' AND CAST(o_orderdate AS DATE) + INTERVAL 30 DAY >= DATE '1996-01-01', false) AS in_window FROM orders",
)
def p20(spark, sf):
    day = F.to_date("o_orderdate")
    lit = lambda d: F.lit(d).cast("date")
    return table(spark, sf, "orders").select("o_orderkey", values.age_years(day, lit("2000-01-01")).alias("age"), values.overlaps(day, F.date_add(day, 30), lit("1996-01-01"), lit("1996-12-31")).alias("in_window"))


@query(
    "v15_domain_risk",
    "SELECT c_custkey, CASE WHEN shift AND (age < 2 OR age >= 5) THEN 'high' WHEN shift THEN 'medium' WHEN NOT shift AND age >= 1 THEN 'low' ELSE 'unknown' END AS risk FROM (SELECT c_custkey, c_acctbal / 1000 AS age, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS shift FROM customer)",
)
def v15(spark, sf):
    shift = F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False)
    return table(spark, sf, "customer").select("c_custkey", metrics.domain_risk(F.col("c_acctbal") / 1000, shift).alias("risk"))


@query(
    "v13_dominant_parts",
    "SELECT l_orderkey, l_linenumber, part, round(v / s, 4) AS share, coalesce(v / s >= 0.4, false) AS dominant FROM (SELECT l_orderkey, l_linenumber, l_quantity + l_discount * 100 + l_tax * 100 AS s, unnest(['l_quantity', 'discount', 'tax']) AS part, unnest([l_quantity, l_discount * 100, l_tax * 100]) AS v FROM lineitem)",
)
def v13(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"discount": F.col("l_discount") * 100, "tax": F.col("l_tax") * 100})
    return metrics.dominant_parts(rows, ["l_orderkey", "l_linenumber"], ["l_quantity", "discount", "tax"])


def _score_sql(weights, least, parts):
    total = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in weights.items())
    top = " + ".join(f"coalesce({c}, 0.0) * {w}" for c, w in weights.items())
    n = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in weights)
    return f"SELECT c_custkey, CAST({n} AS BIGINT) AS factors, CASE WHEN {n} >= {least} AND {total} > 0 THEN round(({top}) / ({total}), 2) END AS score FROM (SELECT c_custkey, {parts} FROM customer)"


def _factors(weights):
    return ", ".join(f"CASE WHEN (c_custkey + {k}) % 3 > 0 THEN CAST((c_custkey * {k + 3}) % 101 AS DOUBLE) END AS {c}" for k, c in enumerate(weights))


def _scored(weights, least):
    def run(spark, sf):
        key = F.col("c_custkey")
        rows = table(spark, sf, "customer").select("c_custkey", *[F.when((key + k) % 3 > 0, ((key * (k + 3)) % 101).cast("double")).alias(c) for k, c in enumerate(weights)])
        return metrics.weighted_score(rows, weights, least).select("c_custkey", "factors", "score")

    return run


for _name, _weights, _least in (
    ("c01_site_health", metrics.SITE_HEALTH, 1), ("c03_backlink_health", metrics.BACKLINK_HEALTH, 4), ("c05_trust", metrics.TRUST, 1), ("c06_generative", metrics.GENERATIVE, 1),
    ("c07_local", metrics.LOCAL, 1), ("c08_shop_page", metrics.SHOP_PAGE, 1), ("c10_parity", metrics.PARITY, 1),
):
    query(_name, _score_sql(_weights, _least, _factors(_weights)))(_scored(_weights, _least))
