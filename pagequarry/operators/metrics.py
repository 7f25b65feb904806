"""Price statistics, spend ledgers, search and traffic facts, trends, and guards over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import exact_percentiles


def _beside(rows: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of their group in groups (by, ...); nulls in ``by`` are equal."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))  # one row
    groups = groups.select(*[F.col(c).alias(f"__{c}" if c in by else c) for c in groups.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return rows.join(groups, same, how).drop(*[f"__{c}" for c in by])


def price_statistics(facts: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, min, max, mean, quartiles (linear interpolation) and population deviation of a value, to two decimals."""
    quartiles = exact_percentiles(facts, by, value, [0.25, 0.5, 0.75])
    r = lambda c: F.round(F.round(c, 6), 2)  # noqa: E731  interpolation leaves a last digit of noise at halves
    out = facts.groupBy(*by).agg(
        F.count(value).alias("count"), r(F.min(value)).alias("min"), r(F.max(value)).alias("max"), r(F.avg(value)).alias("mean"),
        r(F.stddev_pop(value)).alias("std_dev"),
    )
    out = _beside(out, quartiles, by, "left")
    return out.withColumns({"p25": r(F.get("q", F.lit(0))), "median": r(F.get("q", F.lit(1))), "p75": r(F.get("q", F.lit(2)))}).drop("q")


def search_summary(items: DataFrame, by: list[str], price: str, rating: str, reviews: str) -> DataFrame:
    """Per group: items, least, highest and upper-median price, mean of the ratings above zero, mean of the review counts.

    The upper median is the price at place n div 2 of the ascending order; it comes
    from counts of each price and their running sum, so no group is gathered.
    """
    priced = items.where(F.col(price).isNotNull())
    counts = priced.groupBy(*by, price).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    upto = counts.withColumn("upto", F.sum("n").over(group.orderBy(price).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(group))
    median = upto.where(F.col("upto") > F.expr("`all` div 2")).groupBy(*by).agg(F.min(price).alias("price_median"))
    summary = items.groupBy(*by).agg(
        F.count("*").alias("items"), F.min(price).alias("price_min"), F.max(price).alias("price_max"),
        F.round(F.avg(F.when(F.col(rating) > 0, F.col(rating))), 2).alias("avg_rating"), F.round(F.avg(reviews), 1).alias("avg_reviews"),
    )
    return summary.join(median, by, "left")


def top_per_group(items: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order, with their rank."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def dominance(items: DataFrame, seller: str, position: str, n: int = 10) -> DataFrame:
    """Sellers with the most listings, the first seen before others; share of all listings in percent."""
    counted = items.groupBy(seller).agg(F.count("*").alias("listings"), F.min(position).alias("first_seen"))
    total = counted.agg(F.sum("listings").alias("total"))
    shared = counted.crossJoin(F.broadcast(total))  # one row
    return shared.select(seller, "listings", "first_seen", F.round(F.col("listings") * 100.0 / F.col("total"), 2).alias("share_pct")).orderBy(F.desc("listings"), "first_seen", seller).limit(n)


def spend_by_day(ledger: DataFrame, time: str = "timestamp", cost: str = "cost") -> DataFrame:
    """Calls and cost per day, and a last row without day for all of them."""
    day = F.to_date(time).alias("day")
    return ledger.select(day, F.col(cost).alias("cost")).rollup("day").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("total_cost"), F.grouping("day").cast("int").alias("is_total"))


def spend_on_day(ledger: DataFrame, day: str, limit: float, time: str = "timestamp", endpoint: str = "endpoint", cost: str = "cost") -> DataFrame:
    """Calls and cost of one day by endpoint, with what remains of the day's limit."""
    by = ledger.where(F.to_date(time) == F.lit(day).cast("date")).groupBy(F.col(endpoint).alias("endpoint")).agg(F.count("*").alias("calls"), F.sum(cost).alias("c"))
    total = F.sum("c").over(Window.partitionBy(F.lit(1)))  # one row per endpoint
    return by.select("endpoint", "calls", F.round("c", 4).alias("cost"), F.round(F.greatest(F.lit(0.0), limit - total), 4).alias("remaining"))


def budget_to_date(ledger: DataFrame, limit: float, time: str = "timestamp", cost: str = "cost", tie: str = "event_id") -> DataFrame:
    """ledger with spent_before (the day's cost before a call, in order of time) and allowed (the call fits the day's limit).

    Costs are summed by minute first, so that a busy day is the work of many tasks.
    """
    keyed = ledger.withColumn("__pq_minute", F.date_trunc("minute", time))
    before = lambda window: F.coalesce(F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    minutes = keyed.groupBy("__pq_minute").agg(F.sum(cost).alias(cost))
    minutes = minutes.select("__pq_minute", before(Window.partitionBy(F.to_date("__pq_minute")).orderBy("__pq_minute")).alias("__pq_earlier"))
    inside = before(Window.partitionBy("__pq_minute").orderBy(time, tie))
    spent = keyed.withColumn("__pq_inside", inside).join(minutes, "__pq_minute", "left")
    spent = spent.withColumn("spent_before", F.round(F.coalesce("__pq_earlier", F.lit(0.0)) + F.col("__pq_inside"), 4)).drop("__pq_minute", "__pq_inside", "__pq_earlier")
    return spent.withColumn("allowed", F.col("spent_before") + F.col(cost) <= limit)


def spend_guard(calls: DataFrame, costs: DataFrame, daily_limit: float, threshold: float, warn_only: list[str] | None = None, always: bool = False) -> DataFrame:
    """calls (endpoint, spent_before) with cost and status.

    An unknown endpoint needs approval; a call over the daily limit is blocked, which
    is tested before approval; then endpoints that only warn, the mode that always
    asks, and costs at the threshold or above.
    """
    joined = calls.join(costs, "endpoint", "left")
    status = (
        F.when(F.col("cost").isNull(), "needs_approval")
        .when(F.col("spent_before") + F.col("cost") > daily_limit, "blocked")
        .when(F.col("endpoint").isin(warn_only or []), "warn")
        .when(F.lit(always) | (F.col("cost") >= threshold), "needs_approval")
        .otherwise("approved")
    )
    return joined.withColumn("status", status)


def site_totals(detail: DataFrame, true_total: DataFrame | None) -> DataFrame:
    """One row of clicks and impressions: the source's own totals, or the sum of rows, which undercounts and says so."""
    summed = detail.agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("row_clicks"), F.coalesce(F.sum("impressions"), F.lit(0)).alias("row_impressions"))
    total = true_total.select(F.col("clicks").alias("true_clicks"), F.col("impressions").alias("true_impressions")) if true_total is not None else summed.select(F.lit(None).cast("bigint").alias("true_clicks"), F.lit(None).cast("bigint").alias("true_impressions"))
    joined = summed.join(total.limit(1), F.lit(True), "left")  # one row on either side
    known = F.col("true_clicks").isNotNull()
    clicks, impressions = F.coalesce("true_clicks", "row_clicks"), F.coalesce("true_impressions", "row_impressions")
    return joined.select(
        clicks.alias("clicks"), impressions.alias("impressions"), F.when(impressions > 0, F.round(clicks * 100.0 / impressions, 2)).otherwise(0.0).alias("ctr"),
        F.when(known, "aggregate").otherwise("partial_row_sum").alias("totals_source"), known.alias("totals_complete"),
    )


def traffic_totals(days: DataFrame) -> DataFrame:
    """Sums over daily traffic, and the mean of daily sessions."""
    return days.agg(F.sum("sessions").alias("sessions"), F.sum("users").alias("users"), F.sum("pageviews").alias("pageviews"), F.round(F.sum("sessions") / F.count("*"), 1).alias("avg_daily_sessions"))


def traffic_by(facts: DataFrame, by: list[str], channel: str = "Organic Search", most: int | None = None) -> DataFrame:
    """Sessions, users, and bounce and engagement rates of one channel, by landing page, device, country or day; with ``most`` the first by sessions.

    facts: channel, sessions, users, bounced, engaged (sessions), and the columns of ``by``. Rates are over sessions, in percent to one decimal, null without sessions.
    """
    rows = facts.where(F.col("channel") == channel).groupBy(*by).agg(F.sum("sessions").alias("sessions"), F.sum("users").alias("users"), F.sum("bounced").alias("b"), F.sum("engaged").alias("e"))
    rate = lambda c: F.when(F.col("sessions") > 0, F.round(F.col(c) * 100.0 / F.col("sessions"), 1))
    out = rows.select(*by, "sessions", "users", rate("b").alias("bounce_rate"), rate("e").alias("engagement_rate"))
    return out.orderBy(F.desc("sessions"), *by).limit(most) if most is not None else out


def position_buckets(rows: DataFrame, position: str = "position") -> DataFrame:
    p = F.col(position)
    return rows.agg(F.count_if(p <= 3).alias("top3"), F.count_if(p <= 10).alias("top10"), F.count_if(p > 10).alias("beyond"))


def quick_wins(rows: DataFrame, tie: str, candidates: int = 200, most: int = 20) -> DataFrame:
    """Of the rows with the most impressions, those at positions 4 to 10 with more than 50 impressions; the limits are the feature."""
    order = [F.desc("impressions"), F.col(tie)]
    return rows.orderBy(*order).limit(candidates).where("position between 4 and 10 and impressions > 50").orderBy(*order).limit(most)


def trends(points: DataFrame, key: list[str], order: str, value: str, stable_pct: float = 5.0) -> DataFrame:
    """Mean of the first four values against that of the last four: direction and change in percent.

    Nulls are left out; fewer than eight values are too few. Falling is improving.
    """
    by = Window.partitionBy(*key)
    valid = points.where(F.col(value).isNotNull())
    placed = valid.withColumns({"up": F.row_number().over(by.orderBy(order)), "down": F.row_number().over(by.orderBy(F.desc(order)))})
    out = placed.groupBy(*key).agg(F.count("*").alias("points"), F.avg(F.when(F.col("up") <= 4, F.col(value))).alias("early"), F.avg(F.when(F.col("down") <= 4, F.col(value))).alias("late"))
    change = F.when(F.col("early") != 0, (F.col("late") - F.col("early")) * 100.0 / F.col("early"))
    direction = F.when(F.col("points") < 8, "insufficient_data").when(change.isNull() | (F.abs(change) < stable_pct), "stable").when(change < 0, "improving").otherwise("degrading")
    enough = F.col("points") >= 8
    return out.select(*key, "points", F.when(enough, F.round("early", 3)).alias("early_avg"), F.when(enough, F.round("late", 3)).alias("late_avg"), F.when(enough, F.round(change, 1)).alias("change_pct"), direction.alias("trend"))


def dominant_parts(totals: DataFrame, key: list[str], parts: list[str], share: float = 0.40) -> DataFrame:
    """One row per part of a total: its share, and whether it is at least ``share`` of the sum."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("double").alias("value")) for p in parts]))
    long = totals.select(*key, sum((F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in parts), F.lit(0.0)).alias("sum"), pairs.alias("x"))
    ratio = F.when(F.col("sum") > 0, F.col("x.value") / F.col("sum"))
    return long.select(*key, F.col("x.part").alias("part"), F.round(ratio, 4).alias("share"), F.coalesce(ratio >= share, F.lit(False)).alias("dominant"))


def domain_risk(age_years: Column, topic_shift: Column) -> Column:
    """Risk of a domain's history; what is not known stays unknown."""
    shift, age = F.coalesce(topic_shift, F.lit(None).cast("boolean")), age_years
    return (
        F.when(shift & ((age < 2) | (age >= 5)), "high")
        .when(shift, "medium")
        .when(~shift & (age >= 1), "low")
        .otherwise("unknown")
    )


def price_outliers(items: DataFrame, by: list[str], key: str, price: str, widths: float = 2.0) -> DataFrame:
    """Items further than ``widths`` population deviations from their group's median."""
    stats = items.groupBy(*by).agg(F.stddev_pop(price).alias("deviation"))
    stats = _beside(stats, exact_percentiles(items, by, price, [0.5]).withColumn("median", F.get("q", F.lit(0))).drop("q"), by)
    joined = _beside(items, stats, by)
    far = F.abs(F.col(price) - F.col("median")) > widths * F.col("deviation")
    return joined.where(far).select(*by, key, F.col(price), F.round("median", 2).alias("median"))


def labelled_histogram(facts: DataFrame, labels: list[str], column: str) -> DataFrame:
    """Rows per label, with zero for labels that do not occur, and "other" for values that are no label."""
    spark = facts.sparkSession
    known = spark.createDataFrame([(x,) for x in [*labels, "other"]], "label string")
    counted = facts.groupBy(F.when(F.col(column).isin(labels), F.col(column)).otherwise("other").alias("label")).agg(F.count("*").alias("n"))
    return known.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def within_budget(rows: DataFrame, order: str, text: str, tokens: int = 4000, chars_per_token: float = 3.5, part: list[str] | None = None, spread: int = 64) -> DataFrame:
    """The longest prefix of rows (per part) whose text fits a context of so many tokens.

    A part is first cut into ``spread`` shares by the hash of the order. A row that has more than the
    budget before it in its share alone is out, and what stays of the share shows that for all later
    rows; so only some budgets' worth of rows of each part meet in one task, however large the part.
    """
    most, by = tokens * chars_per_token, [F.col(p) for p in part or []]
    share = Window.partitionBy(*by, F.pmod(F.xxhash64(order), F.lit(spread))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("__pq_before", F.sum(F.length(text)).over(share)).where(F.coalesce("__pq_before", F.lit(0)) <= most).drop("__pq_before")
    whole = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("upto_chars", F.sum(F.length(text)).over(whole)).where(F.col("upto_chars") <= most)


def weighted_score(rows: DataFrame, weights: dict[str, float], least_factors: int = 1, name: str = "score") -> DataFrame:
    """rows with the weighted mean of the factors that are present, and their number.

    The weights of missing factors are spread over the others; with fewer than
    ``least_factors`` there is no score.
    """
    present = lambda c: F.col(c).isNotNull().cast("int")
    n = sum((present(c) for c in weights), F.lit(0))
    total = sum((present(c) * w for c, w in weights.items()), F.lit(0.0))
    weighted = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return rows.withColumns({"factors": n.cast("long"), name: F.when((n >= least_factors) & (total > 0), F.round(weighted / total, 2))})


# Weights of the composite scores.
SITE_HEALTH = {"technical": 0.22, "content": 0.23, "on_page": 0.20, "schema": 0.10, "vitals": 0.10, "ai_ready": 0.10, "images": 0.05}
BACKLINK_HEALTH = {"referring_domains": 0.20, "domain_quality": 0.20, "anchor_mix": 0.15, "toxic_share": 0.20, "velocity": 0.10, "follow_ratio": 0.05, "relevance": 0.10}
TRUST = {"experience": 0.20, "expertise": 0.25, "authority": 0.25, "trust": 0.30}
GENERATIVE = {"citability": 0.25, "structure": 0.20, "multimodal": 0.15, "authority": 0.20, "technical": 0.20}
LOCAL = {"profile": 0.25, "reviews": 0.20, "citations": 0.20, "on_page": 0.15, "schema": 0.10, "links": 0.10}
SHOP_PAGE = {"schema": 0.25, "images": 0.15, "content": 0.20, "price": 0.20, "reviews": 0.10, "technical": 0.10}
PARITY = {"content": 0.30, "seo": 0.30, "freshness": 0.25, "localization": 0.15}
