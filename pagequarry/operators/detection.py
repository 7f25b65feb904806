"""What pages, sites, link profiles and reviews look like: page types, business types, locale markers, velocities.

Signals are column expressions; everything is grouped by page, site or business, with sums per
day, week or month before any window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Page types, the first that holds decides, with the signals each needs.
PAGE_TYPES = (
    ("Tool", ("tool",)),
    ("Local", ("address", "map")),
    ("Comparison", ("comparison_table", "versus")),
    ("Product", ("price", "buy_button")),
    ("Landing Page", ("many_calls", "little_navigation")),
    ("Service Page", ("process", "case_studies")),
    ("Hybrid", ("educational", "calls")),
)
DEFAULT_PAGE_TYPE = "Blog Post"
# Signals of business types and of local trades. Those that begin with a slash are paths.
BUSINESS_SIGNALS = {
    "SaaS": ("/pricing", "/features", "/integrations", "/docs", "free trial", "sign up"),
    "Local Service": ("phone", "address", "service area", "serving ", "google.com/maps/embed"),
    "E-commerce": ("/products", "/collections", "/cart", "add to cart", '"product"'),
    "Publisher": ("/blog", "/articles", "/topics", '"article"', "/author", "published on"),
    "Agency": ("/case-studies", "/portfolio", "/industries", "our work", "client logos"),
}
TRADE_SIGNALS = {
    "Restaurant": ("/menu", "menu items", "reservations", "cuisine", "food ordering", "dine-in", "takeout"),
    "Healthcare": ("insurance accepted", "patients", "appointments", "npi", "dr.", "hipaa"),
    "Legal": ("attorney", "lawyer", "practice areas", "bar admission", "case results", "free consultation"),
    "Home Services": ("service area", "emergency service", "free estimate", "licensed", "insured", "bonded", "24/7"),
    "Real Estate": ("listings", "mls", "properties for sale", "properties for rent", "brokerage", "open house"),
    "Automotive": ("inventory", "vin", "test drive", "dealership", "service department", "certified"),
}
# Markers of a page made for another market: name, severity, pattern, languages it is checked in (None: all but English).
_EURO = ("de", "fr", "es", "it", "nl", "pt", "fi", "ie")
LOCALE_MARKERS = (
    ("foreign-brand", "Medium", r"(?i)\b(?:Walmart|Target\.com|Best Buy|Walgreens|CVS Pharmacy)\b", None),
    ("foreign-statistics", "Medium", r"(?i)\b\d+\s?% of (?:Americans|US adults|U\.S\. adults)\b", None),
    ("aggressive-call", "Low", r"\b(?:BUY NOW|ACT NOW|ORDER NOW|HURRY)!", ("ja", "ko", "zh", "de")),
    ("foreign-law", "High", r"\b(?:CCPA|HIPAA|COPPA|CAN-SPAM)\b", None),
    ("currency-or-unit", "High", r"(?:US)?\$\s?\d|(?i)\b\d+(?:\.\d+)?\s?(?:miles|pounds|inches|feet|ounces|fahrenheit)\b", _EURO),
    ("untranslated", "Medium", r"(?i)\b(?:read more|learn more|add to cart|sign up|contact us|click here)\b", None),
)


def page_type(signals: dict[str, Column]) -> Column:
    """The first type all of whose signals hold; signals that are null or not given do not hold."""
    holds = lambda name: F.coalesce(signals[name], F.lit(False)) if name in signals else F.lit(False)
    types = F.when(F.lit(False), "")
    for name, needed in PAGE_TYPES:
        test = holds(needed[0])
        for other in needed[1:]:
            test = test & holds(other)
        types = types.when(test, name)
    return types.otherwise(DEFAULT_PAGE_TYPE)


def page_type_signals(html: Column) -> dict[str, Column]:
    """Signals of page types as patterns over markup; what calls for action three times or more has many calls, and ten links or fewer are little navigation."""
    has = lambda pattern: F.coalesce(html.rlike(pattern), F.lit(False))
    calls = F.regexp_count(html, F.lit(r"(?i)>\s*(?:get started|sign up|buy now|book now|try (?:it )?free|request a demo|subscribe)\b"))
    return {
        "tool": has(r"(?i)<(?:canvas|output)\b|calculator|data-tool"), "address": has(r"(?i)<address\b|PostalAddress"), "map": has(r"(?i)maps/embed|openstreetmap\.org/export"),
        "comparison_table": has(r"(?i)<table\b"), "versus": has(r"(?i)\bvs\.?\b|\bversus\b"), "price": has(r"(?i)itemprop=.price|[$€£]\s?\d"), "buy_button": has(r"(?i)add to (?:cart|basket)|buy now"),
        "many_calls": calls >= 3, "calls": calls >= 1, "little_navigation": F.regexp_count(html, F.lit(r"(?i)<a\s")) <= 10, "process": has(r"(?i)our process|how we work"),
        "case_studies": has(r"(?i)case stud(?:y|ies)"), "educational": has(r"(?i)\bhow to\b|\bguide\b|\btutorial\b|\bwhat is\b"),
    }


def _signals_met(path: Column, text: Column, kinds: dict[str, tuple[str, ...]]) -> Column:
    low, at = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    hits = [
        F.when(((at == s) | at.startswith(s + "/")) if s.startswith("/") else low.contains(s), F.struct(F.lit(kind).alias("kind"), F.lit(s).alias("signal")))
        for kind, signals in kinds.items()
        for s in signals
    ]
    return F.array_compact(F.array(*hits))


def business_type(pages: DataFrame, kinds: dict[str, tuple[str, ...]] = BUSINESS_SIGNALS) -> DataFrame:
    """(site, kind, n_signals, second, ambiguous) of sites with a signal, from pages (site, path, text).

    A signal counts once a site. The kind with most signals wins, ties in the order of ``kinds``;
    second is the runner-up, and ambiguous says that it has as many.
    """
    order = F.create_map(*[F.lit(x) for pair in zip(kinds, range(len(kinds)), strict=True) for x in pair])
    met = pages.select("site", F.explode(_signals_met(F.col("path"), F.col("text"), kinds)).alias("s")).select("site", "s.kind", "s.signal").distinct()
    counts = met.groupBy("site", "kind").agg(F.count("*").alias("n"))
    ranked = counts.groupBy("site").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), order[F.col("kind")].alias("rank"), "kind"))).alias("r"))
    second = F.get("r", F.lit(1))
    return ranked.select("site", F.col("r")[0]["kind"].alias("kind"), (-F.col("r")[0]["down"]).alias("n_signals"), second["kind"].alias("second"), F.coalesce(second["down"] == F.col("r")[0]["down"], F.lit(False)).alias("ambiguous"))


def locale_markers(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, lang, marker, severity, n) for each marker of another market in pages (key, lang, text); English pages have none."""
    lang = F.lower(F.substring_index("lang", "-", 1))
    tests = []
    for name, severity, pattern, langs in LOCALE_MARKERS:
        checked = lang.isin(*langs) if langs else lang != "en"
        n = F.when(checked, F.regexp_count("text", F.lit(pattern)))
        tests.append(F.when(n > 0, F.struct(F.lit(name).alias("marker"), F.lit(severity).alias("severity"), n.alias("n"))))
    return pages.select(key, "lang", F.explode(F.array_compact(F.array(*tests))).alias("m")).select(key, "lang", "m.*")


def link_velocity(links: DataFrame, until: Column, spike: int = 10, lost_share: float = 0.5, quiet_months: int = 3, least_same: int = 5) -> DataFrame:
    """(target, flag, period, n) of links (target, tld, first_seen, lost_at).

    spike: a week with ``spike`` times the mean of the target's earlier weeks, those without links
    included. losses: a month that loses the share or more of the links alive at its start. quiet: so
    many months or more without a new link, up to ``until`` (period: the first of them, n: their
    number). same-tld: a week with ``least_same`` new links or more, all of one tld.
    """
    week, month = F.date_trunc("week", "first_seen").cast("date"), F.trunc("first_seen", "month")
    weeks = links.groupBy("target", week.alias("period")).agg(F.count("*").alias("n"), F.min("tld").alias("lo"), F.max("tld").alias("hi"))
    before = Window.partitionBy("target").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    earlier = weeks.withColumns({"sum": F.sum("n").over(before), "weeks": F.datediff("period", F.min("period").over(before)) / 7})
    spikes = earlier.where(F.col("n") * F.col("weeks") >= F.col("sum") * spike).select("target", F.lit("spike").alias("flag"), "period", "n")
    same = weeks.where((F.col("n") >= least_same) & (F.col("lo") == F.col("hi"))).select("target", F.lit("same-tld").alias("flag"), "period", "n")

    gained = links.groupBy("target", month.alias("period")).agg(F.count("*").alias("gained"), F.lit(0).cast("long").alias("lost"))
    gone = links.where("lost_at is not null").groupBy("target", F.trunc("lost_at", "month").alias("period")).agg(F.lit(0).cast("long").alias("gained"), F.count("*").alias("lost"))
    months = gained.union(gone).groupBy("target", "period").agg(F.sum("gained").alias("gained"), F.sum("lost").alias("lost"))
    alive = months.withColumn("alive", F.sum(F.col("gained") - F.col("lost")).over(before))
    losses = alive.where((F.col("alive") > 0) & (F.col("lost") >= F.col("alive") * lost_share)).select("target", F.lit("losses").alias("flag"), "period", F.col("lost").alias("n"))

    end = F.trunc(until, "month")
    following = F.coalesce(F.lead("period").over(Window.partitionBy("target").orderBy("period")), F.add_months(end, 1))
    gaps = gained.withColumn("n", (F.months_between(following, "period") - 1).cast("long")).where(F.col("n") >= quiet_months)
    quiet = gaps.select("target", F.lit("quiet").alias("flag"), F.add_months("period", 1).alias("period"), "n")
    return spikes.union(same).union(losses).union(quiet)


def review_velocity(reviews: DataFrame, until: Column, months: int = 6, gap_days: int = 21) -> DataFrame:
    """(business, reviews, per_month, response_rate, stars_1 to stars_5, longest_gap, ranking_risk) of reviews (business, rating, ts, answered) up to a date.

    per_month is the mean of the last months; stars are shares; the longest gap, in days, is between
    days with reviews, the time since the last one included.
    """
    day = F.to_date("ts")
    seen = reviews.where(day <= until)
    recent = F.count_if(day > F.add_months(until, -months))
    star = [(F.count_if(F.round("rating") == k) / F.count("rating")).alias(f"stars_{k}") for k in range(1, 6)]
    facts = seen.groupBy("business").agg(F.count("*").alias("reviews"), (recent / months).alias("per_month"), F.avg(F.coalesce("answered", F.lit(False)).cast("int")).alias("response_rate"), *star)
    days = seen.select("business", day.alias("day")).distinct()
    following = F.coalesce(F.lead("day").over(Window.partitionBy("business").orderBy("day")), until)
    gaps = days.withColumn("gap", F.datediff(following, "day")).groupBy("business").agg(F.max("gap").alias("longest_gap"))
    return facts.join(gaps, "business").withColumn("ranking_risk", F.col("longest_gap") > gap_days)


def price_rating(items: DataFrame, by: list[str], price: str, rating: str) -> DataFrame:
    """Correlation of price and rating in each group, over items that have both; null where either does not vary."""
    both = items.where(F.col(price).isNotNull() & F.col(rating).isNotNull())
    varies = (F.min(price) < F.max(price)) & (F.min(rating) < F.max(rating))
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.when(varies, F.corr(price, rating)).alias("correlation"))


def heat_rows(points: DataFrame, by: str = "keyword") -> DataFrame:
    """Rows of a grid of ranks as text, from points (by, row, col, rank): (by, row, line).

    Ranks to 10 are digits (10 as 9), to 20 a plus, others a minus; the middle point of a grid stands in brackets.
    """
    size = points.groupBy(by).agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    rank = F.col("rank")
    symbol = F.when(rank <= 10, F.least(rank, F.lit(9)).cast("string")).when(rank <= 20, "+").otherwise("-")
    middle = (F.col("row") * 2 == F.col("rows")) & (F.col("col") * 2 == F.col("cols"))
    drawn = points.join(size, by).withColumn("symbol", F.when(middle, F.concat(F.lit("["), symbol, F.lit("]"))).otherwise(symbol))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "symbol"))), lambda x: x["symbol"]), " ")
    return drawn.groupBy(by, "row").agg(line.alias("line"))
