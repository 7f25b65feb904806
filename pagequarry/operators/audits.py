"""Audits over saved responses: vendor records, images, pages, headers, robots, listings, reviews, link statistics, gates.

All are joins, aggregates and column expressions. Vendor records are JSON strings; what a record
does not have takes the default that its field names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions import values

# --- vendor records


def _field(record: Column, *names: str, kind: str = "string") -> Column:
    """The first of the named fields that the record has and that casts."""
    return F.coalesce(*[F.try_variant_get(record, f"$.{n}", kind) for n in names])


def _said(record: Column, *names: str, default: str = "") -> Column:
    return F.coalesce(_field(record, *names), F.lit(default))


def _rated(record: Column, name: str = "rating") -> Column:
    """A rating that stands alone or inside an object, to one decimal."""
    return F.round(values.number(_field(record, f"{name}.value", f"{name}.rating_value", name)), 1)


def _records(items: DataFrame, raw: str, columns) -> DataFrame:
    keys = [c for c in items.columns if c != raw]
    record = F.col("__pq_record")
    return items.withColumn("__pq_record", F.try_parse_json(raw)).select(*keys, *[c.alias(n) for n, c in columns(record).items()])


def merchant_items(items: DataFrame, raw: str = "raw") -> DataFrame:
    """Product records in one shape; other columns of items pass through. Marketplace fields are null where a record has none."""
    return _records(items, raw, lambda r: {
        "title": _said(r, "title"), "price": values.price(_field(r, "price")), "currency": values.currency(_field(r, "currency")), "seller": _said(r, "seller", "seller_name"),
        "rating": _rated(r), "reviews_count": values.whole(_field(r, "reviews_count")), "url": _said(r, "url"), "image_url": _said(r, "image_url", "marketplace_url"),
        "availability": values.availability(_field(r, "availability")), "asin": _field(r, "asin"), "is_prime": _field(r, "is_prime", kind="boolean"),
        "is_best_seller": _field(r, "is_best_seller", kind="boolean"), "product_id": _field(r, "product_id"), "delivery_info": _field(r, "delivery_info"),
    })


def social_items(items: DataFrame, raw: str = "raw") -> DataFrame:
    """Records of posts and shares in one shape."""
    count = lambda r, *names: values.whole(_field(r, *names))
    return _records(items, raw, lambda r: {
        "url": _said(r, "url"), "title": _said(r, "title"), "platform": _said(r, "platform", "source", default="unknown"), "engagement_count": count(r, "engagement_count", "social_count"),
        "likes": count(r, "likes"), "shares": count(r, "shares"), "comments": count(r, "comments"), "date": _said(r, "date", "datetime"), "sentiment": _said(r, "sentiment", default="neutral"),
    })


def review_items(items: DataFrame, raw: str = "raw") -> DataFrame:
    """Review records in one shape."""
    return _records(items, raw, lambda r: {
        "author": _said(r, "author", "profile_name", default="Anonymous"), "rating": F.round(values.number(_field(r, "rating")), 1), "text": _said(r, "text", "review_text"),
        "date": _said(r, "date", "time_ago"), "source": _said(r, "source"), "verified": F.coalesce(_field(r, "is_verified", kind="boolean"), F.lit(False)),
        "helpful_count": values.whole(_field(r, "helpful_count", "likes")),
    })


def product_items(items: DataFrame, marketplace: str, raw: str = "raw") -> DataFrame:
    """The products of one marketplace."""
    wanted = ["title", "price", "currency", "seller", "rating", "reviews_count", "url", "image_url", "availability"]
    keys = [c for c in items.columns if c != raw]
    return merchant_items(items, raw).select(*keys, F.lit(marketplace).alias("marketplace"), *wanted)


def seller_items(items: DataFrame, raw: str = "raw") -> DataFrame:
    """Seller records in one shape."""
    return _records(items, raw, lambda r: {
        "seller_name": _said(r, "seller_name", "title"), "seller_rating": F.round(values.number(_field(r, "seller_rating")), 1), "seller_reviews_count": values.whole(_field(r, "seller_reviews_count")),
        "price": values.price(_field(r, "price")), "delivery_info": _said(r, "delivery_info"), "url": _said(r, "url"),
    })


# --- images and pages

# Kilobytes up to which an image is on target, and beyond which it is a warning or critical, by category.
IMAGE_SIZES = {"thumbnail": (50, 100, 200), "content": (100, 200, 500), "hero": (200, 300, 700)}
MODERN_FORMATS = ("webp", "avif", "svg")


def image_audit(images: DataFrame) -> DataFrame:
    """images (src, alt, width, height, bytes, category) with alt_status, has_dimensions, modern_format and size_tier."""
    size = F.col("bytes") / 1024
    tier = F.lit("unknown")
    for name, (target, warning, critical) in IMAGE_SIZES.items():
        mine = F.when(size > critical, "critical").when(size > warning, "warning").when(size < target, "target").otherwise("over-target")
        tier = F.when(F.col("category") == name, mine).otherwise(tier)
    alt = F.when(F.col("alt").isNull(), "missing").when(F.trim("alt") == "", "decorative").when(F.length("alt") < 10, "short").when(F.length("alt") > 125, "long").otherwise("ok")
    ending = F.lower(F.regexp_extract("src", r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return images.withColumns({"alt_status": alt, "has_dimensions": F.col("width").isNotNull() & F.col("height").isNotNull(), "modern_format": ending.isin(*MODERN_FORMATS), "size_tier": F.when(size.isNull(), "unknown").otherwise(tier)})


# Fixed values: (least words, least share of own content in percent) by type of page.
PAGE_GATES = {
    "homepage": (500, 100), "service": (800, 100), "location-primary": (600, 60), "location-secondary": (500, 40), "blog-post": (1500, 100),
    "product": (400, 80), "category": (400, 100), "about": (400, 100), "landing": (600, 100), "faq": (800, 100),
}


def thin_content(pages: DataFrame) -> DataFrame:
    """pages (page_type, words, unique_pct) with too_short and too_alike; null for types without a gate."""
    gates = pages.sparkSession.createDataFrame([(k, w, u) for k, (w, u) in PAGE_GATES.items()], "page_type string, __pq_words int, __pq_unique int")
    joined = pages.join(F.broadcast(gates), "page_type", "left")  # ten rows
    return joined.withColumns({"too_short": F.col("words") < F.col("__pq_words"), "too_alike": F.col("unique_pct") < F.col("__pq_unique")}).drop("__pq_words", "__pq_unique")


SECURITY_HEADERS = {"csp": "content-security-policy", "hsts": "strict-transport-security", "frame_options": "x-frame-options", "content_type_options": "x-content-type-options", "referrer_policy": "referrer-policy"}


def security_headers(responses: DataFrame, headers: str = "headers") -> DataFrame:
    """responses with a boolean per security header and the list of those missing; names in any case, null headers have none."""
    low = F.transform(F.map_keys(F.coalesce(F.col(headers), F.create_map().cast("map<string,string>"))), F.lower)
    has = {k: F.array_contains(low, F.lit(name)) for k, name in SECURITY_HEADERS.items()}
    missing = F.array_compact(F.array(*[F.when(~has[k], F.lit(name)) for k, name in SECURITY_HEADERS.items()]))
    return responses.withColumns({**has, "missing_headers": missing})


# Crawlers, and those that act for a user and do not ask robots.txt.
CRAWLERS = ("GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "PerplexityBot", "CCBot", "anthropic-ai", "Bytespider", "cohere-ai", "Google-Extended", "Google-CloudVertexBot", "Google-Agent", "Google-NotebookLM", "Google Messages")
USER_TRIGGERED = ("ChatGPT-User", "Google-Agent", "Google-NotebookLM", "Google Messages")


def crawler_matrix(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """(site, crawler, status) of each site and crawler; rules: site, agent, directive, path.

    A crawler without rules of its own has those of "*". blocked: "/" is disallowed and not allowed; partial: some
    path is disallowed; user-triggered: it does not ask.
    """
    lined = rules.select("site", F.lower("agent").alias("agent"), F.lower("directive").alias("directive"), F.trim("path").alias("path")).where("directive in ('allow', 'disallow')")
    group = lined.groupBy("site", "agent").agg(
        F.max((F.col("directive") == "disallow") & (F.col("path") == "/")).alias("closed"), F.max((F.col("directive") == "allow") & (F.col("path") == "/")).alias("opened"),
        F.max((F.col("directive") == "disallow") & (F.col("path") != "")).alias("some"),
    )
    group = group.withColumn("status", F.when(F.col("closed") & ~F.col("opened"), "blocked").when(F.col("some"), "partial").otherwise("allowed")).select("site", "agent", "status")
    asked = sites.select("site", F.explode(F.array(*[F.lit(c) for c in CRAWLERS])).alias("crawler")).withColumn("agent", F.lower("crawler"))
    every = group.where("agent = '*'").select("site", F.col("status").alias("of_all"))
    found = asked.join(group, ["site", "agent"], "left").join(every, "site", "left")
    status = F.when(F.col("crawler").isin(*USER_TRIGGERED), "user-triggered").otherwise(F.coalesce("status", "of_all", F.lit("allowed")))
    return found.select("site", "crawler", status.alias("status"))


def keyword_placement(pages: DataFrame) -> DataFrame:
    """pages (keyword, title, h1, slug, meta, text, alts) with six booleans in_... and their number; nulls hold nothing."""
    word = F.lower(F.trim("keyword"))
    has = lambda c: F.coalesce(F.contains(F.lower(c), word), F.lit(False))
    first = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 100), " ")
    found = {
        "in_title": has(F.col("title")), "in_h1": has(F.col("h1")), "in_slug": F.coalesce(F.contains(F.lower("slug"), F.replace(word, F.lit(" "), F.lit("-"))), F.lit(False)), "in_meta": has(F.col("meta")),
        "in_first_words": has(first), "in_alt": F.coalesce(F.exists("alts", lambda a: F.coalesce(F.contains(F.lower(a), word), F.lit(False))), F.lit(False)),
    }
    return pages.withColumns(found).withColumn("placements", sum((F.col(k).cast("int") for k in found), F.lit(0)))


def reading_ease(text: Column) -> Column:
    """Flesch reading ease to one decimal: syllables are groups of vowels, at least one a word; null for a text without words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z']*[a-z]"), F.lit(0))
    n = F.size(words)
    syllables = F.aggregate(words, F.lit(0), lambda s, w: s + F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+"))))
    sentences = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[.!?]+(?=\s|$)")))
    return F.when(n > 0, F.round(206.835 - 1.015 * n / sentences - 84.6 * syllables / n, 1))


# What is appended to a seed, before or after it.
MODIFIERS = ("best {}", "how to {}", "{} vs", "{} for beginners", "{} tools", "{} examples", "{} guide", "{} template", "{} mistakes", "{} checklist", "who {}", "what {}", "when {}", "where {}", "why {}", "how {}", "{} pricing", "{} review", "{} alternative", "{} comparison", "free {}", "top {}")


def expanded_keywords(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """(seed, keyword): each seed and its variants in lower case without articles; of equal ones of a seed one stays."""
    variants = F.array(F.col(seed), *[F.concat(F.lit(m.split("{}")[0]), F.col(seed), F.lit(m.split("{}")[1])) for m in MODIFIERS])
    plain = lambda k: F.btrim(F.regexp_replace(F.regexp_replace(F.lower(k), r"(?<![a-z])(?:an?|the)(?![a-z])", " "), r"\s+", " "))
    return seeds.select(seed, F.explode(F.array_distinct(F.transform(variants, plain))).alias("keyword")).distinct()


# --- lab audits


def category_audits(refs: DataFrame, audits: DataFrame) -> DataFrame:
    """refs (page, category, id) of the audits that have a score, with it and whether it passes (0.9)."""
    return refs.join(audits.where(F.col("score").isNotNull()), ["page", "id"]).withColumn("pass", F.col("score") >= 0.9)


def failed_audits(audits: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Audits (page, id, score) with a score below 0.9 that are no opportunities."""
    return audits.where(F.col("score") < 0.9).join(opportunities.select("page", "id").distinct(), ["page", "id"], "left_anti")


def top_per_page(rows: DataFrame, by: list[Column], most: int) -> DataFrame:
    """The first rows of each page in the given order, with their place; the limit is the feature."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(*by))).where(F.col("place") <= most)


# --- joins of lists


def keyword_gaps(organic: DataFrame, shopping: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """(keyword, gap): organic-only, shopping-only, both, and neither for keywords of the universe that neither list has."""
    a, b = organic.select("keyword").distinct().withColumn("a", F.lit(True)), shopping.select("keyword").distinct().withColumn("b", F.lit(True))
    both = a.join(b, "keyword", "full")
    if universe is not None:
        both = both.join(universe.select("keyword").distinct(), "keyword", "full")
    gap = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "organic-only").when(F.col("b"), "shopping-only").otherwise("neither")
    return both.select("keyword", gap.alias("gap"))


# Severity of a difference by field.
LISTING_FIELDS = {"name": "Critical", "address": "High", "phone": "Medium"}


def listing_consistency(listings: DataFrame) -> DataFrame:
    """(business, field, status, severity) over the sources of each business; listings: business, source, name, address, phone.

    exact: all sources say the same; partial: the same but for case, white space and punctuation; missing: a source
    has none; conflicting: they differ. Severity is null where exact.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in LISTING_FIELDS])).alias("x")
    rows = listings.select("business", pairs).select("business", "x.*")
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    plain = F.regexp_replace(F.lower("value"), r"[^\p{L}\p{N}]+", "")
    found = rows.groupBy("business", "field").agg(F.count_if(blank).alias("blank"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(plain).alias("plain_lo"), F.max(plain).alias("plain_hi"))
    status = F.when(F.col("blank") > 0, "missing").when(F.col("lo") == F.col("hi"), "exact").when(F.col("plain_lo") == F.col("plain_hi"), "partial").otherwise("conflicting")
    severity = F.lit(None).cast("string")
    for f, s in LISTING_FIELDS.items():
        severity = F.when((F.col("field") == f) & (F.col("status") != "exact"), s).otherwise(severity)
    return found.withColumn("status", status).select("business", "field", "status", severity.alias("severity"))


def linked_missing_pages(links: DataFrame, crawl: DataFrame) -> DataFrame:
    """(url, links, domains) of pages that answer 404 and are linked: links has url and domain, crawl has url and status_code."""
    missing = crawl.where("status_code = 404").select("url").distinct()
    counted = links.groupBy("url", "domain").agg(F.count("*").alias("n")).groupBy("url").agg(F.sum("n").alias("links"), F.count("domain").alias("domains"))
    return counted.join(missing, "url", "left_semi")


def link_totals(counts: DataFrame) -> DataFrame:
    """(targets, links) over pages of link counts (page, url, count): of a url that comes more than once the last page's count holds."""
    last = counts.groupBy("url").agg(F.max_by(F.greatest(F.lit(0), F.coalesce("count", F.lit(0))), "page").alias("n"))
    return last.agg(F.count("*").alias("targets"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"))


def top_targets(counts: DataFrame, most: int = 10) -> DataFrame:
    """The urls with the most links; the limit is the feature."""
    last = counts.groupBy("url").agg(F.max_by("count", "page").alias("count"))
    return last.orderBy(F.desc("count"), "url").limit(most)


# What a verification can say.
VERIFIED = ("verified", "lost", "moved", "link_removed", "unverifiable_js", "exists", "error")


def verification_histogram(results: DataFrame, status: str = "status") -> DataFrame:
    """One row: total and a count per status; a status of another name counts as error."""
    of = F.when(F.col(status).isin(*VERIFIED), F.col(status)).otherwise("error")
    return results.select(of.alias("s")).agg(F.count("*").alias("total"), *[F.count_if(F.col("s") == v).alias(v) for v in VERIFIED])


# --- links and reviews that look made


def toxic_links(links: DataFrame) -> DataFrame:
    """links (domain, anchor, outbound_links, age_days, outbound_ratio, nofollow) with the numeric patterns of bad links and the worst tier.

    Patterns: link-farm (10,000 outbound links or more), new-and-busy (under 30 days with 100 or more),
    exact-anchor (the anchor from five domains or more), outbound-ratio (above 0.9), many-outbound (above 50),
    nofollow-only (all links of the domain). Tiers: spam, likely, monitor, or null.
    """
    anchors = links.where("anchor <> ''").groupBy("anchor", "domain").agg(F.lit(1).alias("one")).groupBy("anchor").agg(F.count("*").alias("anchor_domains")).where("anchor_domains >= 5")
    quiet = links.groupBy("domain").agg(F.min(F.coalesce("nofollow", F.lit(False))).alias("only_nofollow"))
    # Links without an anchor match none; they are spread by domain instead of meeting under one key.
    key = F.when(F.col("anchor") != "", F.col("anchor")).otherwise(F.concat(F.lit("\0"), F.coalesce("domain", F.lit(""))))
    joined = links.withColumn("__pq_anchor", key).join(anchors.withColumnRenamed("anchor", "__pq_anchor"), "__pq_anchor", "left").drop("__pq_anchor").join(quiet, "domain", "left")
    out, young = F.coalesce("outbound_links", F.lit(0)), F.coalesce(F.col("age_days") < 30, F.lit(False))
    tests = {
        "link-farm": ("spam", out >= 10_000), "new-and-busy": ("spam", young & (out >= 100)), "exact-anchor": ("spam", F.col("anchor_domains").isNotNull()),
        "outbound-ratio": ("likely", F.coalesce(F.col("outbound_ratio") > 0.9, F.lit(False))), "many-outbound": ("likely", out > 50), "nofollow-only": ("monitor", F.col("only_nofollow")),
    }
    patterns = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, (_, test) in tests.items()]))
    tier = F.coalesce(*[F.when(F.greatest(*[t for _, (x, t) in tests.items() if x == level], F.lit(False)), F.lit(level)) for level in ("spam", "likely", "monitor")])
    return joined.withColumns({"patterns": patterns, "tier": tier}).drop("anchor_domains", "only_nofollow")


def fake_review_flags(reviews: DataFrame, spike: float = 3.0) -> DataFrame:
    """reviews (business, reviewer_reviews, reviewer_country, business_country, rating, text, ts) with six signals, their number and suspicious (two or more).

    same_hour: several of the business in the hour; new_reviewer: one review at most; elsewhere: another country;
    five_star_spike and volume_spike: the day's five-star reviews, or reviews, are ``spike`` times the business's
    daily mean and more than one; same_text: an equal text elsewhere in the table.
    """
    day, hour = F.to_date("ts"), F.date_trunc("hour", "ts")
    keyed = reviews.withColumns({"__pq_day": day, "__pq_hour": hour, "__pq_text": F.when(F.col("text").isNotNull(), F.xxhash64(F.lower(F.trim("text")))).otherwise(F.xxhash64("business", "ts"))})
    hours = keyed.groupBy("business", "__pq_hour").agg(F.count("*").alias("__pq_in_hour"))
    days = keyed.groupBy("business", "__pq_day").agg(F.count("*").alias("__pq_in_day"), F.count_if(F.col("rating") == 5).alias("__pq_fives"))
    means = days.groupBy("business").agg(F.avg("__pq_in_day").alias("__pq_mean"), F.avg("__pq_fives").alias("__pq_five_mean"))
    texts = keyed.where("text is not null").groupBy("__pq_text").agg(F.count("*").alias("__pq_same")).where("__pq_same > 1")
    joined = keyed.join(hours, ["business", "__pq_hour"], "left").join(days, ["business", "__pq_day"], "left").join(means, "business", "left").join(texts, "__pq_text", "left")
    no = F.lit(False)
    signals = {
        "same_hour": F.coalesce(F.col("__pq_in_hour") > 1, no), "new_reviewer": F.coalesce(F.col("reviewer_reviews") <= 1, no), "elsewhere": F.coalesce(F.col("reviewer_country") != F.col("business_country"), no),
        "five_star_spike": F.coalesce((F.col("rating") == 5) & (F.col("__pq_fives") > 1) & (F.col("__pq_fives") >= spike * F.col("__pq_five_mean")), no), "same_text": F.col("__pq_same").isNotNull() & F.col("text").isNotNull(),
        "volume_spike": F.coalesce((F.col("__pq_in_day") > 1) & (F.col("__pq_in_day") >= spike * F.col("__pq_mean")), no),
    }
    out = joined.withColumns(signals).withColumn("signals", sum((F.col(k).cast("int") for k in signals), F.lit(0))).withColumn("suspicious", F.col("signals") >= 2)
    return out.drop(*[c for c in out.columns if c.startswith("__pq_")])


# --- gates, estimates, orders


def cluster_gates(posts: DataFrame, links: DataFrame, shows: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """Per cluster the six gates, true where passed; posts: cluster, url, is_pillar, keyword, words, target_words; links: src, dst.

    Menus are given as shows (menu, src) and lists (menu, dst): every page that shows a menu links to every page it lists. These links, as many
    as the product of the two, are never made: pages are counted by the set of menus they show, and a page's incoming
    links are those of the sets that meet the menus it is on. A link that is given and also in a menu counts once.
    """
    edges = links.where("src <> dst").select("src", "dst").distinct()
    menus = lambda df, url, to: df.groupBy(F.col(url).alias("url")).agg(F.array_sort(F.collect_set("menu")).alias(to))
    met = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    if shows is None or lists is None:
        posts = posts.withColumns({"shown": F.array().cast("array<string>"), "on": F.array().cast("array<string>")})
    else:
        posts = posts.join(menus(shows, "src", "shown"), "url", "left").join(menus(lists, "dst", "on"), "url", "left")
    of = posts.select("cluster", F.col("url").alias("dst"), "on")
    incoming = edges.join(of, "dst").join(posts.select(F.col("cluster").alias("from_cluster"), F.col("url").alias("src"), "shown"), "src").where("cluster = from_cluster")
    incoming = incoming.where(~met("shown", "on")).groupBy("dst").agg(F.count("*").alias("n")).withColumnRenamed("dst", "url")
    sets = posts.where(F.size("shown") > 0).groupBy("cluster", "shown").agg(F.count("*").alias("pages"))
    by_menu = posts.where(F.size("on") > 0).select("cluster", "on").distinct().join(sets, "cluster").where(met("shown", "on")).groupBy("cluster", "on").agg(F.sum("pages").alias("by_menu"))
    pillars = posts.where("is_pillar").select("cluster", F.col("url").alias("pillar"), F.col("shown").alias("pillar_shown"), F.col("on").alias("pillar_on"))
    spokes = posts.join(pillars, "cluster", "left").join(incoming, "url", "left").join(by_menu, ["cluster", "on"], "left").fillna(0, ["n", "by_menu"])
    # A page that shows a menu it is on does not link to itself.
    spokes = spokes.withColumn("n", F.col("n") + F.col("by_menu") - met("shown", "on").cast("int"))
    up = edges.select(F.col("src").alias("url"), F.col("dst").alias("pillar"), F.lit(True).alias("up"))
    down = edges.select(F.col("dst").alias("url"), F.col("src").alias("pillar"), F.lit(True).alias("down"))
    spokes = spokes.join(up, ["url", "pillar"], "left").join(down, ["url", "pillar"], "left")
    links_up, links_down = F.col("up").isNotNull() | met("shown", "pillar_on"), F.col("down").isNotNull() | met("pillar_shown", "on")
    spoke = ~F.col("is_pillar")
    out = spokes.groupBy("cluster").agg(
        (F.count_if(spoke & ~links_up) == 0).alias("spokes_link_pillar"), (F.count_if(spoke & ~links_down) == 0).alias("pillar_links_spokes"),
        (F.min("n") >= 3).alias("enough_incoming"), (F.min("n") > 0).alias("no_orphans"), (F.count_if(F.col("words") < 0.8 * F.col("target_words")) == 0).alias("long_enough"),
    )
    keywords = posts.groupBy("cluster", F.lower("keyword").alias("k")).agg(F.count("*").alias("n")).groupBy("cluster").agg((F.max("n") == 1).alias("own_keywords"))
    return out.join(keywords, "cluster")


def cost_estimates(calls: DataFrame, costs: dict[str, float]) -> DataFrame:
    """calls (endpoint, count) with status, unit_cost, total_cost, and for unknown endpoints the known ones whose names hold theirs."""
    names = F.array(*[F.lit(k) for k in costs]).cast("array<string>")
    unit = F.try_element_at(F.create_map(*[F.lit(x) for pair in costs.items() for x in pair]).cast("map<string,double>"), F.col("endpoint"))
    count = F.when(F.coalesce("count", F.lit(0)) == 0, 1).otherwise(F.col("count"))
    near = F.filter(names, lambda k: F.contains(k, F.col("endpoint")))
    return calls.withColumns({"status": F.when(unit.isNull(), "unknown_endpoint").otherwise("estimated"), "unit_cost": unit, "total_cost": F.round(unit * count, 4), "suggestions": F.when(unit.isNull(), near)})


SEVERITIES = ("critical", "high", "medium", "low", "info")


def ordered_findings(findings: DataFrame, tie: str, critical: int = 5, wins: int = 5) -> DataFrame:
    """The first critical findings and the first quick wins (low effort, not critical), in order of severity, then impact; the limits are the feature."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower("severity")), F.lit(9))
    ranked = findings.withColumn("rank", F.when(rank == 0, len(SEVERITIES) + 1).otherwise(rank))
    order = ["rank", F.desc("impact"), tie]
    first = ranked.where("rank = 1").orderBy(*order).limit(critical).withColumn("list", F.lit("critical"))
    return first.union(ranked.where("rank > 1 and effort = 'low'").orderBy(*order).limit(wins).withColumn("list", F.lit("quick-win")))


def pillar_keywords(keywords: DataFrame) -> DataFrame:
    """(cluster, pillar, volume): the keyword with the most volume of each cluster, then the shortest, then the first."""
    best = F.max_by("keyword", F.struct("volume", -F.length("keyword"), "__pq_order"))
    # Of keywords with equal volume and length the smaller one: its order is that of characters turned around.
    turned = keywords.withColumn("__pq_order", F.transform(F.split("keyword", ""), lambda c: -F.ascii(c)))
    return turned.groupBy("cluster").agg(best.alias("pillar"), F.max("volume").alias("volume"))


def gap_priority(gaps: DataFrame) -> DataFrame:
    """gaps (impact, advantage, effort) with priority, impact times advantage over effort; null where effort is none."""
    return gaps.withColumn("priority", F.round(F.col("impact") * F.col("advantage") / F.nullif("effort", F.lit(0)), 4))


def chart_rows(queries: DataFrame, most: int = 12, least_max: int = 3) -> DataFrame:
    """The queries with the most impressions, none at all where the highest stays under ``least_max``; the limit is the feature."""
    top = queries.where("impressions > 0").orderBy(F.desc("impressions"), "query").limit(most)
    return top.withColumn("__pq_max", F.max("impressions").over(Window.partitionBy(F.lit(1)))).where(F.col("__pq_max") >= least_max).drop("__pq_max")


def printed_ranks(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of a report with their place from 1; the limit is the feature, and bounds the one window."""
    return rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


# --- bands and scores


def lab_band(score: Column) -> Column:
    return F.when(score >= 90, "good").when(score >= 50, "warn").when(score.isNotNull(), "bad")


def badge_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "warn").when(score.isNotNull(), "bad")


def persona_band(score: Column) -> Column:
    """The rating of a persona's score, the sum of four parts of 25."""
    return F.when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Needs Work").when(score.isNotNull(), "Critical Mismatch")


def profile_score(fields: DataFrame, multipliers: DataFrame) -> DataFrame:
    """(business, score): points of 0, 1 or 2 a field, weighted by the industry's multiplier (1 where none is given), in percent of the most.

    fields: business, industry, field, points; multipliers: industry, field, multiplier, a few rows an industry.
    """
    joined = fields.join(multipliers, ["industry", "field"], "left").withColumn("w", F.coalesce("multiplier", F.lit(1.0)))
    points = F.least(F.lit(2), F.greatest(F.lit(0), F.coalesce("points", F.lit(0))))
    return joined.groupBy("business").agg(F.round(F.sum(points * F.col("w")) * 100 / F.sum(F.col("w") * 2), 1).alias("score"))


# --- text and arguments


def redacted(text: Column) -> Column:
    """Keys and bearer tokens of a message replaced by [REDACTED]."""
    out = F.regexp_replace(text, r"(?i)([?&](?:key|api_key|apikey|token|access_token)=)[^&\s]+", "$1[REDACTED]")
    out = F.regexp_replace(out, r"AIza[0-9A-Za-z_-]{20,}", "[REDACTED]")
    return F.regexp_replace(out, r"(?i)(bearer\s+)[A-Za-z0-9._~+/-]+=*", "$1[REDACTED]")


#: Dimensions of a search report.
DIMENSIONS = ("query", "page", "country", "device", "date", "searchAppearance", "hour")


def checked_dimensions(dimensions: list[str] | None) -> list[str]:
    """The dimensions asked for: query and page for None; raises for other types, unknown names and repetitions."""
    if dimensions is None:
        return ["query", "page"]
    if not isinstance(dimensions, list) or any(d not in DIMENSIONS for d in dimensions) or len(set(dimensions)) < len(dimensions):
        raise ValueError(f"dimensions are a list of different names out of {', '.join(DIMENSIONS)}")
    return list(dimensions)


def all_links(external: Column, internal: Column) -> Column:
    """Both lists of links as one, external ones first; null lists are empty."""
    return F.concat(F.coalesce(external, F.array()), F.coalesce(internal, F.array()))
