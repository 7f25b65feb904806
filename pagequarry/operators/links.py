"""Link profiles: verification, set algebra of domains, shares, orphans, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions.stored import written
from pagequarry.functions.urls import host_of, normalize_backlink_url, report_domain


def _bare_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def verify_backlinks(pages: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_url, target_url, status, match_type, anchor_text, rel) for each target.

    pages: url, status_code, script_rendered; links: page_url, pos, href, text, rel;
    targets: source_url, target_url. The first link of the source that is the target
    itself, on its domain or on a subdomain of it verifies the target. A link is
    compared under its host and each parent domain of it, so all three cases are
    equality joins.
    """
    wanted = targets.withColumns({"t_norm": normalize_backlink_url(F.col("target_url")), "t_host": _bare_host(F.col("target_url"))})
    host = F.split(_bare_host(F.col("href")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(host)), lambda k: F.array_join(F.slice(host, k, F.size(host)), "."))
    found = links.withColumns({"l_norm": normalize_backlink_url(F.col("href")), "l_host": F.array_join(host, ".")}).withColumn("suffix", F.explode(suffixes))
    joined = wanted.join(found, (wanted["source_url"] == found["page_url"]) & (wanted["t_host"] == found["suffix"]))
    kind = F.when(F.col("l_norm") == F.col("t_norm"), "exact_url").when(F.col("l_host") == F.col("t_host"), "domain_match").otherwise("subdomain_match")
    first = joined.groupBy("source_url", "target_url").agg(F.min_by(F.struct(kind.alias("match_type"), F.left(F.trim("text"), F.lit(200)).alias("anchor_text"), "rel"), "pos").alias("m"))
    out = wanted.join(first, ["source_url", "target_url"], "left").join(pages, wanted["source_url"] == pages["url"], "left")
    status = (
        F.when(F.col("url").isNull(), "error")
        .when(F.col("status_code") >= 400, "source_unavailable")
        .when(F.col("m").isNotNull(), "verified")
        .when(F.col("script_rendered"), "unverifiable_js")
        .otherwise("link_removed")
    )
    follow = F.when(F.size("m.rel") > 0, F.col("m.rel")).when(F.col("m").isNotNull(), F.array(F.lit("follow")))
    return out.select("source_url", "target_url", status.alias("status"), "m.match_type", "m.anchor_text", follow.alias("rel"))


def domain_sets(ours: DataFrame, theirs: DataFrame, column: str = "domain") -> DataFrame:
    """(domain, relation): shared, gap (only theirs) or unique (only ours)."""
    a, b = ours.select(column).distinct().withColumn("a", F.lit(True)), theirs.select(column).distinct().withColumn("b", F.lit(True))
    relation = F.when(F.col("a") & F.col("b"), "shared").when(F.col("b"), "gap").otherwise("unique")
    return a.join(b, column, "full").select(column, relation.alias("relation"))


def common_keys(rows: DataFrame, part: str, key: str, most: int = 3) -> DataFrame:
    """(parts, n_parts, shared): for every set of up to ``most`` parts (domains), how many keys (keyword numbers) all of them have.

    A part's keys are bitmaps of 32,768 bits, one for each range of key numbers; a set's bitmaps are intersected
    and counted range by range, so work goes by parts and ranges, not by pairs of rows. key is a whole number from 0; nulls
    count for nothing; sets without a common key are not listed. Only the parts that a range has are combined.
    """
    numbered = rows.where(F.col(part).isNotNull() & (F.col(key) >= 0)).select(F.col(part).alias("part"), F.col(key).cast("long").alias("key"))
    bits = numbered.groupBy(F.bitmap_bucket_number("key").alias("range"), "part").agg(F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("bits"))
    bits = written(bits, "common-bits")
    sets = met = bits.select("range", F.array("part").alias("parts"), "bits")
    for _ in range(most - 1):
        more = sets.join(bits.select("range", F.col("part").alias("next"), F.col("bits").alias("other")), "range").where(F.element_at("parts", -1) < F.col("next"))
        pair = more.select("range", F.concat("parts", F.array("next")).alias("parts"), F.explode(F.array("bits", "other")).alias("bits"))
        sets = written(pair.groupBy("range", "parts").agg(F.bitmap_and_agg("bits").alias("bits")).where(F.bitmap_count("bits") > 0), "common-sets")
        met = met.unionByName(sets)
    return met.groupBy("parts").agg(F.sum(F.bitmap_count("bits")).alias("shared")).select(F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"), F.size("parts").alias("n_parts"), "shared")


def reciprocal_domains(outbound: DataFrame, inbound: DataFrame, url: str = "url") -> DataFrame:
    """Domains that are linked to and link back."""
    domain = report_domain(F.col(url)).alias("domain")
    return outbound.select(domain).intersect(inbound.select(domain)).where("domain <> ''")


def map_diff(old: DataFrame, new: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, change): added, removed or changed entries."""
    a, b = old.select(key, F.struct(value).alias("a")), new.select(key, F.struct(value).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def shares(rows: DataFrame, by: list[str], part: str) -> DataFrame:
    """(by, part, n, share_pct) of each part within its group; groups are summed before they are compared."""
    counted = rows.groupBy(*by, part).agg(F.count("*").alias("n"))
    return counted.withColumn("share_pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*(by or [F.lit(1)]))), 2))


def crowded(rows: DataFrame, by: list[str], part: str, limit_pct: float) -> DataFrame:
    """The parts that hold more than a share of their group, such as one anchor with over 40 % of a page's links."""
    return shares(rows, by, part).where(F.col("share_pct") > limit_pct)


# A domain's share of a profile's links, in percent, above which it is worth watching, a risk, or critical.
CONCENTRATION = ((25.0, "critical"), (10.0, "risk"), (5.0, "watch"))


def concentration(links: DataFrame, by: str, domain: str = "domain", nofollow: str = "nofollow") -> DataFrame:
    """(by, links, domains, top_domain, top_pct, tier, follow_pct) of each profile: its largest domain's share and the share of links that are followed.

    Links are summed by profile and domain before profiles are compared; of equal domains the first by name counts. Null domains are one domain.
    """
    counted = links.groupBy(by, domain).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(nofollow), F.lit(False))).alias("followed"))
    out = counted.groupBy(by).agg(F.sum("n").alias("links"), F.count("*").alias("domains"), F.min(F.struct((-F.col("n")).alias("order"), F.col(domain).alias("name"))).alias("top"), F.sum("followed").alias("followed"))
    out = out.withColumn("top_pct", F.round(-F.col("top.order") * 100.0 / F.col("links"), 2))
    tier = F.lit(None).cast("string")
    for least, name in reversed(CONCENTRATION):
        tier = F.when(F.col("top_pct") > least, F.lit(name)).otherwise(tier)
    return out.select(by, "links", "domains", F.col("top.name").alias("top_domain"), "top_pct", tier.alias("tier"), F.round(F.col("followed") * 100.0 / F.col("links"), 1).alias("follow_pct"))


def orphans(nodes: DataFrame, edges: DataFrame, key: str = "url", least: int = 1) -> DataFrame:
    """Nodes with fewer than ``least`` incoming edges (src, dst) from other nodes."""
    incoming = edges.where("src <> dst").groupBy(F.col("dst").alias(key)).agg(F.count_distinct("src").alias("incoming"))
    return nodes.select(key).distinct().join(incoming, key, "left").select(key, F.coalesce("incoming", F.lit(0)).alias("incoming")).where(F.col("incoming") < least)


def _contracted(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, length) between nodes that are no inner links of a chain, and (node, head, length) of those that are.

    An inner link has one edge in and one edge out and is no start. Its chain's head comes from pointer
    doubling, in as many rounds as a chain's length has binary digits; rings of inner links alone have no head, and nothing leads into them.
    """
    inner = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node")
    inner = inner.join(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node"), "node")
    inner = written(inner.join(start, "node", "left_anti"), "depth-inner")
    back = edges.join(inner, F.col("dst") == F.col("node"), "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("head"), F.lit(1).cast("long").alias("length"))
    known = back.join(inner.toDF("head"), "head", "left_semi").withColumn("open", F.lit(True)).unionByName(back.join(inner.toDF("head"), "head", "left_anti").withColumn("open", F.lit(False)))
    known = written(known.select("node", "head", "length", "open"), "depth-chains")
    rounds = max(known.count(), 1).bit_length()
    for _ in range(rounds):
        if known.where("open").isEmpty():
            break
        hop = known.select(F.col("node").alias("head"), F.col("head").alias("h2"), F.col("length").alias("l2"), F.col("open").alias("o2"))
        moved = known.where("open").join(hop, "head").select("node", F.col("h2").alias("head"), (F.col("length") + F.col("l2")).alias("length"), F.col("o2").alias("open"))
        known = written(known.where("not open").unionByName(moved), "depth-chains")
    chains = known.where("not open").drop("open")
    own = edges.join(inner, F.col("src") == F.col("node"), "left_anti").join(inner, F.col("dst") == F.col("node"), "left_anti").select("src", "dst", F.lit(1).cast("long").alias("length"))
    tails = edges.join(inner, F.col("dst") == F.col("node"), "left_anti").join(chains, F.col("src") == F.col("node")).select(F.col("head").alias("src"), "dst", (F.col("length") + 1).alias("length"))
    return written(own.union(tails).groupBy("src", "dst").agg(F.min("length").alias("length")), "depth-edges"), chains


def clicks_from(start: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, clicks) of what is reached from start (node) along edges (src, dst), by at most so many where ``most`` is given.

    A frontier search: each round follows the edges of the nodes that the round before found or found nearer, and
    leaves out what is already known as near, until nothing is new. Chains are contracted before, so
    rounds go by the branchings of a path and not by its length. Each round is written; rings and nodes that are
    their own neighbours are no matter.
    """
    start = written(start.select("node").where("node is not null").distinct(), "depth-start")
    edges = written(edges.select("src", "dst").where("src <> dst").distinct(), "depth-links")
    hops, chains = _contracted(edges, start)
    known = frontier = written(start.withColumn("clicks", F.lit(0).cast("long")), "depth-known")
    limit = F.lit(True) if most is None else F.col("clicks") <= most
    while True:
        step = frontier.join(hops, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("clicks") + F.col("length")).alias("clicks")).where(limit)
        step = step.groupBy("node").agg(F.min("clicks").alias("clicks"))
        frontier = written(step.join(known.select("node", F.col("clicks").alias("before")), "node", "left").where("before is null or clicks < before").drop("before"), "depth-frontier")
        if frontier.isEmpty():
            break
        known = written(known.union(frontier).groupBy("node").agg(F.min("clicks").alias("clicks")), "depth-known")
    inside = chains.join(known.select(F.col("node").alias("head"), "clicks"), "head").select("node", (F.col("clicks") + F.col("length")).alias("clicks"))
    return known.union(inside.where(limit)).select("node", F.col("clicks").cast("int").alias("clicks"))


def disavow_lines(domains: DataFrame, column: str = "domain") -> DataFrame:
    """The lines of a disavow file."""
    return domains.select(F.concat(F.lit("domain:"), F.col(column)).alias("value")).distinct()


def return_tags(tags: DataFrame) -> DataFrame:
    """(page_url, lang, href, problem): alternates that are not linked back, and pages without a tag for themselves.

    tags: page_url, lang, href.
    """
    pairs = tags.select(F.col("page_url").alias("src"), F.col("href").alias("dst")).distinct()
    back = pairs.select(F.col("dst").alias("page_url"), F.col("src").alias("href"))
    missing = tags.where("page_url <> href").join(back, ["page_url", "href"], "left_anti").select("page_url", "lang", "href", F.lit("missing-return-tag").alias("problem"))
    own = tags.where("page_url = href").select("page_url").distinct()
    alone = tags.select("page_url").distinct().join(own, "page_url", "left_anti")
    return missing.union(alone.select("page_url", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("missing-self-reference")))


# Codes that look right and are not.
BAD_CODES = {"eng": "en", "jp": "ja", "en-uk": "en-GB", "eu": "a region", "es-la": "es-419 or a country"}


def code_problem(lang: Column) -> Column:
    """What is wrong with an hreflang code, or null."""
    low = F.lower(lang)
    form = low.rlike(r"^(?:x-default|[a-z]{2}(?:-[a-z]{4})?(?:-(?:[a-z]{2}|\d{3}))?)$")
    return F.when(low.isin(*BAD_CODES), "invalid-code").when(~form, "malformed-code")


def sitemap_coverage(sitemap: DataFrame, crawl: DataFrame) -> DataFrame:
    """(url, problem) between a sitemap (url) and a crawl (url, status_code, noindex, canonical)."""
    joined = sitemap.select("url").distinct().withColumn("s", F.lit(True)).join(crawl.withColumn("c", F.lit(True)), "url", "full")
    problem = (
        F.when(F.col("c").isNull(), "not-crawled")
        .when(F.col("s").isNull(), F.when((F.col("status_code") == 200) & ~F.coalesce("noindex", F.lit(False)), "missing-from-sitemap"))
        .when(F.col("status_code").between(300, 399), "redirected")
        .when(F.col("status_code") != 200, "not-ok")
        .when(F.col("noindex"), "noindexed")
        .when(F.col("canonical").isNotNull() & (F.col("canonical") != F.col("url")), "non-canonical")
    )
    return joined.select("url", problem.alias("problem")).where("problem is not null")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in the given order, its key and order columns; found within tasks before any shuffle, so a frequent key is no task of its own."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first")).select(*keys, "__first.*")
