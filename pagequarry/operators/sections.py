"""Risk of site sections: third-party, commercial and affiliate signals of pages by first path segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions.urls import section_of

# What the signals look for in raw html, case-insensitive.
THIRD_PARTY = r"(?i)\bPartner\s+Content\b|\bSponsored\s+Content\b|\bSponsored\s+by\b|\bBrand\s+Studio\b|\bIn\s+Partnership\s+With\b|\bAdvertisement\b|\bAdvertorial\b|\bPaid\s+Post\b|\bPromoted\b|\bPaid\s+Content\b"
COMMERCE = r"(?i)\bBuy\s+Now\b|\bShop\s+Now\b|\bAdd\s+to\s+Cart\b|\bCompare\s+Prices\b|\bBest\s+\w+\s+Deals?\b|\bPromo\s+Code\b|\bCoupon\b|\bDiscount\s+Code\b|\bAffiliate\s+Disclosure\b"
AFFILIATE = r"(?i)\b(?:tag=|aff_id=|affid=|partnerid=|ref_=|utm_source=|utm_campaign=)"
# Hits per page from which a flag is raised.
THIRD_PARTY_RATE, COMMERCE_RATE, AFFILIATE_RATE = 1.0, 2.0, 3.0


def page_signals(pages: DataFrame) -> DataFrame:
    """(url, third_party_hits, commerce_hits, affiliate_link_hits) of each page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    count = lambda pattern: F.regexp_count(html, F.lit(pattern)).cast("long")
    return pages.select("url", count(THIRD_PARTY).alias("third_party_hits"), count(COMMERCE).alias("commerce_hits"), count(AFFILIATE).alias("affiliate_link_hits"))


def section_risk(signals: DataFrame) -> DataFrame:
    """One row per section: page count, hits per page, flags and risk.

    A section whose commerce rate exceeds twice the mean of all sections' rates (as
    rounded) drifts, which makes a low risk medium.
    """
    by = signals.groupBy(section_of(F.col("url")).alias("section")).agg(
        F.count("*").alias("page_count"),
        F.avg("third_party_hits").alias("third"),
        F.avg("commerce_hits").alias("commerce"),
        F.avg("affiliate_link_hits").alias("affiliate"),
        F.slice(F.array_sort(F.collect_set("url")), 1, 3).alias("sample_urls"),
    )
    third, commerce, affiliate = F.col("third") >= THIRD_PARTY_RATE, F.col("commerce") >= COMMERCE_RATE, F.col("affiliate") >= AFFILIATE_RATE
    # Sections are few; the site's mean is over one row per section.
    mean = F.avg(F.round("commerce", 2)).over(Window.partitionBy(F.lit(1)))
    drift = (mean > 0) & (F.round("commerce", 2) > 2 * mean)
    flags = F.filter(
        F.array(
            F.when(third, F.lit("third-party-authorship-density")), F.when(commerce, F.lit("commercial-intent-skew")), F.when(affiliate, F.lit("affiliate-density")), F.when(drift, F.lit("commercial-intent-drift"))
        ),
        lambda x: x.isNotNull(),
    )
    risk = F.when(third | (commerce & affiliate), "high").when(commerce | affiliate | drift, "medium").otherwise("low")
    return by.select(
        "section", "page_count", F.round("third", 2).alias("third_party_hits_per_page"), F.round("commerce", 2).alias("commerce_hits_per_page"),
        F.round("affiliate", 2).alias("affiliate_link_hits_per_page"), flags.alias("flags"), risk.alias("risk"), "sample_urls",
    )


def risk_histogram(report: DataFrame) -> DataFrame:
    """Sections by risk, with the site's overall risk (the worst)."""
    rank = F.when(F.col("risk") == "high", 3).when(F.col("risk") == "medium", 2).otherwise(1)
    counted = report.groupBy("risk").agg(F.count("*").alias("sections"), F.max(rank).alias("rank"))
    worst = F.max("rank").over(Window.partitionBy(F.lit(1)))
    overall = F.when(worst == 3, "high").when(worst == 2, "medium").otherwise("low")
    return counted.select("risk", "sections", overall.alias("overall_risk"))
