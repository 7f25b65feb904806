"""Responses that come in numbered pages, and requests sent in order: what holds until the first failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Link pages asked for at most, and notifications a day.
MOST_PAGES, DAILY_QUOTA = 10, 200


def paged_totals(pages: DataFrame, by: str = "site", most_pages: int | None = MOST_PAGES) -> DataFrame:
    """(by, status, pages_fetched, total_pages, targets, links, complete) of every site.

    pages: by, page (from 0), status, total_pages, links (array of url and count). Pages count in order up to the first that
    failed or is missing, and up to the number of pages that the page before named; ``most_pages`` None asks for all. Of a target on
    several pages the last page's count holds. A site whose first page failed has status error, one that was not
    read to its end partial. The stop is a minimum over the pages, so pages need no sorting and are summed where they lie.
    """
    named = F.greatest(F.lit(1).cast("long"), F.coalesce(F.col("total_pages").cast("long"), F.lit(1).cast("long")))
    known = pages.where(f"{by} is not null and page is not null").withColumns({"__page": F.col("page").cast("long"), "__total": named, "__ok": F.coalesce(F.col("status") == "success", F.lit(False))})
    last = F.when(~F.col("__ok"), F.col("__page")).when(F.col("__page") + 1 >= F.col("__total"), F.col("__page") + 1)
    # The first missing page follows the longest row of pages from 0 on: page numbers are distinct, so it is where a page's number leaves its rank.
    numbers = known.select(by, "__page").distinct()
    gap = numbers.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy("__page")) - 1).where("__page = __rank").groupBy(by).agg((F.max("__page") + 1).alias("__gap"))
    stops = known.groupBy(by).agg(F.min(last).alias("__stop")).join(gap, by, "left")
    most = [F.lit(most_pages).cast("long")] if most_pages is not None else []
    stops = stops.select(by, F.least(F.coalesce("__stop", F.lit(2**62)), F.coalesce("__gap", F.lit(0).cast("long")), *most, F.lit(2**62)).alias("fetched"))
    read = known.join(stops, by).where(F.col("__page") < F.col("fetched"))
    total = read.groupBy(by).agg(F.max_by("__total", "__page").alias("total_pages"))
    counts = read.select(by, "__page", F.posexplode("links").alias("__at", "__link")).where("__link.url is not null and __link.url <> ''")
    counts = counts.groupBy(by, "__link.url").agg(F.max_by(F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("__link.count").cast("long"), F.lit(0).cast("long"))), F.struct("__page", "__at")).alias("n"))
    sums = counts.groupBy(by).agg(F.count("*").alias("targets"), F.sum("n").alias("links"))
    out = stops.join(total, by, "left").join(sums, by, "left")
    complete = (F.col("fetched") > 0) & (F.col("fetched") >= F.col("total_pages"))
    status = F.when(F.col("fetched") == 0, "error").when(complete, "success").otherwise("partial")
    return out.select(by, status.alias("status"), F.col("fetched").alias("pages_fetched"), "total_pages", F.coalesce("targets", F.lit(0)).alias("targets"), F.coalesce("links", F.lit(0)).alias("links"), complete.alias("complete"))


def notified(requests: DataFrame, by: str = "day", quota: int = DAILY_QUOTA) -> DataFrame:
    """(by, asked, sent, success, errors, stopped, remaining) of requests in order: by, position, url, error (null where it succeeded).

    Of each day the first ``quota`` requests are sent, blank urls passed over, up to the first error that names 429,
    which counts. The engine keeps ``quota`` rows of a day in each task before it shuffles, so a day with very many requests is no large group.
    """
    order = Window.partitionBy(by).orderBy("position", "url")
    first = requests.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= quota).where(F.trim(F.coalesce("url", F.lit(""))) != "")
    stop = first.groupBy(by).agg(F.min(F.when(F.contains("error", F.lit("429")), F.col("__k"))).alias("__stop"))
    sent = first.join(stop, by).where(F.col("__stop").isNull() | (F.col("__k") <= F.col("__stop")))
    sums = sent.groupBy(by).agg(F.count("*").alias("sent"), F.count_if(F.col("error").isNull()).alias("success"), F.count("error").alias("errors"), F.max(F.col("__stop").isNotNull()).alias("stopped"))
    asked = requests.groupBy(by).agg(F.count("*").alias("asked")).join(sums, by, "left").fillna(0, ["sent", "success", "errors"]).fillna(False, ["stopped"])
    return asked.withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.lit(quota) - F.col("success")))
