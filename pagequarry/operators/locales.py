"""Alternate-language sets: pages that name each other as alternates, with rules for codes, pages and whole sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.stored import written

from .components import components


def iso_codes(spark: SparkSession) -> DataFrame:
    """(kind, code): the two-letter languages and countries of ISO 639-1 and 3166-1, as the Java runtime lists them (about 440 rows)."""
    locale = spark._jvm.java.util.Locale
    rows = [("language", c) for c in locale.getISOLanguages() if len(c) == 2] + [("country", c) for c in locale.getISOCountries()]
    return spark.createDataFrame(rows, "kind string, code string")


def judged_codes(tags: DataFrame, codes: DataFrame, lang: str = "lang") -> DataFrame:
    """tags with code_problem: malformed, unknown-language, unknown-country or null; codes: kind, code.

    A code is a language, maybe a script of four letters, maybe a country or a UN area of three digits; or x-default.
    The script is taken by its form only. Each distinct code is judged once.
    """
    parts = F.split(F.lower(F.trim(lang)), "-")
    region = F.when(F.length(F.element_at(parts, -1)) != 4, F.when(F.size(parts) > 1, F.element_at(parts, -1)))
    seen = tags.select(lang).where(F.col(lang).isNotNull()).distinct().withColumns({"__l": F.get(parts, F.lit(0)), "__r": F.upper(region), "__low": F.lower(F.trim(lang))})
    known = lambda kind, at: codes.where(F.col("kind") == kind).select(F.col("code").alias(at), F.lit(True).alias(f"{at}_ok"))
    seen = seen.join(F.broadcast(known("language", "__l")), "__l", "left").join(F.broadcast(known("country", "__r")), "__r", "left")
    form = F.col("__low").rlike(r"^[a-z]{2}(?:-[a-z]{4})?(?:-(?:[a-z]{2}|\d{3}))?$")
    problem = (
        F.when(F.col("__low") == "x-default", F.lit(None))
        .when(~form, "malformed")
        .when(F.col("__l_ok").isNull(), "unknown-language")
        .when(F.col("__r").isNotNull() & ~F.col("__r").rlike(r"^\d{3}$") & F.col("__r_ok").isNull(), "unknown-country")
    )
    judged = seen.select(F.col(lang).alias("__lang"), problem.alias("code_problem"))
    return tags.join(judged, F.col(lang) == F.col("__lang"), "left").drop("__lang")


def _lists(tags: DataFrame) -> DataFrame:
    """(page_url, alternates): each page's own alternates (lang, href), each once."""
    ways = tags.where("page_url is not null and href is not null")
    return written(ways.groupBy("page_url").agg(F.collect_set(F.struct("lang", "href")).alias("alternates")), "alternates")


def _sets(lists: DataFrame) -> DataFrame:
    """(page_url, set) of _lists. Pages of a set mostly name the same ones: each different list is taken once, so links grow with pages, not with pairs of them."""
    hrefs = F.array_sort(F.array_distinct(F.transform("alternates", lambda x: x["href"])))
    named = lists.select("page_url", hrefs.alias("hrefs"))
    first = F.get("hrefs", F.lit(0)).alias("b")
    ways = named.select(F.col("page_url").alias("a"), first).union(named.select("hrefs").distinct().select(F.explode("hrefs").alias("a"), first))
    ways = written(ways.distinct(), "alternate-ways")
    found = components(ways).select(F.col("doc").alias("page_url"), F.col("label").alias("set"))
    pages = ways.select("a").distinct().toDF("page_url")
    return pages.join(found, "page_url", "left").select("page_url", F.coalesce("set", "page_url").alias("set"))


def alternate_sets(tags: DataFrame) -> DataFrame:
    """(page_url, set): pages that alternates connect, in whatever direction; a set's name is its least URL. tags: page_url, lang, href."""
    return _sets(_lists(tags))


def judged_sets(tags: DataFrame, pages: DataFrame, codes: DataFrame) -> DataFrame:
    """(set, pages, alternates, problems) of every set of alternates; problems are the sorted names of those it has.

    tags: page_url, lang, href; pages: url, canonical (null where a page names none).
    bad-code: a code that is none. several-defaults: x-default names more than one page. no-default: it names none.
    several-pages: a language names more than one page. non-canonical: a page of the set is not its own canonical
    page, to the last slash. mixed-protocol: http and https. missing-return, missing-self: a page that is named does not name back, or a page does not name itself.
    """
    lists = _lists(tags)
    member = written(_sets(lists), "sets")
    full = lists.select("page_url", F.explode("alternates").alias("x")).select("page_url", "x.lang", "x.href")
    bad = written(judged_codes(full.select("lang").distinct(), codes).where("code_problem is not null").select("lang"), "bad-codes")
    wrong = full.join(bad, "lang", "left_semi").select("page_url").distinct().withColumn("wrong", F.lit(True))
    # What a page's own list tells is counted by page, before pages meet their sets.
    own = lists.select("page_url", F.size("alternates").cast("long").alias("n"), (~F.exists("alternates", lambda x: x["href"] == F.col("page_url"))).alias("no_self"))
    # Of two pages that name each other both ways meet; where only one does, its page misses the return.
    pairs = full.where("page_url <> href").groupBy(F.least("page_url", "href").alias("a"), F.greatest("page_url", "href").alias("b")).agg(F.max(F.col("page_url") < F.col("href")).alias("up"), F.max(F.col("page_url") > F.col("href")).alias("down"))
    one_way = pairs.where("up <> down").select(F.when(F.col("up"), F.col("a")).otherwise(F.col("b")).alias("page_url")).distinct().withColumn("one_way", F.lit(True))
    whole = member.join(own, "page_url").join(wrong, "page_url", "left").join(one_way, "page_url", "left").groupBy("set").agg(
        F.sum("n").alias("alternates"), F.max(F.col("wrong").isNotNull()).alias("bad"), F.max("no_self").alias("no_self"), F.max(F.col("one_way").isNotNull()).alias("no_return")
    )
    # A page is in the set of those that name it.
    named = full.select(F.lower(F.trim("lang")).alias("low"), F.col("href").alias("page_url")).distinct().join(member, "page_url").groupBy("set", "low").agg(F.count("*").alias("n"))
    named = named.groupBy("set").agg(F.max(F.when(F.col("low") == "x-default", F.col("n"))).alias("defaults"), F.max(F.when(F.col("low") != "x-default", F.col("n"))).alias("most"))
    canonical = pages.select(F.col("url").alias("page_url"), "canonical")
    urls = member.join(canonical, "page_url", "left").groupBy("set").agg(
        F.count_distinct("page_url").alias("pages"), F.max(F.col("canonical").isNotNull() & (F.col("canonical") != F.col("page_url"))).alias("elsewhere"),
        (F.max(F.col("page_url").startswith("http://")) & F.max(F.col("page_url").startswith("https://"))).alias("mixed"),
    )
    out = urls.join(whole, "set").join(named, "set")
    rules = {
        "bad-code": F.col("bad"), "missing-return": F.col("no_return"), "missing-self": F.col("no_self"), "mixed-protocol": F.col("mixed"), "no-default": F.col("defaults").isNull(),
        "non-canonical": F.col("elsewhere"), "several-defaults": F.col("defaults") > 1, "several-pages": F.col("most") > 1,
    }
    problems = F.array_join(F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull()), ",")
    return out.select("set", "pages", "alternates", problems.alias("problems"))
