"""Saved speed responses: lab runs with their audits, field records, and field data of a URL or else of its origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.values import lab_layout_shift, rating

EXPERIENCE = "struct<metrics:map<string,struct<percentile:double,category:string>>>"
LAB = (
    "analysisUTCTimestamp string, lighthouseResult struct<categories:map<string,struct<score:double>>,"
    "audits:map<string,struct<title:string,score:double,numericValue:double,displayValue:string,details:struct<type:string,overallSavingsMs:double>>>>,"
    f"loadingExperience {EXPERIENCE}, originLoadingExperience {EXPERIENCE}"
)
DAY = "struct<year:int,month:int,day:int>"
FIELD = f"record struct<collectionPeriod:struct<firstDate:{DAY},lastDate:{DAY}>,metrics:map<string,struct<histogram:array<struct<density:double>>,percentiles:struct<p75:string>>>>"
# Audits that are lab metrics, names of field metrics in lab responses, and short names.
LAB_METRICS = ("first-contentful-paint", "largest-contentful-paint", "total-blocking-time", "cumulative-layout-shift", "speed-index", "interactive")
FIELD_NAMES = {
    "LARGEST_CONTENTFUL_PAINT_MS": "largest_contentful_paint", "INTERACTION_TO_NEXT_PAINT": "interaction_to_next_paint", "CUMULATIVE_LAYOUT_SHIFT_SCORE": "cumulative_layout_shift",
    "FIRST_CONTENTFUL_PAINT_MS": "first_contentful_paint", "EXPERIMENTAL_TIME_TO_FIRST_BYTE": "experimental_time_to_first_byte",
}
LABELS = {"largest_contentful_paint": "LCP", "interaction_to_next_paint": "INP", "cumulative_layout_shift": "CLS", "first_contentful_paint": "FCP", "experimental_time_to_first_byte": "TTFB"}
#: An audit with this score or more is passed.
PASSED = 0.9


def _named(values: dict[str, str], name: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out


def lab_runs(responses: DataFrame, body: str = "body") -> DataFrame:
    """responses with the parsed run as ``lab``; a body that is no JSON gives null."""
    return responses.withColumn("lab", F.from_json(body, LAB)).drop(body)


def lab_scores(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, score) in percent, halves to even; a missing score counts as 0."""
    rows = runs.select(*keys, F.explode("lab.lighthouseResult.categories").alias("category", "c"))
    return rows.select(*keys, "category", F.bround(F.coalesce("c.score", F.lit(0.0)) * 100).cast("int").alias("score"))


def lab_audits(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, audit, kind, value, score): metric (its value), opportunity (milliseconds saved), or passed and failed for all other audits with a score."""
    rows = runs.select(*keys, F.explode("lab.lighthouseResult.audits").alias("audit", "a"))
    saved = F.coalesce((F.col("a.details.type") == "opportunity") & (F.col("a.details.overallSavingsMs") > 0), F.lit(False))
    kinds = F.array(
        F.when(F.col("audit").isin(*LAB_METRICS) & F.col("a.numericValue").isNotNull(), F.struct(F.lit("metric").alias("kind"), F.col("a.numericValue").alias("value"))),
        F.when(saved, F.struct(F.lit("opportunity").alias("kind"), F.col("a.details.overallSavingsMs").alias("value"))),
        F.when(F.col("a.score") >= PASSED, F.struct(F.lit("passed").alias("kind"), F.lit(None).cast("double").alias("value"))).when(
            (F.col("a.score") < PASSED) & ~saved, F.struct(F.lit("failed").alias("kind"), F.lit(None).cast("double").alias("value"))
        ),
    )
    return rows.select(*keys, "audit", F.col("a.score").alias("score"), F.explode(F.array_compact(kinds)).alias("k")).select(*keys, "audit", "k.kind", "k.value", "score")


def lab_field_metrics(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, metric, p75, rating) of the field data that a lab response carries, of the url and of its origin."""
    sides = F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"lab.{at}.metrics").alias("m")) for s, at in (("url", "loadingExperience"), ("origin", "originLoadingExperience"))])
    rows = runs.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.source", F.explode("s.m").alias("name", "v"))
    metric = _named(FIELD_NAMES, F.col("name"))
    p75 = F.when(metric == "cumulative_layout_shift", lab_layout_shift(F.col("v.percentile"))).otherwise(F.col("v.percentile"))
    out = rows.select(*keys, "source", metric.alias("metric"), p75.alias("p75"), F.translate(F.lower(F.coalesce("v.category", F.lit("none"))), "_", "-").alias("rating"))
    return out.where("metric is not null and p75 is not null")


def field_records(responses: DataFrame, body: str = "body") -> DataFrame:
    """(target, metric, label, p75, rating, good_pct, needs_improvement_pct, poor_pct, first_day, last_day) of field responses (target, status_code, body).

    Values may come as strings. Shares need three classes. Responses other than 200 have no rows.
    """
    rows = responses.where("status_code = 200").select("target", F.from_json(body, FIELD)["record"].alias("r"))
    day = lambda d: F.make_date(F.col(f"r.collectionPeriod.{d}.year"), F.col(f"r.collectionPeriod.{d}.month"), F.col(f"r.collectionPeriod.{d}.day"))
    rows = rows.select("target", day("firstDate").alias("first_day"), day("lastDate").alias("last_day"), F.explode("r.metrics").alias("metric", "m"))
    number = F.col("m.percentiles.p75").try_cast("double")
    p75 = F.when((F.col("metric") == "cumulative_layout_shift") & F.col("m.percentiles.p75").isNotNull(), F.coalesce(number, F.lit(0.0))).otherwise(number)
    label = F.coalesce(_named(LABELS, F.col("metric")), F.col("metric"))
    shares = F.when(F.size("m.histogram") >= 3, F.transform("m.histogram", lambda h: F.round(F.coalesce(h["density"], F.lit(0.0)) * 100, 1)))
    rows = rows.select("target", "metric", label.alias("label"), p75.alias("p75"), shares.alias("h"), "first_day", "last_day").where("p75 is not null")
    share = lambda k, name: F.get("h", F.lit(k)).alias(name)
    return rows.select("target", "metric", "label", "p75", rating(F.col("label"), F.col("p75")).alias("rating"), share(0, "good_pct"), share(1, "needs_improvement_pct"), share(2, "poor_pct"), "first_day", "last_day")


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def field_or_origin(urls: DataFrame, responses: DataFrame, body: str = "body") -> DataFrame:
    """Field records of every url (url) whose own response has data, else, where that one was 404, of its origin; ``level`` says which.

    responses: target, status_code, body, for urls and origins, one of each target. A url without any row has neither.
    """
    records = field_records(responses, body)
    wanted = urls.select("url").distinct().withColumn("origin", origin_of(F.col("url")))
    state = responses.select(F.col("target").alias("url"), F.col("status_code"))
    missing = wanted.join(state.where("status_code = 404"), "url", "left_semi")
    own = wanted.join(records, F.col("url") == F.col("target")).withColumn("level", F.lit("url"))
    above = missing.join(records, F.col("origin") == F.col("target")).withColumn("level", F.lit("origin"))
    return own.union(above).drop("origin", "target")
