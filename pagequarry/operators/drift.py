"""Snapshot drift: the current state of pages against their latest baseline, by seventeen rules.

A snapshot has url_hash, id, title, meta_description, robots, canonical, h1 (first),
h1_count, h2 and schema (arrays; schema holds JSON nodes), open_graph (map),
status_code, html_hash, performance_score and p75 (map of field metric to value).
"""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT = (
    "url_hash string, url string, id bigint, captured_at timestamp, title string, meta_description string, robots string, canonical string, h1 string, h1_count int, "
    "h2 array<string>, schema array<string>, open_graph map<string,string>, status_code int, html_hash string, performance_score double, p75 map<string,double>"
)
# Types that no longer give rich results, and the field metrics compared.
RETIRED = ("FAQPage", "HowTo", "Dataset")
FIELD = (("largest_contentful_paint", "LCP"), ("interaction_to_next_paint", "INP"), ("cumulative_layout_shift", "CLS"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each page."""
    return snapshots.groupBy("url_hash").agg(F.max_by(F.struct(*snapshots.columns), "id").alias("s")).select("s.*")


def as_of(snapshots: DataFrame, cutoff: Column) -> DataFrame:
    """The newest snapshot of each page that is not later than a time."""
    return latest(snapshots.where(F.col("captured_at") <= cutoff))


def chosen(snapshots: DataFrame, choices: DataFrame) -> DataFrame:
    """The snapshots that choices (url_hash, id) name, to compare pages with a baseline of one's choice instead of the latest."""
    return snapshots.join(choices.select("url_hash", "id").distinct(), ["url_hash", "id"], "left_semi")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def canonical_json(nodes: pd.Series) -> pd.Series:
    """A list of JSON nodes as one string with sorted keys; null for none."""
    return nodes.map(lambda x: json.dumps([json.loads(n) for n in x], sort_keys=True) if x is not None and len(x) else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def top_types(nodes: pd.Series) -> pd.Series:
    """Sorted distinct @type names of JSON nodes, without their vocabulary's address."""

    def names(x) -> list[str]:
        out = set()
        for n in x if x is not None else []:
            kind = json.loads(n)
            kind = kind.get("@type") if isinstance(kind, dict) else None
            out |= {k.rsplit("/", 1)[-1].rsplit("#", 1)[-1] for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str) and k}
        return sorted(out)

    return nodes.map(names)


def _p75(side: str, metric: str) -> Column:
    values = F.col(f"{side}.p75")
    return F.coalesce(*[F.try_element_at(values, F.lit(k)) for k in (f"url_{metric}", f"origin_{metric}", metric)])


def _count(x: Column) -> Column:
    return F.coalesce(F.greatest(F.size(x), F.lit(0)), F.lit(0))


def rules() -> list[tuple[str, Column, Column, Column, Column]]:
    """(rule, severity, triggered, old value, new value) over columns old and new."""
    o, n = (lambda k: F.col(f"old.{k}")), (lambda k: F.col(f"new.{k}"))
    full = lambda c: c.isNotNull() & (c != "")
    gone = lambda c: c.isNull() | (c == "")
    changed = lambda a, b: full(F.trim(a)) & full(F.trim(b)) & (F.trim(a) != F.trim(b))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    critical, warning, info = F.lit("CRITICAL"), F.lit("WARNING"), F.lit("INFO")
    short = lambda c: F.when(F.length(c) > 120, F.concat(F.left(c, F.lit(120)), F.lit("..."))).otherwise(c)
    blocks = lambda c: F.concat(_count(c).cast("string"), F.lit(" schema block(s)"))
    removed = (_count(o("schema")) > 0) & (_count(n("schema")) == 0)
    kinds = F.col("old_types")
    retired_only = (F.size(kinds) > 0) & F.forall(kinds, lambda t: t.isin(*RETIRED))
    worse = [(name, _p75("old", m), _p75("new", m)) for m, name in FIELD]
    regressed = F.filter(F.array(*[F.when((a > 0) & ((b - a) / a > 0.20), F.lit(name)) for name, a, b in worse]), lambda x: x.isNotNull())
    joined = lambda k: F.concat_ws(",", *[F.concat(F.lit(f"{name}="), v.cast("string")) for name, *pair in worse for v in (pair[k],)])
    hash_ = lambda side: F.sha2(F.col(f"{side}_json"), 256)
    return [
        ("schema_removed", F.when(removed & retired_only, warning).otherwise(critical), removed, blocks(o("schema")), blocks(n("schema"))),
        ("canonical_changed", critical, o("canonical").isNotNull() & n("canonical").isNotNull() & (o("canonical") != n("canonical")), o("canonical"), n("canonical")),
        ("canonical_removed", critical, o("canonical").isNotNull() & gone(n("canonical")), o("canonical"), n("canonical")),
        ("noindex_added", critical, ~F.contains(low(o("robots")), F.lit("noindex")) & F.contains(low(n("robots")), F.lit("noindex")), o("robots"), n("robots")),
        ("h1_removed", critical, full(o("h1")) & (F.coalesce(n("h1_count"), F.lit(0)) == 0), o("h1"), n("h1")),
        ("h1_changed", critical, full(o("h1")) & full(n("h1")) & (F.col("h1_similarity") < 0.5), o("h1"), n("h1")),
        ("title_removed", critical, full(o("title")) & gone(n("title")), o("title"), n("title")),
        ("status_code_error", critical, o("status_code").between(200, 399) & (n("status_code") >= 400), o("status_code").cast("string"), n("status_code").cast("string")),
        ("title_changed", warning, changed(o("title"), n("title")), o("title"), n("title")),
        ("meta_description_changed", warning, changed(o("meta_description"), n("meta_description")), short(o("meta_description")), short(n("meta_description"))),
        ("cwv_regressed", warning, F.size(regressed) > 0, joined(0), joined(1)),
        ("perf_score_dropped", warning, o("performance_score") - n("performance_score") >= 10, o("performance_score").cast("string"), n("performance_score").cast("string")),
        ("og_tags_removed", warning, (_count(o("open_graph")) > 0) & (_count(n("open_graph")) == 0), _count(o("open_graph")).cast("string"), _count(n("open_graph")).cast("string")),
        ("schema_modified", warning, hash_("old") != hash_("new"), F.left(hash_("old"), F.lit(12)), F.left(hash_("new"), F.lit(12))),
        ("schema_added", info, (_count(o("schema")) == 0) & (_count(n("schema")) > 0), blocks(o("schema")), blocks(n("schema"))),
        ("h2_structure_changed", info, F.coalesce(o("h2"), F.array().cast("array<string>")) != F.coalesce(n("h2"), F.array().cast("array<string>")), _count(o("h2")).cast("string"), _count(n("h2")).cast("string")),
        ("content_hash_changed", info, o("html_hash") != n("html_hash"), F.left(o("html_hash"), F.lit(12)), F.left(n("html_hash"), F.lit(12))),
    ]


def compare(current: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(url_hash, baseline_id, rule, severity, triggered, old_value, new_value): seventeen rows per page that has a baseline."""
    old, new = latest(snapshots), current
    pairs = new.select("url_hash", F.struct(*new.columns).alias("new")).join(old.select("url_hash", F.struct(*old.columns).alias("old")), "url_hash")
    # Only headings that differ are compared, and only types that are gone are read: the others go to the functions as nulls.
    differ = F.col("old.h1") != F.col("new.h1")
    gone = F.when(_count(F.col("new.schema")) == 0, F.col("old.schema"))
    pairs = pairs.withColumns({"h1_similarity": similarity(F.when(differ, F.col("old.h1")), F.when(differ, F.col("new.h1"))), "old_types": top_types(gone), "old_json": canonical_json("old.schema"), "new_json": canonical_json("new.schema")})
    made = F.array(*[F.struct(F.lit(name).alias("rule"), severity.alias("severity"), F.coalesce(hit, F.lit(False)).alias("triggered"), a.alias("old_value"), b.alias("new_value")) for name, severity, hit, a, b in rules()])
    return pairs.select("url_hash", F.col("old.id").alias("baseline_id"), F.explode(made).alias("f")).select("url_hash", "baseline_id", "f.*")


def without_baseline(current: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The pages that have no baseline to be compared with."""
    return current.join(snapshots.select("url_hash").distinct(), "url_hash", "left_anti")


def summary(findings: DataFrame) -> DataFrame:
    """Triggered findings per page by severity, and the page's status (the worst)."""
    count = lambda s: F.count_if(F.col("triggered") & (F.col("severity") == s))
    out = findings.groupBy("url_hash").agg(count("CRITICAL").alias("critical"), count("WARNING").alias("warning"), count("INFO").alias("info"))
    return out.withColumn("status", F.when(F.col("critical") > 0, "CRITICAL").when(F.col("warning") > 0, "WARNING").when(F.col("info") > 0, "INFO").otherwise("none"))
