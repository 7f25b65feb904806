"""Sinks: markdown tables, sitemaps, audit envelopes."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_ROWS = 50
SITEMAP_URLS, SITEMAP_BYTES = 50_000, 50 * 1024 * 1024


def markdown_table(df: DataFrame, columns: list[str] | None = None, headers: list[str] | None = None, most: int = MOST_ROWS) -> str:
    """The first rows as a markdown table; only most + 1 rows reach the driver."""
    columns = columns or df.columns
    rows = df.select(*columns).limit(most + 1).collect()

    def cell(v: object) -> str:
        if v is None:
            return "--"
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else f"{v:.2f}"
        return str(v).replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(headers or columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"\n_Shown: the first {most} rows._")
    return "\n".join(lines)


def sitemap_parts(urls: DataFrame, by: str = "host") -> DataFrame:
    """(by, part, url, lastmod) with part numbers so that no file has more than 50 000 URLs or 50 MB.

    URLs are numbered within hash buckets whose sizes are summed first, so a large
    site is not sorted in one task; part k holds one range of the buckets' order.
    """
    entry = F.concat(F.lit("<url><loc>"), F.col("url"), F.lit("</loc></url>\n"))
    rows = urls.withColumns({"bucket": F.pmod(F.xxhash64("url"), F.lit(4096)), "bytes": F.octet_length(entry).cast("long")})
    sums = rows.groupBy(by, "bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(by, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    within = Window.partitionBy(by, "bucket").orderBy("url").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(sums, [by, "bucket"]).withColumns({"k": F.col("n0") + F.row_number().over(within) - 1, "upto": F.col("b0") + F.sum("bytes").over(within)})
    part = F.greatest(F.floor(F.col("k") / SITEMAP_URLS), F.floor(F.col("upto") / (SITEMAP_BYTES - 4096)))
    return placed.select(by, part.cast("long").alias("part"), "url", *[c for c in ("lastmod",) if c in urls.columns])


def audit_envelope(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """One JSON value per site: scores, counts by severity, and findings by category.

    findings: site, category, severity, message (summarized findings of a site);
    scores: site, score.
    """
    worst = F.when(F.col("severity") == "Critical", 0).when(F.col("severity") == "High", 1).when(F.col("severity") == "Medium", 2).otherwise(3)
    by = findings.groupBy("site", "category").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.struct(worst.alias("order"), "severity", "message"))).alias("findings"))
    cats = by.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("category", "n", F.transform("findings", lambda f: F.struct(f["severity"].alias("severity"), f["message"].alias("message"))).alias("findings")))).alias("categories"))
    counts = findings.groupBy("site").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Critical", "High", "Medium", "Info")])
    joined = scores.join(counts, "site", "left").join(cats, "site", "left")
    summary = F.struct("score", *[F.coalesce(s, F.lit(0)).alias(s) for s in ("critical", "high", "medium", "info")])
    return joined.select("site", F.to_json(F.struct(summary.alias("summary"), "categories")).alias("envelope"))


def drift_report(findings: DataFrame, most: int = 500) -> str:
    """An HTML page of triggered findings, worst first; only the rows shown reach the driver."""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    rows = findings.where("triggered").orderBy(rank, "url_hash", "rule").limit(most).collect()
    body = "".join(f"<tr class='{escape(r.severity.lower())}'>" + "".join(f"<td>{escape(str(v if v is not None else '--'))}</td>" for v in (r.url_hash, r.severity, r.rule, r.old_value, r.new_value)) + "</tr>" for r in rows)
    status = rows[0].severity if rows else "none"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Drift: {escape(status)}</title></head><body><h1>{escape(status)}</h1><table>{body}</table></body></html>"
