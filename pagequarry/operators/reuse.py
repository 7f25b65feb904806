"""Near-duplicate pages: what share of a page's words stands on other pages too, and which page shares most.

Every window of ``width`` consecutive words has a rolling fingerprint. A fingerprint keeps its two
first pages (the engine keeps two rows of each task before it shuffles, so the navigation
of a whole site is two rows a task), and a page's words inside shared windows are a bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions.stored import written

#: A page with so many percent of its words in shared windows is a near duplicate.
NEAR_DUPLICATE_PCT = 80.0


def plain_text(html: Column) -> Column:
    """The text between a page's tags, without scripts, styles and comments."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")


def fingerprints(pages: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, at, fingerprint) of every window of ``width`` words, lower-cased; ``at`` is its first word, from 0."""
    words = pages.select(key, F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w")).where(F.size("w") >= width)
    at = words.select(key, "w", F.posexplode("w").alias("at", "first")).where(F.col("at") + width <= F.size("w"))
    return at.select(key, "at", F.xxhash64(*[F.get("w", F.col("at") + k) for k in range(width)]).alias("fingerprint"))


def page_reuse(pages: DataFrame, key: str = "page_id", text: str = "text", width: int = 8) -> DataFrame:
    """(key, words, shared_words, shared_pct, best_source, source_windows, near_duplicate) of every page.

    pages has one row for each key; key cannot be null. A window's source is the first other page that has it (for the first page
    itself the second), the best source the one with most of a page's windows, the first of
    equals. Null texts have no words. Windows are compared by 64-bit hashes.
    """
    prints = written(fingerprints(pages, key, text, width), "reuse-prints")
    first = Window.partitionBy("fingerprint").orderBy(key)
    two = prints.select("fingerprint", key).distinct().withColumn("k", F.row_number().over(first)).where("k <= 2")
    shared = two.groupBy("fingerprint").agg(F.min(key).alias("p1"), F.max(key).alias("p2")).where("p1 <> p2")
    hits = written(prints.join(shared, "fingerprint").select(key, "at", F.when(F.col(key) == F.col("p1"), F.col("p2")).otherwise(F.col("p1")).alias("source")), "reuse-hits")
    marked = hits.select(key, F.explode(F.sequence(F.col("at").cast("long"), F.col("at").cast("long") + (width - 1))).alias("at"))
    bits = marked.groupBy(key, F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    covered = bits.groupBy(key).agg(F.sum(F.bitmap_count("bits")).alias("shared_words"))
    sources = hits.groupBy(key, "source").agg(F.count("*").alias("n")).groupBy(key).agg(F.max(F.struct("n", (-F.col("source")).alias("order"), "source")).alias("best"))
    words = pages.select(key, F.size(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")).cast("long").alias("words"))
    out = words.join(covered, key, "left").join(sources, key, "left").withColumn("shared_words", F.coalesce("shared_words", F.lit(0)))
    pct = F.when(F.col("words") > 0, F.round(F.col("shared_words") * 100.0 / F.col("words"), 2)).otherwise(F.lit(0.0))
    out = out.select(key, "words", "shared_words", pct.alias("shared_pct"), F.col("best.source").alias("best_source"), F.col("best.n").alias("source_windows"))
    return out.withColumn("near_duplicate", F.col("shared_pct") >= NEAR_DUPLICATE_PCT)
