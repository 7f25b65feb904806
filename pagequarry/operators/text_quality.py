"""Text quality: filler and machine-typical phrases, repetition, information density, composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that add little.
FILLER = (
    "it's important to note that", "in this article, we'll explore", "in this article we will explore", "in today's fast-paced world",
    "in today's digital age", "in today's competitive landscape", "needless to say", "at the end of the day", "when it comes to",
    "when all is said and done", "in the realm of", "in the world of", "the bottom line is", "without further ado", "first and foremost",
    "last but not least", "for what it's worth", "it goes without saying", "as we all know", "the truth is that",
    "the fact of the matter is", "more often than not", "let's dive in", "let's dive into", "let's take a closer look", "let's take a deeper look",
)
# Phrases typical of generated text (after Wikipedia's AI Cleanup catalogue, CC BY-SA 4.0).
GENERATED = (
    "delve into", "delve deeper into", "in the ever-evolving", "ever-evolving landscape", "ever-changing landscape",
    "in the dynamic landscape", "navigating the", "navigate the complexities", "tapestry of", "rich tapestry", "intricate tapestry",
    "embark on a journey", "embarking on this", "a testament to", "a beacon of", "the cornerstone of", "a cornerstone of",
    "at the heart of", "at its core", "in essence,", "in conclusion,", "ultimately,", "moreover,", "furthermore,",
    "however, it's worth noting", "it's worth noting that", "by leveraging", "leverage the power of", "leveraging the power of",
    "harness the power of", "unlock the potential", "unlock the full potential", "the realm of possibilities", "open up a world of",
    "a world of possibilities", "elevate your", "transform your", "revolutionize the way", "game-changer", "game-changing",
    "cutting-edge", "state-of-the-art", "in summary,", "to summarize,", "to put it simply,", "in a nutshell,",
)
# Tokens, numbers, and names of two capitalised words or more.
TOKEN = r"[A-Za-z][A-Za-z'\-]*"
NUMBER = r"\b\d+(?:[.,]\d+)?(?:%|st|nd|rd|th)?\b"
ENTITY = r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"


def tokens_of(text: Column) -> Column:
    """Words in lower case."""
    return tokens_in(F.lower(text))


def tokens_in(low: Column) -> Column:
    """Words of a lower-cased text."""
    return F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once: inside a function over an array an expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def phrases_in(low: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases that a lower-cased text contains, in the list's order; low is a column of its own, so that it is made once."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases]))


def repeated_bigrams(tokens: Column) -> Column:
    """Share of distinct bigrams that occur more than once; 0 for fewer than four tokens.

    The bigrams' 64-bit hashes are sorted, so an equal neighbour shows a repetition: the
    number of distinct repeated bigrams is that of positions equal to the one before and
    different from the one before that.
    """

    def share(words: Column) -> Column:
        return _bound(F.sort_array(F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda t, i: F.xxhash64(t, F.get(words, i + 1)))), counted)

    def counted(grams: Column) -> Column:
        before = lambda i, k: F.get(grams, i - k)
        first = F.filter(grams, lambda g, i: (i == 0) | (g != before(i, 1)))
        again = F.filter(grams, lambda g, i: F.coalesce(g == before(i, 1), F.lit(False)) & ((i == 1) | F.coalesce(g != before(i, 2), F.lit(True))))
        return F.size(again) / F.size(first)

    return F.when(F.size(tokens) < 4, F.lit(0.0)).otherwise(_bound(tokens, share))


def half_even(x: Column) -> Column:
    """A whole number, halves to the even one."""
    return F.bround(x, 0).cast("long")


def analyse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with tokens, unique_tokens, filler_hits, ai_hits, entities, numbers and the scores and flags of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    empty = F.btrim(t, F.lit(" \t\n\r\x0b\f")) == ""
    df = docs.withColumn("__low", F.lower(t)).withColumn("__tokens", tokens_in(F.col("__low")))
    df = df.withColumns(
        {
            "tokens": F.size("__tokens").cast("long"),
            "unique_tokens": F.size(F.array_distinct("__tokens")).cast("long"),
            "filler_hits": phrases_in(F.col("__low"), FILLER),
            "ai_hits": phrases_in(F.col("__low"), GENERATED),
            "entities": F.regexp_count(t, F.lit(ENTITY)).cast("long"),
            "numbers": F.regexp_count(t, F.lit(NUMBER)).cast("long"),
            "__repeated": repeated_bigrams(F.col("__tokens")),
        }
    )
    scale = F.greatest(F.lit(1.0), F.col("tokens") / 1000.0)
    density = F.least(F.lit(1.0), (F.col("entities") + F.col("numbers")) * 100.0 / F.greatest(F.lit(1), "tokens") / 10.0)
    df = df.withColumns(
        {
            "filler_score": F.when(empty, 0).otherwise(F.least(F.lit(100), half_even(F.size("filler_hits") / scale * 25))).cast("long"),
            "ai_pattern_score": F.when(empty, 0).otherwise(F.least(F.lit(100), half_even(F.size("ai_hits") / scale * 15))).cast("long"),
            "__density": F.when(empty, 0.0).otherwise(density),
            "repetition_score": half_even(F.col("__repeated") * 100),
        }
    )
    overall = (
        (100 - F.col("filler_score")) * 0.25
        + (100 - F.col("ai_pattern_score")) * 0.25
        + F.col("__density") * 100 * 0.25
        + (100 - F.col("repetition_score")) * 0.15
        + F.least(F.lit(100.0), F.col("tokens") / 10.0) * 0.10
    )
    raised = F.array(
        F.when(F.col("filler_score") >= 50, "filler"), F.when(F.col("ai_pattern_score") >= 40, "ai-patterns"), F.when(F.col("__density") < 0.20, "low-density"),
        F.when(F.col("repetition_score") >= 30, "repetitive"), F.when(F.col("tokens") < 300, "thin-content"),
    )
    df = df.withColumns(
        {
            "information_density": F.round("__density", 3),
            "overall_quality": F.when(empty, 0).otherwise(half_even(overall)).cast("long"),
            "flags": F.when(empty, F.array(F.lit("empty-input"))).otherwise(F.filter(raised, lambda x: x.isNotNull())),
        }
    )
    return df.drop("__low", "__tokens", "__repeated", "__density")


def uniqueness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, total_words, unique_words, uniqueness_pct): the share of a text's words that no other text of the set has.

    A word keeps its first and last text and its number, which each task sums before the words are shuffled: a word is a text's own where the
    two are one. Totals are counted in place, so no text's words are shuffled once more. Keys are not null; a text without words has no row.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = docs.select(key, F.explode(found).alias("word"))
    own = words.groupBy("word").agg(F.min(key).alias(key), F.max(key).alias("last"), F.count("*").alias("n")).where(F.col(key) == F.col("last"))
    own = own.groupBy(key).agg(F.sum("n").alias("own"))
    totals = docs.select(key, F.size(found).cast("long").alias("n")).groupBy(key).agg(F.sum("n").alias("total_words")).where("total_words > 0")
    out = totals.join(own, key, "left").select(key, "total_words", F.coalesce("own", F.lit(0).cast("long")).alias("unique_words"))
    return out.withColumn("uniqueness_pct", F.round(F.col("unique_words") * 100.0 / F.col("total_words"), 2))


def keyword_density(docs: DataFrame, keyword: str, text: str = "text") -> DataFrame:
    """docs with keyword_hits and keyword_density (percent of words); a value to report, with no limit attached."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    n = F.regexp_count(low, F.lit(r"[\p{L}\p{N}_]+")).cast("long")
    hits = ((F.length(low) - F.length(F.replace(low, F.lit(keyword.lower()), F.lit("")))) / len(keyword)).cast("long")
    return docs.withColumns({"keyword_hits": hits, "keyword_density": F.when(n > 0, F.round(hits * 100.0 / n, 2)).otherwise(0.0)})


def citability(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph: words, whether its length suits citation (134 to 167 words), whether it defines something."""
    paragraphs = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\n+")).alias("paragraph", "body")).where("trim(body) <> ''")
    n = F.regexp_count("body", F.lit(r"\S+")).cast("long")
    return paragraphs.select(key, "paragraph", n.alias("words"), n.between(134, 167).alias("citable_length"), F.col("body").rlike(r"(?i)\b(?:is|are|refers to|means)\b").alias("defines"))


# Words that show what a searcher wants.
INTENT = (
    ("navigational", r"\b(?:login|log in|sign in|official site|homepage|website)\b"),
    ("transactional", r"\b(?:buy|price|pricing|cheap|deal|deals|discount|coupon|order|purchase|for sale|hire|book)\b"),
    ("commercial", r"\b(?:best|top|review|reviews|vs|versus|compare|comparison|alternative|alternatives)\b"),
    ("informational", r"\b(?:how|what|why|when|who|guide|tutorial|examples?|tips|learn|ideas)\b"),
)


def intent(keyword: Column) -> Column:
    """The first intent whose words a keyword has; informational if none."""
    out = F.lit("informational")
    for name, pattern in reversed(INTENT):
        out = F.when(F.lower(keyword).rlike(pattern), F.lit(name)).otherwise(out)
    return out
