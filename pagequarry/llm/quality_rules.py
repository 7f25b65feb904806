"""Quality rules with adaptive thresholds (DataFrame functions only).

``features`` counts words, symbols, repeated lines and repeated word windows of
each text. ``sketches`` folds four values of every document into quantile
sketches per language and source: a sketch is a map from a rounded value (nine
significant bits, so within 1/256) to a count, two sketches merge by adding
counts, and the merged sketch is the same in any order of merging.

Three of the values are rates, of symbols, repeated lines and repeated words. Most
texts have none of these, so a plain rate has no spread to measure; with one event
and one place added ((n + 1) / (m + 1), as in a rule of succession) the rates of
texts without events spread by their length, which is what one event may weigh
there. The fourth is the mean length of a word.

``fences`` reads the quartiles q1 and q3 of each group from its sketch and draws
them toward those of its language, and these toward the whole corpus, by weight of
documents: the weighted geometric mean own ** (n / (n + PRIOR)) * parent ** (PRIOR /
(n + PRIOR)). So there is no group size at which a rule switches. A limit lies SPREAD times the quartile ratio beyond the
quartile: hi = q3 * (q3 / q1) ** SPREAD, lo = q1 * (q1 / q3) ** SPREAD, and a rate
has an upper one only. The ratio counts as ``RESOLUTION`` at least: one event doubles
a rate, and a mean is known no better than to a few buckets. ``judge`` joins the
limits to the documents and filters; a rate without events is never too high.

Nulls: a null text counts as empty; a null language or source is a group of its
own. A document without words fails the base rule. Repeated rows are judged
each for itself and weigh in the sketches as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import SPACE_CHARS, broadcast_if_small, text_or_empty, words_of, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents that a group's parent counts for beside the group's own.
PRIOR = 20
#: Quartile ratios between a quartile and its fence, by metric.
SPREAD = {"symbol": 2, "dup_line": 1, "repeat_word": 2, "word_length": 4}
#: Least quartile ratio: what one event, or a few buckets of the sketch, come to.
RESOLUTION = {"symbol": 2.0, "dup_line": 2.0, "repeat_word": 2.0, "word_length": 1.02}
#: The count behind each rate.
EVENTS = {"symbol": "n_symbols", "dup_line": "n_dup_lines", "repeat_word": "n_repeat_words"}
METRICS = tuple(SPREAD)
#: Significant bits of a sketch's buckets.
SKETCH_BITS = 9
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_positions(df: DataFrame, words: str, out: str) -> DataFrame:
    """Number of word positions inside three-word windows that occur twice or more in the text.

    Windows are sorted as (32-bit hash, position) in one long array; only windows
    whose hash has an equal neighbour are compared as text.
    """
    n = F.size(words)
    packed = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
            lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), 32).bitwiseOR(i.cast("long")),
        )
    )
    sorted_ = F.col("__pq_sorted")
    high = lambda x: F.shiftright(x, 32)
    near = lambda a, x, i, key: F.coalesce(key(F.get(a, i - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(a, i + 1)) == key(x), F.lit(False))
    df = df.withColumn("__pq_sorted", F.sort_array(packed))
    df = df.withColumn("__pq_cand", F.filter(sorted_, lambda x, i: near(sorted_, x, i, high)))

    def window(x: Column) -> Column:
        p = x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        return F.struct(F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2)).alias("k"), p.alias("p"))

    df = df.withColumn("__pq_windows", F.sort_array(F.transform("__pq_cand", window)))
    windows = F.col("__pq_windows")
    df = df.withColumn("__pq_repeated", F.filter(windows, lambda x, i: near(windows, x, i, lambda y: y["k"])))
    covered = F.flatten(F.transform("__pq_repeated", lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    df = df.withColumn(out, F.size(F.array_distinct(covered)).cast("long"))
    return df.drop("__pq_sorted", "__pq_cand", "__pq_windows", "__pq_repeated")


def features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) and base_failed; columns of these names are replaced."""
    text = text_or_empty()
    df = docs.withColumn("__pq_words", words_of(text))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    df = df.withColumn("__pq_lines", lines)
    df = df.withColumns(
        {
            "n_words": F.size("__pq_words").cast("long"),
            "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("__pq_lines").cast("long"),
            "n_dup_lines": (F.size("__pq_lines") - F.size(F.array_distinct("__pq_lines"))).cast("long"),
        }
    )
    df = _repeated_positions(df, "__pq_words", "n_repeat_words").drop("__pq_words", "__pq_lines")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def values() -> dict[str, Column]:
    """The judged values as whole numbers from 1, from the counts of ``features``: rates per million, the mean word length in thousandths."""
    rate = lambda n, m: F.expr(f"greatest((1000000 * ({n} + 1)) div ({m} + 1), 1)")
    return {
        "symbol": rate("n_symbols", "word_chars"),
        "dup_line": rate("n_dup_lines", "n_lines"),
        "repeat_word": rate("n_repeat_words", "n_words"),
        "word_length": F.expr("greatest((1000 * word_chars) div greatest(n_words, 1), 1)"),
    }


def rounded(value: Column) -> Column:
    """A value cut to its leading bits: the sketch's bucket."""
    shift = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of documents with words: mergeable by adding n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), rounded(v).alias("bucket")) for k, v in values().items()]))
    return (
        counted.where("n_words > 0")
        .select("lang", "source", pairs.alias("pair"))
        .groupBy("lang", "source", "pair.metric", "pair.bucket")
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches to keys and read both quartiles: the first bucket at which the counts reach the share."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "metric")
    merged = merged.withColumn("upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("docs", F.sum("n").over(by))
    return merged.groupBy(*keys, "metric").agg(
        F.max("docs").alias("docs"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs") * 3, F.col("bucket"))).alias("q3"),
    )


def _toward(own: str, parent: str, prior: int) -> Column:
    """The struct (docs, q1, q3) of a group, its quartiles drawn toward its parent's."""
    drawn = lambda q: F.expr(f"exp(({own}.docs * ln({own}.{q}) + {prior} * ln({parent}.{q})) / ({own}.docs + {prior}))").alias(q)
    return F.struct(F.col(f"{own}.docs").alias("docs"), drawn("q1"), drawn("q3"))


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source): <metric>_hi of each metric and word_length_lo, doubles, inclusive."""
    struct = F.struct("docs", "q1", "q3")
    own = _quartiles(sketch, ["lang", "source"]).select("lang", "source", "metric", struct.alias("own"))
    by_lang = _quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("lm"), struct.alias("by_lang"))
    overall = _quartiles(sketch, []).select(F.col("metric").alias("am"), struct.alias("overall"))
    parents = by_lang.join(F.broadcast(overall), by_lang["lm"] == overall["am"]).select("l", "lm", _toward("by_lang", "overall", prior).alias("parent"))
    joined = own.join(parents, own["lang"].eqNullSafe(F.col("l")) & (own["metric"] == F.col("lm"))).select("lang", "source", "metric", _toward("own", "parent", prior).alias("q"))
    limits = []
    for m in METRICS:
        low, high = F.col("q.q1"), F.col("q.q3")
        ratio = F.greatest(high / low, F.lit(RESOLUTION[m]))
        for _ in range(SPREAD[m]):
            low, high = low / ratio, high * ratio
        limits += [F.max(F.when(F.col("metric") == m, x)).alias(f"{m}_{s}") for s, x in (("hi", high), ("lo", low)) if f"{m}_{s}" in LIMITS]
    return joined.groupBy("lang", "source").agg(*limits)


#: Columns of the limits. (The corpus has one row of quartiles per metric, so these four are broadcast.)
LIMITS = (*[f"{m}_hi" for m in METRICS], "word_length_lo")


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted with ``kept``: not base_failed and every value within its group's limits."""
    limits = limits.select(F.col("lang").alias("__pq_lang"), F.col("source").alias("__pq_source"), *[F.col(x).alias(f"__pq_{x}") for x in LIMITS])
    out = counted.join(limits, counted["lang"].eqNullSafe(F.col("__pq_lang")) & counted["source"].eqNullSafe(F.col("__pq_source")), "left")
    inside = F.lit(True)
    for m, v in values().items():
        inside = inside & ((v <= F.col(f"__pq_{m}_hi")) | (F.col(EVENTS[m]) == 0 if m in EVENTS else F.lit(False)))
    inside = inside & (values()["word_length"] >= F.col("__pq_word_length_lo"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop(*limits.columns)


def apply_rules(docs: DataFrame, carry: list[str] | None = None, prior: int = PRIOR) -> DataFrame:
    """Count, sketch, set limits and judge.

    docs needs text, lang and source; ``carry`` names the columns to keep (all by
    default). Returns them with the counts, base_failed and kept.
    """
    counted = features(docs)
    keep = list(dict.fromkeys([*(carry if carry is not None else docs.columns), "lang", "source"]))
    new = [*BASE, "n_lines", "base_failed"]
    counted = written(counted.select(*[c for c in keep if c not in new], *new), "quality-counts")
    limits = written(fences(sketches(counted), prior), "quality-limits")
    return judge(counted, broadcast_if_small(limits, 20_000))
