"""Benchmark decontamination: a prefix-filtered set join (DataFrame functions only).

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of texts with A-Z lowered. A window is ``WINDOW``
consecutive words of a benchmark item; an item of fewer words is one window. A document's word is hit
if it lies in an occurrence of a window.

1. ``normal_words`` writes the documents' words once, joined by single spaces.
2. Distinct windows are sets of shingles (``SHINGLE`` words, or the whole of a shorter window).
   A document that contains a window contains all its shingles, so one of them is a sufficient
   prefix of the ordered set: the rarest. Rarity is counted over all documents, for the shingles
   that items hold.
3. Documents' shingles join the prefixes by hash. The shingle's place in the window gives the place where the
   window must start (positional bound); it must end within the document (length bound).
4. What is left is verified on the words themselves, in windows of the item's size.

Windows one of whose shingles no document holds go before the join. The items' shingles and windows are
broadcast up to ``BROADCAST_BYTES`` as counted, beyond that joined by shuffle; then places travel without
words, and the few documents with candidates are read again to be verified. Equal windows of
many items are one window until the end, and a passage that many documents share is counted per document.

Nulls: a null text, of a document or an item, has no words and is hit by nothing; a null doc_id stays null, and an item with a
null item_id marks words but is not listed. Rows with equal doc_id and equal words
share their counts. Two shingles of one hash (64 bits) cost a verification more and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import broadcast_if_small, text_or_empty, written

#: Words of a window, and of the shingles that stand for it.
WINDOW, SHINGLE = 10, 5
#: What is broadcast has so many bytes at most.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """The words of a text, A-Z lowered, joined by one space."""
    return F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), NO_WORD, " "))


def _listed(words: Column) -> Column:
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def _shingle(words: Column, at: Column, size: int) -> Column:
    """The hash of size words from place ``at`` on (from 0); null where the text ends before."""
    return F.when(at + size <= F.size(words), F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)]))


def _small(df: DataFrame, width: Column) -> bool:
    """Whether a written table is small enough to broadcast, by the sum of its rows' bytes."""
    return (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES


def _places(words: DataFrame, sizes: list[int], carry: list[str]) -> DataFrame:
    """(carry, at, key): every shingle of each text and its place; listed words stay in ``__words`` for what follows."""
    rows = words.select(*carry, _listed(F.col("words")).alias("__words")).select(*carry, "__words", F.posexplode("__words").alias("at", "__word"))
    keys = [_shingle(F.col("__words"), F.col("at"), s) for s in sizes]
    return rows.withColumn("key", keys[0] if len(keys) == 1 else F.explode(F.array(*keys))).where("key is not null").drop("__word")


def windows_of(items: DataFrame) -> DataFrame:
    """(item_id, window, size) of the items (item_id, text): distinct windows, as words joined by spaces."""
    listed = items.select("item_id", _listed(normal_words(text_or_empty())).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    rows = listed.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, WINDOW), " "))).alias("window"))
    return rows.distinct().withColumn("size", F.size(F.split("window", " ")))


def _prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, offset, window, size) of each window that can occur: its rarest shingle over the documents and that shingle's place in it."""
    shingles = written(_places(windows.select("window", F.col("window").alias("words")), sizes, ["window"]).select("window", "at", "key"), "leak-shingles")
    # Of a window of ten words only shingles of SHINGLE words are needed, of a short one the whole.
    whole = windows.select("window", "size")
    wanted = written(shingles.select("key").distinct(), "leak-keys")
    wanted = F.broadcast(wanted) if _small(wanted, F.lit(16)) else wanted
    counts = _places(docs, sizes, []).select("key").join(wanted, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    counted = shingles.join(written(counts, "leak-rarity"), "key", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "key")).alias("rarest"))
    return counted.where("rarest.n > 0").join(whole, "window").select("rarest.key", F.col("rarest.at").alias("offset"), "window", "size")


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(d, th, start, size, window) of every place where one of the windows (window, size) stands in docs (d, th, words)."""
    # At most SHINGLE sizes.
    sizes = sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("s")).distinct().collect()) or [SHINGLE]
    prefixes = written(_prefixes(docs, windows, sizes), "leak-prefixes")
    start = (F.col("at") - F.col("offset")).alias("start")
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.slice("__words", F.col("start") + 1, F.col("size")), " ") == F.col("window")
    if _small(prefixes, F.octet_length("window") + 32):
        found = _places(docs, sizes, ["d", "th", "n_words"]).join(F.broadcast(prefixes), "key")
        return found.select("d", "th", start, "size", "window", "n_words", "__words").where(fits).where(same).select("d", "th", "start", "size", "window")
    found = _places(docs, sizes, ["d", "th", "n_words"]).drop("__words").join(prefixes, "key")
    maybe = written(found.select("d", "th", start, "size", "window", "n_words").where(fits).drop("n_words"), "leak-maybe")
    wanted = broadcast_if_small(written(maybe.select("d", "th").distinct(), "leak-wanted"), BROADCAST_BYTES // 64)
    texts = docs.select("d", "th", "words").join(wanted, ["d", "th"], "left_semi").dropDuplicates(["d", "th"])
    return maybe.join(texts.select("d", "th", _listed(F.col("words")).alias("__words")), ["d", "th"]).where(same).select("d", "th", "start", "size", "window")


def _covered(spans: Column) -> Column:
    """Places covered by an array of (start, end), sorted."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto")
    )
    return F.aggregate(spans, zero, step)["n"]


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of each row of docs (doc_id, text): items are the sorted item_ids, as strings."""
    words = docs.select("doc_id", normal_words(text_or_empty()).alias("words"))
    words = words.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("d"), F.xxhash64("words").alias("th"), F.size(_listed(F.col("words"))).alias("n_words"), "words")
    words = written(words, "leak-words")
    members = written(windows_of(items), "leak-windows")
    found = written(occurrences(words, members.select("window", "size").distinct()), "leak-found")
    spans = found.groupBy("d", "th").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    hit = spans.select("d", "th", _covered(F.col("spans")).alias("n_hit"))
    members = members.where("item_id is not null").select("window", F.col("item_id").cast("string").alias("item"))
    members = F.broadcast(members) if _small(members, F.octet_length("window") + 32) else members
    named = found.select("d", "th", "window").distinct().join(members, "window").groupBy("d", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = words.drop("words").join(hit, ["d", "th"], "left").join(named, ["d", "th"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))
