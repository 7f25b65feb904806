"""Line dedup: a deletion-neighbourhood join (DataFrame functions only).

A line is the text between two ``\\n``, compared without the white space at its
ends. An occurrence goes if an earlier one, in order of (doc_id, line number),
has an equal line, or one within one edit (a character inserted, deleted or
replaced) where both have ``near_from`` characters or more: the edit bound goes by
length, 0 below ``near_from`` and 1 from there on. In a short line one edit makes another
word ("page 1", "page 2"), so the production value is ``NEAR_FROM``; with 1 all lines are compared with one
edit, with None none is. The rule is about
pairs, not chains: it does not matter whether the earlier line itself stays.
Lines without a word are never compared and always stay.

Only distinct lines enter the neighbourhood join. Two lines within one edit
agree outside the place of the edit, so they share the key of some segment: the
hash of what stands before and after it, measured in the shorter line. Keys
over halves (computed with the first scan) leave the few lines that may have a
neighbour (lines of up to ``SHORT`` characters, of which there are few distinct ones, all may); keys over about sqrt(length) segments then tell where in such a line
the edit can be, and there every deletion variant is emitted as a hashed key.
Equal variants meet: two lines with the same variant at the same place differ in
one character, so their group is never larger than the alphabet and its earliest
member is within one edit of all; a line equal to a variant is one deletion
away. The edit distance of each pair found is verified on the texts.

Nulls: a null text counts as empty, a null doc_id comes after all others. Rows
with equal doc_id and equal text count as one document and all keep the same
lines. A hash is 64 bits wide and goes with the line's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import SPACE_CHARS, broadcast_if_small, text_or_empty, written

#: Length from which lines are compared with one edit, shorter ones for equality.
NEAR_FROM = 20
#: Lines of up to so many characters have halves too short to tell them apart: one key stands for all of these.
SHORT = 4
#: Most rows of a line list that is broadcast (about 40 bytes each); longer lists are joined by shuffle.
BROADCAST_ROWS = 400_000
LAST = 2**63 - 1


def _lines(docs: DataFrame, hashed: bool = True) -> DataFrame:
    """(d, th, pos, line, h, len): the lines with a word; d is doc_id, th the text's hash."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("th"), F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "raw"))
    rows = rows.withColumn("line", F.btrim("raw", F.lit(SPACE_CHARS))).where("line <> ''").drop("raw")
    return rows.withColumns({"h": F.xxhash64("line"), "len": F.length("line")})


def _parts(line: Column, length: Column, a: Column, start: Column, end: Column) -> list[Column]:
    """What stands before ``start`` and after ``end``, both offsets in a line of length a."""
    return [F.substring(line, F.lit(1), start), F.substring(line, length - (a - end) + 1, a - end)]


def _half_keys() -> Column:
    """Keys of the halves that one edit can leave alone: beginnings and ends of half the length, shorter or longer by one."""
    half, line = F.expr("len div 2").cast("int"), F.col("line")
    odd = F.col("len") % 2 == 1
    begins = lambda n: F.xxhash64(F.lit(0), F.substring(line, F.lit(1), n))
    ends = lambda n: F.xxhash64(F.lit(1), F.substring(line, F.col("len") - n + 1, n))
    keys = F.array(begins(half), ends(half), F.when(odd, ends(half + 1)).otherwise(begins(half - 1)))
    # A line of SHORT characters may be one edit from a longer one as well.
    short = F.array(F.xxhash64(F.lit(2)))
    return F.when(F.col("len") < SHORT, short).when(F.col("len") == SHORT, F.concat(short, keys)).otherwise(keys)


def _first_lines(docs: DataFrame, near_from: int | None) -> DataFrame:
    """One row per distinct line: its hash, number of occurrences, first place and half keys."""
    near = F.col("len") >= near_from if near_from is not None else F.lit(False)
    rows = _lines(docs).withColumn("keys", F.when(near, _half_keys()))
    return rows.groupBy("h", "len").agg(F.count("*").alias("n"), F.min(F.struct("d", "pos", "th")).alias("first"), F.max("keys").alias("keys"))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs on two rows or more."""
    keys = rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key)
    return rows.join(broadcast_if_small(written(keys, "line-keys"), BROADCAST_ROWS), key, "left_semi")


def _variants(texts: DataFrame) -> DataFrame:
    """Deletion variants where a pair's edit can be: (h, len, first, a, kind, key)."""
    a = F.explode(F.array(F.col("len"), F.col("len") - 1)).alias("a")
    segments = texts.select("h", "len", "first", "line", a).where("a > 0").withColumn("q", F.ceil(F.sqrt("a")).cast("int"))
    segments = segments.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    segments = segments.withColumns({"start": F.expr("cast((cast(a as bigint) * j) div q as int)"), "end": F.expr("cast((cast(a as bigint) * (j + 1)) div q as int)")})
    segments = segments.withColumn("key", F.xxhash64("a", "j", *_parts(F.col("line"), F.col("len"), F.col("a"), F.col("start"), F.col("end"))))
    places = _shared(segments, "key")
    longer = F.col("a") < F.col("len")
    offset = F.explode(F.sequence(F.col("start"), F.when(longer, F.col("end")).otherwise(F.col("end") - 1))).alias("o")
    variant = F.concat(F.substring(F.col("line"), F.lit(1), F.col("o")), F.substring(F.col("line"), F.col("o") + 2, F.col("len")))
    deleted = places.where("end > start or a < len").select("h", "len", "first", "a", "line", offset)
    deleted = deleted.select(
        "h", "len", "first", "a",
        F.when(longer, F.lit("longer")).otherwise(F.lit("equal")).alias("kind"),
        F.xxhash64(F.when(longer, F.lit(-1)).otherwise(F.col("o")), variant).alias("key"),
    )
    whole = texts.select("h", "len", "first", F.col("len").alias("a"), F.lit("shorter").alias("kind"), F.xxhash64(F.lit(-1), "line").alias("key"))
    return deleted.union(whole)


def _near_lines(texts: DataFrame) -> DataFrame:
    """(h, len) of the lines that have an earlier line within one edit."""
    variants = _variants(texts).dropDuplicates(["h", "len", "a", "kind", "key"])
    earliest = F.min(F.struct("first", "h", "len")).over(Window.partitionBy("key", "a"))
    same = variants.where("kind = 'equal'").withColumn("other", earliest)
    same = same.where(F.col("other.first") < F.col("first")).select("h", "len", F.col("other.h").alias("h0"), F.col("other.len").alias("len0"))
    x = variants.where("kind = 'shorter'").select(F.col("key"), F.col("a"), F.struct("first", "h", "len").alias("x"))
    y = variants.where("kind = 'longer'").select(F.col("key"), F.col("a"), F.struct("first", "h", "len").alias("y"))
    both = x.join(y, ["key", "a"]).select(F.greatest("x", "y").alias("late"), F.least("x", "y").alias("early"))
    both = both.select("late.h", "late.len", F.col("early.h").alias("h0"), F.col("early.len").alias("len0"))
    pairs = same.union(both).distinct()
    late = texts.select("h", "len", "line")
    early = texts.select(F.col("h").alias("h0"), F.col("len").alias("len0"), F.col("line").alias("line0"))
    verified = pairs.join(late, ["h", "len"]).join(early, ["h0", "len0"]).where(F.levenshtein("line", "line0", 1) >= 0)
    return verified.select("h", "len").distinct()


def removed_lines(docs: DataFrame, near_from: int | None = NEAR_FROM) -> DataFrame:
    """(d, th, gone): for each document that loses lines, the sorted numbers of these lines."""
    firsts = written(_first_lines(docs, near_from), "line-firsts")
    keyed = firsts.where("keys is not null").select("h", F.explode("keys").alias("key"))
    halves = broadcast_if_small(written(_shared(keyed, "key").select("h").distinct(), "line-halves"), BROADCAST_ROWS)
    maybe = written(firsts.where("keys is not null").join(halves, "h", "left_semi").select("h", "len", "first"), "line-maybe")
    at = F.struct("d", "pos", "th")
    texts = _lines(docs).join(broadcast_if_small(maybe, BROADCAST_ROWS), ["h", "len"]).where(at == F.col("first")).select("h", "len", "first", "line")
    texts = written(texts.dropDuplicates(["h", "len"]), "line-texts")
    near = written(_near_lines(texts), "line-near").withColumn("near", F.lit(True))
    known = firsts.select("h", "len", "n", "first").join(near, ["h", "len"], "left").where("n > 1 or near")
    gone = _lines(docs).select("d", "th", "pos", "h", "len").join(known, ["h", "len"]).where(F.col("near") | (at != F.col("first")))
    return gone.groupBy("d", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, near_from: int | None = NEAR_FROM) -> DataFrame:
    """docs (doc_id, text and any other columns) with the remaining lines as text.

    Adds n_lines (lines with a word), n_removed and emptied (it had words and has
    none left), replacing columns of these names. The text of a document that
    loses nothing is unchanged; a null text stays null.
    """
    gone = removed_lines(docs, near_from).select(F.col("d").alias("__pq_d"), F.col("th").alias("__pq_th"), F.col("gone").alias("__pq_gone"))
    key = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)) == F.col("__pq_d")) & (F.xxhash64(docs["text"]) == F.col("__pq_th"))
    df = docs.join(gone, key, "left")
    has_word = lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""
    df = df.withColumn("__pq_lines", F.split(text_or_empty(), "\n"))
    left = F.filter("__pq_lines", lambda x, i: ~F.array_contains("__pq_gone", i))
    df = df.withColumn("n_lines", F.size(F.filter("__pq_lines", has_word)).cast("long"))
    df = df.withColumn("n_removed", F.coalesce(F.size("__pq_gone"), F.lit(0)).cast("long")).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
    df = df.withColumn("text", F.when(F.col("__pq_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    df = df.withColumn("emptied", (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines")))
    return df.drop("__pq_d", "__pq_th", "__pq_gone", "__pq_lines")
