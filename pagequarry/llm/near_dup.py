"""MinHash near-dedup with odd sketches.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered; a document's set
holds its distinct five-word shingles (all its words as one where it has fewer),
each as a 64-bit hash. Two documents are linked if their Jaccard similarity is
0.75 or more; components of linked documents form the groups.

1. ``signatures`` (Arrow batches, numpy) makes 180 MinHash samples of each set, 36
   band keys of five samples, and the odd sketch: every (sample number, value) is
   hashed to one of 1024 bits, and a bit is 1 if an odd number fell on it. The
   XOR of two sketches is the sketch of the samples in which they differ, so its
   population count estimates high similarities closely. A second sketch of 2048
   bits folds the whole set in the same way; the XOR of two of these estimates the
   size of the symmetric difference, more closely for all but the longest texts.
   A candidate must pass both.
2. Documents with equal sets are one class; only the smallest doc_id goes on.
3. Candidates come from bands. In each band's bucket every document meets the
   bucket's most central document (the one with most company over all bands);
   sketches estimate the similarities, and each document's best hub is confirmed
   on the full sets. So rows grow with the bucket, not with its square.
4. Components of confirmed links (star contraction, written at each round); buckets
   whose documents lie in different components have another round, with new hubs.
5. What the rounds can miss: documents of one bucket that still lie in different
   components. In buckets with few of a size each meets each, with the sketch test in the join's
   condition; documents of larger ones, which share much and are no copies, meet where they share
   a rare shingle (a prefix-filtered join, which loses nothing), and then have the sketch test. New links are
   confirmed and the components joined.

A pair at similarity 0.75 shares no band with probability 6e-5, and fails the
sketch test with about 3e-5; both fall quickly above. Nulls and texts without words have an empty set
and are linked with nothing; a null doc_id counts as the largest. Rows with equal
doc_id are one document for the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import broadcast_if_small, written
from .components import components

SHINGLE = 5
BANDS, ROWS = 36, 5
SAMPLES = BANDS * ROWS
BITS = 1024
SET_BITS = 2048
#: Similarity is confirmed as 100 * |A and B| >= 75 * |A or B|.
PERCENT = 75
#: Lowest estimate that is confirmed on the full sets: four standard deviations below 0.75.
SKETCH_MIN = 0.62
LAST = 2**63 - 1
#: Documents of a bucket's size class up to which each meets each in the last step, and of a label that one row of its join holds, about.
BLOCK = 256
#: Most rows of a list of documents or classes that is broadcast (at most 40 bytes each).
BROADCAST_ROWS = 500_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out + h[k : len(h) - n + 1 + k]) * _MULTIPLIER
            out ^= out >> np.uint64(29)
        return np.unique(_mixed(out))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    a = rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SAMPLES minima of the sets's values under 32-bit permutations x -> a * x + b."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    half = SAMPLES // 2
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), 2048):
            for rows, x in ((slice(0, half), low[start : start + 2048]), (slice(half, SAMPLES), high[start : start + 2048])):
                best[rows] = np.minimum(best[rows], (a[rows, None] * x[None, :] + b[rows, None]).min(axis=1))
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of (sample number, value), as 64-bit words."""
    with np.errstate(over="ignore"):
        at = _mixed(samples.astype(np.uint64) * np.uint64(SAMPLES) + np.arange(len(samples), dtype=np.uint64) + np.uint64(7)) % np.uint64(BITS)
    parity = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def set_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity bitmap of a whole set."""
    parity = (np.bincount((shingles % np.uint64(SET_BITS)).astype(np.int64), minlength=SET_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key per band of ROWS samples: the band's number above 32 bits of hash."""
    s = samples.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = _mixed((out + s[:, k]) * _MULTIPLIER)
    return ((np.arange(BANDS, dtype=np.uint64) << np.uint64(32)) | (out >> np.uint64(32))).view(np.int64)


def _signature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a, b = _permutations()
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            s = shingle_set(text)
            if len(s):
                m = minhash(s, a, b)
                rows.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(m), odd_sketch(m), set_sketch(s)))
            else:
                rows.append((doc_id, 0, None, None, None, None))
        yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_hash", "bands", "sketch", "parity"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands, sketch, parity) of each row; the last four are null without words."""
    # Ids travel as strings: beside a null, pandas would make floats of them.
    schema = "doc_id string, n_shingles long, set_hash binary, bands array<long>, sketch array<long>, parity array<long>"
    signed = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")).mapInPandas(_signature_rows, schema)
    return signed.withColumn("doc_id", F.col("doc_id").cast("long"))


def _confirmed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hub, of_hub = None, np.empty(0, np.uint64)
    for pdf in batches:
        out = []
        for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["x"], pdf["y"], strict=True):
            if y is not hub and y != hub:
                hub, of_hub = y, shingle_set(y)
            mine = shingle_set(x)
            both = len(np.intersect1d(mine, of_hub, assume_unique=True))
            if both and both * 100 >= (len(mine) + len(of_hub) - both) * PERCENT:
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def differing_bits(x: Column, y: Column) -> Column:
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def most_bits(similarity: float) -> int:
    """Differing bits expected at a similarity: J = 1 + BITS / (4 * SAMPLES) * ln(1 - 2 * bits / BITS)."""
    return int(BITS / 2 * (1 - np.exp((similarity - 1) * 4 * SAMPLES / BITS)))


def _side(sketched: DataFrame, name: str) -> DataFrame:
    """Columns of one side of a pair, all with the side's name in front."""
    return sketched.select(*[F.col(c).alias(f"{name}_{c}") for c in sketched.columns])


def _sizes_allow() -> Column:
    return F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * PERCENT


def _most_set_bits() -> Column:
    """Differing bits of the set sketches that a pair at the similarity has at most: the expectation and five standard deviations.

    The symmetric difference has m = (|A| + |B|) * (100 - PERCENT) / (100 + PERCENT) elements.
    """
    m = (F.col("a_n") + F.col("b_n")) * (100 - PERCENT) / (100 + PERCENT)
    fade = F.exp(m * (-2.0 / SET_BITS))
    variance = (1 - fade * fade) * (SET_BITS / 4) - m * fade * fade
    return (1 - fade) * (SET_BITS / 2) + F.sqrt(F.greatest(variance, F.lit(0.0))) * 5 + 2


def _sketches_allow() -> Column:
    return (differing_bits(F.col("a_sketch"), F.col("b_sketch")) <= most_bits(SKETCH_MIN)) & (differing_bits(F.col("a_parity"), F.col("b_parity")) <= _most_set_bits())


def _pairs_with_bits(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """pairs (a, b) whose sizes and sketches allow the similarity, with their differing bits."""
    joined = pairs.join(_side(sketched, "b"), pairs["b"] == F.col("b_doc")).join(_side(sketched, "a"), F.col("a") == F.col("a_doc"))
    joined = joined.where(_sizes_allow()).where(_sketches_allow())
    return joined.select("a", "b", (differing_bits(F.col("a_sketch"), F.col("b_sketch")) + differing_bits(F.col("a_parity"), F.col("b_parity"))).alias("bits"))


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; their texts are read again."""
    wanted = written(pairs.select("a").union(pairs.select("b")).distinct().toDF("doc"), "near-wanted")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("text").cast("string").alias("text"))
    texts = texts.join(broadcast_if_small(wanted, BROADCAST_ROWS), "doc", "left_semi")
    joined = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    return joined.select("a", "b", "x", "y").mapInPandas(_confirmed_rows, "a long, b long").distinct()


def _star_candidates(open_: DataFrame) -> DataFrame:
    """Pairs (a, b) within buckets (key, doc, label): each document a with the hub b of its bucket, where labels differ."""
    sizes = open_.groupBy("key").agg(F.count("*").alias("size"))
    central = open_.join(sizes, "key").groupBy("doc").agg(F.sum("size").alias("weight"))
    hubs = open_.join(central, "doc").groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc")).alias("order"), "doc", "label")).alias("hub"))
    pairs = open_.join(hubs, "key").where(F.col("label") != F.col("hub.label"))
    return pairs.select(F.col("doc").alias("a"), F.col("hub.doc").alias("b")).distinct()


def near_duplicates(docs: DataFrame, star_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach; kept marks its row.
    """
    signed = written(signatures(docs).withColumn("doc", F.coalesce("doc_id", F.lit(LAST))), "near-signatures")
    classes = signed.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc").alias("head"), F.count("*").alias("size")).where("size > 1")
    classes = broadcast_if_small(written(classes.select("set_hash", "head"), "near-classes"), BROADCAST_ROWS)
    heads = signed.where("n_shingles > 0").join(classes, "set_hash", "left").where("head is null or head = doc")
    rows = heads.select("doc", F.explode("bands").alias("key"))
    company = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    company = broadcast_if_small(written(company, "near-company"), BROADCAST_ROWS)
    buckets = written(rows.join(company, "key", "left_semi"), "near-buckets")
    in_bucket = broadcast_if_small(written(buckets.select("doc").distinct(), "near-in-bucket"), BROADCAST_ROWS)
    sketched = written(heads.join(in_bucket, "doc", "left_semi").select("doc", F.col("n_shingles").alias("n"), "sketch", "parity"), "near-sketches")

    labels = sketched.select("doc", F.col("doc").alias("label")).distinct()
    tried = links = sketched.sparkSession.createDataFrame([], "a long, b long")
    for _ in range(star_rounds):
        pairs = _star_candidates(_open_buckets(buckets, labels)).join(tried, ["a", "b"], "left_anti")
        best = _pairs_with_bits(pairs, sketched).groupBy("a").agg(F.min_by("b", F.struct("bits", "b")).alias("b"))
        best = written(best, "near-pairs")
        if best.isEmpty():
            break
        tried = tried.union(best)
        links = links.union(written(_confirmed(best, docs), "near-links"))
        labels = _labels(sketched, links)
    rest = _sweep(_open_buckets(buckets, labels), sketched, docs)
    pairs = written(rest.join(tried, ["a", "b"], "left_anti").join(tried.toDF("b", "a"), ["a", "b"], "left_anti"), "near-rest")
    if not pairs.isEmpty():
        links = links.union(written(_confirmed(pairs, docs), "near-links"))
        labels = _labels(sketched, links)

    moved = broadcast_if_small(written(labels.where("label <> doc").select(F.col("doc").alias("node"), "label"), "near-moved"), BROADCAST_ROWS)
    out = signed.select("doc_id", "doc", "n_shingles", "set_hash").join(classes, "set_hash", "left").withColumn("node", F.coalesce("head", "doc"))
    out = out.join(moved, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
    return out.withColumn("kept", F.coalesce("doc_id", F.lit(LAST)) == F.col("component_id"))


def _open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets (key, doc, label) whose documents have more than one label."""
    labelled = buckets.join(labels, "doc")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return written(labelled.join(mixed, "key", "left_semi").select("key", "doc", "label"), "near-open")


def _sweep(open_: DataFrame, sketched: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of one bucket with different labels that pass the size and sketch tests.

    A bucket is first cut into classes of sizes, each 4/3 times the one before (with
    PERCENT 75): two documents that the size test allows lie in one class or in
    neighbouring ones. Documents of a class of at most BLOCK documents are compared with each other.
    Those of larger classes share much without being copies, or their bucket would be closed by now: they
    go by their rare shingles, see ``_by_rare_shingles``. So rows grow with the bucket, however large it is.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT)) + 1e-9).cast("int")
    rows = open_.join(sketched.select("doc", "n"), "doc").withColumn("own", step).withColumn("class", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("size"), F.max(F.col("own") == F.col("class")).alias("any")).where("size > 1 and any")
    sizes = broadcast_if_small(written(sizes.select("key", "class", (F.col("size") > BLOCK).alias("large")), "near-classes-of-size"), BROADCAST_ROWS)
    rows = written(rows.join(sizes, ["key", "class"]).select("key", "class", "own", "doc", "label", "large"), "near-sweep")
    small = rows.where("not large").drop("large").join(sketched, "doc")
    near = (F.col("a_key") == F.col("b_key")) & (F.col("a_class") == F.col("b_class")) & (F.col("a_label") != F.col("b_label")) & (F.col("a_doc") > F.col("b_doc"))
    # Each pair once: in the larger one's class.
    near = near & (F.greatest("a_own", "b_own") == F.col("a_class"))
    met = _side(small, "a").join(_side(small, "b"), near & _sizes_allow() & _sketches_allow()).select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))
    large = rows.where("large").select("doc", "label").distinct()
    if large.isEmpty():
        return met.distinct()
    rare = written(_by_rare_shingles(large, docs), "near-rare")
    return met.union(_pairs_with_bits(rare, sketched).select("a", "b")).distinct()


def _shingle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for doc, part, text in zip(pdf["doc"], pdf["part"], pdf["text"], strict=True):
            s = shingle_set(text).view(np.int64)
            yield pd.DataFrame({"doc": doc, "part": part, "n": len(s), "shingle": s})


def _by_rare_shingles(members: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of members (doc, label) with different labels that share a rare shingle where copies must.

    A prefix-filtered join, which loses no pair: with the shingles of each text in one order, rare ones (among the
    members) first, two sets that reach the similarity meet in the first n - ceil(3/4 n) + 1 of the larger and
    the first n - ceil(6/7 n) + 1 of the smaller one (for PERCENT 75). What all members share stands last and is
    not among these, unless next to nothing else is in the texts, and then they are copies. Members of one label meet in blocks of
    BLOCK, so that a group of linked copies is not paired with itself.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("part"), F.col("text").cast("string").alias("text"))
    texts = texts.join(broadcast_if_small(members.select("doc"), BROADCAST_ROWS), "doc", "left_semi").dropDuplicates(["doc", "part"])
    shingles = written(texts.mapInPandas(_shingle_rows, "doc long, part long, n int, shingle long"), "near-shingles")
    known = shingles.groupBy("shingle").agg(F.count("*").alias("texts"))
    order = Window.partitionBy("doc", "part").orderBy("texts", "shingle")
    ranked = shingles.join(known, "shingle").withColumn("rank", F.row_number().over(order))
    least = lambda x, y: F.col("n") - F.ceil(F.col("n") * x / F.lit(float(y))) + 1
    ranked = ranked.where("texts > 1").where(F.col("rank") <= least(PERCENT, 100)).withColumn("first", F.col("rank") <= least(2 * PERCENT, 100 + PERCENT))
    sizes = members.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    held = members.join(sizes, "label").select("doc", "label", F.pmod(F.xxhash64("doc"), F.col("blocks")).alias("block"))
    postings = ranked.join(held, "doc").groupBy("shingle", "label", "block").agg(F.collect_list(F.struct("n", "doc", "rank", "first")).alias("m"))
    postings = written(postings, "near-postings")
    smaller = postings.where(F.exists("m", lambda x: x["first"])).select("shingle", F.col("label").alias("la"), F.filter("m", lambda x: x["first"]).alias("x"))
    met = smaller.join(postings.select("shingle", F.col("label").alias("lb"), F.col("m").alias("y")), "shingle").where("la <> lb")
    met = met.select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y")).where("x.n < y.n or x.n = y.n and x.doc < y.doc")
    both = F.ceil((F.col("x.n") + F.col("y.n")) * PERCENT / F.lit(float(100 + PERCENT)))
    met = met.where(F.col("x.n") * 100 >= F.col("y.n") * PERCENT).where(F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank")) + 1 >= both)
    return met.select(F.greatest("x.doc", "y.doc").alias("a"), F.least("x.doc", "y.doc").alias("b")).distinct()


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links.select("a", "b"))
    return written(nodes.select("doc").distinct().join(found, "doc", "left").select("doc", F.coalesce("label", "doc").alias("label")), "near-labels")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that are near copies of a document with a smaller doc_id; of rows with equal doc_id all stay."""
    gone = written(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "near-gone")
    gone = broadcast_if_small(gone, BROADCAST_ROWS)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
