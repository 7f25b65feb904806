"""Keyword clustering by shared results, and geographic grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from pagequarry.functions.stored import written

from . import packed_pairs
from .components import components

# Shared results from which two keywords belong to one post, one cluster, or link to each other.
SAME_POST, SAME_CLUSTER, INTERLINK = 7, 4, 2
KM_PER_DEGREE = 111.32
EARTH_KM = 6371.0088
#: Keywords of one url that are paired in one group of the join, on average.
PAIR_BLOCK = 200
#: Pairs that one task counts, on average: their counts stay within a few hundred megabytes.
TASK_PAIRS = 4_000_000
#: Results that one task sorts by url, on average, and groups of keywords whose pairs are summed to find how uneven they are.
TASK_RESULTS, LOAD_GROUPS = 2_000_000, 8_192
#: Names of one point that stand in one row, on average.
POINT_BLOCK = 1_000


def _pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(k1, k2, keys) of the keywords k1 < k2 with equal keys; rows (keyword, keys) are distinct."""
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / PAIR_BLOCK).alias("blocks"))
    dealt = rows.join(blocks, keys).withColumn("own", F.pmod(F.xxhash64("keyword"), F.col("blocks")))
    a = dealt.select(*keys, F.col("keyword").alias("x"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    b = dealt.select(*keys, F.col("keyword").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("i"), F.col("own").alias("j"))
    met = a.join(b, [*keys, "i", "j"]).where("i < j OR x < y")
    return met.select(F.least("x", "y").alias("k1"), F.greatest("x", "y").alias("k2"), *keys)


def _lists(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, ks): the different keywords with equal keys, greatest first, in lists of PAIR_BLOCK; only the last list may be shorter."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / TASK_RESULTS))
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("keyword"))) - 1
    known = rows.where(" and ".join(f"`{k}` is not null" for k in ("keyword", *keys)))
    dealt = known.repartition(tasks, *keys).withColumn("block", F.floor(place / PAIR_BLOCK))
    return dealt.groupBy(*keys, "block").agg(F.sort_array(F.collect_set("keyword"), asc=False).alias("ks"))


def _counted(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(k1, k2, shared) of the keywords k1 < k2, whole numbers: with how many equal keys they meet, if at least so many.

    The keywords of each url are listed once and stored; lists become pairs only inside a task, which
    packs them for the tasks that count them (three bytes a pair or less). A keyword with more pairs than a task should count is spread over several.
    """
    lists = written(_lists(rows, keys), "result-lists")
    # In its url's falling order a keyword stands behind as many others as it has pairs there as the lesser one.
    placed = lists.select("block", F.posexplode("ks").alias("place", "keyword"))
    loads = placed.groupBy(F.pmod(F.xxhash64("keyword"), F.lit(LOAD_GROUPS)).alias("g")).agg(F.sum(F.col("block") * PAIR_BLOCK + F.col("place")).alias("n"), F.max("block").alias("last"))
    made, most, last = loads.agg(F.sum("n"), F.max("n"), F.max("last")).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((made or 0) / TASK_PAIRS))
    split, at_once = max(1, math.ceil((most or 0) / TASK_PAIRS)), TASK_PAIRS
    met = lists.select(F.col("ks").alias("xs"), F.lit(None).cast("array<bigint>").alias("ys"))
    if last:
        further = lists.where("block > 0").select(*keys, F.col("ks").alias("xs"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("block"))
        full = lists.where(F.size("ks") == PAIR_BLOCK).select(*keys, F.col("ks").alias("ys"), "block")
        met = met.union(further.join(full, [*keys, "block"]).select("xs", "ys"))
    packed = met.mapInArrow(lambda batches: packed_pairs.pack(batches, tasks, split), packed_pairs.PACKED)
    return packed.repartitionById(tasks, "task").mapInArrow(lambda batches: packed_pairs.count(batches, at_once, least), packed_pairs.COUNTED)


#: Most values that a summary of frequent items lists, and its error as a share of rows * 1 / slots.
MOST_LISTED, SKETCH_ERROR = 10_000, 7


def heavy_hitters(rows: DataFrame, key: str, more_than: int, slots: int = 100_000) -> DataFrame:
    """(key, n) of the values that occur more than so many times, exactly.

    Each task keeps a summary of at most ``slots`` values (a mergeable sketch of frequent items); a value beyond twice the
    sketch's error is in it, so only its candidates are counted exactly. Where the rows are too many for the
    sketch to be sure of, or its list is full, all values are counted instead: the result is the same.
    """
    rows = rows.where(F.col(key).isNotNull())
    if rows.count() * SKETCH_ERROR <= slots * more_than:
        top = rows.agg(F.expr(f"approx_top_k(`{key}`, {MOST_LISTED}, {slots})").alias("top")).select(F.explode("top").alias("t"))
        few = written(top.select(F.col("t.item").alias(key)), "heavy-candidates")
        if few.count() < MOST_LISTED:
            rows = rows.join(F.broadcast(few), key, "left_semi")
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def result_overlap(results: DataFrame, group: str | None = None, ubiquitous: int | None = None, least: int = 1, domain: Column | None = None) -> DataFrame:
    """(k1, k2, shared, band) of keyword pairs with at least so many results in common; results: keyword, url, and maybe a group (an intent) that limits the pairs.

    Results whose url (or ``domain``, an expression over url) is on more than ``ubiquitous`` keywords are left out of the pairing: they
    say nothing of any two of them. The keywords of a url are dealt to blocks, and
    each pair of blocks is a group of the join, so a frequent url spreads over tasks. Pairs of whole
    numbers without a group travel packed, in lists; others as rows, each with its url.
    """
    keys = ["url", *([group] if group else [])]
    kind = results.schema["keyword"].dataType
    packs = not group and isinstance(kind, IntegralType)
    rows = results.select("keyword", *keys)
    if ubiquitous or not packs:
        rows = rows.distinct()
    if ubiquitous:
        named = rows.withColumn("__of", domain if domain is not None else F.col("url"))
        heavy = written(heavy_hitters(named.select("keyword", "__of").distinct(), "__of", ubiquitous).select("__of"), "heavy")
        rows = named.join(heavy, "__of", "left_anti").drop("__of")
    if packs:
        pairs = _counted(rows.withColumn("keyword", F.col("keyword").cast("long")), keys, least)
        return pairs.select(F.col("k1").cast(kind), F.col("k2").cast(kind), "shared", band(F.col("shared")).alias("band"))
    # Pairs mostly meet once, so sums before the shuffle would hold nearly all of a task's pairs and save little;
    # the number of tasks goes by the pairs instead, whose number follows from the keywords of each url.
    n = F.col("n").cast("double")
    made = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    tasks = max(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(made / TASK_PAIRS))
    pairs = _pairs(rows, keys).repartition(tasks, "k1", "k2")
    # Without a group no pair meets twice at a url, so plain counts are distinct.
    pairs = pairs.groupBy("k1", "k2").agg((F.count_distinct("url") if group else F.count("*")).alias("shared")).where(F.col("shared") >= least)
    return pairs.withColumn("band", band(F.col("shared")))


def band(shared: Column) -> Column:
    return F.when(shared >= SAME_POST, "same-post").when(shared >= SAME_CLUSTER, "same-cluster").when(shared >= INTERLINK, "interlink").otherwise("separate")


def keyword_clusters(keywords: DataFrame, overlap: DataFrame) -> DataFrame:
    """(keyword, cluster): keywords joined by overlaps of SAME_CLUSTER or more; a cluster's name is its least keyword.

    Raises where the components do not settle.
    """
    found = components(overlap.where(F.col("shared") >= SAME_CLUSTER).select(F.col("k1").alias("a"), F.col("k2").alias("b")))
    found = found.select(F.col("doc").alias("keyword"), "label")
    return keywords.select("keyword").distinct().join(found, "keyword", "left").select("keyword", F.coalesce("label", "keyword").alias("cluster"))


def cluster_scorecard(posts: DataFrame, links: DataFrame) -> DataFrame:
    """Per cluster: posts, links into and out of the pillar, cross links, orphans, duplicated keywords, mean words.

    posts: url, cluster, is_pillar, primary_keyword, words; links: src, dst.
    """
    p = posts.select("url", "cluster", "is_pillar")
    edges = links.join(p.toDF("src", "c1", "p1"), "src").join(p.toDF("dst", "c2", "p2"), "dst")
    inside = edges.where("c1 = c2").groupBy(F.col("c1").alias("cluster")).agg(
        F.count_distinct(F.when(F.col("p1") & ~F.col("p2"), F.col("dst"))).alias("pillar_to_posts"), F.count_distinct(F.when(F.col("p2") & ~F.col("p1"), F.col("src"))).alias("posts_to_pillar"), F.count("*").alias("inner_links")
    )
    cross = edges.where("c1 <> c2").groupBy(F.col("c1").alias("cluster")).agg(F.count("*").alias("cross_links"))
    alone = p.join(links.where("src <> dst").select(F.col("dst").alias("url")).distinct(), "url", "left_anti").groupBy("cluster").agg(F.count("*").alias("orphans"))
    repeats = posts.groupBy("cluster", F.lower(F.trim("primary_keyword")).alias("k")).agg(F.count("*").alias("n")).where("n > 1").groupBy("cluster").agg(F.count("*").alias("cannibalized"))
    out = posts.groupBy("cluster").agg(F.count_if(~F.col("is_pillar")).alias("posts"), F.round(F.avg("words"), 1).alias("avg_words"))
    for part in (inside, cross, alone, repeats):
        out = out.join(part, "cluster", "left")
    return out.fillna(0)


def plan_scorecard(posts: DataFrame, links: DataFrame, recommended: DataFrame) -> DataFrame:
    """Per cluster of planned posts: how far the plan is written and how it is linked.

    posts: url, cluster, is_pillar, written, primary_keyword, words, images; links, recommended (links between clusters): src, dst. Links count once, between
    different written posts. coverage_pct, gaps: planned and written posts. link_density: links into the cluster's posts, a post. orphans: posts
    without a link to them. to_pillar_pct, from_pillar_pct: other posts that link to a pillar of the cluster, and that one links to. cross_pct: of the recommended links from the cluster those
    that exist. cannibalized: posts that share a primary keyword with another post of the table. image_pct, avg_words: of written posts.
    """
    done = posts.where("written")
    p = done.select("url", "cluster", "is_pillar")
    between = links.select("src", "dst").where("src <> dst").distinct().join(p.toDF("src", "c1", "p1"), "src").join(p.toDF("dst", "c2", "p2"), "dst")
    into = between.groupBy(F.col("c2").alias("cluster")).agg(F.count("*").alias("links"))
    linked = between.select(F.col("dst").alias("url")).distinct().withColumn("linked", F.lit(True))
    alone = p.join(linked, "url", "left").groupBy("cluster").agg(F.count_if(F.col("linked").isNull()).alias("orphans"))
    same = between.where("c1 = c2").groupBy(F.col("c1").alias("cluster")).agg(F.count_distinct(F.when(~F.col("p1") & F.col("p2"), F.col("src"))).alias("up"), F.count_distinct(F.when(F.col("p1") & ~F.col("p2"), F.col("dst"))).alias("down"))
    asked = recommended.select("src", "dst").where("src <> dst").distinct().join(posts.select(F.col("url").alias("src"), F.col("cluster")), "src")
    made = asked.join(between.select("src", "dst").withColumn("made", F.lit(True)), ["src", "dst"], "left").groupBy("cluster").agg(F.count("*").alias("asked"), F.count("made").alias("made"))
    word = F.lower(F.trim("primary_keyword"))
    shared = done.where(word != "").groupBy(word.alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    doubled = done.withColumn("k", word).join(shared.select("k"), "k", "left_semi").groupBy("cluster").agg(F.count("*").alias("cannibalized"))
    out = posts.groupBy("cluster").agg(
        F.count("*").alias("planned"), F.count_if("written").alias("posts"), F.count_if(F.col("written") & ~F.col("is_pillar")).alias("spokes"),
        F.count_if(F.col("written") & (F.col("images") > 0)).alias("with_images"), F.round(F.avg(F.when(F.col("written"), F.col("words"))), 1).alias("avg_words"),
    )
    for part in (into, alone, same, made, doubled):
        out = out.join(part, "cluster", "left")
    out = out.fillna(0, ["links", "orphans", "up", "down", "asked", "made", "cannibalized"])
    pct = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) * 100.0 / F.col(b), 1))
    return out.select(
        "cluster", pct("posts", "planned").alias("coverage_pct"), (F.col("planned") - F.col("posts")).alias("gaps"), F.when(F.col("posts") > 0, F.round(F.col("links") / F.col("posts"), 2)).alias("link_density"), "orphans",
        pct("up", "spokes").alias("to_pillar_pct"), pct("down", "spokes").alias("from_pillar_pct"), pct("made", "asked").alias("cross_pct"), "cannibalized", pct("with_images", "posts").alias("image_pct"), "avg_words",
    )


def grid_points(spark, lat: float, lng: float, size: int, step_km: float) -> DataFrame:
    """(i, j, lat, lng) of a size by size grid around a centre."""
    axis = spark.range(size).select(F.col("id").cast("int").alias("i"))
    grid = axis.select("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j"))
    middle = (size - 1) / 2
    return grid.select(
        "i", "j", F.round(lat + (middle - F.col("i")) * step_km / KM_PER_DEGREE, 6).alias("lat"),
        F.round(lng + (F.col("j") - middle) * step_km / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(F.lit(lat)))), 6).alias("lng"),
    )


def grid_metrics(ranks: DataFrame, by: list[str], size: int) -> DataFrame:
    """Per group: share of points in the top three, mean rank, visibility (3, 1, 0 points), and the quadrant with the worst mean.

    ranks: i, j, rank; no rank counts as 21.
    """
    rank = F.coalesce("rank", F.lit(21))
    half = size / 2
    quadrant = F.concat(F.when(F.col("i") < half, "N").otherwise("S"), F.when(F.col("j") < half, "W").otherwise("E"))
    quarters = ranks.groupBy(*by, quadrant.alias("quadrant")).agg(F.avg(rank).alias("mean"))
    worst = quarters.groupBy(*by).agg(F.max_by("quadrant", F.struct("mean", "quadrant")).alias("worst_quadrant"))
    points = F.when(rank <= 3, 3).when(rank <= 10, 1).otherwise(0)
    out = ranks.groupBy(*by).agg(
        F.round(F.avg((rank <= 3).cast("double")) * 100, 2).alias("solv_pct"), F.round(F.avg(rank), 2).alias("avg_rank"), F.round(F.sum(points) * 100.0 / (F.count("*") * 3), 2).alias("visibility_pct")
    )
    return out.join(worst, by)


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _at_points(rows: DataFrame, name: str, lat: str, lng: str) -> DataFrame:
    """(lat, lng, block, names) of rows (name, lat, lng): the names at each point, dealt to blocks of POINT_BLOCK on average."""
    rows = rows.select(F.col(name).alias("name"), F.col("lat").alias(lat), F.col("lng").alias(lng))
    blocks = rows.groupBy(lat, lng).agg(F.ceil(F.count("*") / POINT_BLOCK).alias("blocks"))
    dealt = rows.join(blocks, [lat, lng]).withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")))
    return dealt.groupBy(lat, lng, "block").agg(F.collect_list("name").alias(f"{name}s")).drop("block")


def within_radius(centres: DataFrame, places: DataFrame, radius_km: float) -> DataFrame:
    """(centre, place, km, rank): places within a radius of each centre, nearest first; centres: centre, lat, lng; places: place, lat, lng.

    Points are taken as points of the unit sphere in space, and space is cut into cubes as wide as
    the radius's chord: two points within the radius are in one cube or in neighbouring ones, at the date line
    and the poles as anywhere else. Places go to their cube, centres to theirs and the 26 around it, so the join is on cubes.
    Each two different points are measured once, however many centres and places stand there; blocks of
    their names then meet, spread over tasks, and become rows only at the end.
    """
    chord = max(2 * math.sin(min(radius_km / EARTH_KM, math.pi) / 2), 1e-9) * (1 + 1e-9)
    lat, lng = F.radians("lat"), F.radians("lng")
    cube = [F.floor(c / chord).cast("long") for c in (F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat))]
    points = lambda rows: rows.select("lat", "lng").where("lat is not null and lng is not null").distinct().select("lat", "lng", *[c.alias(n) for c, n in zip(cube, "xyz", strict=True)])
    here = points(places).withColumnsRenamed({"lat": "plat", "lng": "plng"})
    around = points(centres)
    for n in "xyz":
        around = around.withColumn(n, F.explode(F.sequence(F.col(n) - 1, F.col(n) + 1)))
    km = distance_km(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng"))
    near = around.join(here, ["x", "y", "z"]).select("lat", "lng", "plat", "plng", F.round(km, 6).alias("km")).where(F.col("km") <= radius_km)
    met = near.join(_at_points(centres, "centre", "lat", "lng"), ["lat", "lng"]).join(_at_points(places, "place", "plat", "plng"), ["plat", "plng"]).select("centres", "places", "km")
    # A row of blocks becomes up to a million rows: dealt out again by a fixed number of tasks, as few bytes as they are.
    dealt = met.repartition(int(centres.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = dealt.select(F.explode("centres").alias("centre"), "places", "km").select("centre", F.explode("places").alias("place"), "km")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("centre").orderBy("km", "place")))
