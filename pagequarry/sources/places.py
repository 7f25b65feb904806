"""Saved place responses: map elements (points, and ways of ordered point references) as places, and searches among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.clusters import within_radius

RESPONSE = "elements array<struct<type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>>>"
# The tags that name a place's category, and those a place is described by.
CATEGORIES = ("amenity", "shop", "office", "craft", "tourism")
DETAILS = {"name": "name", "phone": "phone", "website": "website", "opening_hours": "opening_hours", "street": "addr:street", "housenumber": "addr:housenumber", "city": "addr:city", "postcode": "addr:postcode", "cuisine": "cuisine", "brand": "brand"}


def elements(responses: DataFrame, body: str = "body") -> DataFrame:
    """(type, id, lat, lon, nodes, tags) of saved responses, each element once; a later copy may carry the tags that an earlier one lacks."""
    rows = responses.select(F.explode(F.from_json(body, RESPONSE)["elements"]).alias("e")).select("e.*").where("type is not null and id is not null")
    fuller = F.struct(F.coalesce(F.size("tags"), F.lit(-1)).alias("n"), F.coalesce(F.size("nodes"), F.lit(-1)).alias("m"), F.to_json(F.struct("lat", "lon", "nodes", F.array_sort(F.map_entries("tags")).alias("t"))).alias("s"))
    return rows.groupBy("type", "id").agg(F.max_by(F.struct("lat", "lon", "nodes", "tags"), fuller).alias("e")).select("type", "id", "e.*")


def way_centres(found: DataFrame) -> DataFrame:
    """(id, lat, lon, points, missing) of the ways: the centre of the area of a closed way, the mean of the points of any other.

    A way's points are its references in order; each is looked up by id, so a point of many ways is found for each. Ways none of
    whose points are in the responses are left out; ``missing`` counts references without a point. Degrees are taken
    as a plane around the first point, which is exact enough for buildings, and points across the date line go around the short way.
    """
    points = found.where("type = 'node' and lat is not null and lon is not null").select(F.col("id").alias("ref"), "lat", "lon")
    refs = found.where("type = 'way'").select("id", F.posexplode("nodes").alias("at", "ref"))
    at = refs.join(points, "ref", "left")
    line = F.array_sort(F.collect_list(F.when(F.col("lat").isNotNull(), F.struct("at", "ref", "lat", "lon"))))
    ways = at.groupBy("id").agg(line.alias("p"), F.count_if(F.col("lat").isNull()).alias("missing")).where(F.size("p") > 0)
    first = F.get("p", F.lit(0))
    turn = lambda d: d - 360 * F.floor((d + 180) / 360)
    p = F.transform("p", lambda x: F.struct((x["lat"] - first["lat"]).alias("y"), turn(x["lon"] - first["lon"]).alias("x")))
    closed = (F.col("missing") == 0) & (F.size("p") > 3) & (first["ref"] == F.element_at("p", -1)["ref"])
    ways = ways.select("id", "missing", first.alias("first"), p.alias("p"), closed.alias("closed"))
    # Of a closed way the last point is the first again.
    ways = ways.withColumn("p", F.when(F.col("closed"), F.slice("p", F.lit(1), F.size("p") - 1)).otherwise(F.col("p")))
    pairs = F.zip_with("p", F.concat(F.slice("p", F.lit(2), F.size("p")), F.slice("p", F.lit(1), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, q: s + f(q))
    cross = lambda q: q["a"]["x"] * q["b"]["y"] - q["b"]["x"] * q["a"]["y"]
    ways = ways.withColumn("area", F.when(F.col("closed"), total(pairs, cross)))
    centre = lambda c: F.when(F.abs("area") > 1e-14, total(pairs, lambda q: (q["a"][c] + q["b"][c]) * cross(q)) / (3 * F.col("area"))).otherwise(total(F.col("p"), lambda q: q[c]) / F.size("p"))
    east = F.col("first.lon") + centre("x")
    return ways.select("id", (F.col("first.lat") + centre("y")).alias("lat"), turn(east).alias("lon"), F.size("p").alias("points"), "missing")


def places(found: DataFrame) -> DataFrame:
    """(place, type, id, lat, lng, category, ...) of the elements with a name or a category: points by their own place, ways by their centre."""
    tagged = found.where(F.coalesce(*[F.try_element_at("tags", F.lit(k)) for k in (*CATEGORIES, "name")]).isNotNull())
    nodes = tagged.where("type = 'node' and lat is not null and lon is not null").select("type", "id", "lat", "lon", "tags")
    ways = tagged.where("type = 'way'").select("type", "id", "tags").join(way_centres(found), "id").select("type", "id", "lat", "lon", "tags")
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    category = F.coalesce(*[F.concat(F.lit(f"{k}="), tag(k)) for k in CATEGORIES])
    return nodes.union(ways).select(F.concat_ws("/", "type", "id").alias("place"), "type", "id", "lat", F.col("lon").alias("lng"), category.alias("category"), *[tag(k).alias(c) for c, k in DETAILS.items()])


def in_box(found: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """The places of a box; a box with west above east goes across the date line."""
    lng = F.col("lng")
    inside = lng.between(west, east) if west <= east else (lng >= west) | (lng <= east)
    return found.where(F.col("lat").between(south, north) & inside)


def near(found: DataFrame, centres: DataFrame, radius_km: float, categories: list[str] | None = None) -> DataFrame:
    """(centre, place, km, rank) of the places within a radius of centres (centre, lat, lng), maybe of some categories only."""
    kept = found.where(F.col("category").isin(categories)) if categories else found
    return within_radius(centres, kept.select("place", "lat", "lng"), radius_km)
