"""Exact quantiles of groups of any size, by mergeable sketches and counting passes.

A quantile sketch of each group bounds where a place of the ascending order lies; the next pass
counts what is below the bounds and what is between them. When few enough rows are
between, their values are counted one by one. A group is never gathered: tasks
send sketches, counts, and at last the counts of the values inside the bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions.stored import written

#: Rows of a group, or between two bounds, up to which values are counted one by one.
MOST_BETWEEN = 500_000
#: Rank error of a sketch that the bounds allow for, as a share of the rows; counting shows whether it was enough.
RANK_ERROR = 0.03
#: Quantiles that a sketch is asked for, evenly from the least to the greatest.
STEPS = 100
#: Bytes of a row of bounds, and of bounds that are broadcast.
BOUND_BYTES, BROADCAST_BYTES = 200, 16 << 20


def _within(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """rows (g, v) beside the bounds of their group that they are within; bounds are broadcast while they are few."""
    small = bounds.count() * BOUND_BYTES <= BROADCAST_BYTES
    return rows.join(F.broadcast(bounds) if small else bounds, "g").where("v between lo and hi")


def order_statistics(rows: DataFrame, places: DataFrame, most: int = MOST_BETWEEN) -> DataFrame:
    """(g, place, value): the value at each place (from 0) of its group's ascending order.

    rows: g, v (a double, not null); places: g, place, each below its group's count. g may be a struct.
    """
    ends = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    start = places.join(ends, "g").select("g", "place", "lo", "hi", F.lit(0).cast("long").alias("below"), "n", F.lit(RANK_ERROR).alias("error"), F.lit(False).alias("settled"))
    bounds = written(start, "quantile-bounds")
    wide = (F.col("n") > most) & (F.col("lo") < F.col("hi")) & ~F.col("settled")
    while not bounds.where(wide).isEmpty():
        sketches = _within(rows, bounds.where(wide)).groupBy("g", "place").agg(F.kll_sketch_agg_double("v").alias("sketch"))
        at = (F.col("place") - F.col("below") + 0.5) / F.col("n")
        steps = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)]))
        cut = lambda k: F.get("steps", F.greatest(F.lit(0), F.least(F.lit(STEPS), k.cast("int"))))
        tried = bounds.join(sketches.select("g", "place", steps.alias("steps")), ["g", "place"])
        tried = tried.withColumns({"x": F.greatest("lo", cut(F.floor((at - F.col("error")) * STEPS))), "y": F.least("hi", cut(F.ceil((at + F.col("error")) * STEPS)))}).drop("steps")
        tried = written(tried, "quantile-tried")
        counts = _within(rows, tried.select("g", "place", "lo", "hi", "x", "y")).groupBy("g", "place").agg(F.count_if(F.col("v") < F.col("x")).alias("less"), F.count_if(F.col("v").between(F.col("x"), F.col("y"))).alias("inside"))
        rank = F.col("place") - F.col("below")
        held = (F.col("less") <= rank) & (rank < F.col("less") + F.col("inside"))
        # Bounds that held without leaving half of the rows out have one value many times at their ends: the rest is few values.
        moved = tried.join(counts, ["g", "place"]).select(
            "g", "place", F.when(held, F.col("x")).otherwise(F.col("lo")).alias("lo"), F.when(held, F.col("y")).otherwise(F.col("hi")).alias("hi"),
            (F.col("below") + F.when(held, F.col("less")).otherwise(0)).alias("below"), F.when(held, F.col("inside")).otherwise(F.col("n")).alias("n"),
            F.when(held, F.lit(RANK_ERROR)).otherwise(F.col("error") * 2).alias("error"), (held & (F.col("inside") * 2 > F.col("n"))).alias("settled"),
        )
        bounds = written(bounds.where(~wide).union(moved), "quantile-bounds")
    values = _within(rows, bounds.select("g", "place", "lo", "hi", "below")).groupBy("g", "place", "below", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "place").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumn("upto", F.col("below") + upto).where(F.col("upto") > F.col("place")).groupBy("g", "place").agg(F.min("v").alias("value"))


def exact_percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float], most: int = MOST_BETWEEN) -> DataFrame:
    """(by, q): an array of each group's percentiles of a value, with linear interpolation, as ``percentile`` gives them.

    Nulls of the value do not count; groups that have no other are left out. A null in ``by`` is a group's name like others.
    Where no group has more than ``most`` values, ``percentile`` itself is bounded and gives the same result.
    """
    kept = rows.select(F.struct(*by).alias("g") if by else F.lit(0).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    counts = written(kept.groupBy("g").agg(F.count("*").alias("n")), "quantile-counts")
    if counts.where(F.col("n") > most).isEmpty():
        listed = kept.groupBy("g").agg(F.percentile("v", F.lit([float(s) for s in shares])).alias("q"))
        return listed.select(*["g.*"] * bool(by), "q")
    spots = counts.select("g", F.posexplode(F.array(*[(F.col("n") - 1) * F.lit(float(s)) for s in shares])).alias("k", "spot"))
    spots = written(spots.withColumns({"p1": F.floor("spot").cast("long"), "p2": F.ceil("spot").cast("long")}), "quantile-spots")
    places = spots.select("g", F.explode(F.array("p1", "p2")).alias("place")).distinct()
    found = written(order_statistics(kept, places, most), "quantile-found")
    joined = spots.join(found.toDF("g", "p1", "v1"), ["g", "p1"]).join(found.toDF("g", "p2", "v2"), ["g", "p2"])
    q = F.col("v1") + (F.col("v2") - F.col("v1")) * (F.col("spot") - F.col("p1"))
    listed = joined.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", q.alias("q")))), lambda x: x["q"]).alias("q"))
    return listed.select(*["g.*"] * bool(by), "q")
