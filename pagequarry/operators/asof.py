"""As-of joins: each row of one table with the latest row of another that is not later.

Both sides are united and cut into stretches of time; within a stretch the last right row is
carried down in order, and what a stretch ends with is carried to the stretches after it. So a
key with many rows is as many tasks as it has stretches, and only one row per key and
stretch meets in the second step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], tie: str, stretch: str = "1 day", tolerance: str | None = None) -> DataFrame:
    """left with the ``values`` of the latest right row of the same key that is not later; null where there is none.

    Of right rows with equal times the one with the largest ``tie`` counts; right times may
    equal the left one. A match older than ``tolerance`` (an interval such as "7 days") is
    none. Rows with a null key or time stay, without a match. ``values`` may carry
    names of left columns: they then come as ``right_<name>``.
    """
    size = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {stretch}"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    mine = left.select(F.struct(*left.columns).alias("l"), F.col(key).alias("k"), micros(left_time).alias("t"), F.lit(1).alias("side"), F.lit(None).alias("tie"), F.lit(None).alias("r"))
    theirs = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    found = F.struct(micros(right_time).alias("t"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    theirs = theirs.select(F.lit(None).alias("l"), F.col(key).alias("k"), micros(right_time).alias("t"), F.lit(0).alias("side"), F.col(tie).alias("tie"), found.alias("r"))
    both = mine.where("k is not null and t is not null").unionByName(theirs).withColumn("slot", F.floor(F.col("t") / size))
    inside = Window.partitionBy("k", "slot").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("got", F.last("r", ignorenulls=True).over(inside))
    ends = both.groupBy("k", "slot").agg(F.max_by("r", F.when(F.col("side") == 0, F.struct("t", "tie"))).alias("end"))
    before = Window.partitionBy("k").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("k", "slot", F.last("end", ignorenulls=True).over(before).alias("carried"))
    out = both.where("side = 1").join(carried, ["k", "slot"]).select("l", "t", F.coalesce("got", "carried").alias("r"))
    if tolerance:
        limit = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {tolerance}"))
        out = out.withColumn("r", F.when(F.col("t") - F.col("r.t") <= limit, F.col("r")))
    alone = mine.where("k is null or t is null").select("l", "t", F.lit(None).cast(out.schema["r"].dataType).alias("r"))
    name = lambda v: f"right_{v}" if v in left.columns else v
    return out.union(alone).select("l.*", *[F.col(f"r.v{i}").alias(name(v)) for i, v in enumerate(values)])


def last_before(rows: DataFrame, key: str, cutoff: Column, time: str, order: str) -> DataFrame:
    """The latest row of each key up to one time for all; ``order`` decides between equal times."""
    kept = rows.where(F.col(time) <= cutoff)
    return kept.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(time, order)).alias("s")).select("s.*")
