"""Connected components by alternating star contraction, all rounds as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.stored import written

#: Up to so many edges (16 bytes each) a round is one task without a shuffle.
ONE_TASK_EDGES = 200_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of it and its neighbours."""
    ways = _both_ways(edges)
    least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return ways.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
    return moved.select("e.*").where("a <> b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(doc, label) of every node that has an edge (a, b): label is the smallest node reachable.

    Only a count and a sum of 64-bit hashes of each round reach the driver. Each round
    shortens chains by a constant factor or more; beyond max_rounds the job ends with an
    error, never with a partial result (raise max_rounds then). A round of few edges, as counted, is one
    task: its joins then need no exchange, which spares the driver many small plans.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums[0] == 0 or tuple(sums) == seen:
            break
        seen = tuple(sums)
        # A coalesced table of one partition needs no exchange; it is said again where a join hides it.
        held = (lambda df: df.coalesce(1)) if sums[0] <= ONE_TASK_EDGES else (lambda df: df)
        edges = written(held(_small_star(held(_large_star(held(edges))))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(F.col("a").alias("doc"), F.col("b").alias("label"))
    return found.union(edges.select(F.col("b").alias("doc"), F.col("b").alias("label")).distinct())
