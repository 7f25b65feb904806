"""Stores of snapshots, comparisons and spending: Parquet tables that grow by appends.

Snapshots carry ids that rise with each append. Appends to one store come from one job at a
time; readers may run meanwhile, as Parquet commits whole files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry.operators.drift import SNAPSHOT

COMPARISON = "url_hash string, baseline_id bigint, compared_at timestamp, results string, critical bigint, warning bigint, info bigint"
ENTRY = "timestamp timestamp, endpoint string, cost double, detail string"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots of a store; none if nothing was appended yet."""
    return _stored(spark, path, SNAPSHOT)


def append_snapshots(pages: DataFrame, path: str) -> None:
    """Add pages (a snapshot's columns but id; others are left out) under new ids, larger than all before.

    Only the largest id reaches the driver; ids within an append are distinct, not dense.
    """
    spark = pages.sparkSession
    last = snapshots(spark, path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    wanted = spark.createDataFrame([], SNAPSHOT).schema
    made = pages.withColumn("id", F.monotonically_increasing_id() + last + 1)
    made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]).write.mode("append").parquet(path)


def comparison_rows(findings: DataFrame, at: Column | None = None) -> DataFrame:
    """Findings of a comparison as one row per page: its results as JSON, by rule, and how many were triggered by severity."""
    count = lambda s: F.count_if(F.col("triggered") & (F.col("severity") == s)).alias(s.lower())
    results = F.to_json(F.array_sort(F.collect_list(F.struct("rule", "severity", "triggered", "old_value", "new_value"))))
    rows = findings.groupBy("url_hash", "baseline_id").agg(results.alias("results"), count("CRITICAL"), count("WARNING"), count("INFO"))
    return rows.select("url_hash", "baseline_id", (at if at is not None else F.current_timestamp()).alias("compared_at"), "results", "critical", "warning", "info")


def append_comparisons(findings: DataFrame, path: str, at: Column | None = None) -> None:
    comparison_rows(findings, at).write.mode("append").parquet(path)


def comparisons(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, COMPARISON)


def append_ledger(entries: DataFrame, path: str) -> None:
    """Add spending entries (timestamp, endpoint, cost, detail), in folders by day, so that a day's total reads that day."""
    rows = entries.select("timestamp", "endpoint", F.col("cost").cast("double"), F.col("detail").cast("string"), F.to_date("timestamp").alias("day"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, f"{ENTRY}, day date")


def ledger_stream(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of entries, each exactly once, for several producers: the stream is the one writer."""
    rows = entries.withColumn("day", F.to_date("timestamp"))
    return rows.writeStream.partitionBy("day").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
