"""A snapshot store as a bucketed table: rows of one page lie in one bucket, sorted, so that readers need no shuffle.

``latest``, ``as_of`` and joins of two stores with equal buckets are planned without an exchange. Appends add files
to the buckets; ``compact`` rewrites the store with one file a bucket, in a folder of its own beside the old one,
which readers may go on reading, and points the table's name at it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _write(rows: DataFrame, name: str, path: str, buckets: int, key: str, order: str) -> None:
    # One task a bucket writes one file; a page's rows are in one task however many pages there are.
    dealt = rows.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key, order).format("parquet").option("path", path).mode("append").saveAsTable(name)


def create_store(rows: DataFrame, name: str, folder: str, buckets: int, key: str = "url_hash", order: str = "id") -> None:
    """Make the table ``name`` below ``folder``, of rows with a page's key and a number that rises with time."""
    _write(rows, name, f"{folder.rstrip('/')}/{uuid.uuid4().hex}", buckets, key, order)


def _layout(spark: SparkSession, name: str) -> tuple[str, int, str, str]:
    """(path, buckets, key, order) of a store."""
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    return about["Location"], int(about["Num Buckets"]), about["Bucket Columns"].strip("[]`"), about["Sort Columns"].strip("[]").split(",")[-1].strip(" `")


def append(rows: DataFrame, name: str) -> None:
    """Add rows to a store."""
    path, buckets, key, order = _layout(rows.sparkSession, name)
    _write(rows.select(*rows.sparkSession.table(name).columns), name, path, buckets, key, order)


def _newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each page with the largest number; the key stays a column of its own, so that its buckets go on counting."""
    rest = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s"))
    return newest.select(*[key if c == key else F.col(f"s.{c}").alias(c) for c in rows.columns])


def latest(spark: SparkSession, name: str) -> DataFrame:
    """The newest row of each page."""
    _, _, key, order = _layout(spark, name)
    return _newest(spark.table(name), key, order)


def as_of(spark: SparkSession, name: str, most: int) -> DataFrame:
    """The newest row of each page whose number is at most so large."""
    _, _, key, order = _layout(spark, name)
    return _newest(spark.table(name).where(F.col(order) <= most), key, order)


def changes(spark: SparkSession, old: str, new: str, value: str) -> DataFrame:
    """(key, old_value, new_value) of the pages of two stores whose newest rows differ in a column; also those that only one store has."""
    _, _, key, _ = _layout(spark, old)
    a, b = latest(spark, old).select(key, F.col(value).alias("old_value")), latest(spark, new).select(key, F.col(value).alias("new_value"))
    return a.join(b, key, "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def compact(spark: SparkSession, name: str, keep: int | None = None) -> None:
    """Rewrite a store with one file a bucket and, where ``keep`` is given, only the newest ``keep`` rows of each page.

    Done by the store's one writer. The old files stay for those that read them; the folder's retention removes them.
    """
    path, buckets, key, order = _layout(spark, name)
    rows = spark.table(name)
    if keep:
        rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__k") <= keep).drop("__k")
    fresh = f"{name}_{uuid.uuid4().hex}"
    _write(rows, fresh, f"{path.rpartition('/')[0]}/{uuid.uuid4().hex}", buckets, key, order)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
