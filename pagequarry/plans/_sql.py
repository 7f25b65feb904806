"""What the plan modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(values) -> str:
    """SQL list of string literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: DuckDB expressions for the parts of a URL.
AUTHORITY = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2)"
PATH = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3)"
HOST = rf"lower(regexp_replace(regexp_replace({AUTHORITY}, '^[^@]*@', ''), ':\d*$', ''))"
SECTION = rf"CASE WHEN regexp_extract({PATH}, '^/*([^/]+)', 1) = '' THEN '/' ELSE '/' || regexp_extract({PATH}, '^/*([^/]+)', 1) || '/' END"
