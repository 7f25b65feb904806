"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, line_dedup, mixing, near_dup, quality_rules
from pagequarry.llm._shared import table, written
from pagequarry.llm.queries import TOKENIZER


#: Columns that the stages read; all others only pass through.
READ = ("doc_id", "text", "lang", "source")


def _applied(stage: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """stage(docs) with the columns of docs: those that no stage reads go under names of their own meanwhile, as an operator may make columns of their names."""
    names = {c: c if c in READ else f"__in_{k}" for k, c in enumerate(docs.columns)}
    out = stage(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _applied(lambda df: quality_rules.apply_rules(df).where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats; one that has no line left goes."""
    out = _applied(lambda df: line_dedup.dedup_lines(df).where("not emptied"), docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return _applied(near_dup.drop_near_duplicates, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The production mixture; a document comes once for each epoch that takes it."""
    return _applied(mixing.mix, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, TOKENIZER)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near), ("mixture", mixture), ("tokens", tokens)]

#: MinHash components and tokenization are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
