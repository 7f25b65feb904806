"""A web graph's rank files as a sorted index, and lookups of domains that read little of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.stored import written

#: Names that are pushed to the files as a list (their blocks are then skipped by range, dictionary and Bloom filter), and bytes of names that are broadcast.
MOST_PUSHED, BROADCAST_BYTES = 10, 32 << 20


def reversed_host(domain: Column) -> Column:
    """com.example of example.com, Example.com, www.example.com or an address on it."""
    host = F.regexp_replace(F.lower(F.trim(domain)), r"^[a-z][a-z0-9+.-]*://|[/?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@|:\d*$", ""), r"^www\.", "")
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def write_index(graph: DataFrame, path: str, files: int, rows_a_file: int = 10_000_000, **options: str) -> None:
    """Write rows with host_rev sorted by it, in files of a range each, with a Bloom filter of the names in each block.

    options: further options of the Parquet writer, such as parquet.block.size.
    """
    sorted_ = graph.repartitionByRange(files, "host_rev").sortWithinPartitions("host_rev")
    bloom = {"parquet.bloom.filter.enabled#host_rev": "true", "parquet.bloom.filter.expected.ndv#host_rev": str(rows_a_file)}
    sorted_.write.options(**bloom, **options).parquet(path)


def asked_rows(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The index rows of the names asked (host_rev, a written table).

    Few names go to the scan as a list of values, more as the range between the first and last of them beside a join; names are
    broadcast up to a checked number of bytes.
    """
    names = asked.select("host_rev").where("host_rev is not null").distinct()
    index = spark.read.parquet(path)
    few = [r[0] for r in names.limit(MOST_PUSHED + 1).collect()]
    if len(few) <= MOST_PUSHED:
        return index.where(F.col("host_rev").isin(few))
    lo, hi, size = names.agg(F.min("host_rev"), F.max("host_rev"), F.sum(F.octet_length("host_rev") + 32)).first()
    small = F.broadcast(names) if size <= BROADCAST_BYTES else names
    return index.where(F.col("host_rev").between(lo, hi)).join(small, "host_rev", "left_semi")


def domain_metrics(spark: SparkSession, ranks: str, vertices: str | None, domains: DataFrame) -> DataFrame:
    """domains (domain) with in_crawl, in_rankings, pagerank, pagerank_rank, harmonic_centrality, harmonic_centrality_rank, n_hosts and found.

    ranks and vertices are indexes of ``write_index``. A domain is looked up in the vertices only where it is not ranked: it may be crawled, but
    too small for a rank. found: ranked, crawled or absent. Of several rows of a name the best ranked counts.
    """
    wanted = written(domains.select("domain", reversed_host(F.col("domain")).alias("host_rev")), "graph-asked")
    found = asked_rows(spark, ranks, wanted).groupBy("host_rev").agg(F.min_by(F.struct("harmonic_pos", "harmonic_val", "pagerank_pos", "pagerank_val", "n_hosts"), F.struct("harmonic_pos", "pagerank_pos", "n_hosts")).alias("r"))
    ranked = written(wanted.join(found, "host_rev", "left").withColumn("in_rankings", F.coalesce(F.col("r.pagerank_val") != 0, F.lit(False))), "graph-ranked")
    crawled = ranked.select("domain", "host_rev", F.lit(False).alias("seen")).limit(0)
    if vertices is not None:
        rest = written(ranked.where("not in_rankings").select("host_rev"), "graph-rest")
        crawled = asked_rows(spark, vertices, rest).select("host_rev").distinct().withColumn("seen", F.lit(True))
    out = ranked.join(crawled.select("host_rev", "seen").distinct(), "host_rev", "left")
    in_crawl = F.col("in_rankings") | F.coalesce("seen", F.lit(False))
    state = F.when(F.col("in_rankings"), "ranked").when(in_crawl, "crawled").otherwise("absent")
    r = lambda k: F.when(F.col("in_rankings"), F.col(f"r.{k}"))
    return out.select(
        "domain", in_crawl.alias("in_crawl"), "in_rankings", r("pagerank_val").alias("pagerank"), r("pagerank_pos").alias("pagerank_rank"),
        r("harmonic_val").alias("harmonic_centrality"), r("harmonic_pos").alias("harmonic_centrality_rank"), r("n_hosts").alias("n_hosts"), state.alias("found"),
    )
