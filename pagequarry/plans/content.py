"""Queries over pages and documents: sections, text quality, titles, URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.operators import claims, links, sections, text_quality

from ._sql import AUTHORITY, HOST, PATH, SECTION, listed, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


_SIGNALS = f"""
SELECT url, {SECTION} AS section,
  CAST(len(regexp_extract_all(html, '{sections.THIRD_PARTY}')) AS BIGINT) AS third_party_hits,
  CAST(len(regexp_extract_all(html, '{sections.COMMERCE}')) AS BIGINT) AS commerce_hits,
  CAST(len(regexp_extract_all(html, '{sections.AFFILIATE}')) AS BIGINT) AS affiliate_link_hits
FROM pages"""


@query("h11_section_signals", f"SELECT url, third_party_hits, commerce_hits, affiliate_link_hits FROM ({_SIGNALS})")
def h11(spark, sf):
    return sections.page_signals(table(spark, sf, "pages"))


_RISK = f"""
WITH s AS ({_SIGNALS}), r AS (
  SELECT section, count(*) AS page_count, avg(third_party_hits) AS t, avg(commerce_hits) AS c, avg(affiliate_link_hits) AS a,
         array_to_string(list_slice(list_sort(list_distinct(list(url))), 1, 3), ' ') AS sample_urls
  FROM s GROUP BY section
), m AS (SELECT *, avg(round(c, 2)) OVER () AS mean FROM r), d AS (SELECT *, mean > 0 AND round(c, 2) > 2 * mean AS drift FROM m)
SELECT section, page_count, round(t, 2) AS third_party_hits_per_page, round(c, 2) AS commerce_hits_per_page,
       round(a, 2) AS affiliate_link_hits_per_page,
       concat_ws(',', CASE WHEN t >= 1 THEN 'third-party-authorship-density' END, CASE WHEN c >= 2 THEN 'commercial-intent-skew' END,
                 CASE WHEN a >= 3 THEN 'affiliate-density' END, CASE WHEN drift THEN 'commercial-intent-drift' END) AS flags,
       CASE WHEN t >= 1 OR (c >= 2 AND a >= 3) THEN 'high' WHEN c >= 2 OR a >= 3 OR drift THEN 'medium' ELSE 'low' END AS risk,
       sample_urls
FROM d"""


@query("a01_section_risk", _RISK)
def a01(spark, sf):
    report = sections.section_risk(sections.page_signals(table(spark, sf, "pages")))
    return report.withColumns({"flags": F.array_join("flags", ","), "sample_urls": F.array_join("sample_urls", " ")})


@query("a03_risk_histogram", f"SELECT risk, count(*) AS sections, CASE WHEN max(max(CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)) OVER () = 3 THEN 'high' WHEN max(max(CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)) OVER () = 2 THEN 'medium' ELSE 'low' END AS overall_risk FROM ({_RISK}) GROUP BY risk")
def a03(spark, sf):
    return sections.risk_histogram(sections.section_risk(sections.page_signals(table(spark, sf, "pages"))))


@query("p08_url_section", f"SELECT page_id, {SECTION} AS section FROM pages")
def p08(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.section_of(F.col("url")).alias("section"))


@query("p05_backlink_url", r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS normalized FROM pages")
def p05(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalize_backlink_url(F.col("url")).alias("normalized"))


@query("p06_link_domain", rf"SELECT page_id, regexp_replace(regexp_replace({HOST}, '\.$', ''), '^www\.', '') AS domain, replace(lower({AUTHORITY}), 'www.', '') AS report_domain FROM pages")
def p06(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.link_domain(url).alias("domain"), urls.report_domain(url).alias("report_domain"))


_SNAPSHOT_SQL = rf"""
SELECT page_id, normalized, left(sha256(normalized), 16) AS url_hash FROM (
  SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || {HOST}
    || CASE WHEN regexp_replace({PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END
    || CASE WHEN url LIKE '%page=2&ref=x%' THEN '?page=2&ref=x' ELSE '' END AS normalized
  FROM pages)"""


@query("p01_snapshot_url", _SNAPSHOT_SQL)
def p01(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", urls.normalize_snapshot_url("url").alias("normalized"))
    return rows.withColumn("url_hash", urls.url_hash(F.col("normalized")))


@query("p03_content_hash", "SELECT page_id, sha256(html) AS html_hash FROM pages")
def p03(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("html_hash"))


@query("p07_safe_url", rf"SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) || '://' || {HOST} || {PATH} AS shown FROM pages")
def p07(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.safe_output_url("url").alias("shown"))


@query("p24_fetchable_url", "SELECT page_id, regexp_matches(url, '^https?://[a-z]') AS fetchable, regexp_matches(url, '^https?://[^#]*$') AS sitemap_url FROM pages")
def p24(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.is_fetchable_url("url").alias("fetchable"), urls.is_sitemap_url("url").alias("sitemap_url"))


_TITLE = r"trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"


@query(
    "h14_titles",
    f"""WITH t AS (SELECT page_id, {_TITLE} AS title, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS h1_count FROM pages)
SELECT page_id, CAST(length(title) AS BIGINT) AS title_length, length(title) BETWEEN 30 AND 60 AS title_ok, h1_count, h1_count = 1 AS h1_ok,
       count(*) OVER (PARTITION BY lower(title)) AS same_title FROM t""",
)
def h14(spark, sf):
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    rows = table(spark, sf, "pages").select("page_id", title.alias("title"), F.regexp_count("html", F.lit("<h1[ >]")).cast("long").alias("h1_count"))
    counts = rows.groupBy(F.lower("title").alias("low")).agg(F.count("*").alias("same_title"))
    joined = rows.join(counts, F.lower(rows["title"]) == counts["low"])
    n = F.length("title").cast("long")
    return joined.select("page_id", n.alias("title_length"), n.between(30, 60).alias("title_ok"), "h1_count", (F.col("h1_count") == 1).alias("h1_ok"), "same_title")


@query("h15_url_rules", f"SELECT page_id, length(url) > 100 AS too_long, {PATH} LIKE '%/' AS slash_at_end, url LIKE 'http://%' AS insecure, contains(url, '?') AS has_query FROM pages")
def h15(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", (F.length(url) > 100).alias("too_long"), urls.part_of(url, 3).endswith("/").alias("slash_at_end"), url.startswith("http://").alias("insecure"), url.contains("?").alias("has_query"))


@query(
    "w11_duplicate_titles",
    f"SELECT title, count(*) AS pages, min(page_id) AS first_page FROM (SELECT page_id, lower({_TITLE}) AS title FROM pages) GROUP BY title HAVING count(*) > 1",
)
def w11(spark, sf):
    title = F.lower(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))).alias("title")
    return table(spark, sf, "pages").select("page_id", title).groupBy("title").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


@query(
    "t01_tokens",
    "SELECT doc_id, CAST(len(ts) AS BIGINT) AS tokens, CAST(len(list_distinct(ts)) AS BIGINT) AS unique_tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z][A-Za-z''\\-]*') AS ts FROM documents)",
)
def t01(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", text_quality.tokens_of(F.col("text")).alias("ts"))
    return rows.select("doc_id", F.size("ts").cast("long").alias("tokens"), F.size(F.array_distinct("ts")).cast("long").alias("unique_tokens"))


@query(
    "t02_phrase_hits",
    f"""SELECT doc_id, CAST(len(list_filter([{listed(text_quality.FILLER)}], lambda p: contains(lower(text), p))) AS BIGINT) AS filler_hits,
       CAST(len(list_filter([{listed(text_quality.GENERATED)}], lambda p: contains(lower(text), p))) AS BIGINT) AS ai_hits FROM documents""",
)
def t02(spark, sf):
    size = lambda phrases: F.size(text_quality.phrases_in(F.col("low"), phrases)).cast("long")
    return table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low")).select("doc_id", size(text_quality.FILLER).alias("filler_hits"), size(text_quality.GENERATED).alias("ai_hits"))


@query(
    "t03_repetition",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z][A-Za-z''\-]*') AS ts FROM documents),
g AS (SELECT doc_id, ts[i] || ' ' || ts[i + 1] AS gram FROM (SELECT doc_id, ts, unnest(range(1, len(ts))) AS i FROM t WHERE len(ts) >= 4)),
c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY doc_id, gram),
r AS (SELECT doc_id, count(*) FILTER (WHERE n > 1) / count(*) AS share FROM c GROUP BY doc_id)
SELECT t.doc_id, round(coalesce(share, 0.0), 6) AS repetition FROM t LEFT JOIN r USING (doc_id)""",
)
def t03(spark, sf):
    tokens = text_quality.tokens_of(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", tokens.alias("ts"))
    return rows.select("doc_id", F.round(text_quality.repeated_bigrams(F.col("ts")), 6).alias("repetition"))


@query("t06_text_quality")
def t06(spark, sf):
    """Word boundaries differ between the regex dialects, so this one is tested on fixtures instead of by SQL."""
    out = text_quality.analyse(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "tokens", "unique_tokens", "entities", "numbers", "filler_score", "ai_pattern_score", "information_density", "repetition_score", "overall_quality", F.array_join("flags", ",").alias("flags"))


@query(
    "t15_uniqueness",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents),
p AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY doc_id, word),
o AS (SELECT word FROM p GROUP BY word HAVING count(*) = 1)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_words, CAST(sum(CASE WHEN o.word IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS unique_words,
       round(sum(CASE WHEN o.word IS NOT NULL THEN n ELSE 0 END) * 100.0 / sum(n), 2) AS uniqueness_pct
FROM p LEFT JOIN o ON p.word = o.word GROUP BY doc_id""",
)
def t15(spark, sf):
    return text_quality.uniqueness(table(spark, sf, "documents"))


@query(
    "t13_keyword_density",
    r"""SELECT doc_id, hits AS keyword_hits, CASE WHEN n > 0 THEN round(hits * 100.0 / n, 2) ELSE 0 END AS keyword_density FROM (
SELECT doc_id, CAST((length(text) - length(replace(lower(text), 'tion', ''))) / 4 AS BIGINT) AS hits, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n FROM documents)""",
)
def t13(spark, sf):
    return text_quality.keyword_density(table(spark, sf, "documents"), "tion").select("doc_id", "keyword_hits", "keyword_density")


@query(
    "t14_citability",
    r"""WITH p AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\n+'), lambda x: true)) AS body, unnest(range(len(regexp_split_to_array(text, '\n+')))) AS paragraph FROM documents)
SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, CAST(len(regexp_extract_all(body, '\S+')) AS BIGINT) AS words,
       len(regexp_extract_all(body, '\S+')) BETWEEN 134 AND 167 AS citable_length, regexp_matches(body, '(?i)(^|[^\p{L}\p{N}_])(is|are|refers to|means)([^\p{L}\p{N}_]|$)') AS defines
FROM p WHERE trim(body) <> ''""",
)
def t14(spark, sf):
    return text_quality.citability(table(spark, sf, "documents"))


@query(
    "t18_intent",
    "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(p_name || ' ' || p_type), '{p}') THEN '{n}'" for n, p in text_quality.INTENT) + " ELSE 'informational' END AS intent FROM part",
)
def t18(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text_quality.intent(F.concat_ws(" ", "p_name", "p_type")).alias("intent"))


@query(
    "w04_context_budget",
    "SELECT source, doc_id, upto_chars FROM (SELECT source, doc_id, CAST(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS upto_chars FROM documents) WHERE upto_chars <= 14000",
)
def w04(spark, sf):
    from pagequarry.operators.metrics import within_budget

    return within_budget(table(spark, sf, "documents"), "doc_id", "text", part=["source"]).select("source", "doc_id", "upto_chars")


@query(
    "l06_first_of_repeated",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS k FROM conversations) WHERE k = 1",
)
def l06(spark, sf):
    """Ordered dedupe: of equal turns, the first."""
    return links.first_of(table(spark, sf, "conversations"), ["role", "text"], ["conv_id", "turn"]).select("conv_id", "turn", "role")


@query("t07_claims")
def t07(spark, sf):
    return claims.claims(table(spark, sf, "documents"))


@query("t09_claim_summary")
def t09(spark, sf):
    return claims.claim_summary(table(spark, sf, "documents"))


@query("t10_rewriting")
def t10(spark, sf):
    return claims.rewrite(table(spark, sf, "documents")).select("doc_id", "change_count", F.sha2("cleaned", 256).alias("cleaned_sha256"))
