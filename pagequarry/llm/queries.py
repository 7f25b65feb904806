"""The thin queries over the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_main, line_dedup, media, mixing, near_dup, periodic_runs, pii, quality_rules, secrets, spelling, warc
from ._shared import table, written


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), spots AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM spots
), twice AS (
  SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1
), covered AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (doc_id, g)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM covered GROUP BY doc_id
), c AS (
  SELECT w.doc_id, lang, source,
         CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         greatest((1000000 * (n_symbols + 1)) // (word_chars + 1), 1) AS v_symbol,
         greatest((1000000 * (n_dup_lines + 1)) // (n_lines + 1), 1) AS v_dup_line,
         greatest((1000000 * (n_repeat_words + 1)) // (n_words + 1), 1) AS v_repeat_word,
         greatest((1000 * word_chars) // greatest(n_words, 1), 1) AS v_word_length
  FROM c
), m AS (
  SELECT lang, source, 'symbol' AS metric, v_symbol AS v FROM b WHERE n_words > 0
  UNION ALL SELECT lang, source, 'dup_line', v_dup_line FROM b WHERE n_words > 0
  UNION ALL SELECT lang, source, 'repeat_word', v_repeat_word FROM b WHERE n_words > 0
  UNION ALL SELECT lang, source, 'word_length', v_word_length FROM b WHERE n_words > 0
), r AS (
  SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 9, 0)) << greatest(length(bin(v)) - 9, 0) AS bucket, count(*) AS n
  FROM m GROUP BY ALL
), q3 AS (
  SELECT lang, source, metric, max(docs) AS docs, min(CASE WHEN upto * 4 >= docs THEN bucket END) AS lower_q,
         min(CASE WHEN upto * 4 >= docs * 3 THEN bucket END) AS upper_q
  FROM (SELECT lang, source, metric, bucket, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto,
               sum(n) OVER (PARTITION BY lang, source, metric) AS docs FROM r)
  GROUP BY ALL
), q2 AS (
  SELECT lang, metric, max(docs) AS docs, min(CASE WHEN upto * 4 >= docs THEN bucket END) AS lower_q,
         min(CASE WHEN upto * 4 >= docs * 3 THEN bucket END) AS upper_q
  FROM (SELECT lang, metric, bucket, sum(n) OVER (PARTITION BY lang, metric ORDER BY bucket) AS upto,
               sum(n) OVER (PARTITION BY lang, metric) AS docs
        FROM (SELECT lang, metric, bucket, sum(n) AS n FROM r GROUP BY ALL))
  GROUP BY ALL
), q1 AS (
  SELECT metric, max(docs) AS docs, min(CASE WHEN upto * 4 >= docs THEN bucket END) AS lower_q,
         min(CASE WHEN upto * 4 >= docs * 3 THEN bucket END) AS upper_q
  FROM (SELECT metric, bucket, sum(n) OVER (PARTITION BY metric ORDER BY bucket) AS upto,
               sum(n) OVER (PARTITION BY metric) AS docs
        FROM (SELECT metric, bucket, sum(n) AS n FROM r GROUP BY ALL))
  GROUP BY ALL
), p AS (
  SELECT q2.lang, q2.metric, exp((q2.docs * ln(q2.lower_q) + 20 * ln(q1.lower_q)) / (q2.docs + 20)) AS lower_q,
         exp((q2.docs * ln(q2.upper_q) + 20 * ln(q1.upper_q)) / (q2.docs + 20)) AS upper_q
  FROM q2 JOIN q1 USING (metric)
), f AS (
  SELECT q3.lang, q3.source, q3.metric, exp((q3.docs * ln(q3.lower_q) + 20 * ln(p.lower_q)) / (q3.docs + 20)) AS lower_q,
         exp((q3.docs * ln(q3.upper_q) + 20 * ln(p.upper_q)) / (q3.docs + 20)) AS upper_q
  FROM q3 JOIN p ON q3.lang IS NOT DISTINCT FROM p.lang AND q3.metric = p.metric
), g AS (
  SELECT *, greatest(upper_q / lower_q, CAST(CASE metric WHEN 'word_length' THEN 1.02 ELSE 2 END AS DOUBLE)) AS ratio FROM f
), h AS (
  SELECT lang, source,
         max(CASE WHEN metric = 'symbol' THEN upper_q * ratio * ratio END) AS hi1,
         max(CASE WHEN metric = 'dup_line' THEN upper_q * ratio END) AS hi2,
         max(CASE WHEN metric = 'repeat_word' THEN upper_q * ratio * ratio END) AS hi3,
         max(CASE WHEN metric = 'word_length' THEN upper_q * ratio * ratio * ratio * ratio END) AS hi4,
         max(CASE WHEN metric = 'word_length' THEN lower_q / ratio / ratio / ratio / ratio END) AS lo4
  FROM g GROUP BY lang, source
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce((n_symbols = 0 OR v_symbol <= hi1) AND (n_dup_lines = 0 OR v_dup_line <= hi2)
         AND (n_repeat_words = 0 OR v_repeat_word <= hi3) AND v_word_length BETWEEN lo4 AND hi4, false) AS kept
FROM b LEFT JOIN h ON b.lang IS NOT DISTINCT FROM h.lang AND b.source IS NOT DISTINCT FROM h.source
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that no earlier line repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed", "emptied")


OP8_SQL = r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw_line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), lines AS (
  SELECT doc_id, pos, raw_line, trim(raw_line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM raw
), firsts AS (
  SELECT line, length(line) AS n, min((doc_id * 1000000 + pos)) AS first_at FROM lines WHERE line <> '' GROUP BY line
), spots AS (
  SELECT line, n, first_at, unnest(range(n)) AS o FROM firsts WHERE n >= 20
), variants AS (
  SELECT line, n, first_at, o, hash(left(line, CAST(o AS INTEGER)) || substr(line, CAST(o AS INTEGER) + 2)) AS v FROM spots
), equal_length AS (
  SELECT line, first_at, min(first_at) OVER (PARTITION BY n, o, v) AS earliest FROM variants
), near AS (
  SELECT line FROM equal_length WHERE earliest < first_at
  UNION
  SELECT CASE WHEN a.first_at > b.first_at THEN a.line ELSE b.line END
  FROM variants a JOIN firsts b ON a.v = hash(b.line) AND a.n = b.n + 1 AND b.n >= 20
), marked AS (
  SELECT l.doc_id, l.pos, l.raw_line, l.line <> '' AS has_word,
         l.line <> '' AND (l.doc_id * 1000000 + l.pos <> f.first_at OR near.line IS NOT NULL) AS gone
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near ON l.line = near.line
), counted AS (
  SELECT doc_id, coalesce(string_agg(raw_line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS left_over,
         CAST(count(*) FILTER (WHERE has_word) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN n_removed = 0 THEN d.text ELSE left_over END AS text, n_lines, n_removed,
       n_removed > 0 AND n_removed = n_lines AS emptied
FROM documents d JOIN counted USING (doc_id)
"""

def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the production mixture, a row for each epoch that takes one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).select("doc_id", "epoch", "domain", "lang", "source", "n_tokens")


def _fill_sql(name: str, level: str, above: list[str], node: str) -> str:
    """One level of water-filling, as ``mixing._fill``."""
    keys = ", ".join([*above, level])
    by = f"PARTITION BY {', '.join(above)}" if above else ""
    source = f"{name}_c JOIN {node} USING ({', '.join(above)})" if above else f"{name}_c CROSS JOIN {node}"
    names = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mixing.WEIGHTS.items())
    return f"""
{name}_c AS (
  SELECT {keys}, CAST(sum(tokens * {mixing.MAX_EPOCHS}) AS HUGEINT) AS capacity,
         CAST(CASE {level} {names} ELSE {mixing.OTHER_WEIGHT} END AS HUGEINT) AS weight FROM leaves WHERE tokens > 0 GROUP BY {keys}
), {name}_a AS (
  SELECT {keys}, capacity, weight, budget, CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE) AS r FROM {source}
), {name}_b AS (
  SELECT *, CAST(coalesce(sum(capacity) OVER ({by} ORDER BY r, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS filled,
         CAST(sum(weight) OVER ({by} ORDER BY r, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS weights FROM {name}_a
), {name}_d AS (
  SELECT *, (budget - filled) * weight >= capacity * weights AS is_full FROM {name}_b
), {name}_e AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({by}), 0) AS HUGEINT) AS taken,
         CAST(sum(CASE WHEN NOT is_full THEN weight END) OVER ({by}) AS HUGEINT) AS open_weight FROM {name}_d
), {name}_f AS (
  SELECT *, CASE WHEN is_full THEN capacity ELSE ((budget - taken) * weight) // open_weight END AS part,
         CASE WHEN NOT is_full THEN ((budget - taken) * weight) % open_weight END AS rest FROM {name}_e
), {name}_g AS (
  SELECT *, budget - CAST(sum(part) OVER ({by}) AS HUGEINT) AS spare,
         row_number() OVER ({by} ORDER BY rest DESC NULLS LAST, {level}) AS place FROM {name}_f
), {name} AS (
  SELECT {keys}, part + CASE WHEN NOT is_full AND place <= spare AND part < capacity THEN 1 ELSE 0 END AS budget FROM {name}_g
)"""


OP2_SQL = rf"""
WITH tokens AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, lang AS lang0, source AS source0,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS n,
         CASE WHEN NOT regexp_matches(coalesce(source, ''), '\d$') THEN 'unknown'
              ELSE list_extract(['web', 'books', 'forums', 'news'], CAST(regexp_extract(source, '(\d{{1,9}})$', 1) AS INTEGER) % 4 + 1) END AS domain
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n) AS tokens FROM tokens GROUP BY ALL
), root AS (
  SELECT least(CAST(sum(tokens) AS HUGEINT) * {mixing.BUDGET_PERCENT} // 100, CAST(sum(tokens) AS HUGEINT) * {mixing.MAX_EPOCHS}) AS budget FROM leaves
), {_fill_sql("top", "domain", [], "root")}, {_fill_sql("mid", "lang", ["domain"], "top")}, {_fill_sql("low", "source", ["domain", "lang"], "mid")}, plan AS (
  SELECT leaves.domain, leaves.lang, leaves.source,
         CASE WHEN tokens = 0 THEN 1 ELSE budget // tokens END AS whole,
         CASE WHEN tokens = 0 THEN 0 ELSE budget - budget // tokens * tokens END AS part_left
  FROM leaves LEFT JOIN low USING (domain, lang, source)
), keyed AS (
  SELECT t.*, whole, part_left, md5(concat_ws(':', '{mixing.SEED}', CAST(CAST(whole + 1 AS BIGINT) AS VARCHAR), CAST(doc_id AS VARCHAR))) AS k
  FROM tokens t JOIN plan USING (domain, lang, source)
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k, n) AS running FROM keyed
), times AS (
  SELECT *, CAST(whole + CASE WHEN part_left > 0 AND running <= part_left THEN 1 ELSE 0 END AS INTEGER) AS c FROM summed
)
SELECT doc_id, epoch, domain, lang0 AS lang, source0 AS source, n AS n_tokens
FROM (SELECT *, CAST(unnest(range(1, c + 1)) AS INTEGER) AS epoch FROM times WHERE c > 0)
"""

#: Where the tokenizer's vocabulary lies; another file of its kind can be given to the operator.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def op6_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a media file, read back and sniffed."""
    stored = written(media.store_media(table(spark, sf_dir, "documents")), "media")
    return media.digests(stored)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.payload_report(warc.reassemble(warc.read_archives(spark, path)))


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), h AS (
  SELECT html, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY html
)
SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON p.html = h.html
"""

def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its form, the end of its chain of forms, and counts."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of repeated words of every document."""
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), with_text=False)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's windows in every document."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), spots AS (
  SELECT item_id, ws, least(len(ws), 10) AS size, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM spots
), starts AS (
  SELECT doc_id, ws, size, unnest(range(1, greatest(len(ws) - size + 2, 1))) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM win)
), got AS (
  SELECT doc_id, i, size, w FROM (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM starts) SEMI JOIN win USING (size, w)
), places AS (
  SELECT DISTINCT doc_id, i, size FROM got
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM places) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM got JOIN win USING (size, w) WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants, "op12_periodic_runs": op12_periodic_runs, "op13_decontamination": op13_decontamination, "op4_pii_surrogates": op4_pii_surrogates, "op1_html_main_text": op1_html_main_text, "op5_warc": op5_warc, "op6_media_sniffing": op6_media_sniffing, "op7_bpe": op7_bpe, "op9_secrets": op9_secrets, "op2_source_mixing": op2_source_mixing, "op3_near_dedup": op3_near_dedup, "op8_line_dedup": op8_line_dedup, "op10_quality_rules": op10_quality_rules}
ORACLE_SQL = {"op13_decontamination": OP13_SQL, "op2_source_mixing": OP2_SQL, "op5_warc": OP5_SQL, "op8_line_dedup": OP8_SQL, "op10_quality_rules": OP10_SQL}
