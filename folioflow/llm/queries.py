"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, gif, langid, lexical, lm_scoring, mixing, near_dedup, packing, periodic_runs, quality, substring_dedup, url_rules
from .common import table

#: Fixed by the contract of op4: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules).select("row.page_id", "host", "path", "rule", "verdict")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("+"), m["length"].cast("string"))), ",")
    return shown.withColumn("mask", spans)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return told.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.judge_rows(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return told.select("row.doc_id", *[F.col(f"counts.{c}") for c in quality.COUNTS], "base_failed", "host_rejected", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    media = gif.stored(docs, gif.payload(F.col("text")), ["doc_id", "n_bytes"])
    media = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    told = gif.read(media, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    back = F.col("gif.samples")
    return told.select(
        "doc_id", "n_bytes", F.octet_length(back).cast("long").alias("payload_bytes"), F.sha2(back, 256).alias("payload_sha256"), F.crc32(F.substring(back, -16, 16)).alias("tail_crc32"),
        "media_bytes", "media_sha256", gif.feature(F.col("gif")).alias("feature"), F.size("gif.frames").alias("n_frames"), F.col("gif.reason").alias("reason"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    looped = docs.select("doc_id", periodic_runs.looped(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs.digests(periodic_runs.periodic_runs(looped))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_near_dedup": op2_near_dedup,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_url_filter": op4_url_filter,
        "op5_chat_format": op5_chat_format,
        "op6_language_id": op6_language_id,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_mixing": op8_mixing,
        "op9_quality_rules": op9_quality_rules,
        "op10_packing": op10_packing,
        "op11_media_gif": op11_media_gif,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_ranked_search": op13_ranked_search,
    }


_OP4 = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
j AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""

_OP5 = r"""
WITH said AS (
  SELECT conv_id, coalesce(turn, -1) AS turn,
    CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE regexp_replace(trim(role), '\s+', '_', 'g') END AS who,
    coalesce(text, '') AS text
  FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY who, text) - 1 AS seq FROM said),
cast_ AS (SELECT DISTINCT conv_id, who AS perspective FROM said WHERE who <> 'system'),
shown AS (
  SELECT p.conv_id, c.perspective, CAST(floor(p.turn / 32) AS BIGINT) AS piece, CAST(floor(p.seq / 32) AS BIGINT) AS part, p.turn, p.seq,
    '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = perspective THEN 'assistant' ELSE 'user name=' || who END || chr(10) AS head,
    text || '<|im_end|>' || chr(10) AS body, who = perspective AS mine
  FROM placed p JOIN cast_ c ON p.conv_id IS NOT DISTINCT FROM c.conv_id),
laid AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, piece, part ORDER BY turn, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS BIGINT) AS pos
  FROM shown)
SELECT conv_id, perspective, piece, part, count(*) AS n_turns, CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars,
  string_agg(head || body, '' ORDER BY turn, seq) AS rendered,
  coalesce(string_agg(CASE WHEN mine THEN pos || '+' || length(body) END, ',' ORDER BY turn, seq), '') AS mask
FROM laid GROUP BY conv_id, perspective, piece, part
"""

_OP7 = """
WITH g AS (
  SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(g.t) AS text_sha256
FROM documents d JOIN g ON coalesce(d.text, '') = g.t
"""

_OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
swept AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(source_size * 2) OVER before, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM s
  WINDOW before AS (ORDER BY source_size / w::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
  SELECT level AS lvl FROM swept WHERE level * w <= source_size * 2
  ORDER BY source_size / w::DOUBLE, source ASC NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, least(coalesce((SELECT lvl FROM lev) * w, (source_size * 2)::DOUBLE), (source_size * 2)::DOUBLE) AS target,
    CAST('0x' || substr(md5('7:' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM s),
r AS (
  SELECT d.*, row_number() OVER (PARTITION BY source
    ORDER BY size, h % greatest(1, (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) FROM documents)), h, doc_id) - 1 AS k
  FROM d),
e AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.k, t.u,
    CASE WHEN t.source_size > 0 AND r.size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(floor((k + 1) * each + u) - floor(k * each + u) AS BIGINT) * size AS taken
FROM e
"""


_OP9 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS id FROM documents),
w AS (
  SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (
  SELECT id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
t AS (SELECT id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM p),
again AS (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS n FROM t),
rep AS (
  SELECT id, count(DISTINCT i + j) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY id),
l AS (
  SELECT id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (
  SELECT id, sum(n - 1) AS n_dup_lines
  FROM (SELECT id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id, line) GROUP BY id),
c AS (
  SELECT d.doc_id, d.source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (id) LEFT JOIN rep USING (id) LEFT JOIN dup USING (id)),
f AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > n_words AS f3,
    20 * n_dup_lines > n_words AS f4, word_chars < 2 * n_words OR word_chars > 15 * n_words AS f5
  FROM c),
h AS (
  SELECT source, rule, count(*) AS n, sum(CAST(hit AS INT)) AS k
  FROM (SELECT source, unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5]) AS hit FROM f) GROUP BY source, rule),
m AS (
  SELECT rule, sum(k)::DOUBLE / sum(n) AS mean, sum(k * k::DOUBLE / n) - sum(k) * (sum(k)::DOUBLE / sum(n)) AS spread, count(*) AS hosts,
    sum(n) - count(*) - sum(n * n::DOUBLE) / sum(n) + 1 AS room FROM h GROUP BY rule),
al AS (
  SELECT rule, mean, CASE WHEN mean * (1 - mean) > 0 AND room > 0 THEN (spread / (mean * (1 - mean)) - (hosts - 1)) / room ELSE 0 END AS alike FROM m),
pr AS (
  SELECT rule, mean, CASE WHEN alike > 0 THEN least(greatest(1 / alike - 1, 10), 1000) ELSE 1000 END AS s FROM al),
rt AS (
  SELECT source, rule, (k + mean * s) / (n + s) AS rate, mean, n + s + 1 AS seen FROM h JOIN pr USING (rule)),
rates AS (
  SELECT source, rule, rate - 3.0 * sqrt(greatest(rate * (1 - rate) / seen, 0)) AS rate, mean FROM rt),
bad AS (
  SELECT source, bool_or(rate > greatest(0.25, 20.0 * mean / (1 - mean + 20.0 * mean))) AS whole,
    bool_or(rule = 3 AND rate > 1.25 * mean) AS s3, bool_or(rule = 4 AND rate > 1.25 * mean) AS s4, bool_or(rule = 5 AND rate > 1.25 * mean) AS s5
  FROM rates GROUP BY source),
v AS (
  SELECT f.*, f1 OR f2 AS base_failed, whole OR (s3 AND f3) OR (s4 AND f4) OR (s5 AND f5) AS host_rejected
  FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
  NOT base_failed AND NOT host_rejected AS kept
FROM v
"""


_OP13 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
q AS (
  SELECT item_id, t, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
p AS (
  SELECT doc_id, row, n, t, count(*) AS tf FROM (SELECT doc_id, row, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, row, n, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, g GROUP BY t),
s AS (
  SELECT item_id, doc_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t), g GROUP BY item_id, doc_id, row)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": _OP4,
        "op5_chat_format": _OP5,
        "op7_exact_dedup": _OP7,
        "op8_mixing": _OP8,
        "op9_quality_rules": _OP9,
        "op13_ranked_search": _OP13,
    }
