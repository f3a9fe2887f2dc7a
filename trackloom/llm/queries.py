"""Registered queries of the corpus operators: name -> (query, SQL or None)."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm import (byte_bpe, fingerprints, hard_negatives, lexical_search, license_scan, near_dedup, packing, pii,
                           quality_rules, secret_scan, suffix_dedup, token_counts, url_filters)


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _span_digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _span_digest(secret_scan.scan(_read(spark, folder, "documents")), secret_scan.KINDS)


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(_read(spark, folder, "documents"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return _span_digest(pii.scan(_read(spark, folder, "documents")), pii.KINDS)


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(_read(spark, folder, "documents"))


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judged(_read(spark, folder, "pages"), _read(spark, folder, "labels"))


OP10_SQL = r"""
WITH split AS (
  SELECT page_id,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM split),
known AS (
  SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, count(bad) AS n, count(*) FILTER (WHERE bad) AS y, list_last(string_split(host, '.')) AS suffix,
    array_to_string(string_split(host, '.')[-2:], '.') AS domain
  FROM parts LEFT JOIN known ON page_id = doc_id GROUP BY host),
domains AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM domains GROUP BY suffix),
levels AS (
  SELECT 'h' AS level, n::DOUBLE AS n, y::DOUBLE AS y FROM hosts
  UNION ALL SELECT 'd', n, y FROM domains UNION ALL SELECT 's', n, y FROM suffixes),
moments AS (
  SELECT level, sum(n) AS n, sum(y) / sum(n) AS p, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room, count(*) AS g,
    sum(y * y / n) - sum(y) * sum(y) / sum(n) AS s
  FROM levels WHERE n > 0 GROUP BY level),
strengths AS (
  SELECT level, CASE WHEN p <= 0 OR p >= 1 OR room <= 0 THEN 1
    ELSE 1 / least(greatest((s / (p * (1 - p)) - (g - 1)) / room, 0.001), 0.999) - 1 END AS k
  FROM moments),
k AS (
  SELECT coalesce(max(k) FILTER (WHERE level = 'h'), 1) AS kh, coalesce(max(k) FILTER (WHERE level = 'd'), 1) AS kd,
    coalesce(max(k) FILTER (WHERE level = 's'), 1) AS ks,
    (SELECT coalesce(sum(y) / nullif(sum(n), 0), 0) FROM suffixes) AS share
  FROM strengths),
sm AS (SELECT suffix, (y + ks * share) / (n + ks) AS sm FROM suffixes, k),
dm AS (SELECT domain, (y + kd * sm) / (n + kd) AS dm FROM domains JOIN sm USING (suffix), k),
hm AS (SELECT host, n, kh, (y + kh * dm) / (n + kh) AS m FROM hosts JOIN dm USING (domain), k),
low AS (SELECT host, m - 1.645 * sqrt(m * (1 - m) / (n + kh + 1)) > 0.4 AS low FROM hm),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts)
SELECT page_id, r.host, path, rule, CASE
  WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow' WHEN low THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN low l ON r.host = l.host"""


def op5_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digests(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN)


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # The query's own threshold. A pair at 0.85 shares no band with probability (1 - 0.85 ** 8) ** 40 < 4e-6.
    return near_dedup.duplicate_groups(_read(spark, folder, "documents"), threshold=85, bands=40, rows=8)


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (
  SELECT x AS doc_id, y AS other FROM links
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(r.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id"""


def op11_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_read(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
windows AS (
  SELECT doc_id, i, b[i + 1:i + 50] AS s
  FROM (SELECT doc_id, b, unnest(range(n - 49)) AS i FROM sized WHERE n >= 50)),
firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
gone AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE least < doc_id),
marked AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 50 AS fresh FROM gone),
runs AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS s, max(i) + 50 AS e FROM runs GROUP BY doc_id, run),
parts AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS since FROM spans
  UNION ALL SELECT doc_id, n, n, coalesce((SELECT max(e) FROM spans x WHERE x.doc_id = sized.doc_id), 0) FROM sized),
kept AS (
  SELECT p.doc_id, string_agg(hex(b[since + 1:s]), '' ORDER BY s, e) AS h
  FROM parts p JOIN sized USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM sized LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(e - s) AS removed, count(*) AS n FROM spans GROUP BY doc_id) r(doc_id, removed, spans) USING (doc_id)"""


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    number, label = F.col("vec_id"), F.col("label")
    rows = _read(spark, folder, "embeddings").withColumn("label", F.when(number % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(rows, number % 50 == 0)


OP12_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


def op13_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term
  FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term
  FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
dfs AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, total GROUP BY term, big_n),
given AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)) AS impact
  FROM tfs JOIN sizes USING (doc_id), total),
scored AS (
  SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score
  FROM asked JOIN dfs USING (term) JOIN given USING (term) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""

QUERIES = {
    "op1_quality_rules": (op1_quality_rules, None),
    "op2_secret_scan": (op2_secret_scan, None),
    "op3_license_scan": (op3_license_scan, None),
    "op4_pii": (op4_pii, None),
    "op5_byte_level_bpe": (op5_byte_level_bpe, None),
    "op6_best_fit_packing": (op6_best_fit_packing, None),
    "op8_token_counts": (op8_token_counts, None),
    "op7_minhash_near_dedup": (op7_minhash_near_dedup, OP7_SQL),
    "op9_fingerprints": (op9_fingerprints, None),
    "op10_url_filters": (op10_url_filters, OP10_SQL),
    "op11_suffix_array_dedup": (op11_suffix_array_dedup, OP11_SQL),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_ranked_lexical_search": (op13_ranked_lexical_search, OP13_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
