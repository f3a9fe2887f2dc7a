"""Audit, priority and diagnostics queries."""

from pyspark.sql import functions as F

from checks.base import DIRTY, FLAGGED, INVALID, VALID, flagged, rounded, union_counts
from trackloom.operators import audit
from trackloom.schemas import CLASS_TARGETS, MODELLED_COLUMNS, RAW_TRACK_COLUMNS, REGRESSION_TARGETS, UNIT_INTERVAL_COLUMNS
from trackloom.sources.adapters import table

SOURCE = f"WITH {DIRTY}, {VALID}, {FLAGGED}"
NUMERIC = [c for c in MODELLED_COLUMNS if c not in CLASS_TARGETS]
COLUMNS = [*RAW_TRACK_COLUMNS, *[f"{c}_missing" for c in MODELLED_COLUMNS]]


def _rows(spark, d):
    return flagged(spark, d).select(*COLUMNS)


def audit_basic_profile(spark, d):
    return audit.basic_profile(_rows(spark, d))


def _basic_sql():
    items = [("rows", "", "count(*)"), ("columns", "", f"max({len(COLUMNS)})"),
             *[("nulls", c, f"count(*) - count({c})") for c in COLUMNS],
             *[("invalid", c, f"count(*) FILTER (WHERE {m})") for c, m in INVALID.items()]]
    return f"SELECT * FROM ({union_counts('flagged', items)}) WHERE metric <> 'nulls' OR value > 0"


def audit_metadata_profile(spark, d):
    return audit.metadata_profile(_rows(spark, d))


_METADATA = [
    ("missing_track_id", "count(*) FILTER (WHERE trim(coalesce(track_id, '')) = '')"),
    ("missing_artist_name", "count(*) FILTER (WHERE trim(coalesce(artist_name, '')) = '')"),
    ("missing_track_name", "count(*) FILTER (WHERE trim(coalesce(track_name, '')) = '')"),
    ("duplicate_nonempty_track_id_rows", "count(track_id) - count(DISTINCT track_id)"),
    ("duplicate_nonempty_track_name_artist_pairs",
     "count(artist_name) - count(DISTINCT CASE WHEN artist_name IS NOT NULL THEN track_name || '|' || artist_name END)"),
    ("artist_name_list_like_prefix", "count(*) FILTER (WHERE artist_name LIKE '[%')"),
    ("artist_name_semicolon_count", "count(*) FILTER (WHERE artist_name LIKE '%;%')"),
    ("artist_name_comma_count", "count(*) FILTER (WHERE artist_name LIKE '%,%')"),
    *[(f"{c}_leading_trailing_space_count", f"count(*) FILTER (WHERE {c} <> trim({c}))")
      for c in ("artist_name", "track_name", "track_id")],
]
METADATA = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST({e} AS BIGINT) AS value FROM flagged" for m, e in _METADATA)


def metadata_profile_text(spark, d):
    """The same counts over document text, which has blanks and punctuation."""
    docs = table(spark, d, "documents")
    return audit.metadata_profile(docs.select(
        F.col("text").alias("artist_name"), F.col("source").alias("track_name"), F.col("lang").alias("track_id")))


METADATA_TEXT = "WITH flagged AS (SELECT text AS artist_name, source AS track_name, lang AS track_id FROM documents) " \
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({e} AS BIGINT) AS value FROM flagged" for m, e in [
        (m, e.replace("trim(coalesce(artist_name, ''))",
                      r"regexp_replace(coalesce(artist_name, ''), '^\s+|\s+$', '', 'g')")
         .replace("trim(artist_name)", r"regexp_replace(artist_name, '^\s+|\s+$', '', 'g')")
         .replace("track_name || '|' || artist_name", "md5(track_name || '|' || artist_name)"))
        for m, e in _METADATA])


CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}_missing AS flag, CAST({c} AS DOUBLE) AS value FROM flagged" for c in NUMERIC) + ")"
CLASS_CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}_missing AS flag, CAST({c} AS DOUBLE) AS value FROM flagged" for c in CLASS_TARGETS) + ")"


def numeric_summary_by_flag(spark, d):
    return audit.numeric_summary_by_flag(_rows(spark, d))


_BOUNDED = ", ".join(f"'{c}'" for c in UNIT_INTERVAL_COLUMNS)


def _q(p):
    return f"round_even(quantile_cont(value, {p}), 6)"


NUMERIC_SUMMARY = f"""{SOURCE}, {CELLS}
SELECT feature, flag, count(*) AS rows, count(*) - count(value) AS nulls,
  CASE WHEN feature IN ({_BOUNDED}) THEN round(avg(CAST(value = 0 AS DOUBLE)), 6) END AS zero_fraction,
  CASE WHEN feature IN ({_BOUNDED}) THEN round(avg(CAST(value = 1 AS DOUBLE)), 6) END AS one_fraction,
  count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round_even(min(value), 6) AS min, round_even(max(value), 6) AS max,
  {_q(0.25)} AS p25, {_q(0.5)} AS p50, {_q(0.75)} AS p75
FROM cells GROUP BY feature, flag"""


def class_distribution_by_flag(spark, d):
    return audit.class_distribution_by_flag(_rows(spark, d))


CLASS_DISTRIBUTION = f"""{SOURCE}, {CLASS_CELLS}
SELECT feature, flag, value, count(*) AS rows FROM cells GROUP BY ALL"""


def storage_recommendations(spark, d):
    return audit.storage_recommendations(_rows(spark, d))


STORAGE = f"""{SOURCE}
SELECT 'key_can_be_int8' AS metric, CAST(bool_and(key BETWEEN 0 AND 11) AS BIGINT) AS value FROM flagged
UNION ALL SELECT 'mode_can_be_int8', CAST(bool_and(mode IN (0, 1)) AS BIGINT) FROM flagged
UNION ALL SELECT c || '_can_be_string_dtype', 0 FROM (VALUES ('track_id'), ('artist_name'), ('track_name')) t(c)"""


def full_audit(spark, d):
    report = audit.full_audit(_rows(spark, d))
    return report.groupBy("section").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("values"))


_MEASURES = ["rows", "nulls", "zero_fraction", "one_fraction", "count", "mean", "std", "min", "max", "p25", "p50", "p75"]
FULL_AUDIT = f"""{SOURCE}, {CELLS}, summary AS ({NUMERIC_SUMMARY.split('FROM cells')[0].split(CELLS)[1]} FROM cells GROUP BY feature, flag),
classes AS (SELECT feature, flag, value, count(*) AS n FROM (SELECT 'key' AS feature, key_missing AS flag, key AS value
  FROM flagged UNION ALL SELECT 'mode', mode_missing, mode FROM flagged) GROUP BY ALL)
SELECT 'basic' AS section, count(*) AS rows, count(value) AS values FROM ({_basic_sql()})
UNION ALL SELECT 'metadata', count(*), count(value) FROM ({METADATA})
UNION ALL SELECT 'numeric', count(*) * {len(_MEASURES)}, CAST(sum({' + '.join(
    f'CAST({m} IS NOT NULL AS INT)' for m in _MEASURES)}) AS BIGINT) FROM summary
UNION ALL SELECT 'class', count(*), count(*) FROM classes
UNION ALL SELECT 'storage', 5, 5"""


def target_priority(spark, d):
    table = audit.target_priority(flagged(spark, d))
    return rounded(table, *[c for c, t in table.dtypes if t == "double"])


def _priority_sql():
    others = len(MODELLED_COLUMNS) - 1
    present = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in MODELLED_COLUMNS)
    rows = []
    for t in REGRESSION_TARGETS + CLASS_TARGETS:
        corr = "NULL"
        if t in REGRESSION_TARGETS:
            rest = [c for c in REGRESSION_TARGETS if c != t]
            corr = "(" + " + ".join(f"abs(corr({t}, {c}))" for c in rest) + f") / {len(rest)}"
        kind = "regression" if t in REGRESSION_TARGETS else "classification"
        missing = f"FILTER (WHERE {t} IS NULL)"
        rows.append(f"""SELECT '{t}' AS target, '{kind}' AS target_type, count(*) {missing} AS missing_count,
          count(*) {missing} / count(*) AS missing_pct,
          coalesce(avg(present / {others}) {missing}, 1) AS avg_non_null_fraction_on_missing_rows,
          coalesce(quantile_cont(present / {others}, 0.5) {missing}, 1) AS median_non_null_fraction_on_missing_rows,
          count(*) FILTER (WHERE {t} IS NULL AND present = 0) AS zero_signal_missing_rows,
          CAST({corr} AS DOUBLE) AS mean_abs_corr_with_other_regression_targets FROM counted""")

    def scaled(x):
        return f"CASE WHEN max({x}) OVER () = min({x}) OVER () THEN 0 ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"

    corr0 = "coalesce(mean_abs_corr_with_other_regression_targets, 0)"
    return f"""{SOURCE}, counted AS (SELECT *, {present} AS present FROM flagged),
    facts AS ({' UNION ALL '.join(rows)}),
    scored AS (SELECT *, 0.6 * {scaled('avg_non_null_fraction_on_missing_rows')}
        + 0.4 * (1 - {scaled('zero_signal_missing_rows')}) AS readiness_score,
        0.6 * {scaled(corr0)} + 0.4 * {scaled('missing_count')} AS benefit_score FROM facts)
    SELECT target, target_type, missing_count, round(missing_pct, 6) AS missing_pct,
      round(avg_non_null_fraction_on_missing_rows, 6) AS avg_non_null_fraction_on_missing_rows,
      round(median_non_null_fraction_on_missing_rows, 6) AS median_non_null_fraction_on_missing_rows,
      zero_signal_missing_rows,
      round(mean_abs_corr_with_other_regression_targets, 6) AS mean_abs_corr_with_other_regression_targets,
      round(readiness_score, 6) AS readiness_score, round(benefit_score, 6) AS benefit_score,
      round(CASE WHEN target_type = 'regression' AND missing_count > 0
            THEN readiness_score * benefit_score END, 6) AS overall_priority_score FROM scored"""


# --- diagnostics of one target --------------------------------------------------

FEATURES = [c for c in audit.DIAGNOSTIC_FEATURES]


def _diagnostics(spark, d, target, name):
    return audit.target_diagnostics(flagged(spark, d), target, ["row_id"])[name]


def diagnostics_summary(spark, d):
    tables = [_diagnostics(spark, d, t, "summary") for t in ("energy", "tempo", "key")]
    return rounded(tables[0].unionByName(tables[1]).unionByName(tables[2]), "missing_pct")


DIAGNOSTICS_SUMMARY = SOURCE + " UNION ALL ".join(
    f""" SELECT '{t}' AS target, count(*) AS rows, count(*) - count({t}) AS missing_count, count({t}) AS observed_count,
    round((count(*) - count({t})) / count(*), 6) AS missing_pct, {len(FEATURES) - 1} AS feature_count FROM flagged"""
    for t in ("energy", "tempo", "key"))


def diagnostics_distribution(spark, d):
    return _diagnostics(spark, d, "loudness", "distribution")


DIAGNOSTICS_DISTRIBUTION = f"""{SOURCE}, cells AS (SELECT 'loudness' AS feature, loudness AS value FROM flagged)
SELECT feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round_even(min(value), 6) AS min, round_even(max(value), 6) AS max,
  {_q(0.25)} AS p25, {_q(0.5)} AS p50, {_q(0.75)} AS p75 FROM cells GROUP BY feature"""


def diagnostics_class_counts(spark, d):
    return _diagnostics(spark, d, "key", "distribution")


DIAGNOSTICS_CLASS_COUNTS = f"{SOURCE} SELECT key AS value, count(*) AS rows FROM flagged GROUP BY key"


def diagnostics_missing_features(spark, d):
    return _diagnostics(spark, d, "energy", "missing_features")


DIAGNOSTICS_MISSING_FEATURES = SOURCE + " UNION ALL ".join(
    f""" SELECT '{c}' AS feature, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
    count(DISTINCT {c}) AS distinct_count FROM flagged WHERE energy IS NULL""" for c in FEATURES if c != "energy")


def diagnostics_row_coverage(spark, d):
    return _diagnostics(spark, d, "speechiness", "row_coverage")


DIAGNOSTICS_ROW_COVERAGE = f"""{SOURCE} SELECT {' + '.join(
    f'CAST({c} IS NOT NULL AS INT)' for c in FEATURES if c != 'speechiness')} AS non_null_features, count(*) AS rows
FROM flagged WHERE speechiness IS NULL GROUP BY 1"""


def diagnostics_null_ranking(spark, d):
    return _diagnostics(spark, d, "tempo", "null_ranking")


DIAGNOSTICS_NULL_RANKING = SOURCE + " UNION ALL ".join(
    f""" SELECT '{c}' AS "column", count(*) - count({c}) AS null_count FROM flagged WHERE tempo IS NULL"""
    for c in ["row_id", *COLUMNS])


def diagnostics_sample(spark, d):
    """The first twenty rows without a value: the limit is the feature."""
    return _diagnostics(spark, d, "acousticness", "sample")


DIAGNOSTICS_SAMPLE = f"""{SOURCE} SELECT track_id, artist_name, track_name, acousticness FROM flagged
WHERE acousticness IS NULL ORDER BY row_id LIMIT 20"""


def diagnostics_correlation(spark, d):
    return rounded(_diagnostics(spark, d, "loudness", "correlation"), "correlation")


DIAGNOSTICS_CORRELATION = SOURCE + " UNION ALL ".join(
    f" SELECT '{c}' AS feature, round(corr(loudness, {c}), 6) AS correlation FROM flagged"
    for c in REGRESSION_TARGETS if c != "loudness")


def deep_quantiles(spark, d):
    rows = flagged(spark, d)
    spread = rows.withColumn("loud_flag", (F.col("mode").isNull()).cast("int"))
    return audit.deep_quantiles(spread, "loudness", "loud_flag")


DEEP_QUANTILES = f"""{SOURCE}, cells AS (SELECT CAST(mode IS NULL AS INT) AS flag, loudness AS value FROM flagged)
SELECT flag, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
round_even(min(value), 6) AS min, round_even(max(value), 6) AS max, {', '.join(
    f'{_q(p)} AS q{round(p * 100):02d}' for p in audit.DEEP_QUANTILES)}, count(DISTINCT value) AS distinct_count
FROM cells GROUP BY flag"""


QUERIES = {
    "audit_basic_profile": (audit_basic_profile, f"{SOURCE} {_basic_sql()}"),
    "audit_metadata_profile": (audit_metadata_profile, f"{SOURCE} {METADATA}"),
    "metadata_profile_text": (metadata_profile_text, METADATA_TEXT),
    "numeric_summary_by_flag": (numeric_summary_by_flag, NUMERIC_SUMMARY),
    "class_distribution_by_flag": (class_distribution_by_flag, CLASS_DISTRIBUTION),
    "storage_recommendations": (storage_recommendations, STORAGE),
    "full_audit": (full_audit, FULL_AUDIT),
    "target_priority": (target_priority, _priority_sql()),
    "diagnostics_summary": (diagnostics_summary, DIAGNOSTICS_SUMMARY),
    "diagnostics_distribution": (diagnostics_distribution, DIAGNOSTICS_DISTRIBUTION),
    "diagnostics_class_counts": (diagnostics_class_counts, DIAGNOSTICS_CLASS_COUNTS),
    "diagnostics_missing_features": (diagnostics_missing_features, DIAGNOSTICS_MISSING_FEATURES),
    "diagnostics_row_coverage": (diagnostics_row_coverage, DIAGNOSTICS_ROW_COVERAGE),
    "diagnostics_null_ranking": (diagnostics_null_ranking, DIAGNOSTICS_NULL_RANKING),
    "diagnostics_sample": (diagnostics_sample, DIAGNOSTICS_SAMPLE),
    "diagnostics_correlation": (diagnostics_correlation, DIAGNOSTICS_CORRELATION),
    "deep_quantiles": (deep_quantiles, DEEP_QUANTILES),
}
