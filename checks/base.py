"""SQL twins of the adapters and helpers that build oracle text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import clean, quality
from trackloom.schemas import MODELLED_COLUMNS, POSITIVE_COLUMNS, RAW_TRACK_COLUMNS, UNIT_INTERVAL_COLUMNS
from trackloom.sources import adapters

DIRTY = """
dirty AS (
  SELECT CASE WHEN l_orderkey % 11 <> 0 THEN p_brand END AS artist_name,
         p_name AS track_name,
         CASE WHEN l_orderkey % 5 <> 0 THEN p_retailprice * 1000 END AS duration_ms,
         l_discount * 12 AS valence,
         -l_extendedprice / 5000 AS loudness,
         l_tax * CAST(12.5 AS DOUBLE) AS danceability,
         CASE WHEN l_orderkey % 97 <> 0 THEN l_quantity / 50 END AS energy,
         l_quantity * 4 - 20 AS tempo,
         CASE WHEN l_partkey % 23 <> 0 THEN (l_suppkey % 101) / 100 END AS acousticness,
         CASE WHEN l_partkey % 29 <> 0 THEN (l_partkey % 211) / 210 END AS instrumentalness,
         (l_orderkey % 89) / 88 AS liveness,
         CASE WHEN l_orderkey % 17 <> 0 THEN (l_orderkey % 53) / 52 END AS speechiness,
         CASE l_returnflag WHEN 'A' THEN CAST(1 AS DOUBLE) WHEN 'R' THEN CAST(0 AS DOUBLE) END AS explicit,
         CASE WHEN l_orderkey % 13 <> 0 THEN CAST(month(l_shipdate) - 1 AS DOUBLE) END AS key,
         CAST(l_linenumber % 5 AS DOUBLE) AS time_signature,
         CASE WHEN l_linenumber <> 7 THEN CAST(l_partkey AS VARCHAR) END AS track_id,
         CASE WHEN l_orderkey % 19 <> 0 THEN CAST(l_linestatus = 'F' AS DOUBLE) END AS mode,
         concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
                   CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT),
                   CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus,
                   date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS row_id
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

INVALID = {c: f"({c} IS NOT NULL AND NOT ({c} BETWEEN 0 AND 1))" for c in UNIT_INTERVAL_COLUMNS}
INVALID |= {c: f"({c} IS NOT NULL AND {c} <= 0)" for c in POSITIVE_COLUMNS}

VALID = "valid AS (SELECT row_id, " + ", ".join(
    f"CASE WHEN NOT {INVALID[c]} THEN {c} END AS {c}" if c in INVALID else c for c in RAW_TRACK_COLUMNS) + " FROM dirty)"

FLAGGED = "flagged AS (SELECT *, " + ", ".join(
    f"CAST({c} IS NULL AS INT) AS {c}_missing" for c in MODELLED_COLUMNS) + " FROM valid)"


def fill_ctes(source: str, key: str, targets: list[str], out: str, extra: str = "") -> str:
    """CTEs <out>_lookup and <out>: fill ``targets`` per ``key`` from ``source``."""
    lookup = ", ".join(f"CASE WHEN min({c}) = max({c}) THEN min({c}) END AS f_{c}" for c in targets)
    keep = [c for c in ["row_id", *RAW_TRACK_COLUMNS]]
    filled = ", ".join(f"coalesce(s.{c}, l.f_{c}) AS {c}" if c in targets else f"s.{c}" for c in keep)
    marks = ", ".join(f"CAST(s.{c} IS NULL AND l.f_{c} IS NOT NULL AS INT) AS {out}_m_{c}" for c in targets)
    return f"""
{out}_lookup AS (SELECT {key}, {lookup} FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}),
{out} AS (SELECT {filled}, {marks}{extra} FROM {source} s LEFT JOIN {out}_lookup l ON s.{key} = l.{key})"""


def hash32_sql(key: str, seed: str = "42") -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"


def union_counts(source: str, items: list[tuple[str, str, str]]) -> str:
    """SELECT metric, column, value rows for (metric, column, aggregate) items."""
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{c}' AS \"column\", CAST({e} AS BIGINT) AS value FROM {source}" for m, c, e in items)


BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def dirty(spark: SparkSession, d: str) -> DataFrame:
    return adapters.dirty_tracks(spark, d)


def valid(spark: SparkSession, d: str) -> DataFrame:
    return quality.invalid_to_null(dirty(spark, d))


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return clean.add_missing_flags(valid(spark, d))


def six(c: str):
    return F.round(F.col(c), 6).alias(c)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
