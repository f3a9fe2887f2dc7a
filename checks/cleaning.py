"""Cleaning, quality and fill queries."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import (
    BLANK, DIRTY, FLAGGED, INVALID, VALID, dirty, fill_ctes, flagged, hash32_sql, strip_sql, union_counts, valid,
)
from trackloom.functions import sampling, text
from trackloom.operators import clean, fill, quality
from trackloom.plans import cleaning
from trackloom.schemas import MODELLED_COLUMNS, RAW_TRACK_COLUMNS
from trackloom.sources.adapters import catalogue_source, graph_input, table


# --- text --------------------------------------------------------------------

def clean_text_documents(spark, d):
    docs = table(spark, d, "documents")
    cleaned = docs.select("doc_id", text.clean_text(F.col("text")).alias("c"))
    return cleaned.select("doc_id", F.length("c").alias("chars"), F.md5("c").alias("digest"))


CLEAN_TEXT_DOCUMENTS = f"""
WITH s AS (SELECT doc_id, {strip_sql('text')} AS t FROM documents),
u AS (SELECT doc_id, CASE WHEN starts_with(t, '[') AND ends_with(t, ']')
        THEN translate(substr(t, 2, length(t) - 2), '''",', '   ') ELSE t END AS t FROM s),
c AS (SELECT doc_id, nullif({strip_sql(f"regexp_replace(t, '{BLANK}+', ' ', 'g')")}, '') AS c FROM u)
SELECT doc_id, length(c) AS chars, md5(c) AS digest FROM c"""


def _artist_forms(spark, d):
    docs = table(spark, d, "documents")
    kind = F.col("doc_id") % 6
    return docs.select("doc_id", (
        F.when(kind == 0, F.concat(F.lit("['"), "source", F.lit("', \""), "lang", F.lit("\"]")))
        .when(kind == 1, F.concat(F.lit(" ["), "source", F.lit("] ")))
        .when(kind == 2, F.concat("source", F.lit(" ;"), "lang", F.lit(";  x")))
        .when(kind == 3, F.lit("  "))
        .when(kind == 4, F.concat(F.lit(" "), "lang", F.lit("\t")))
        .otherwise(F.lit("[]"))).alias("artists"))


ARTIST_FORMS = """forms AS (SELECT doc_id, source, lang, doc_id % 6 AS kind FROM documents)"""


def joined_artist_names(spark, d):
    return _artist_forms(spark, d).select("doc_id", text.joined_artists(F.col("artists")).alias("artist_name"))


JOINED_ARTIST_NAMES = f"""
WITH {ARTIST_FORMS}
SELECT doc_id, CASE kind WHEN 0 THEN source || '; ' || lang WHEN 1 THEN source
  WHEN 2 THEN source || '; ' || lang || '; x' WHEN 3 THEN NULL WHEN 4 THEN lang ELSE '[]' END AS artist_name
FROM forms"""


def primary_artists(spark, d):
    forms = _artist_forms(spark, d)
    listed = forms.withColumn("artists", F.split("artists", ";"))
    first = clean.normalise_schema(forms).select("doc_id", F.lit("string").alias("form"), "artist", "genre")
    return first.unionByName(clean.normalise_schema(listed).select(
        "doc_id", F.lit("array").alias("form"), "artist", "genre"))


PRIMARY_ARTISTS = f"""
WITH {ARTIST_FORMS}
SELECT doc_id, 'string' AS form, CASE kind WHEN 0 THEN source WHEN 1 THEN '[' || source || ']'
  WHEN 2 THEN source || ' ;' || lang || ';  x' WHEN 3 THEN NULL WHEN 4 THEN lang ELSE '[]' END AS artist,
  CAST(NULL AS VARCHAR) AS genre FROM forms
UNION ALL
SELECT doc_id, 'array', CASE kind WHEN 0 THEN '[''' || source || ''', "' || lang || '"]' WHEN 1 THEN '[' || source || ']'
  WHEN 2 THEN source WHEN 3 THEN '' WHEN 4 THEN lang ELSE '[]' END, NULL FROM forms"""


def artist_track_keys(spark, d):
    key = text.artist_track_key(F.col("artist_name"), F.col("track_name"))
    return dirty(spark, d).groupBy(key.alias("artist_track_key")).agg(F.count(F.lit(1)).alias("rows"))


ARTIST_TRACK_KEYS = f"""
WITH {DIRTY} SELECT lower(trim(artist_name)) || '||' || lower(trim(track_name)) AS artist_track_key, count(*) AS rows
FROM dirty GROUP BY 1"""


# --- quality -------------------------------------------------------------------

def invalid_counts(spark, d):
    return quality.invalid_counts(dirty(spark, d))


INVALID_COUNTS = f"WITH {DIRTY} " + union_counts(
    "dirty", [("invalid", c, f"count(*) FILTER (WHERE {m})") for c, m in INVALID.items()])


def invalid_to_null(spark, d):
    return valid(spark, d).select("row_id", *INVALID)


INVALID_TO_NULL = f"WITH {DIRTY}, {VALID} SELECT row_id, {', '.join(INVALID)} FROM valid"


def default_fills(spark, d):
    rows = dirty(spark, d)
    return quality.fill_defaults(rows).groupBy("explicit").agg(F.count(F.lit(1)).alias("rows"))


DEFAULT_FILLS = f"WITH {DIRTY} SELECT coalesce(explicit, 0) AS explicit, count(*) AS rows FROM dirty GROUP BY 1"


def table_profile(spark, d):
    return quality.profile(dirty(spark, d).select(*RAW_TRACK_COLUMNS))


def profile_items(source_columns=RAW_TRACK_COLUMNS):
    return [
        ("rows", "", "count(*)"), ("columns", "", str(len(source_columns))),
        *[("nulls", c, f"count(*) - count({c})") for c in source_columns],
        *[("invalid", c, f"count(*) FILTER (WHERE {m})") for c, m in INVALID.items()],
        ("duplicate_track_ids", "", "count(track_id) - count(DISTINCT track_id)"),
        ("distinct_track_ids", "", "count(DISTINCT track_id)"),
    ]


TABLE_PROFILE = f"WITH {DIRTY} " + union_counts("dirty", profile_items()).replace("CAST(17 AS", "CAST(max(17) AS")


def missing_flags(spark, d):
    return flagged(spark, d).select("row_id", *[F.col(f"{c}_missing").cast("int") for c in MODELLED_COLUMNS])


MISSING_FLAGS = f"WITH {DIRTY}, {VALID}, {FLAGGED} SELECT row_id, " + ", ".join(
    f"{c}_missing" for c in MODELLED_COLUMNS) + " FROM flagged"


def float32_features(spark, d):
    return clean.to_float32(valid(spark, d).select("row_id", *MODELLED_COLUMNS)).select(
        "row_id", *[F.col(c).cast("double") for c in MODELLED_COLUMNS])


FLOAT32_FEATURES = f"WITH {DIRTY}, {VALID} SELECT row_id, " + ", ".join(
    f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in MODELLED_COLUMNS) + " FROM valid"


# --- fills ---------------------------------------------------------------------

PASS1 = fill_ctes("valid", "track_id", fill.BY_TRACK_ID, "p1")
KEYED = "keyed AS (SELECT *, lower(trim(artist_name)) || '||' || lower(trim(track_name)) AS k FROM p1)"
PASS2 = fill_ctes("keyed", "k", fill.BY_ARTIST_TRACK, "p2",
                  ", " + ", ".join(f"s.p1_m_{c} AS p1_m_{c}" for c in fill.BY_TRACK_ID))
FILLS = f"WITH {DIRTY}, {VALID}, {PASS1}, {KEYED}, {PASS2}"
_ALL = ", ".join(["row_id", *RAW_TRACK_COLUMNS])


def unique_fill_values(spark, d):
    return fill.unique_values(valid(spark, d), "track_id", fill.BY_TRACK_ID)


UNIQUE_FILL_VALUES = f"WITH {DIRTY}, {VALID}, {PASS1} SELECT track_id, " + ", ".join(
    f"f_{c} AS _fill_{c}" for c in fill.BY_TRACK_ID) + " FROM p1_lookup"


def fill_by_track_id(spark, d):
    return fill.fill_by_track_id(valid(spark, d)).select("row_id", *RAW_TRACK_COLUMNS)


def deterministic_fill(spark, d):
    return fill.deterministic_fill(valid(spark, d)).select("row_id", *RAW_TRACK_COLUMNS)


def fill_counts(spark, d):
    return fill.fill_counts(fill.deterministic_fill(valid(spark, d), marks=True))


_FILL_ITEMS = [("fill_track_id", c, f"sum(p1_m_{c})") for c in fill.BY_TRACK_ID] + [
    ("fill_artist_track", c, f"sum(p2_m_{c})") for c in fill.BY_ARTIST_TRACK]


def pre_imputation_table(spark, d):
    return cleaning.pre_imputation(dirty(spark, d)).table.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"n_{c}") for c in RAW_TRACK_COLUMNS if c != "track_id"],
        *[F.round(F.sum(c), 4).alias(f"sum_{c}") for c in ("duration_ms", "explicit", "key", "mode")])


PRE_IMPUTATION_TABLE = f"""{FILLS}, done AS (SELECT * REPLACE (coalesce(explicit, 0) AS explicit) FROM p2)
SELECT track_id, count(*) AS rows, {', '.join(f'count({c}) AS n_{c}' for c in RAW_TRACK_COLUMNS if c != 'track_id')},
{', '.join(f'round(sum({c}), 4) AS sum_{c}' for c in ('duration_ms', 'explicit', 'key', 'mode'))}
FROM done GROUP BY track_id"""


def pre_imputation_report(spark, d):
    return cleaning.pre_imputation(dirty(spark, d)).report


def _staged(stage, sql):
    return f"SELECT '{stage}' AS stage, * FROM ({sql})"


PRE_IMPUTATION_REPORT = f"""{FILLS}, done AS (SELECT * REPLACE (coalesce(explicit, 0) AS explicit) FROM p2)
""" + " UNION ALL ".join([
    _staged("raw", union_counts("dirty", profile_items()).replace("CAST(17 AS", "CAST(max(17) AS")),
    _staged("invalid_to_null", union_counts(
        "dirty", [("invalid", c, f"count(*) FILTER (WHERE {m})") for c, m in INVALID.items()])),
    _staged("deterministic_fill", union_counts("p2", _FILL_ITEMS)),
    _staged("default_fill", union_counts("p2", [("default_fill", "explicit", "count(*) - count(explicit)")])),
    _staged("final", union_counts("done", profile_items()).replace("CAST(17 AS", "CAST(max(17) AS")),
])


# --- dedupe and final form -----------------------------------------------------

_PRESENT = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in RAW_TRACK_COLUMNS)


def most_complete_tracks(spark, d):
    return clean.keep_most_complete(valid(spark, d), ["row_id"]).select("row_id", *RAW_TRACK_COLUMNS)


MOST_COMPLETE_TRACKS = f"""WITH {DIRTY}, {VALID},
best AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY {_PRESENT} DESC, row_id) AS rn FROM valid)
SELECT {_ALL} FROM best WHERE rn = 1 OR track_id IS NULL"""


def zero_signal_dropped(spark, d):
    """A narrow feature set, so that some rows do lack every predictor."""
    kept = clean.drop_zero_signal(valid(spark, d), "energy", ["valence", "tempo"])
    return clean.drop_blank_tracks(kept).select("row_id", "energy", "valence", "tempo")


ZERO_SIGNAL_DROPPED = f"""WITH {DIRTY}, {VALID} SELECT row_id, energy, valence, tempo FROM valid
WHERE NOT (energy IS NULL AND valence IS NULL AND tempo IS NULL) AND trim(track_name) <> ''"""


def consolidated_tracks(spark, d):
    return cleaning.consolidate(flagged(spark, d), ["row_id"]).select("row_id", "track_id", "energy")


_FLAGS_PRESENT = f"{_PRESENT} + {len(MODELLED_COLUMNS)}"
CONSOLIDATED_TRACKS = f"""WITH {DIRTY}, {VALID},
kept AS (SELECT * FROM valid WHERE NOT (energy IS NULL AND {' AND '.join(
    f'{c} IS NULL' for c in MODELLED_COLUMNS if c != 'energy')}) AND trim(track_name) <> ''),
best AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY {_FLAGS_PRESENT} DESC, row_id) AS rn FROM kept)
SELECT row_id, track_id, energy FROM best WHERE rn = 1 OR track_id IS NULL"""


def _finished(spark, d):
    rows = valid(spark, d)
    wrapped = F.when(F.substring("row_id", -1, 1) == "1", F.concat(F.lit("['"), "artist_name", F.lit("']"))).otherwise(
        F.col("artist_name"))
    return rows.na.fill(0.0, ["key", "mode"]).withColumn("artist_name", wrapped)


_FINISHED = f"""WITH {DIRTY}, {VALID}, done AS (SELECT * REPLACE (coalesce(key, 0) AS key, coalesce(mode, 0) AS mode) FROM valid)"""


def final_storage(spark, d):
    done = clean.postprocess_final(_finished(spark, d))
    assert done.schema["key"].dataType == T.ByteType()
    return done.select("row_id", "artist_name", "track_id", F.col("key").cast("int"), F.col("mode").cast("int"))


FINAL_STORAGE = f"""{_FINISHED} SELECT row_id, artist_name, track_id, CAST(key AS INT) AS key, CAST(mode AS INT) AS mode
FROM done"""


def postprocess_report(spark, d):
    before = _finished(spark, d)
    return clean.postprocess_report(before, clean.postprocess_final(before))


POSTPROCESS_REPORT = f"""{_FINISHED}
SELECT 'artist_name_full_bracket_wrappers_before' AS metric,
       count(*) FILTER (WHERE artist_name IS NOT NULL AND substr(row_id, -1, 1) = '1') AS value FROM done
UNION ALL SELECT 'rows', count(*) FROM done
UNION ALL SELECT 'artist_name_nulls', count(*) - count(artist_name) FROM done
UNION ALL SELECT 'artist_name_full_bracket_wrappers_after', 0"""


# --- graph input ----------------------------------------------------------------

_GRAPH_COLUMNS = ["artist", "track_name", "genre", "danceability", "energy", "tempo", "valence", "popularity"]

GRAPH_SONGS = """
gin AS (
  SELECT p_name AS track_name, p_brand AS artist, p_type AS genre,
         CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_size AS DOUBLE) END AS popularity,
         (p_partkey * 7919 % 1009) / 1008 AS danceability,
         CASE WHEN p_partkey % 37 <> 0 THEN (p_partkey * 104729 % 997) / 996 END AS energy,
         60 + p_partkey * 1299709 % 1201 / 10 AS tempo,
         CASE WHEN p_partkey % 41 <> 0 THEN (p_partkey * 15485863 % 991) / 990 END AS valence,
         p_partkey AS ord FROM part),
gfirst AS (SELECT *, row_number() OVER (PARTITION BY artist, track_name ORDER BY ord) AS rn FROM gin
           WHERE artist <> '' AND track_name <> ''),
gsongs AS (SELECT * FROM gfirst WHERE rn = 1)"""


def graph_songs(spark, d, max_songs=None):
    return clean.clean_songs(clean.normalise_schema(graph_input(spark, d)), max_songs, ["ord"])


def clean_songs(spark, d):
    return graph_songs(spark, d).select(*_GRAPH_COLUMNS)


CLEAN_SONGS = f"WITH {GRAPH_SONGS} SELECT {', '.join(_GRAPH_COLUMNS)} FROM gsongs"


def capped_songs(spark, d):
    """The 500 most popular songs: the cap is the feature."""
    return graph_songs(spark, d, 500).select(*_GRAPH_COLUMNS)


CAPPED_SONGS = f"""WITH {GRAPH_SONGS} SELECT {', '.join(_GRAPH_COLUMNS)} FROM gsongs
ORDER BY popularity DESC NULLS LAST, {hash32_sql("(artist || chr(31) || track_name)")},
artist || chr(31) || track_name LIMIT 500"""


def sampled_songs(spark, d):
    """A load sample of 1000 songs in hash order: the limit is the feature."""
    return clean.seeded_sample(catalogue_source(spark, d), F.col("track_id"), 1000)


SAMPLED_SONGS = f"""SELECT CAST(p_partkey AS VARCHAR) AS track_id, p_name AS track_name, p_brand AS artist_name,
p_type AS genre FROM part ORDER BY {hash32_sql("CAST(p_partkey AS VARCHAR)")}, CAST(p_partkey AS VARCHAR) LIMIT 1000"""


def hashed_order(spark, d):
    return dirty(spark, d).select("row_id", sampling.hash32(F.col("row_id")).alias("hash"))


HASHED_ORDER = f"WITH {DIRTY} SELECT row_id, {hash32_sql('row_id')} AS hash FROM dirty"

QUERIES = {
    "clean_text_documents": (clean_text_documents, CLEAN_TEXT_DOCUMENTS),
    "joined_artist_names": (joined_artist_names, JOINED_ARTIST_NAMES),
    "primary_artists": (primary_artists, PRIMARY_ARTISTS),
    "artist_track_keys": (artist_track_keys, ARTIST_TRACK_KEYS),
    "invalid_counts": (invalid_counts, INVALID_COUNTS),
    "invalid_to_null": (invalid_to_null, INVALID_TO_NULL),
    "default_fills": (default_fills, DEFAULT_FILLS),
    "table_profile": (table_profile, TABLE_PROFILE),
    "missing_flags": (missing_flags, MISSING_FLAGS),
    "float32_features": (float32_features, FLOAT32_FEATURES),
    "unique_fill_values": (unique_fill_values, UNIQUE_FILL_VALUES),
    "fill_by_track_id": (fill_by_track_id, f"WITH {DIRTY}, {VALID}, {PASS1} SELECT {_ALL} FROM p1"),
    "deterministic_fill": (deterministic_fill, f"{FILLS} SELECT {_ALL} FROM p2"),
    "fill_counts": (fill_counts, f"{FILLS} " + union_counts("p2", _FILL_ITEMS)),
    "pre_imputation_table": (pre_imputation_table, PRE_IMPUTATION_TABLE),
    "pre_imputation_report": (pre_imputation_report, PRE_IMPUTATION_REPORT),
    "most_complete_tracks": (most_complete_tracks, MOST_COMPLETE_TRACKS),
    "zero_signal_dropped": (zero_signal_dropped, ZERO_SIGNAL_DROPPED),
    "consolidated_tracks": (consolidated_tracks, CONSOLIDATED_TRACKS),
    "final_storage": (final_storage, FINAL_STORAGE),
    "postprocess_report": (postprocess_report, POSTPROCESS_REPORT),
    "clean_songs": (clean_songs, CLEAN_SONGS),
    "capped_songs": (capped_songs, CAPPED_SONGS),
    "sampled_songs": (sampled_songs, SAMPLED_SONGS),
    "hashed_order": (hashed_order, HASHED_ORDER),
}
