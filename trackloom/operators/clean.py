"""Row cleaning: schema normalisation, text, casts, dedupe, caps."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import sampling, text
from trackloom.operators.skew import first_per_key
from trackloom.schemas import (
    CLASS_TARGETS, GRAPH_NUMERIC_COLUMNS, GRAPH_TEXT_COLUMNS, IDENTITY_COLUMNS,
    MODELLED_COLUMNS, SEED, TEXT_COLUMNS,
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing: NaN becomes null in every floating column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def normalise_schema(df: DataFrame) -> DataFrame:
    """Accept both spellings of the input columns; add the optional ones as null."""
    df = df.withColumnsRenamed({"name": "track_name", "track_genre": "genre"})
    if "artist" not in df.columns and "artists" in df.columns:
        df = df.withColumn("artist", text.primary_artist(F.col("artists"), df.schema["artists"].dataType))
    if "genre" not in df.columns:
        df = df.withColumn("genre", F.lit(None).cast("string"))
    if "popularity" not in df.columns:
        df = df.withColumn("popularity", F.lit(None).cast("double"))
    return df


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"Dataset is missing required columns: {', '.join(missing)}")
    return df


def keep_known_columns(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    known = [c for c in GRAPH_TEXT_COLUMNS + GRAPH_NUMERIC_COLUMNS if c in df.columns]
    return df.select(*known, *extra)


def trim_text(df: DataFrame) -> DataFrame:
    def tidy(c: str) -> Column:
        stripped = text.strip_or_empty(F.col(c))
        return F.when(stripped == "nan", "").otherwise(stripped)

    return df.withColumns({c: tidy(c) for c in GRAPH_TEXT_COLUMNS if c in df.columns})


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.where((F.col("artist") != "") & (F.col("track_name") != ""))


def first_per_track(df: DataFrame, order: list[Column]) -> DataFrame:
    """One row per (artist, track_name): the first under ``order``."""
    return first_per_key(df, ["artist", "track_name"], order)


def cap_songs(df: DataFrame, max_songs: int | None, seed: int = SEED) -> DataFrame:
    """The most popular songs, missing popularity last.

    Equal popularity goes by a seeded hash of the name, so a table with no
    popularity at all yields a seeded random sample from the same plan.
    """
    if max_songs is None:
        return df
    name = F.concat_ws("\x1f", "artist", "track_name")
    by_popularity = []
    if "popularity" in df.columns:
        popularity = F.col("popularity")
        if isinstance(df.schema["popularity"].dataType, T.StringType):
            popularity = text.to_number(popularity)
        by_popularity = [popularity.desc_nulls_last()]
    return df.orderBy(*by_popularity, sampling.hash32(name, seed), name).limit(max_songs)


def seeded_sample(df: DataFrame, key: Column, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows in the order of a seeded hash of ``key``."""
    return df.orderBy(sampling.hash32(key, seed), key).limit(n)


def clean_songs(df: DataFrame, max_songs: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Graph input cleaning end to end.

    ``order`` names the columns that give the input order for keep-first; by
    default all kept columns decide, which is repeatable but not file order.
    """
    require_columns(df, ["artist", "track_name"])
    kept = keep_known_columns(df, tuple(c for c in order or () if c not in GRAPH_TEXT_COLUMNS + GRAPH_NUMERIC_COLUMNS))
    named = drop_unnamed(trim_text(kept))
    columns = order or [c for c in named.columns if c not in ("artist", "track_name")]
    unique = first_per_track(named, [F.col(c) for c in columns])
    return cap_songs(keep_known_columns(unique), max_songs)


def to_float32(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.col(c).cast("float").alias(c) if c in doubles else F.col(c) for c in df.columns])


def normalise_identity_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: text.clean_text(F.col(c)) for c in TEXT_COLUMNS})


def add_missing_flags(df: DataFrame, columns: list[str] = MODELLED_COLUMNS) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("tinyint") for c in columns})


def drop_blank_tracks(df: DataFrame) -> DataFrame:
    return df.where(text.strip_or_empty(F.col("track_name")) != "")


def non_null_count(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def keep_most_complete(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per non-empty track_id: fewest nulls, then ``order``. Rows
    without an id all stay and are never shuffled."""
    has_id = F.coalesce(text.strip(F.col("track_id")), F.lit("")) != ""
    columns = [c for c in df.columns if c not in order]
    best = first_per_key(
        df.where(has_id), ["track_id"], [-non_null_count(columns), *[F.col(c) for c in order]])
    return best.unionByName(df.where(~has_id))


def drop_zero_signal(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Drop rows whose missing ``target`` has no predictor at all."""
    others = [c for c in features or MODELLED_COLUMNS if c != target]
    return df.where(~(F.col(target).isNull() & (non_null_count(others) == 0)))


def _to_tinyint(c: str) -> Column:
    value = F.col(c)
    return F.when(value.isNull(), F.raise_error(F.lit(f"{c} is null and cannot be stored as an integer"))).otherwise(
        value.cast("tinyint"))


def postprocess_final(df: DataFrame) -> DataFrame:
    """Storage form of the finished table; a null key or mode is an error."""
    changes = {c: F.col(c).cast("string") for c in IDENTITY_COLUMNS if c in df.columns}
    if "artist_name" in df.columns:
        changes["artist_name"] = text.joined_artists(F.col("artist_name").cast("string"))
    changes |= {c: _to_tinyint(c) for c in CLASS_TARGETS if c in df.columns}
    return df.withColumns(changes)


def bracket_wrapped(c: str) -> Column:
    return text.is_bracketed(text.strip_or_empty(F.col(c)))


def postprocess_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row, null and bracket counts of both sides as (metric, value)."""
    first = before.agg(
        F.count_if(bracket_wrapped("artist_name")).alias("artist_name_full_bracket_wrappers_before"))
    second = after.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("artist_name").isNull()).alias("artist_name_nulls"),
        F.count_if(bracket_wrapped("artist_name")).alias("artist_name_full_bracket_wrappers_after"))
    return first.unpivot([], first.columns, "metric", "value").unionByName(
        second.unpivot([], second.columns, "metric", "value"))
