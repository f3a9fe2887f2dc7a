"""Catalogue loading and integrity checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators.skew import first_per_key
from trackloom.schemas import (
    ARTIST_NAME_LENGTH, GENRE_LENGTH, NEIGHBOURS_PER_SONG, SIMILAR_COLUMNS,
    SONG_ID_LENGTH, SONG_NAME_LENGTH, UNKNOWN_LABEL,
)
from trackloom.session import cut_lineage


def _clipped(c: str, length: int) -> Column:
    return F.substring(text.strip_or_empty(F.col(c)), 1, length)


def _or_unknown(c: Column) -> Column:
    return F.when(c == "", UNKNOWN_LABEL).otherwise(c)


def songs_from_source(source: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Catalogue songs; the first row per id under ``order`` (columns of source)."""
    order = order or []
    songs = source.select(
        _clipped("track_id", SONG_ID_LENGTH).alias("song_id"),
        _clipped("track_name", SONG_NAME_LENGTH).alias("song_name"),
        _or_unknown(_clipped("artist_name", ARTIST_NAME_LENGTH)).alias("artist_name"),
        _or_unknown(_clipped("genre", GENRE_LENGTH)).alias("genre"),
        *order,
    ).where((F.col("song_id") != "") & (F.col("song_name") != ""))
    by = order or ["song_name", "artist_name", "genre"]
    return first_per_key(songs, ["song_id"], [F.col(c) for c in by]).drop(*order)


def neighbours_from_wide(wide: DataFrame) -> DataFrame:
    """One row per (source, target, rank) from the five neighbour columns."""
    ids = wide.select(_clipped("track_id", SONG_ID_LENGTH).alias("source_song_id"),
                      F.array(*[_clipped(c, SONG_ID_LENGTH) for c in SIMILAR_COLUMNS]).alias("targets"))
    return (
        ids.where(F.col("source_song_id") != "")
        .select("source_song_id", F.posexplode("targets").alias("pos", "target_song_id"))
        .where(F.col("target_song_id") != "")
        .select("source_song_id", "target_song_id", (F.col("pos") + 1).cast("int").alias("neighbor_rank"))
    )


def wide_from_neighbours(edges: DataFrame, k: int = NEIGHBOURS_PER_SONG) -> DataFrame:
    """The wide table that ``neighbours_from_wide`` reads."""
    return edges.groupBy(F.col("source_song_id").alias("track_id")).agg(*[
        F.max(F.when(F.col("neighbor_rank") == r, F.col("target_song_id"))).alias(f"sim_song_{r}")
        for r in range(1, k + 1)])


def _repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violations"))


def _absent(df: DataFrame, column: str, songs: DataFrame, measure: Column) -> DataFrame:
    """``measure`` over the ids of ``column`` that are not songs. Edges first
    shrink to one row per id, so a hot id costs no more than a rare one."""
    ids = df.groupBy(F.col(column).alias("song_id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.join(songs.select("song_id"), "song_id", "left_anti").agg(
        F.coalesce(measure, F.lit(0)).cast("bigint").alias("violations"))


def _labelled(parts: list[tuple[str, DataFrame]], column: str) -> DataFrame:
    out = None
    for position, (name, counted) in enumerate(parts, 1):
        row = counted.select(F.lit(position).alias("position"), F.lit(name).alias(column), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def _count_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).cast("bigint").alias("violations"))


def frame_violations(songs: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, check, violations): the load checks in the order they are raised."""
    ranks = edges.groupBy("source_song_id").agg(F.count_distinct("neighbor_rank").alias("ranks"))
    distinct_ids = F.count(F.lit(1))
    return _labelled([
        ("duplicate_song_ids", _repeats(songs, ["song_id"])),
        ("incomplete_ranks", _count_where(ranks, F.col("ranks") != NEIGHBOURS_PER_SONG)),
        ("missing_sources", _absent(edges, "source_song_id", songs, distinct_ids)),
        ("missing_targets", _absent(edges, "target_song_id", songs, distinct_ids)),
        ("self_loops", _count_where(edges, F.col("source_song_id") == F.col("target_song_id"))),
    ], "check")


# What each failed check reports.
_MESSAGES = {
    "duplicate_song_ids": "Duplicate song_id values found in songs frame: {}",
    "incomplete_ranks": "Neighbor ranks are incomplete for {} source songs.",
    "missing_sources": "Found {} source song IDs missing from songs metadata.",
    "missing_targets": "Found {} target song IDs missing from songs metadata.",
    "self_loops": "Found {} self-loop neighbor edges.",
}


def validate_frames(songs: DataFrame, edges: DataFrame) -> None:
    """Raise for the first failed check."""
    for row in sorted(frame_violations(songs, edges).collect()):  # five rows
        if row["violations"]:
            raise ValueError(_MESSAGES[row["check"]].format(row["violations"]))


def load_stats(songs: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): songs, edges and distinct sources."""
    per_source = edges.groupBy("source_song_id").agg(F.count(F.lit(1)).alias("n"))
    counted = per_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("neighbor_edges_loaded"),
        F.count(F.lit(1)).alias("unique_neighbor_sources"))
    return songs.agg(F.count(F.lit(1)).alias("value")).select(F.lit("songs_loaded").alias("metric"), "value").unionByName(
        counted.unpivot([], counted.columns, "metric", "value"))


def check_constraints(songs: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, constraint, violations) for every declared table constraint."""
    rows = F.sum("n")
    song_columns = ["song_id", "song_name", "artist_name", "genre"]
    edge_columns = ["source_song_id", "target_song_id", "neighbor_rank"]
    limits = {"song_id": SONG_ID_LENGTH, "song_name": SONG_NAME_LENGTH,
              "artist_name": ARTIST_NAME_LENGTH, "genre": GENRE_LENGTH}
    null_song = _count_where(songs, ~F.equal_null(F.greatest(*[F.col(c).isNull() for c in song_columns]), F.lit(False)))
    null_edge = _count_where(edges, ~F.equal_null(F.greatest(*[F.col(c).isNull() for c in edge_columns]), F.lit(False)))
    too_long = _count_where(songs, F.greatest(*[F.coalesce(F.length(c) > n, F.lit(False)) for c, n in limits.items()]))
    return _labelled([
        ("songs_primary_key", _repeats(songs, ["song_id"])),
        ("songs_not_null", null_song),
        ("songs_length", too_long),
        ("neighbours_primary_key", _repeats(edges, ["source_song_id", "neighbor_rank"])),
        ("neighbours_unique_target", _repeats(edges, ["source_song_id", "target_song_id"])),
        ("neighbours_not_null", null_edge),
        ("neighbours_rank_range", _count_where(edges, ~F.col("neighbor_rank").between(1, NEIGHBOURS_PER_SONG))),
        ("neighbours_not_self", _count_where(edges, F.col("source_song_id") == F.col("target_song_id"))),
        ("neighbours_source_exists", _absent(edges, "source_song_id", songs, rows)),
        ("neighbours_target_exists", _absent(edges, "target_song_id", songs, rows)),
    ], "constraint")


def delete_songs(songs: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply the delete rules to ``ids`` (column song_id).

    Returns (songs left, edges left, refused). Deleting a song removes its
    outgoing edges; a song that another, staying song points to is refused and
    stays with all its edges, so that those it points to stay too.
    """
    wanted = ids.select("song_id").distinct()
    into = cut_lineage(edges.select("source_song_id", F.col("target_song_id").alias("song_id")).join(wanted, "song_id", "left_semi"))
    asked = wanted.withColumnRenamed("song_id", "source_song_id")
    staying = cut_lineage(into.join(asked, "source_song_id", "left_anti").select("song_id").distinct())
    added = staying
    while not added.isEmpty():  # as often as the longest chain of links inside what is asked
        reached = into.join(added.withColumnRenamed("song_id", "source_song_id"), "source_song_id", "left_semi")
        added = cut_lineage(reached.select("song_id").distinct().join(staying, "song_id", "left_anti"))
        staying = cut_lineage(staying.union(added))
    gone = wanted.join(staying, "song_id", "left_anti")
    refused = (
        into.join(gone.withColumnRenamed("song_id", "source_song_id"), "source_song_id", "left_anti")
        .join(staying, "song_id", "left_semi").groupBy("song_id").agg(F.count(F.lit(1)).alias("incoming_edges")))
    return (
        songs.join(gone, "song_id", "left_anti"),
        edges.join(gone.withColumnRenamed("song_id", "source_song_id"), "source_song_id", "left_anti"),
        refused,
    )
