"""Catalogue load: read, check, store."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import ingest
from trackloom.session import cut_lineage
from trackloom.sources import io


def load_catalogue(spark: SparkSession, songs_path: str, similar_path: str, root: str, validate_only: bool = False,
                   engine: str = "parquet", order: list[str] | None = None) -> DataFrame:
    """Songs (Parquet) and wide neighbours (CSV) into the stage copy.

    Raises on the first failed check. Returns (metric, value) counts, those of
    the frames and, after a load, those of the stored copy.
    """
    songs = cut_lineage(ingest.songs_from_source(io.read_catalogue_source(spark, songs_path), order))
    edges = cut_lineage(ingest.neighbours_from_wide(io.read_similar_wide(spark, similar_path)))
    ingest.validate_frames(songs, edges)
    frames = ingest.load_stats(songs, edges).where(F.col("metric") != "unique_neighbor_sources").select(
        F.when(F.col("metric") == "songs_loaded", "songs_in_frame").otherwise("neighbor_edges_in_frame").alias("metric"),
        "value")
    if validate_only:
        return frames
    io.write_catalogue(songs, edges, root, stage=True, engine=engine)
    stored = ingest.load_stats(*io.catalogue(spark, root, stage=True))
    return frames.unionByName(stored)
