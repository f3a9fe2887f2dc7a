"""Catalogue loading and integrity queries."""

import uuid

from pyspark.sql import functions as F

from trackloom.operators import ingest
from trackloom.plans.catalogue import load_catalogue
from trackloom.session import cut_lineage, shared_folder
from trackloom.sources import io
from trackloom.sources.adapters import catalogue_source, similar_wide, table

SONGS = """songs AS (SELECT CAST(p_partkey AS VARCHAR) AS song_id, p_name AS song_name, p_brand AS artist_name,
  p_type AS genre FROM part)"""
EDGES = """edges AS (SELECT CAST(p_partkey AS VARCHAR) AS source_song_id,
  CAST((p_partkey * 31 + r * 17) % (SELECT count(*) FROM part) AS VARCHAR) AS target_song_id, CAST(r AS INT) AS neighbor_rank
  FROM part, (SELECT unnest(range(1, 6)) AS r))"""
CATALOGUE = f"WITH {SONGS}, {EDGES}"

# A damaged copy: ids repeat and go missing, ranks, targets and labels break.
BROKEN = f"""{CATALOGUE},
bsongs AS (SELECT * FROM songs WHERE CAST(song_id AS BIGINT) % 50 <> 7
  UNION ALL SELECT song_id, song_name || '!', artist_name, NULL FROM songs WHERE CAST(song_id AS BIGINT) % 40 = 3),
bedges AS (SELECT source_song_id, CASE WHEN CAST(source_song_id AS BIGINT) % 30 = 4 AND neighbor_rank = 2
    THEN source_song_id WHEN CAST(source_song_id AS BIGINT) % 30 = 5 THEN 'x' || target_song_id
    WHEN CAST(source_song_id AS BIGINT) % 60 = 9 THEN '1' ELSE target_song_id END AS target_song_id,
  CASE WHEN CAST(source_song_id AS BIGINT) % 70 = 6 THEN neighbor_rank + 1
       WHEN CAST(source_song_id AS BIGINT) % 80 = 8 THEN 1 ELSE neighbor_rank END AS neighbor_rank
  FROM edges WHERE NOT (CAST(source_song_id AS BIGINT) % 20 = 1 AND neighbor_rank = 4))"""


def songs(spark, d):
    return ingest.songs_from_source(catalogue_source(spark, d))


def edges(spark, d):
    return ingest.neighbours_from_wide(similar_wide(spark, d))


def broken(spark, d):
    good, links = songs(spark, d), edges(spark, d)
    number = F.col("song_id").cast("bigint")
    bad = good.where(number % 50 != 7).unionByName(
        good.where(number % 40 == 3).withColumns({"song_name": F.concat("song_name", F.lit("!")),
                                                   "genre": F.lit(None).cast("string")}))
    source, rank = F.col("source_song_id").cast("bigint"), F.col("neighbor_rank")
    target = (F.when((source % 30 == 4) & (rank == 2), F.col("source_song_id"))
              .when(source % 30 == 5, F.concat(F.lit("x"), "target_song_id"))
              .when(source % 60 == 9, F.lit("1")).otherwise(F.col("target_song_id")))
    ranks = F.when(source % 70 == 6, rank + 1).when(source % 80 == 8, 1).otherwise(rank)
    links = links.where(~((source % 20 == 1) & (rank == 4))).select(
        "source_song_id", target.alias("target_song_id"), ranks.alias("neighbor_rank"))
    return bad, links


def _messy_source(spark, d):
    """Catalogue rows with blanks, long ids and repeated ids, from the documents."""
    docs = table(spark, d, "documents")
    n = F.col("doc_id")
    return docs.select(
        F.when(n % 9 == 0, F.lit("  ")).when(n % 9 == 1, F.repeat(F.concat(n.cast("string"), F.lit("-")), 60))
        .otherwise(F.concat(F.lit(" "), (n % 400).cast("string"))).alias("track_id"),
        F.when(n % 31 == 0, F.lit(None)).otherwise(F.col("text")).alias("track_name"),
        F.when(n % 4 == 0, F.lit("")).otherwise(F.col("source")).alias("artist_name"),
        F.when(n % 5 == 0, F.lit(None)).otherwise(F.col("lang")).alias("genre"), "doc_id")


def ingested_songs(spark, d):
    found = ingest.songs_from_source(_messy_source(spark, d), ["doc_id"])
    return found.withColumn("song_name", F.md5("song_name"))


INGESTED_SONGS = r"""
WITH messy AS (SELECT CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 9 = 1 THEN repeat(doc_id || '-', 60)
    ELSE CAST(doc_id % 400 AS VARCHAR) END AS song_id,
  CASE WHEN doc_id % 31 = 0 THEN '' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS song_name,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS artist_name,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS genre, doc_id FROM documents),
cut AS (SELECT substr(song_id, 1, 128) AS song_id, substr(song_name, 1, 512) AS song_name,
  CASE WHEN artist_name = '' THEN 'Unknown' ELSE artist_name END AS artist_name,
  CASE WHEN genre = '' THEN 'Unknown' ELSE genre END AS genre, doc_id FROM messy),
firsts AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY doc_id) AS rn FROM cut
  WHERE song_id <> '' AND song_name <> '')
SELECT song_id, md5(song_name) AS song_name, artist_name, genre FROM firsts WHERE rn = 1"""


def ingested_neighbours(spark, d):
    return edges(spark, d)


def wide_neighbours(spark, d):
    return ingest.wide_from_neighbours(edges(spark, d))


WIDE_NEIGHBOURS = f"""{CATALOGUE} SELECT source_song_id AS track_id, {', '.join(
    f'max(CASE WHEN neighbor_rank = {r} THEN target_song_id END) AS sim_song_{r}' for r in range(1, 6))}
FROM edges GROUP BY source_song_id"""


def frame_violations(spark, d):
    return ingest.frame_violations(*broken(spark, d))


FRAME_VIOLATIONS = f"""{BROKEN}
SELECT 1 AS position, 'duplicate_song_ids' AS "check", count(*) - count(DISTINCT song_id) AS violations FROM bsongs
UNION ALL SELECT 2, 'incomplete_ranks', count(*) FROM (SELECT 1 FROM bedges GROUP BY source_song_id
  HAVING count(DISTINCT neighbor_rank) <> 5)
UNION ALL SELECT 3, 'missing_sources', count(DISTINCT source_song_id) FROM bedges
  WHERE source_song_id NOT IN (SELECT song_id FROM bsongs)
UNION ALL SELECT 4, 'missing_targets', count(DISTINCT target_song_id) FROM bedges
  WHERE target_song_id NOT IN (SELECT song_id FROM bsongs)
UNION ALL SELECT 5, 'self_loops', count(*) FROM bedges WHERE source_song_id = target_song_id"""


def load_stats(spark, d):
    return ingest.load_stats(*broken(spark, d))


LOAD_STATS = f"""{BROKEN} SELECT 'songs_loaded' AS metric, count(*) AS value FROM bsongs
UNION ALL SELECT 'neighbor_edges_loaded', count(*) FROM bedges
UNION ALL SELECT 'unique_neighbor_sources', count(DISTINCT source_song_id) FROM bedges"""


def table_constraints(spark, d):
    return ingest.check_constraints(*broken(spark, d))


TABLE_CONSTRAINTS = f"""{BROKEN}
SELECT 1 AS position, 'songs_primary_key' AS "constraint", count(*) - count(DISTINCT song_id) AS violations FROM bsongs
UNION ALL SELECT 2, 'songs_not_null', count(*) FILTER (WHERE song_id IS NULL OR song_name IS NULL
  OR artist_name IS NULL OR genre IS NULL) FROM bsongs
UNION ALL SELECT 3, 'songs_length', count(*) FILTER (WHERE length(song_name) > 512) FROM bsongs
UNION ALL SELECT 4, 'neighbours_primary_key', count(*) - count(DISTINCT (source_song_id, neighbor_rank)) FROM bedges
UNION ALL SELECT 5, 'neighbours_unique_target', count(*) - count(DISTINCT (source_song_id, target_song_id)) FROM bedges
UNION ALL SELECT 6, 'neighbours_not_null', 0
UNION ALL SELECT 7, 'neighbours_rank_range', count(*) FILTER (WHERE neighbor_rank NOT BETWEEN 1 AND 5) FROM bedges
UNION ALL SELECT 8, 'neighbours_not_self', count(*) FILTER (WHERE source_song_id = target_song_id) FROM bedges
UNION ALL SELECT 9, 'neighbours_source_exists', count(*) FROM bedges
  WHERE source_song_id NOT IN (SELECT song_id FROM bsongs)
UNION ALL SELECT 10, 'neighbours_target_exists', count(*) FROM bedges
  WHERE target_song_id NOT IN (SELECT song_id FROM bsongs)"""


def _deleted(spark, d):
    """Delete the songs whose id ends in 3; those that others point to are refused.
    Each song has a twin that points to it and that nothing points to."""
    twin = F.concat(F.lit("x"), "song_id")
    every = songs(spark, d).unionByName(songs(spark, d).withColumn("song_id", twin))
    links = edges(spark, d).unionByName(songs(spark, d).select(
        twin.alias("source_song_id"), F.col("song_id").alias("target_song_id"), F.lit(1).alias("neighbor_rank")))
    return ingest.delete_songs(every, links, every.where(F.col("song_id").endswith("3")).select("song_id"))


DELETED = f"""{CATALOGUE.replace('WITH', 'WITH RECURSIVE', 1)}, xsongs AS (SELECT * FROM songs UNION ALL SELECT 'x' || song_id, song_name, artist_name, genre FROM songs),
xedges AS (SELECT * FROM edges UNION ALL SELECT 'x' || song_id, song_id, 1 FROM songs),
wanted AS (SELECT song_id FROM xsongs WHERE song_id LIKE '%3'),
stay AS (
  SELECT target_song_id AS song_id FROM xedges
  WHERE source_song_id NOT IN (SELECT song_id FROM wanted) AND target_song_id IN (SELECT song_id FROM wanted)
  UNION
  SELECT target_song_id FROM xedges JOIN stay ON source_song_id = stay.song_id
  WHERE target_song_id IN (SELECT song_id FROM wanted)),
refused AS (SELECT target_song_id AS song_id, count(*) AS incoming_edges FROM xedges
  WHERE target_song_id IN (SELECT song_id FROM stay)
    AND (source_song_id NOT IN (SELECT song_id FROM wanted) OR source_song_id IN (SELECT song_id FROM stay))
  GROUP BY target_song_id),
gone AS (SELECT song_id FROM wanted WHERE song_id NOT IN (SELECT song_id FROM refused))"""


def _loaded(spark, d, engine):
    """Write sources as files, run the load, read the stored copy back."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    songs_path, wide_path = f"{folder}/songs", f"{folder}/similar"
    io.write_table(catalogue_source(spark, d), songs_path)
    similar_wide(spark, d).write.mode("overwrite").option("header", True).csv(wide_path)
    report = load_catalogue(spark, songs_path, wide_path, f"{folder}/catalogue", engine=engine)
    stored_songs, stored_edges = io.catalogue(spark, f"{folder}/catalogue", stage=True)
    return cut_lineage(report), stored_songs, stored_edges


def catalogue_load_report(spark, d):
    return _loaded(spark, d, "parquet")[0]


CATALOGUE_LOAD_REPORT = f"""{CATALOGUE} SELECT 'songs_in_frame' AS metric, count(*) AS value FROM songs
UNION ALL SELECT 'neighbor_edges_in_frame', count(*) FROM edges
UNION ALL SELECT 'songs_loaded', count(*) FROM songs
UNION ALL SELECT 'neighbor_edges_loaded', count(*) FROM edges
UNION ALL SELECT 'unique_neighbor_sources', count(DISTINCT source_song_id) FROM edges"""


def _stored(spark, d, engine):
    _, kept, links = _loaded(spark, d, engine)
    return links.join(kept, F.col("source_song_id") == F.col("song_id")).select(
        "song_id", "song_name", "artist_name", "genre", "target_song_id", "neighbor_rank")


STORED = f"""{CATALOGUE} SELECT song_id, song_name, artist_name, genre, target_song_id, neighbor_rank
FROM edges JOIN songs ON source_song_id = song_id"""

QUERIES = {
    "ingested_songs": (ingested_songs, INGESTED_SONGS),
    "ingested_neighbours": (ingested_neighbours, f"{CATALOGUE} SELECT * FROM edges"),
    "wide_neighbours": (wide_neighbours, WIDE_NEIGHBOURS),
    "frame_violations": (frame_violations, FRAME_VIOLATIONS),
    "load_stats": (load_stats, LOAD_STATS),
    "table_constraints": (table_constraints, TABLE_CONSTRAINTS),
    "delete_songs_left": (lambda s, d: _deleted(s, d)[0],
                          f"{DELETED} SELECT * FROM xsongs WHERE song_id NOT IN (SELECT song_id FROM gone)"),
    "delete_edges_left": (lambda s, d: _deleted(s, d)[1],
                          f"{DELETED} SELECT * FROM xedges WHERE source_song_id NOT IN (SELECT song_id FROM gone)"),
    "delete_refused": (lambda s, d: _deleted(s, d)[2], f"{DELETED} SELECT * FROM refused"),
    "catalogue_load_report": (catalogue_load_report, CATALOGUE_LOAD_REPORT),
    "stage_catalogue": (lambda s, d: _stored(s, d, "parquet"), STORED),
    "bulk_catalogue": (lambda s, d: _stored(s, d, "bulk"), STORED),
}
