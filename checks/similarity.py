"""Graph ids, nodes, edges and similarity queries."""

from pyspark.sql import functions as F

from checks.cleaning import GRAPH_SONGS, graph_songs
from trackloom.functions import text
from trackloom.operators import graph, ingest, neighbours
from trackloom.plans.graph_build import build_graph
from trackloom.session import cut_lineage
from trackloom.sources.adapters import graph_input, table, vectors

# In this data no two names share a slug, so ids are plain slugs; the documents
# below do have names that share one.
_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"
IDS = f"""WITH {GRAPH_SONGS}, ids AS (SELECT *, {_SLUG.format('artist')} AS artist_slug,
  {_SLUG.format('track_name')} AS track_slug FROM gsongs),
named AS (SELECT *, 'artist:' || artist_slug AS artist_id, 'song:' || artist_slug || ':' || track_slug AS song_id FROM ids)"""


def _named(spark, d):
    return graph.add_graph_ids(graph_songs(spark, d))


def graph_ids(spark, d):
    return _named(spark, d).select("artist", "track_name", "artist_slug", "track_slug", "artist_id", "song_id")


GRAPH_IDS = f"{IDS} SELECT artist, track_name, artist_slug, track_slug, artist_id, song_id FROM named"


def _shared_names(spark, d):
    """Documents as songs whose names differ only in case and punctuation."""
    docs = table(spark, d, "documents")
    n = F.col("doc_id")
    return docs.select(
        F.when(n % 3 == 0, F.concat(F.upper("lang"), F.lit("!"))).when(n % 3 == 1, F.concat("lang", F.lit("?")))
        .otherwise(F.lit("!!!")).alias("artist"),
        F.concat(F.lit("Doc "), (n % 50).cast("string"), F.when(n % 2 == 0, ".").otherwise("")).alias("track_name"))


def collision_safe_ids(spark, d):
    return graph.add_graph_ids(_shared_names(spark, d).distinct())


_BASE = "coalesce(nullif(trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')"


def _safe(base, value):
    return (f"CASE WHEN min({value}) OVER (PARTITION BY {base}) <> max({value}) OVER (PARTITION BY {base}) "
            f"THEN {base} || '_' || substr(sha1({value}), 1, 8) ELSE {base} END")


COLLISION_SAFE_IDS = f"""
WITH names AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN upper(lang) || '!' WHEN 1 THEN lang || '?' ELSE '!!!' END AS artist,
  'Doc ' || (doc_id % 50) || CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '' END AS track_name FROM documents),
based AS (SELECT *, {_BASE.format('artist')} AS ab, {_BASE.format('track_name')} AS tb FROM names),
slugs AS (SELECT *, {_safe('ab', 'artist')} AS artist_slug, {_safe('tb', 'track_name')} AS track_slug FROM based),
songs AS (SELECT *, 'artist:' || artist_slug AS artist_id, 'song:' || artist_slug || ':' || track_slug AS song_id_base,
  artist || '::' || track_name AS sig FROM slugs)
SELECT artist, track_name, artist_slug, track_slug, artist_id, song_id_base, {_safe('song_id_base', 'sig')} AS song_id FROM songs"""


def folded_slugs(spark, d):
    """Slugs of whole accented texts."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.slug(text.strip(F.col("text")))).alias("digest"))


FOLDED_SLUGS = r"""
WITH folded AS (SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]+', '', 'g') AS t FROM documents)
SELECT doc_id, md5(coalesce(nullif(trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')) AS digest
FROM folded"""


def performs_edges(spark, d):
    return graph.performs_edges(_named(spark, d))


def graph_nodes(spark, d):
    return graph.graph_nodes(cut_lineage(_named(spark, d)))


GRAPH_NODES = f"""{IDS} SELECT DISTINCT artist_id AS id, 'artist' AS type, artist AS name, NULL AS artist, NULL AS genre,
  NULL AS popularity, NULL AS danceability, NULL AS energy, NULL AS tempo, NULL AS valence FROM named
UNION ALL SELECT song_id, 'song', track_name, artist, genre, popularity, danceability, energy, tempo, valence FROM named"""

_FEATURES = ["danceability", "energy", "tempo", "valence", "popularity"]
SCALED = f"""med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in _FEATURES)} FROM named),
full_rows AS (SELECT song_id, {', '.join(f'coalesce(n.{c}, m.{c}, 0) AS {c}' for c in _FEATURES)} FROM named n, med m),
mom AS (SELECT {', '.join(f'avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}' for c in _FEATURES)} FROM full_rows),
scaled AS (SELECT song_id, [{', '.join(f'({c} - a_{c}) / s_{c}' for c in _FEATURES)}] AS vec FROM full_rows, mom)"""


def similarity_features(spark, d):
    vec = graph.similarity_features(_named(spark, d))
    return vec.select("song_id", *[F.round(F.col("vec")[i], 6).alias(c) for i, c in enumerate(_FEATURES)])


SIMILARITY_FEATURES = f"""{IDS}, {SCALED}
SELECT song_id, {', '.join(f'round(vec[{i + 1}], 6) AS {c}' for i, c in enumerate(_FEATURES))} FROM scaled"""


def similarity_edges(spark, d):
    return graph.similarity_edges(cut_lineage(_named(spark, d)), 4)


def top_sql(source, key, vec, k):
    return f"""pairs AS (SELECT a.{key} AS source, b.{key} AS target,
  round(list_cosine_similarity(a.{vec}, b.{vec}), 12) AS cosine FROM {source} a JOIN {source} b ON a.{key} <> b.{key}),
top AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cosine DESC, target) AS rank FROM pairs
  QUALIFY rank <= {k})"""


SIMILARITY_EDGES = f"""{IDS}, {SCALED}, {top_sql('scaled', 'song_id', 'vec', 4)}
SELECT source, target, 'SIMILAR_TO' AS type, round_even((cosine + 1) / 2, 4) AS score, CAST(rank AS INT) AS rank FROM top"""

EMBEDDED = "emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


def embedding_neighbours(spark, d):
    return neighbours.cosine_top_k(vectors(spark, d), 5).select(
        "source", "target", graph.similarity_score(F.col("cosine")).alias("score"), "rank")


EMBEDDING_NEIGHBOURS = f"""WITH {EMBEDDED}, {top_sql('emb', 'id', 'vec', 5)}
SELECT source, target, round_even((cosine + 1) / 2, 4) AS score, CAST(rank AS INT) AS rank FROM top"""


def blocked_neighbours(spark, d):
    """The same through many small blocks and cells."""
    return neighbours.cosine_top_k(vectors(spark, d), 5, block_rows=100).select(
        "source", "target", graph.similarity_score(F.col("cosine")).alias("score"), "rank")


def wide_similar_songs(spark, d):
    near = neighbours.cosine_top_k(vectors(spark, d), 5)
    renamed = graph.ranked_neighbours(near.withColumns({c: F.col(c).cast("string") for c in ("source", "target")}))
    return ingest.wide_from_neighbours(renamed)


WIDE_SIMILAR_SONGS = f"""WITH {EMBEDDED}, {top_sql('emb', 'id', 'vec', 5)}
SELECT CAST(source AS VARCHAR) AS track_id, {', '.join(
    f"max(CASE WHEN rank = {r} THEN CAST(target AS VARCHAR) END) AS sim_song_{r}" for r in range(1, 6))}
FROM top GROUP BY source"""


def built_graph(spark, d):
    """Links of the whole validated build over all songs."""
    built = build_graph(graph_input(spark, d), "part", 4, None, ["ord"])
    return built.links


BUILT_GRAPH = f"""{IDS}, {SCALED}, {top_sql('scaled', 'song_id', 'vec', 4)}
SELECT DISTINCT artist_id AS source, song_id AS target, 'PERFORMS' AS type, CAST(NULL AS DOUBLE) AS score,
  CAST(NULL AS INT) AS rank FROM named
UNION ALL SELECT source, target, 'SIMILAR_TO', round_even((cosine + 1) / 2, 4), CAST(rank AS INT) FROM top"""


def graph_meta(spark, d):
    return graph.graph_meta(_named(spark, d), "part", 4)


GRAPH_META = f"""{IDS} SELECT 'part' AS source, count(*) AS song_count, count(DISTINCT artist_id) AS artist_count,
4 AS similarity_k FROM named"""


def graph_violations(spark, d):
    """A damaged graph: repeated nodes and links, lost nodes, self loops."""
    songs = cut_lineage(_named(spark, d))
    nodes = graph.graph_nodes(songs).select("id", "name")
    links = graph.performs_edges(songs)
    nodes = nodes.where(~F.col("id").endswith("_anvil")).unionByName(nodes.where(F.col("id").endswith("_gear")))
    links = links.unionByName(links.where(F.col("target").endswith("_rod"))).unionByName(
        links.where(F.col("target").endswith("_ring")).select(
            F.col("target").alias("source"), "target", F.lit("SIMILAR_TO").alias("type")))
    return graph.graph_violations(nodes, links)


GRAPH_VIOLATIONS = f"""{IDS}, nodes AS (SELECT DISTINCT artist_id AS id FROM named UNION ALL SELECT song_id FROM named),
bnodes AS (SELECT * FROM nodes WHERE id NOT LIKE '%\\_anvil' ESCAPE '\\'
  UNION ALL SELECT * FROM nodes WHERE id LIKE '%\\_gear' ESCAPE '\\'),
links AS (SELECT artist_id AS source, song_id AS target, 'PERFORMS' AS type FROM named),
blinks AS (SELECT * FROM links UNION ALL SELECT * FROM links WHERE target LIKE '%\\_rod' ESCAPE '\\'
  UNION ALL SELECT target, target, 'SIMILAR_TO' FROM links WHERE target LIKE '%\\_ring' ESCAPE '\\')
SELECT 'duplicate_node' AS "check", id AS source, NULL AS target, NULL AS type FROM bnodes GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_link', source, target, type FROM blinks GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'missing_node', source, target, type FROM blinks
  WHERE source NOT IN (SELECT id FROM bnodes) OR target NOT IN (SELECT id FROM bnodes)
UNION ALL SELECT DISTINCT 'self_similarity', source, target, type FROM blinks WHERE type = 'SIMILAR_TO' AND source = target"""

QUERIES = {
    "graph_ids": (graph_ids, GRAPH_IDS),
    "collision_safe_ids": (collision_safe_ids, COLLISION_SAFE_IDS),
    "folded_slugs": (folded_slugs, FOLDED_SLUGS),
    "performs_edges": (performs_edges, f"{IDS} SELECT DISTINCT artist_id AS source, song_id AS target, 'PERFORMS' AS type FROM named"),
    "graph_nodes": (graph_nodes, GRAPH_NODES),
    "similarity_features": (similarity_features, SIMILARITY_FEATURES),
    "similarity_edges": (similarity_edges, SIMILARITY_EDGES),
    "embedding_neighbours": (embedding_neighbours, EMBEDDING_NEIGHBOURS),
    "blocked_neighbours": (blocked_neighbours, EMBEDDING_NEIGHBOURS),
    "wide_similar_songs": (wide_similar_songs, WIDE_SIMILAR_SONGS),
    "built_graph": (built_graph, BUILT_GRAPH),
    "graph_meta": (graph_meta, GRAPH_META),
    "graph_violations": (graph_violations, GRAPH_VIOLATIONS),
}
