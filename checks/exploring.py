"""Lookup, search and exploration queries over request tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks.base import hash32_sql
from checks.catalogue import CATALOGUE, edges, songs
from trackloom.operators import explore, search
from trackloom.operators.skew import shuffled
from trackloom.session import cut_lineage
from trackloom.sources.adapters import table

CAP = 40

# --- requests: one per event; what they ask for follows from the event ----------

ID_REQUESTS = """requests AS (SELECT event_id AS request_id,
  CAST(event_id * 7 % ((SELECT count(*) FROM part) + 50) AS VARCHAR) AS song_id FROM events)"""
PREFIXES = """requests AS (SELECT md5(query) AS request_id, query FROM (
  SELECT DISTINCT substr(p_name, 1, 4) AS query FROM part UNION SELECT DISTINCT substr(p_name, 1, 1) FROM part
  UNION SELECT DISTINCT ' ' || upper(p_name) || ' ' FROM part UNION SELECT '  ' UNION SELECT '%' UNION SELECT 'a_'))"""
ARTISTS = """requests AS (SELECT md5(query) AS request_id, query FROM (
  SELECT DISTINCT upper(p_brand) AS query FROM part UNION SELECT DISTINCT substr(p_brand, 1, 7) FROM part
  UNION SELECT 'nobody' UNION SELECT ''))"""
GENRES = """requests AS (SELECT md5(query) AS request_id, query FROM (
  SELECT DISTINCT lower(p_type) AS query FROM part UNION SELECT DISTINCT substr(p_type, 1, 2) FROM part
  UNION SELECT 'none'))"""


def id_requests(spark, d):
    total = table(spark, d, "part").agg(F.count(F.lit(1))).scalar()
    return table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), (F.col("event_id") * 7 % (total + 50)).cast("string").alias("song_id"))


def _numbered(queries):
    return queries.distinct().withColumn("request_id", F.md5("query"))


def _constants(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "query string")


def prefix_requests(spark, d):
    names = table(spark, d, "part").select("p_name")
    name = F.col("p_name")
    return _numbered(names.select(F.explode(F.array(
        F.substring(name, 1, 4), F.substring(name, 1, 1),
        F.concat(F.lit(" "), F.upper(name), F.lit(" ")))).alias("query")).unionByName(_constants(spark, "  ", "%", "a_")))


def artist_requests(spark, d):
    brand = F.col("p_brand")
    return _numbered(table(spark, d, "part").select(F.explode(F.array(
        F.upper(brand), F.substring(brand, 1, 7))).alias("query")).unionByName(_constants(spark, "nobody", "")))


def genre_requests(spark, d):
    kind = F.col("p_type")
    return _numbered(table(spark, d, "part").select(F.explode(F.array(
        F.lower(kind), F.substring(kind, 1, 2))).alias("query")).unionByName(_constants(spark, "none")))


_Q = "lower(trim(query))"


def _prefix_sql(requests, source, column, columns, order):
    return f"""{CATALOGUE}, {requests}, hits AS (SELECT request_id, {', '.join(f's.{c}' for c in columns)},
  CASE WHEN lower(s.{column}) = {_Q} THEN 0 ELSE 1 END AS match_rank FROM requests JOIN {source} s
  ON starts_with(lower(s.{column}), {_Q}) WHERE {_Q} <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY match_rank, {', '.join(order)}) AS position FROM hits)
SELECT request_id, match_rank, CAST(position AS INT) AS position, {', '.join(columns)} FROM ranked WHERE position <= 20"""


SONG_COLUMNS = ["song_id", "song_name", "artist_name", "genre"]
SEARCH_SONGS = _prefix_sql(PREFIXES, "songs", "song_name", SONG_COLUMNS, ["song_name", "artist_name", "song_id"])
SEARCH_ARTISTS = _prefix_sql(ARTISTS, "(SELECT DISTINCT artist_name FROM songs)", "artist_name", ["artist_name"],
                             ["artist_name"])
SEARCH_GENRES = _prefix_sql(GENRES, "(SELECT DISTINCT genre FROM songs)", "genre", ["genre"], ["genre"])


def mixed_search(spark, d):
    def of(requests, mode):
        return requests.select(F.concat_ws(":", F.lit(mode), "request_id").alias("request_id"),
                               F.lit(mode).alias("mode"), "query")

    asked = of(prefix_requests(spark, d), "song").unionByName(of(artist_requests(spark, d), "artist")).unionByName(
        of(genre_requests(spark, d), "genre"))
    return search.search(songs(spark, d), asked)


def _nested(sql):
    return f"({sql})"


MIXED_SEARCH = f"""SELECT 'song:' || request_id AS request_id, match_rank, position, song_id, song_name, artist_name, genre FROM {_nested(SEARCH_SONGS)}
UNION ALL SELECT 'artist:' || request_id, match_rank, position, NULL, NULL, artist_name, NULL FROM {_nested(SEARCH_ARTISTS)}
UNION ALL SELECT 'genre:' || request_id, match_rank, position, NULL, NULL, NULL, genre FROM {_nested(SEARCH_GENRES)}"""


def _per_group(requests, column, order, limit):
    return f"""{CATALOGUE}, {requests}, hits AS (SELECT request_id, s.*, row_number() OVER (
  PARTITION BY request_id ORDER BY {order}) AS position FROM requests JOIN songs s ON lower(s.{column}) = {_Q})
SELECT request_id, song_id, song_name, artist_name, genre, CAST(position AS INT) AS position FROM hits
WHERE position <= {limit}"""


SONGS_BY_ARTIST = _per_group(ARTISTS, "artist_name", "song_name, song_id", 300)
GENRE_SAMPLE = _per_group(GENRES, "genre", f"{hash32_sql('song_id')}, song_id", 50)

# --- seeds ----------------------------------------------------------------------

SEEDS = f"""{CATALOGUE}, {ID_REQUESTS},
known AS (SELECT request_id, song_id FROM requests WHERE song_id IN (SELECT song_id FROM songs)),
shown AS (SELECT request_id, e.* FROM known JOIN edges e ON e.source_song_id = song_id
  WHERE e.target_song_id IN (SELECT song_id FROM songs)),
node_ids AS (SELECT request_id, song_id AS id FROM known UNION SELECT request_id, target_song_id FROM shown)"""
SEED_NODES = f"""{SEEDS} SELECT request_id, id, song_name, artist_name AS artist, genre
FROM node_ids JOIN songs ON song_id = id"""
SEED_EDGES = f"""{SEEDS} SELECT request_id, source_song_id || '__' || target_song_id AS id, source_song_id AS source,
target_song_id AS target, neighbor_rank AS rank FROM shown"""
SEED_META = f"""{SEEDS}, n AS (SELECT request_id, count(*) AS c FROM node_ids GROUP BY 1),
e AS (SELECT request_id, count(*) AS c FROM shown GROUP BY 1)
SELECT r.request_id, 'song' AS seed_type, r.song_id AS seed_value, coalesce(n.c, 0) AS visible_node_count,
  coalesce(e.c, 0) AS visible_edge_count, coalesce(n.c, 0) >= 1000 AS reached_limit,
  CASE WHEN n.c IS NULL THEN 'not_found' ELSE 'ok' END AS status
FROM requests r LEFT JOIN n ON n.request_id = r.request_id LEFT JOIN e ON e.request_id = r.request_id"""


def _song_seed(spark, d):
    return explore.seed_from_song(songs(spark, d), edges(spark, d), id_requests(spark, d))


def _named_nodes(sql):
    return f"SELECT request_id, position, song_id AS id, song_name, artist_name AS artist, genre FROM ({sql})"


def _named_meta(requests, sql, kind):
    return f"""WITH {requests} SELECT r.request_id, '{kind}' AS seed_type, r.query AS seed_value,
  count(h.request_id) AS visible_node_count, CAST(0 AS BIGINT) AS visible_edge_count,
  count(h.request_id) >= 1000 AS reached_limit, 'ok' AS status
  FROM requests r LEFT JOIN ({sql}) h ON h.request_id = r.request_id GROUP BY r.request_id, r.query"""


# --- sessions: one per user -------------------------------------------------------

SESSIONS = f"""{CATALOGUE},
visible AS (SELECT DISTINCT user_id AS session_id, CAST(event_id * 13 % (SELECT count(*) FROM part) AS VARCHAR) AS id
  FROM events WHERE event_id % 3 = 0),
vedges AS (SELECT DISTINCT v.session_id, source_song_id || '__' || target_song_id AS id FROM visible v
  JOIN edges ON source_song_id = v.id JOIN visible t ON t.session_id = v.session_id AND t.id = target_song_id
  WHERE neighbor_rank <= 2),
chosen AS (SELECT DISTINCT user_id AS session_id, CAST(event_id * 13 % (SELECT count(*) FROM part) AS VARCHAR) AS id
  FROM events WHERE event_type = 'click')"""

EXPANDED = f"""{SESSIONS},
room AS (SELECT session_id, count(*) AS n FROM visible GROUP BY 1),
reached AS (SELECT c.session_id, room.n, e.* FROM chosen c JOIN visible v ON v.session_id = c.session_id AND v.id = c.id
  JOIN room ON room.session_id = c.session_id AND room.n < {CAP} JOIN edges e ON e.source_song_id = c.id),
unseen AS (SELECT session_id, target_song_id, min(n) AS n, min((source_song_id, neighbor_rank)) AS first_edge FROM reached r
  WHERE NOT EXISTS (SELECT 1 FROM visible v WHERE v.session_id = r.session_id AND v.id = r.target_song_id)
  GROUP BY 1, 2),
turns AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_edge, target_song_id) AS turn FROM unseen),
loaded AS (SELECT session_id, turn, s.* FROM turns JOIN songs s ON s.song_id = target_song_id WHERE turn <= {CAP} - n),
all_ids AS (SELECT session_id, id FROM visible UNION SELECT session_id, song_id FROM loaded),
new_edges AS (SELECT r.session_id, r.source_song_id AS source, r.target_song_id AS target, min(r.neighbor_rank) AS rank
  FROM reached r JOIN all_ids a ON a.session_id = r.session_id AND a.id = r.target_song_id
  WHERE NOT EXISTS (SELECT 1 FROM vedges x WHERE x.session_id = r.session_id
    AND x.id = r.source_song_id || '__' || r.target_song_id) GROUP BY 1, 2, 3)"""
EXPAND_NODES = f"""{EXPANDED} SELECT session_id, CAST(turn AS INT) AS position, song_id AS id, song_name,
artist_name AS artist, genre FROM loaded"""
EXPAND_EDGES = f"{EXPANDED} SELECT session_id, source || '__' || target AS id, source, target, rank FROM new_edges"
EXPAND_META = f"""{EXPANDED}, a AS (SELECT session_id, count(*) AS c FROM loaded GROUP BY 1),
b AS (SELECT session_id, count(*) AS c FROM vedges GROUP BY 1), e AS (SELECT session_id, count(*) AS c FROM new_edges GROUP BY 1)
SELECT room.session_id, coalesce(a.c, 0) AS new_nodes, coalesce(e.c, 0) AS new_edges, n + coalesce(a.c, 0) AS visible_node_count,
  coalesce(b.c, 0) + coalesce(e.c, 0) AS visible_edge_count, n + coalesce(a.c, 0) >= {CAP} AS reached_limit
FROM room LEFT JOIN a ON a.session_id = room.session_id LEFT JOIN b ON b.session_id = room.session_id
LEFT JOIN e ON e.session_id = room.session_id"""


def sessions(spark, d):
    """(visible nodes, visible edges, selected) of every user, through array requests."""
    total = table(spark, d, "part").agg(F.count(F.lit(1))).scalar()
    events = table(spark, d, "events").select(
        F.col("user_id").alias("session_id"), (F.col("event_id") * 13 % total).cast("string").alias("id"),
        "event_id", "event_type")
    visible = events.where(F.col("event_id") % 3 == 0).select("session_id", "id").distinct()
    chosen = events.where(F.col("event_type") == "click").select("session_id", "id").distinct()
    links = edges(spark, d).where(F.col("neighbor_rank") <= 2)
    seen = (
        visible.join(shuffled(links), F.col("id") == F.col("source_song_id"))
        .join(shuffled(visible.select(F.col("session_id").alias("s"), F.col("id").alias("t"))),
              (F.col("s") == F.col("session_id")) & (F.col("t") == F.col("target_song_id")))
        .select("session_id", F.concat_ws("__", "source_song_id", "target_song_id").alias("id")).distinct())
    return visible, seen, chosen


def _expanded(spark, d):
    return explore.expand(*sessions(spark, d), songs(spark, d), edges(spark, d), CAP)


def merged_sessions(spark, d):
    visible, _, _ = sessions(spark, d)
    old = visible.join(shuffled(songs(spark, d)), F.col("id") == F.col("song_id")).select(
        "session_id", "id", F.row_number().over(W.partitionBy("session_id").orderBy("id")).alias("position"),
        "song_name", F.col("artist_name").alias("artist"), F.lit("old").alias("genre"))
    new_nodes, _, _ = _expanded(spark, d)
    again = old.where(F.col("position") <= 3).withColumn("genre", F.lit("new"))
    return explore.merge_delta(old, new_nodes.unionByName(again.withColumn("position", F.lit(1000))))


MERGED_SESSIONS = f"""{EXPANDED},
old AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS position, song_name,
  artist_name AS artist FROM visible JOIN songs ON song_id = id),
everything AS (SELECT session_id, id, 0 AS turn, position, song_name, artist,
    CASE WHEN position <= 3 THEN 'new' ELSE 'old' END AS genre FROM old
  UNION ALL SELECT session_id, song_id, 1, turn, song_name, artist_name, genre FROM loaded)
SELECT session_id, id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn, position, id) AS INT) AS position,
  song_name, artist, genre FROM everything"""


def repeated_expansion(spark, d):
    """Two rounds of selecting everything, per session counts of the last state."""
    visible, seen, _ = sessions(spark, d)
    nodes = cut_lineage(visible.withColumn(
        "position", F.row_number().over(W.partitionBy("session_id").orderBy("id"))))
    return explore.expand_until_cap(nodes, seen, songs(spark, d), edges(spark, d), 2, CAP)[2]


def _round(n, visible, seen):
    return f"""
room{n} AS (SELECT session_id, count(*) AS n FROM {visible} GROUP BY 1),
reached{n} AS (SELECT v.session_id, r.n, e.* FROM {visible} v JOIN room{n} r ON r.session_id = v.session_id AND r.n < {CAP}
  JOIN edges e ON e.source_song_id = v.id),
turns{n} AS (SELECT session_id, n, target_song_id, row_number() OVER (PARTITION BY session_id ORDER BY first_edge, target_song_id) AS turn
  FROM (SELECT session_id, target_song_id, min(n) AS n, min((source_song_id, neighbor_rank)) AS first_edge FROM reached{n} r
    WHERE NOT EXISTS (SELECT 1 FROM {visible} v WHERE v.session_id = r.session_id AND v.id = r.target_song_id) GROUP BY 1, 2)),
visible{n} AS (SELECT session_id, id FROM {visible} UNION SELECT session_id, target_song_id FROM turns{n}
  WHERE turn <= {CAP} - n AND target_song_id IN (SELECT song_id FROM songs)),
seen{n} AS (SELECT session_id, id FROM {seen} UNION SELECT r.session_id, r.source_song_id || '__' || r.target_song_id
  FROM reached{n} r JOIN visible{n} a ON a.session_id = r.session_id AND a.id = r.target_song_id)"""


REPEATED_EXPANSION = f"""{SESSIONS}, {_round(1, 'visible', 'vedges')}, {_round(2, 'visible1', 'seen1')},
a AS (SELECT session_id, count(*) AS c FROM visible2 GROUP BY 1), b AS (SELECT session_id, count(*) AS c FROM seen2 GROUP BY 1)
SELECT a.session_id, a.c AS visible_node_count, coalesce(b.c, 0) AS visible_edge_count, a.c >= {CAP} AS reached_limit
FROM a LEFT JOIN b ON b.session_id = a.session_id"""


SONG_DETAIL = f"""{CATALOGUE}, {ID_REQUESTS}
SELECT r.request_id, r.song_id, s.song_name, s.artist_name, s.genre, t.song_id AS similar_song_id,
  t.song_name AS similar_song_name, t.artist_name AS similar_artist_name, t.genre AS similar_genre, neighbor_rank,
  CASE WHEN s.song_id IS NULL THEN 'not_found' ELSE 'ok' END AS status
FROM requests r LEFT JOIN songs s ON s.song_id = r.song_id LEFT JOIN (edges JOIN songs t ON t.song_id = target_song_id)
  ON source_song_id = s.song_id"""


def song_detail(spark, d):
    return explore.song_detail(songs(spark, d), edges(spark, d), id_requests(spark, d))


QUERIES = {
    "songs_by_id": (lambda s, d: search.songs_by_id(songs(s, d), id_requests(s, d)),
                    f"{CATALOGUE}, {ID_REQUESTS} SELECT request_id, songs.* FROM requests JOIN songs USING (song_id)"),
    "songs_by_ids": (lambda s, d: search.songs_by_ids(songs(s, d), id_requests(s, d)),
                     f"{CATALOGUE}, {ID_REQUESTS} SELECT * FROM songs WHERE song_id IN (SELECT song_id FROM requests)"),
    "songs_by_artist": (lambda s, d: search.songs_by_artist(songs(s, d), artist_requests(s, d)), SONGS_BY_ARTIST),
    "genre_sample": (lambda s, d: search.genre_sample(songs(s, d), genre_requests(s, d)), GENRE_SAMPLE),
    "edges_of_sources": (
        lambda s, d: search.edges_of(edges(s, d), id_requests(s, d)),
        f"{CATALOGUE}, {ID_REQUESTS} SELECT * FROM edges WHERE source_song_id IN (SELECT song_id FROM requests)"),
    "search_songs": (lambda s, d: search.search_songs(songs(s, d), prefix_requests(s, d)), SEARCH_SONGS),
    "search_artists": (lambda s, d: search.search_artists(songs(s, d), artist_requests(s, d)), SEARCH_ARTISTS),
    "search_genres": (lambda s, d: search.search_genres(songs(s, d), genre_requests(s, d)), SEARCH_GENRES),
    "mixed_search": (mixed_search, MIXED_SEARCH),
    "seed_song_nodes": (lambda s, d: _song_seed(s, d)[0], SEED_NODES),
    "seed_song_edges": (lambda s, d: _song_seed(s, d)[1], SEED_EDGES),
    "seed_song_meta": (lambda s, d: _song_seed(s, d)[2], SEED_META),
    "seed_artist_nodes": (lambda s, d: explore.seed_from_artist(songs(s, d), artist_requests(s, d))[0],
                          _named_nodes(SONGS_BY_ARTIST)),
    "seed_artist_meta": (lambda s, d: explore.seed_from_artist(songs(s, d), artist_requests(s, d))[1],
                         _named_meta(ARTISTS, SONGS_BY_ARTIST, "artist")),
    "seed_genre_nodes": (lambda s, d: explore.seed_from_genre(songs(s, d), genre_requests(s, d))[0],
                         _named_nodes(GENRE_SAMPLE)),
    "seed_genre_meta": (lambda s, d: explore.seed_from_genre(songs(s, d), genre_requests(s, d))[1],
                        _named_meta(GENRES, GENRE_SAMPLE, "genre")),
    "expand_nodes": (lambda s, d: _expanded(s, d)[0], EXPAND_NODES),
    "expand_edges": (lambda s, d: _expanded(s, d)[1], EXPAND_EDGES),
    "expand_meta": (lambda s, d: _expanded(s, d)[2], EXPAND_META),
    "merged_sessions": (merged_sessions, MERGED_SESSIONS),
    "repeated_expansion": (repeated_expansion, REPEATED_EXPANSION),
    "song_detail": (song_detail, SONG_DETAIL),
}
