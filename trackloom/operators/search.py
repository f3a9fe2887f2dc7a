"""Lookups and ranked prefix search for whole tables of requests.

Every operator answers each distinct question once and then fans the answer out
to the requests that asked it, so a question asked by a third of all requests
costs one answer.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import sampling, text
from trackloom.operators.skew import shuffled
from trackloom.schemas import ARTIST_SEED_CAP, GENRE_SEED_SAMPLE, SEARCH_LIMIT, SEED

# Distinct questions are broadcast up to this many characters in all.
MAX_BROADCAST_CHARACTERS = 20_000_000


def songs_by_id(songs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(request_id, song_id) -> the song of each request that has one."""
    return requests.select("request_id", "song_id").join(songs, "song_id")


def songs_by_ids(songs: DataFrame, ids: DataFrame) -> DataFrame:
    return songs.join(ids.select("song_id"), "song_id", "left_semi")


def _top(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """First rows per key with their position. The literal limit lets Spark cut
    each map task's groups before the shuffle."""
    ranked = df.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("position") <= limit)


def songs_by_artist(songs: DataFrame, requests: DataFrame, limit: int = ARTIST_SEED_CAP) -> DataFrame:
    """requests(request_id, query): songs of the artist in any casing, by name."""
    asked = requests.select("request_id", text.query_text(F.col("query")).alias("_q"))
    own = songs.withColumn("_q", F.lower("artist_name")).join(asked.select("_q").distinct(), "_q", "left_semi")
    best = _top(own, ["_q"], [F.col("song_name"), F.col("song_id")], limit)
    return asked.join(best, "_q").drop("_q")


def genre_sample(songs: DataFrame, requests: DataFrame, limit: int = GENRE_SEED_SAMPLE, seed: int = SEED) -> DataFrame:
    """requests(request_id, query): seeded random songs of the genre."""
    asked = requests.select("request_id", text.query_text(F.col("query")).alias("_q"))
    own = songs.withColumn("_q", F.lower("genre")).join(asked.select("_q").distinct(), "_q", "left_semi")
    best = _top(own, ["_q"], [sampling.hash32(F.col("song_id"), seed), F.col("song_id")], limit)
    return asked.join(best, "_q").drop("_q")


def edges_of(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges whose source is in sources(song_id)."""
    return edges.join(shuffled(sources.select(F.col("song_id").alias("source_song_id"))), "source_song_id", "left_semi")


def prefix_matches(values: DataFrame, column: str, order: list[str], requests: DataFrame,
                   limit: int = SEARCH_LIMIT) -> DataFrame:
    """Rows of ``values`` whose lowered ``column`` starts with a request's query.

    Exact matches come first, then ``order``. A query of length L can only match
    the L-character prefix, so the join is an equi join on that prefix, for the
    few lengths that occur: no residual, and at most one match per row and length.
    Queries are literal text.
    """
    asked = requests.select("request_id", text.query_text(F.col("query")).alias("_q")).where(F.col("_q") != "")
    questions = asked.select("_q").distinct()
    lengths = questions.groupBy(F.length("_q").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()
    lowered = F.lower(F.col(column))
    prefixes = F.array(*[F.when(F.length(lowered) >= r["l"], F.substring(lowered, 1, r["l"]))
                         for r in sorted(lengths)]) if lengths else F.array(F.lit(None).cast("string"))
    keyed = values.withColumn("_q", F.explode(prefixes)).where(F.col("_q").isNotNull())
    small = sum(r["n"] * (r["l"] + 16) for r in lengths) <= MAX_BROADCAST_CHARACTERS
    keyed = keyed.join(F.broadcast(questions) if small else questions, "_q", "left_semi")
    rank = F.when(lowered == F.col("_q"), 0).otherwise(1)
    best = _top(keyed.withColumn("match_rank", rank), ["_q"], [F.col(c) for c in ["match_rank", *order]], limit)
    return asked.join(best, "_q").drop("_q")


def search_songs(songs: DataFrame, requests: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """requests(request_id, query) -> request_id, position, match_rank, song columns."""
    return prefix_matches(songs.select("song_id", "song_name", "artist_name", "genre"), "song_name",
                          ["song_name", "artist_name", "song_id"], requests, limit)


def _search_spellings(songs: DataFrame, column: str, requests: DataFrame, limit: int) -> DataFrame:
    spellings = songs.select(column).distinct()
    return prefix_matches(spellings, column, [column], requests, limit)


def search_artists(songs: DataFrame, requests: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Distinct artist spellings; two casings are two results."""
    return _search_spellings(songs, "artist_name", requests, limit)


def search_genres(songs: DataFrame, requests: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    return _search_spellings(songs, "genre", requests, limit)


def search(songs: DataFrame, requests: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """requests(request_id, mode, query) with mode song, artist or genre, answered together."""
    def of(mode):
        return requests.where(F.col("mode") == mode)

    nothing = F.lit(None).cast("string")
    head = ["request_id", "position", "match_rank"]
    by_song = search_songs(songs, of("song"), limit)
    by_artist = search_artists(songs, of("artist"), limit)
    by_genre = search_genres(songs, of("genre"), limit)
    return by_song.select(*head, "song_id", "song_name", "artist_name", "genre").unionByName(
        by_artist.select(*head, nothing.alias("song_id"), nothing.alias("song_name"), "artist_name",
                         nothing.alias("genre"))).unionByName(
        by_genre.select(*head, nothing.alias("song_id"), nothing.alias("song_name"),
                        nothing.alias("artist_name"), "genre"))
