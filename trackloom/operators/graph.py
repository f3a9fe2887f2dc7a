"""Artist/song graph: ids, nodes, edges, validation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import text
from trackloom.operators.neighbours import cosine_top_k
from trackloom.operators.quantiles import exact_quantiles
from trackloom.operators.skew import first_per_key
from trackloom.schemas import GRAPH_NUMERIC_COLUMNS

PERFORMS = "PERFORMS"
SIMILAR_TO = "SIMILAR_TO"
SCORE_DECIMALS = 4

_NODE_FEATURES = [c for c in GRAPH_NUMERIC_COLUMNS if c != "popularity"]


def _suffix_shared(df: DataFrame, base: str, original: Column, out: str) -> DataFrame:
    """``base`` plus a hash of ``original`` where two originals share a base.

    Only the shared bases are joined back; which ones they are is decided by a
    mergeable minimum and maximum over the whole table. The many rows of one
    shared base go through the skew join of adaptive execution.
    """
    named = df.withColumn("_original", original)
    shared = (
        named.groupBy(base).agg(F.min("_original").alias("_lo"), F.max("_original").alias("_hi"))
        .where(F.col("_lo") != F.col("_hi")).select(base, F.lit(True).alias("_shared")))
    suffixed = F.concat(F.col(base), F.lit("_"), text.short_hash(F.col("_original")))
    return (
        named.join(shared, base, "left")
        .withColumn(out, F.when(F.col("_shared"), suffixed).otherwise(F.col(base)))
        .drop("_original", "_shared"))


def add_graph_ids(df: DataFrame) -> DataFrame:
    """artist_slug, track_slug, artist_id, song_id_base and song_id."""
    artist, track = text.strip_or_empty(F.col("artist")), text.strip_or_empty(F.col("track_name"))
    based = df.withColumns({"_artist_base": text.slug(artist), "_track_base": text.slug(track)})
    based = _suffix_shared(based, "_artist_base", artist, "artist_slug")
    based = _suffix_shared(based, "_track_base", track, "track_slug").drop("_artist_base", "_track_base")
    named = based.withColumns({
        "artist_id": F.concat(F.lit("artist:"), "artist_slug"),
        "song_id_base": F.concat(F.lit("song:"), "artist_slug", F.lit(":"), "track_slug"),
    })
    return _suffix_shared(named, "song_id_base", F.concat(artist, F.lit("::"), track), "song_id")


def performs_edges(songs: DataFrame) -> DataFrame:
    return songs.select(F.col("artist_id").alias("source"), F.col("song_id").alias("target")).distinct().withColumn(
        "type", F.lit(PERFORMS))


def artist_nodes(songs: DataFrame) -> DataFrame:
    return first_per_key(songs.select("artist_id", "artist"), ["artist_id"], [F.col("artist")]).select(
        F.col("artist_id").alias("id"), F.lit("artist").alias("type"), F.col("artist").alias("name"))


def _number(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.StringType):
        return text.to_number(F.col(column))
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def song_nodes(songs: DataFrame) -> DataFrame:
    features = [c for c in _NODE_FEATURES if c in songs.columns]
    rows = songs.select("song_id", "track_name", "artist", "genre",
                        *[_number(songs, c).alias(c) for c in ["popularity", *features]])
    order = [F.col(c) for c in rows.columns if c != "song_id"]
    return first_per_key(rows, ["song_id"], order).select(
        F.col("song_id").alias("id"), F.lit("song").alias("type"), F.col("track_name").alias("name"),
        "artist", "genre", "popularity", *features)


def graph_nodes(songs: DataFrame) -> DataFrame:
    return artist_nodes(songs).unionByName(song_nodes(songs), allowMissingColumns=True)


def similarity_features(songs: DataFrame) -> DataFrame:
    """song_id and its z-scored features as ``vec``.

    Text becomes numbers, gaps the column median, an all-empty column zero. The
    medians are exact and never gather a column in one task; medians and moments
    are a handful of numbers and enter the plan as literals.
    """
    features = [c for c in GRAPH_NUMERIC_COLUMNS if c in songs.columns]
    numbers = songs.select("song_id", *[_number(songs, c).alias(c) for c in features])
    long = numbers.unpivot([], features, "feature", "value")
    medians = {r["feature"]: r["q"] for r in exact_quantiles(long, ["feature"], "value", [0.5]).collect()}
    filled = numbers.select("song_id", *[F.coalesce(c, F.lit(medians.get(c, 0.0))).alias(c) for c in features])
    moments = filled.agg(
        *[F.avg(c).alias(f"avg_{c}") for c in features], *[F.stddev_pop(c).alias(f"std_{c}") for c in features]).first()
    scaled = F.array(*[(F.col(c) - F.lit(moments[f"avg_{c}"])) / F.lit(moments[f"std_{c}"] or 1.0) for c in features])
    return filled.select("song_id", scaled.alias("vec"))


def similarity_score(cosine: Column) -> Column:
    return F.bround((cosine + 1) / 2, SCORE_DECIMALS)


def similarity_edges(songs: DataFrame, k: int, **blocking) -> DataFrame:
    """(source, target, type, score, rank): k most similar songs of each song."""
    if k <= 0 or not any(c in songs.columns for c in GRAPH_NUMERIC_COLUMNS):
        return songs.sparkSession.createDataFrame(
            [], "source string, target string, type string, score double, rank int")
    near = cosine_top_k(similarity_features(songs), k, "song_id", "vec", **blocking)
    return near.select("source", "target", F.lit(SIMILAR_TO).alias("type"),
                       similarity_score(F.col("cosine")).alias("score"), "rank")


def ranked_neighbours(edges: DataFrame) -> DataFrame:
    """Similarity edges in the catalogue's edge schema."""
    return edges.select(F.col("source").alias("source_song_id"), F.col("target").alias("target_song_id"),
                        F.col("rank").alias("neighbor_rank"))


def graph_meta(songs: DataFrame, source: str, k: int) -> DataFrame:
    per_artist = songs.groupBy("artist_id").agg(F.count(F.lit(1)).alias("n"))
    return per_artist.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("song_count"),
        F.count(F.lit(1)).alias("artist_count")).select(
        F.lit(source).alias("source"), "song_count", "artist_count", F.lit(k).alias("similarity_k"))


def graph_violations(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(check, source, target, type) rows, one per broken rule; empty when valid.

    Ids shrink to one row each before they meet, so neither a hot node nor a hot
    link costs more than a rare one.
    """
    nothing = F.lit(None).cast("string")
    repeated = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("duplicate_node").alias("check"), F.col("id").alias("source"), nothing.alias("target"),
        nothing.alias("type"))
    distinct_links = links.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("n"))
    ids = nodes.select("id").distinct()

    def named(df, check):
        return df.select(F.lit(check).alias("check"), "source", "target", "type")

    ends = distinct_links.select("source", "target", "type")
    no_source = ends.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    no_target = ends.join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return (
        repeated
        .unionByName(named(distinct_links.where("n > 1"), "duplicate_link"))
        .unionByName(named(no_source.unionByName(no_target).distinct(), "missing_node"))
        .unionByName(named(ends.where((F.col("type") == SIMILAR_TO) & (F.col("source") == F.col("target"))),
                           "self_similarity")))


# What each failed check reports.
_MESSAGES = {
    "duplicate_node": "Graph contains duplicate node IDs.",
    "duplicate_link": "Graph contains duplicate edge: {}",
    "missing_node": "Graph edge points to a missing node: {}",
    "self_similarity": "Graph contains a self-referential similarity edge: {}",
}


def validate_graph(nodes: DataFrame, links: DataFrame) -> None:
    """Raise for one violation, duplicate nodes first."""
    order = F.when(F.col("check") == "duplicate_node", 0).otherwise(1)
    row = graph_violations(nodes, links).orderBy(order, "source", "target").limit(1).collect()
    if row:
        raise ValueError(_MESSAGES[row[0]["check"]].format(tuple(row[0])[1:]))
