"""Graph seeds, capped expansion, delta merge and song detail for many sessions."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators import search
from trackloom.operators.skew import shuffled
from trackloom.schemas import ARTIST_SEED_CAP, GENRE_SEED_SAMPLE, GRAPH_NODE_CAP, SEED
from trackloom.session import cut_lineage


def _nodes(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.col("song_id").alias("id"), "song_name", F.col("artist_name").alias("artist"), "genre")


def _edge_columns(df: DataFrame, *keys: str) -> DataFrame:
    source, target = F.col("source_song_id"), F.col("target_song_id")
    return df.select(*keys, text.edge_id(source, target).alias("id"), source.alias("source"),
                     target.alias("target"), F.col("neighbor_rank").alias("rank"))


def song_neighbourhoods(songs: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Existing edges of the distinct song_id in ``ids`` with the target's columns."""
    own = search.edges_of(edges, ids)
    target = songs.select(F.col("song_id").alias("target_song_id"), "song_name", "artist_name", "genre")
    return own.join(shuffled(target), "target_song_id")


def seed_from_song(songs: DataFrame, edges: DataFrame, requests: DataFrame,
                   cap: int = GRAPH_NODE_CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """requests(request_id, song_id) -> (nodes, edges, meta).

    The cap does not cut a song seed, it only sets the flag. A request for an
    unknown song has status ``not_found`` in meta and no rows elsewhere.
    """
    ids = requests.select("song_id").distinct()
    known = songs.join(shuffled(ids), "song_id", "left_semi")
    around = song_neighbourhoods(songs, edges, known)
    seed_edges = around.select(F.col("source_song_id").alias("song_id"), "source_song_id", "target_song_id",
                               "neighbor_rank")
    neighbour_nodes = _nodes(around.withColumn("song_id", F.col("target_song_id"))
                             .withColumn("seed", F.col("source_song_id")), "seed")
    seed_nodes = _nodes(known.withColumn("seed", F.col("song_id")), "seed")
    nodes = seed_nodes.unionByName(neighbour_nodes).distinct()

    sizes = (
        nodes.groupBy(F.col("seed").alias("song_id")).agg(F.count(F.lit(1)).alias("n_nodes"))
        .join(shuffled(seed_edges.groupBy("song_id").agg(F.count(F.lit(1)).alias("n_edges"))), "song_id", "left"))
    asked = requests.select("request_id", "song_id")
    node_count = F.coalesce("n_nodes", F.lit(0)).cast("bigint")
    meta = asked.join(shuffled(sizes), "song_id", "left").select(
        "request_id", F.lit("song").alias("seed_type"), F.col("song_id").alias("seed_value"),
        node_count.alias("visible_node_count"),
        F.coalesce("n_edges", F.lit(0)).cast("bigint").alias("visible_edge_count"),
        (node_count >= cap).alias("reached_limit"),
        F.when(F.col("n_nodes").isNull(), "not_found").otherwise("ok").alias("status"))
    return (
        asked.withColumnRenamed("song_id", "seed").join(shuffled(nodes), "seed").drop("seed"),
        _edge_columns(asked.join(shuffled(seed_edges), "song_id"), "request_id"),
        meta,
    )


def _seed_from_songs(requests: DataFrame, found: DataFrame, seed_type: str, cap: int):
    counts = found.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    node_count = F.coalesce("n", F.lit(0)).cast("bigint")
    meta = requests.select("request_id", "query").join(shuffled(counts), "request_id", "left").select(
        "request_id", F.lit(seed_type).alias("seed_type"), F.col("query").alias("seed_value"),
        node_count.alias("visible_node_count"), F.lit(0).cast("bigint").alias("visible_edge_count"),
        (node_count >= cap).alias("reached_limit"), F.lit("ok").alias("status"))
    return _nodes(found, "request_id", "position"), meta


def seed_from_artist(songs: DataFrame, requests: DataFrame, limit: int = ARTIST_SEED_CAP,
                     cap: int = GRAPH_NODE_CAP) -> tuple[DataFrame, DataFrame]:
    """requests(request_id, query) -> (nodes, meta); an unknown artist is empty."""
    return _seed_from_songs(requests, search.songs_by_artist(songs, requests, min(limit, cap)), "artist", cap)


def seed_from_genre(songs: DataFrame, requests: DataFrame, limit: int = GENRE_SEED_SAMPLE,
                    cap: int = GRAPH_NODE_CAP, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    return _seed_from_songs(requests, search.genre_sample(songs, requests, min(limit, cap), seed), "genre", cap)


def sessions_from_arrays(requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Expand requests with array columns -> (visible nodes, visible edges, selected)."""
    def flat(column):
        return requests.select("session_id", F.explode(F.array_distinct(column)).alias("id"))

    return flat("visible_node_ids"), flat("visible_edge_ids"), flat("selected_node_ids")


def expand(visible_nodes: DataFrame, visible_edges: DataFrame, selected: DataFrame, songs: DataFrame,
           edges: DataFrame, cap: int = GRAPH_NODE_CAP,
           sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One capped expansion of every session -> (new nodes, new edges, meta).

    The three inputs are (session_id, id) tables without repeats. Unseen targets
    are taken in the order of their first (source, rank) up to the free slots;
    a slot taken by a target that is no song stays empty. Every session of the
    inputs, and of ``sessions`` (session_id) if given, has its row in meta, also
    when nothing of it is visible.
    """
    visible = visible_nodes.select("session_id", "id")
    named = [visible, visible_edges, selected] + ([sessions] if sessions is not None else [])
    known = named[0].select("session_id")
    for more in named[1:]:
        known = known.union(more.select("session_id"))
    room = cut_lineage(known.distinct().join(shuffled(
        visible.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_visible"))), "session_id", "left").na.fill(0, ["n_visible"]))
    chosen = selected.select("session_id", "id").join(shuffled(visible), ["session_id", "id"], "left_semi")
    active = chosen.join(shuffled(room.where(F.col("n_visible") < cap)), "session_id")
    reached = active.join(shuffled(
        edges.select(F.col("source_song_id").alias("id"), "source_song_id", "target_song_id", "neighbor_rank")), "id")
    seen = visible.select("session_id", F.col("id").alias("target_song_id"), F.lit(True).alias("_seen"))
    reached = cut_lineage(reached.drop("id").join(shuffled(seen), ["session_id", "target_song_id"], "left"))

    first = reached.where(F.col("_seen").isNull()).groupBy("session_id", "target_song_id").agg(
        F.min(F.struct("source_song_id", "neighbor_rank")).alias("_at"), F.first("n_visible").alias("n_visible"))
    turn = W.partitionBy("session_id").orderBy("_at", "target_song_id")
    allowed = first.withColumn("_turn", F.row_number().over(turn)).where(
        (F.col("_turn") <= cap) & (F.col("_turn") <= F.lit(cap) - F.col("n_visible")))
    loaded = cut_lineage(allowed.withColumn("song_id", F.col("target_song_id")).join(shuffled(songs), "song_id"))
    new_nodes = _nodes(loaded, "session_id", F.col("_turn").alias("position"))

    arrived = loaded.select("session_id", "target_song_id", F.lit(True).alias("_loaded"))
    shown = (
        reached.join(shuffled(arrived), ["session_id", "target_song_id"], "left")
        .where(F.col("_seen") | F.col("_loaded"))
        .groupBy("session_id", "source_song_id", "target_song_id").agg(F.min("neighbor_rank").alias("neighbor_rank")))
    new_edges = _edge_columns(shown, "session_id").join(
        shuffled(visible_edges.select("session_id", "id")), ["session_id", "id"], "left_anti")

    def tally(df, name):
        return shuffled(df.groupBy("session_id").agg(F.count(F.lit(1)).alias(name)))

    meta = (
        room.join(tally(new_nodes, "new_nodes"), "session_id", "left")
        .join(tally(visible_edges, "old_edges"), "session_id", "left")
        .join(tally(new_edges, "new_edges"), "session_id", "left").na.fill(0)
        .select("session_id", "new_nodes", "new_edges",
                (F.col("n_visible") + F.col("new_nodes")).alias("visible_node_count"),
                (F.col("old_edges") + F.col("new_edges")).alias("visible_edge_count"),
                (F.col("n_visible") + F.col("new_nodes") >= cap).alias("reached_limit")))
    return new_nodes, new_edges, meta


def merge_delta(existing: DataFrame, delta: DataFrame) -> DataFrame:
    """Union by (session_id, id): the incoming row wins, the old position stays.

    Both have session_id, id, position and the same payload; new ids follow the
    existing ones of their session.
    """
    payload = [c for c in existing.columns if c not in ("session_id", "id", "position")]

    def side(df, turn):
        return df.select("session_id", "id", F.lit(turn).alias("_turn"), "position", *payload)

    return (
        side(existing, 0).unionByName(side(delta, 1))
        .groupBy("session_id", "id").agg(
            F.min(F.struct("_turn", "position")).alias("_at"),
            F.max_by(F.struct(*payload), "_turn").alias("_row") if payload else F.lit(None).alias("_row"))
        .select("session_id", "id",
                F.row_number().over(W.partitionBy("session_id").orderBy("_at", "id")).alias("position"),
                *[f"_row.{c}" for c in payload])
    )


def expand_until_cap(nodes: DataFrame, edges_seen: DataFrame, songs: DataFrame, edges: DataFrame, rounds: int,
                     cap: int = GRAPH_NODE_CAP, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Select everything visible, expand, merge; ``rounds`` times or until
    nothing new arrives. Returns (nodes, edges, meta of the last state); meta has a
    row for every session of the inputs and of ``sessions`` (session_id) if given."""
    known = nodes.select("session_id").union(edges_seen.select("session_id"))
    known = (known if sessions is None else known.union(sessions.select("session_id"))).distinct()
    # What every round reads again is written once.
    nodes, edges_seen = cut_lineage(nodes.select("session_id", "id", "position")), cut_lineage(edges_seen.select("session_id", "id"))
    songs, edges = cut_lineage(songs), cut_lineage(edges)
    for _ in range(rounds):
        new_nodes, new_edges, _meta = expand(nodes, edges_seen, nodes, songs, edges, cap)
        new_edges = cut_lineage(new_edges.select("session_id", "id"))
        new_nodes = cut_lineage(new_nodes.select("session_id", "id", "position"))
        if new_nodes.isEmpty() and new_edges.isEmpty():
            break
        nodes = cut_lineage(merge_delta(nodes, new_nodes))
        edges_seen = cut_lineage(edges_seen.unionByName(new_edges))
    meta = (
        known.join(shuffled(nodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("visible_node_count"))), "session_id", "left")
        .join(shuffled(edges_seen.groupBy("session_id").agg(F.count(F.lit(1)).alias("visible_edge_count"))), "session_id", "left")
        .na.fill(0).withColumn("reached_limit", F.col("visible_node_count") >= cap))
    return nodes, edges_seen, meta


def song_detail(songs: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(request_id, song_id) -> one row per similar song in rank order.

    A known song without neighbours, or an unknown song (``not_found``), has one
    row with null neighbour columns.
    """
    asked = requests.select("request_id", "song_id")
    around = song_neighbourhoods(songs, edges, asked.select("song_id").distinct()).select(
        F.col("source_song_id").alias("song_id"), F.col("target_song_id").alias("similar_song_id"),
        F.col("song_name").alias("similar_song_name"), F.col("artist_name").alias("similar_artist_name"),
        F.col("genre").alias("similar_genre"), "neighbor_rank")
    answers = songs.join(shuffled(asked.select("song_id").distinct()), "song_id", "left_semi").join(shuffled(around), "song_id", "left")
    return asked.join(shuffled(answers), "song_id", "left").withColumn(
        "status", F.when(F.col("song_name").isNull(), "not_found").otherwise("ok"))
