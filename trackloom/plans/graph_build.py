"""Track table to validated artist/song graph."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import clean, graph
from trackloom.schemas import GRAPH_SIMILARITY_K
from trackloom.session import cut_lineage


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    links: DataFrame
    meta: DataFrame


def build_graph(tracks: DataFrame, source: str, k: int = GRAPH_SIMILARITY_K,
                max_songs: int | None = None, order: list[str] | None = None,
                strict: bool = True, **blocking) -> Graph:
    """Clean, name, connect and check. ``order`` gives the input order of tracks.

    The named songs feed nodes, both edge kinds and meta, so they are written
    once. With ``strict`` a broken rule raises.
    """
    songs = cut_lineage(graph.add_graph_ids(clean.clean_songs(clean.normalise_schema(tracks), max_songs, order)))
    performs = graph.performs_edges(songs).withColumns(
        {"score": F.lit(None).cast("double"), "rank": F.lit(None).cast("int")})
    links = cut_lineage(performs.unionByName(graph.similarity_edges(songs, k, **blocking)))
    nodes = cut_lineage(graph.graph_nodes(songs))
    if strict:
        graph.validate_graph(nodes, links)
    return Graph(nodes, links, graph.graph_meta(songs, source, k))
