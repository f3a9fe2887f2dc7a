import numpy as np
import pytest
from tests.helpers import rows
from pyspark.sql import functions as F

from trackloom.operators import graph, ingest, neighbours
from trackloom.plans.graph_build import build_graph
from trackloom.sources import io


def brute(ids, matrix, k):
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = matrix / np.where(norms == 0, 1, norms)
    scores = np.round(unit @ unit.T, neighbours.COSINE_DECIMALS)
    found = set()
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-scores[i, j], ids[j]))
        found |= {(a, ids[j], r) for r, j in enumerate(order[:k], 1)}
    return found


def vectors(spark, matrix, ids=None):
    ids = ids or list(range(len(matrix)))
    kind = "string" if isinstance(ids[0], str) else "bigint"
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, matrix)], f"id {kind}, vec array<double>")


@pytest.mark.parametrize("block_rows, max_pivots", [(10_000, 8), (16, 1), (16, 8), (7, 40)])
def test_exact_neighbours(spark, block_rows, max_pivots):
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(60, 4))
    tight = rng.normal(size=(60, 4)) * 0.05 + np.array([5, 1, 0, 0])
    copies = np.repeat([[1.0, 2.0, 3.0, 4.0]], 70, axis=0)  # a third of all rows
    pair = np.array([[2.0, 0, 0, 0], [4.0, 0, 0, 0]])  # one direction, two lengths
    nothing = np.zeros((9, 4))
    matrix = np.vstack([spread, tight, copies, pair, nothing])
    matrix = matrix[rng.permutation(len(matrix))]
    ids = [f"n{i:03d}" for i in rng.permutation(len(matrix))]
    got = neighbours.cosine_top_k(vectors(spark, matrix, ids), 3, block_rows=block_rows, max_pivots=max_pivots)
    assert {(r["source"], r["target"], r["rank"]) for r in got.collect()} == brute(ids, matrix, 3)


def test_pruning_skips_far_cells(spark):
    """Well separated bundles: a vector must not visit every block."""
    rng = np.random.default_rng(5)
    centres = np.eye(8) * 10
    matrix = np.vstack([c + rng.normal(size=(40, 8)) * 0.01 for c in centres])
    got = neighbours.cosine_top_k(vectors(spark, matrix), 2, block_rows=20, max_pivots=16)
    assert {(r["source"], r["target"], r["rank"]) for r in got.collect()} == brute(list(range(len(matrix))), matrix, 2)


def test_a_vector_is_sent_to_tiles_not_to_blocks(spark, monkeypatch):
    """In many dimensions nothing is ruled out; 100 blocks must not mean 100 copies."""
    matrix = np.random.default_rng(7).normal(size=(600, 16))
    written, cut = [], neighbours.cut_lineage
    monkeypatch.setattr(neighbours, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    got = neighbours.cosine_top_k(vectors(spark, matrix), 3, block_rows=6)
    assert {(r["source"], r["target"], r["rank"]) for r in got.collect()} == brute(list(range(600)), matrix, 3)
    sent = [df for df in written if "to_tiles" in df.columns]
    assert sent and sent[0].agg(F.max(F.size("to_tiles"))).first()[0] <= neighbours.TILES + 1


def test_fewer_rows_than_k(spark):
    got = neighbours.cosine_top_k(vectors(spark, np.eye(3)), 5)
    assert got.count() == 6
    assert neighbours.cosine_top_k(vectors(spark, np.eye(1)), 5).count() == 0


def songs(spark):
    return spark.createDataFrame(
        [("Hello!", "One", "g", "5", 0.1, 0.5), ("Hello?", "One", None, "x", 0.9, 0.5), ("Café", "日本", "g", None, None, 0.5),
         ("Solo", "A b", "g", "7.5", 0.4, 0.5)],
        "artist string, track_name string, genre string, popularity string, energy double, tempo double")


def test_ids_nodes_edges(spark):
    named = graph.add_graph_ids(songs(spark))
    ids = {r["artist"]: (r["artist_slug"], r["song_id"]) for r in named.collect()}
    assert ids["Hello!"][0] != ids["Hello?"][0] and ids["Hello!"][0].startswith("hello_")
    assert ids["Café"] == ("cafe", "song:cafe:unknown") and ids["Solo"] == ("solo", "song:solo:a_b")
    nodes = graph.graph_nodes(named)
    assert nodes.where("type = 'artist'").count() == 4
    assert rows(nodes.where("type = 'song'").select("popularity")) == [(5.0,), (7.5,), (None,), (None,)]
    assert graph.performs_edges(named).count() == 4


def test_similarity_edges_against_numpy(spark):
    named = graph.add_graph_ids(songs(spark))
    got = graph.similarity_edges(named, 2).collect()
    # energy null -> median; popularity "x" -> null -> median; tempo is constant
    energy, popularity = np.array([0.1, 0.9, 0.4, 0.4]), np.array([5, 6.25, 6.25, 7.5])
    scaled = [(c - c.mean()) / c.std() for c in (energy, popularity)]
    matrix = np.column_stack([scaled[0], np.zeros(4), scaled[1]])
    order = ["Hello!", "Hello?", "Café", "Solo"]
    by_name = {r["song_id"]: r["artist"] for r in named.collect()}
    expected = {(order[a], order[b], rank) for a, b, rank in brute(list(range(4)), matrix, 2)}
    mine = {(by_name[r["source"]], by_name[r["target"]], r["rank"]) for r in got}
    assert mine == expected
    assert all(0 <= r["score"] <= 1 for r in got)


def test_build_validate_export(spark, tmp_path):
    built = build_graph(songs(spark).withColumn("ord", F.monotonically_increasing_id()), "unit", 2, 3, ["ord"])
    assert built.meta.first().asDict() == {"source": "unit", "song_count": 3, "artist_count": 3, "similarity_k": 2}
    assert built.links.where("type = 'SIMILAR_TO'").count() == 6
    io.write_graph(built.nodes, built.links, built.meta, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).count() == 6
    with pytest.raises(ValueError, match="missing node"):
        graph.validate_graph(built.nodes.where("type = 'artist'"), built.links)
    with pytest.raises(ValueError, match="duplicate node"):
        graph.validate_graph(built.nodes.unionByName(built.nodes), built.links)
    with pytest.raises(ValueError, match="duplicate edge"):
        graph.validate_graph(built.nodes, built.links.unionByName(built.links))


def test_wide_round_trip(spark):
    near = neighbours.cosine_top_k(vectors(spark, np.random.default_rng(2).normal(size=(30, 5)), [f"s{i}" for i in range(30)]), 5)
    edges = graph.ranked_neighbours(near)
    back = ingest.neighbours_from_wide(ingest.wide_from_neighbours(edges))
    assert rows(back) == rows(edges)
