import pytest
from tests.helpers import rows
from pyspark.sql import functions as F

from trackloom.operators import explore, ingest, search
from trackloom.plans.catalogue import load_catalogue
from trackloom.sources import io

# The small catalogue: six songs, song s1 points to all others.
NAMES = ["alpha", "alpine", "beta", "gamma", "delta", "echo"]
ARTISTS = ["a", "a", "b", "c", "d", "e"]
GENRES = ["rock", "rock", "pop", "jazz", "rock", "rock"]


@pytest.fixture(scope="module")
def songs(spark):
    return spark.createDataFrame(
        [(f"s{i + 1}", NAMES[i], ARTISTS[i], GENRES[i]) for i in range(6)],
        "song_id string, song_name string, artist_name string, genre string")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("s1", f"s{r + 1}", r) for r in range(1, 6)],
                                 "source_song_id string, target_song_id string, neighbor_rank int")


def asked(spark, *values, column="query"):
    return spark.createDataFrame(list(enumerate(values)), f"request_id int, {column} string")


def test_ranked_prefix_search(spark, songs):
    got = search.search_songs(songs, asked(spark, "al", "ALPHA ", "", "%", "zz", "a"))
    assert rows(got.select("request_id", "position", "match_rank", "song_name")) == [
        (0, 1, 1, "alpha"), (0, 2, 1, "alpine"), (1, 1, 0, "alpha"), (5, 1, 1, "alpha"), (5, 2, 1, "alpine")]
    assert rows(search.search_artists(songs, asked(spark, "A")).select("artist_name", "match_rank")) == [("a", 0)]
    assert rows(search.search_genres(songs, asked(spark, "r", "po")).select("genre")) == [("pop",), ("rock",)]


def test_two_casings_are_two_artists_and_the_limit(spark, songs):
    more = songs.unionByName(spark.createDataFrame(
        [(f"t{i}", f"name {i:02d}", "A" if i % 2 else "a", "x") for i in range(30)], songs.schema))
    assert rows(search.search_artists(more, asked(spark, "a")).select("artist_name")) == [("A",), ("a",)]
    got = search.search_songs(more, asked(spark, "name"))
    assert [r["position"] for r in got.orderBy("position").collect()] == list(range(1, 21))
    assert search.songs_by_artist(more, asked(spark, "A"), 7).count() == 7


def test_search_without_broadcast(spark, songs, monkeypatch):
    before = rows(search.search_songs(songs, asked(spark, "al", "b", "alpha")))
    monkeypatch.setattr(search, "MAX_BROADCAST_CHARACTERS", 0)
    assert rows(search.search_songs(songs, asked(spark, "al", "b", "alpha"))) == before


def test_search_plan_has_no_nested_loop(spark, songs):
    plan = search.search_songs(songs, asked(spark, "al"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan


def test_mixed_search(spark, songs):
    requests = spark.createDataFrame([(1, "song", "be"), (2, "artist", "b"), (3, "genre", "jazz")],
                                     "request_id int, mode string, query string")
    assert rows(search.search(songs, requests).select("request_id", "song_id", "artist_name", "genre")) == [
        (1, "s3", "b", "pop"), (2, None, "b", None), (3, None, None, "jazz")]


def test_seeds(spark, songs, edges):
    nodes, links, meta = explore.seed_from_song(songs, edges, asked(spark, "s1", "s2", "nope", column="song_id"))
    assert nodes.where("request_id = 0").count() == 6 and links.where("request_id = 0").count() == 5
    assert rows(meta.select("request_id", "visible_node_count", "visible_edge_count", "reached_limit", "status")) == [
        (0, 6, 5, False, "ok"), (1, 1, 0, False, "ok"), (2, 0, 0, False, "not_found")]
    nodes, meta = explore.seed_from_artist(songs, asked(spark, " A", "none"))
    assert rows(nodes.select("id")) == [("s1",), ("s2",)]
    assert rows(meta.select("visible_node_count", "status")) == [(0, "ok"), (2, "ok")]
    first = rows(explore.seed_from_genre(songs, asked(spark, "rock"), 2)[0])
    assert len(first) == 2 and rows(explore.seed_from_genre(songs.repartition(3), asked(spark, "rock"), 2)[0]) == first


def sessions(spark, *given):
    return explore.sessions_from_arrays(spark.createDataFrame(
        list(given), "session_id string, visible_node_ids array<string>, visible_edge_ids array<string>, "
                     "selected_node_ids array<string>"))


def test_expansion(spark, songs, edges):
    nodes, links, meta = explore.expand(*sessions(spark, ("x", ["s1"], [], ["s1"])), songs, edges)
    assert nodes.count() == 5 and links.count() == 5
    assert meta.first()["visible_node_count"] == 6


def test_expansion_caps_and_skips(spark, songs, edges):
    more = edges.unionByName(spark.createDataFrame([("s2", "ghost", 1), ("s2", "s6", 2)], edges.schema))
    given = sessions(
        spark,
        ("full", ["s1", "s2", "s3", "s4"], [], ["s1"]),        # already at the cap
        ("none", ["s1"], [], []),                              # nothing selected
        ("hidden", ["s2"], [], ["s1"]),                        # selected is not visible
        ("slots", ["s1"], [], ["s1"]),                         # three free slots for five candidates
        ("ghost", ["s2", "s3", "s4"], [], ["s2"]),             # the one slot goes to a missing song
        ("again", ["s1", "s2"], ["s1__s2"], ["s1"]),           # a known edge is not new
    )
    nodes, links, meta = explore.expand(*given, songs, more, cap=4)
    assert rows(nodes.select("session_id", "id")) == [
        ("again", "s3"), ("again", "s4"), ("slots", "s2"), ("slots", "s3"), ("slots", "s4")]
    assert rows(links.select("session_id", "id")) == [
        ("again", "s1__s3"), ("again", "s1__s4"), ("slots", "s1__s2"), ("slots", "s1__s3"), ("slots", "s1__s4")]
    assert {r["session_id"]: (r["visible_node_count"], r["visible_edge_count"], r["reached_limit"]) for r in meta.collect()} == {
        "full": (4, 0, True), "none": (1, 0, False), "hidden": (1, 0, False), "slots": (4, 3, True),
        "ghost": (3, 0, False), "again": (4, 3, True)}


def test_repeated_expansion_never_repeats(spark, songs, edges):
    ring = edges.unionByName(spark.createDataFrame([("s6", "s1", 1)], edges.schema))
    start = spark.createDataFrame([("x", "s1", 1)], "session_id string, id string, position int")
    none = spark.createDataFrame([], "session_id string, id string")
    nodes, seen, meta = explore.expand_until_cap(start, none, songs, ring, rounds=4)
    assert nodes.count() == nodes.select("id").distinct().count() == 6
    assert seen.count() == seen.distinct().count() == 6
    assert [r["id"] for r in nodes.orderBy("position").collect()] == ["s1", "s2", "s3", "s4", "s5", "s6"]


def test_merge_delta(spark):
    schema = "session_id string, id string, position int, label string"
    old = spark.createDataFrame([("x", "a", 1, "old"), ("x", "b", 2, "old")], schema)
    new = spark.createDataFrame([("x", "a", 1, "new"), ("x", "c", 2, "new"), ("y", "a", 1, "new")], schema)
    assert rows(explore.merge_delta(old, new)) == [
        ("x", "a", 1, "new"), ("x", "b", 2, "old"), ("x", "c", 3, "new"), ("y", "a", 1, "new")]


def test_detail(spark, songs, edges):
    more = edges.unionByName(spark.createDataFrame([("s2", "ghost", 1)], edges.schema))
    got = explore.song_detail(songs, more, asked(spark, "s1", "s2", "nope", column="song_id"))
    assert [r["similar_song_id"] for r in got.where("request_id = 0").orderBy("neighbor_rank").collect()] == [
        "s2", "s3", "s4", "s5", "s6"]
    assert rows(got.where("request_id > 0").select("request_id", "similar_song_id", "status")) == [
        (1, None, "ok"), (2, None, "not_found")]


def source_files(spark, tmp_path):
    spark.createDataFrame(
        [(f" s{i + 1} ", NAMES[i], ARTISTS[i] if i else " ", GENRES[i] if i else None, i) for i in range(6)]
        + [("s1", "later", "z", "z", 9), ("", "no id", "a", "g", 10), ("s9", " ", "a", "g", 11), ("x" * 130, "long", "a", "g", 12)],
        "track_id string, track_name string, artist_name string, genre string, ord int",
    ).write.parquet(str(tmp_path / "songs"))
    wide = [[f"s{i + 1}"] + [f"s{(i + r) % 6 + 1}" for r in range(1, 6)] for i in range(6)]
    spark.createDataFrame(wide, "track_id string, " + ", ".join(f"sim_song_{r} string" for r in range(1, 6))).write.option(
        "header", True).csv(str(tmp_path / "similar"))


@pytest.mark.parametrize("engine", ["parquet", "bulk"])
def test_load(spark, tmp_path, engine):
    source_files(spark, tmp_path)
    paths = [str(tmp_path / p) for p in ("songs", "similar", "store")]
    only = load_catalogue(spark, *paths, validate_only=True)
    assert {r["metric"]: r["value"] for r in only.collect()} == {"songs_in_frame": 7, "neighbor_edges_in_frame": 30}
    report = {r["metric"]: r["value"] for r in load_catalogue(spark, *paths, engine=engine).collect()}
    assert report["songs_loaded"] == 7 and report["unique_neighbor_sources"] == 6
    stored, links = io.catalogue(spark, paths[2], stage=True)
    assert links.count() == 30
    first = stored.where("song_id = 's1'").first()
    assert (first["artist_name"], first["genre"]) == ("Unknown", "Unknown")
    assert stored.agg(F.max(F.length("song_id"))).first()[0] == 128
    load_catalogue(spark, *paths, engine="parquet")  # replaces
    assert io.catalogue(spark, paths[2], stage=True)[1].count() == 30


def test_violations_in_order(spark, songs, edges):
    def broken(extra_edges=(), extra_songs=(), keep="true"):
        s = songs.unionByName(spark.createDataFrame(list(extra_songs), songs.schema))
        e = edges.where(keep).unionByName(spark.createDataFrame(list(extra_edges), edges.schema))
        return s, e

    ingest.validate_frames(songs, edges)
    for expected, frames in {
        "Duplicate song_id values found in songs frame: 1": broken(extra_songs=[("s1", "x", "x", "x")], keep="neighbor_rank < 5"),
        "incomplete for 1 source": broken(keep="neighbor_rank < 5"),
        "1 source song IDs missing": broken([("q", f"s{r}", r) for r in range(1, 6)]),
        "2 target song IDs missing": broken([("s2", t, r) for r, t in enumerate(["u", "v", "u", "s3", "s4"], 1)]),
        "1 self-loop": broken([("s2", t, r) for r, t in enumerate(["s1", "s2", "s3", "s4", "s5"], 1)]),
    }.items():
        with pytest.raises(ValueError, match=expected):
            ingest.validate_frames(*frames)
    found = {r["constraint"]: r["violations"] for r in ingest.check_constraints(
        *broken([("s1", "s2", 1), ("s3", "s3", 6)])).collect() if r["violations"]}
    assert found == {"neighbours_primary_key": 1, "neighbours_unique_target": 1, "neighbours_rank_range": 1,
                     "neighbours_not_self": 1}


def test_delete_rules(spark, songs, edges):
    left, links, refused = ingest.delete_songs(songs, edges, asked(spark, "s1", column="song_id"))
    assert left.count() == 5 and links.count() == 0 and refused.count() == 0
    left, links, refused = ingest.delete_songs(songs, edges, asked(spark, "s2", column="song_id"))
    assert left.count() == 6 and links.count() == 5 and rows(refused) == [("s2", 1)]


def test_reading(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="does not exist"):
        io.read_table(spark, str(tmp_path / "nothing"), "csv")
    (tmp_path / "t.csv").write_text('name,artists,extra\n"a ""b""","[\'x\', \'y\']",1\n')
    got = io.load_tracks(spark, str(tmp_path / "t.csv"))
    assert rows(got.select("track_name", "artist")) == [('a "b"', "x")]
    with pytest.raises(ValueError):
        io.load_tracks(spark)
    got.createOrReplaceTempView("loaded_tracks")
    assert io.load_tracks(spark, table="loaded_tracks", load_limit=1).count() == 1
    io.write_csv_report(got, str(tmp_path / "report"))
    io.write_json_report(got, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
