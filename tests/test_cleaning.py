import pytest
from tests.helpers import rows
from pyspark.sql import functions as F

from trackloom.operators import clean, fill, quality, skew
from trackloom.plans import cleaning
from trackloom.schemas import MODELLED_COLUMNS, RAW_TRACK_COLUMNS, RAW_TRACKS


def tracks(spark, *given):
    return spark.createDataFrame([tuple(g.get(c) for c in RAW_TRACK_COLUMNS) for g in given], RAW_TRACKS)


def test_invalid_values_and_nan(spark):
    df = tracks(spark, {"valence": 0.0, "tempo": 0.0}, {"valence": 1.0, "tempo": 1.0}, {"valence": 1.2, "energy": -0.1},
                {"valence": float("nan"), "time_signature": 0.0})
    fixed = quality.invalid_to_null(clean.nan_to_null(df))
    assert [r[0] for r in fixed.select("valence").collect()] == [0.0, 1.0, None, None]
    assert {r["column"]: r["value"] for r in quality.invalid_counts(clean.nan_to_null(df)).collect() if r["value"]} == {
        "valence": 1, "energy": 1, "tempo": 1, "time_signature": 1}


GROUPED = [
    {"track_id": "a", "artist_name": "x", "track_name": "n", "duration_ms": 5.0, "key": 1.0},
    {"track_id": "a", "artist_name": None, "track_name": "n", "duration_ms": None, "key": 2.0},
    {"track_id": "a", "artist_name": "x", "track_name": "n", "key": None},
    {"track_id": None, "artist_name": "X ", "track_name": " N", "duration_ms": None},
    {"track_id": None, "artist_name": None, "track_name": "n"},
]


def check_fill(spark):
    done = fill.deterministic_fill(tracks(spark, *GROUPED), marks=True)
    got = rows(done.select("track_id", "artist_name", "duration_ms", "key"))
    # one distinct value fills, two do not; a null id is found through artist and track
    assert got == sorted([("a", "x", 5.0, 1.0), ("a", "x", 5.0, 2.0), ("a", "x", 5.0, None), ("a", "X ", 5.0, None),
                          (None, None, None, None)], key=lambda r: tuple((v is None, str(v)) for v in r))
    counts = {(r["metric"], r["column"]): r["value"] for r in fill.fill_counts(done).collect() if r["value"]}
    assert counts == {("fill_track_id", "artist_name"): 1, ("fill_track_id", "duration_ms"): 2,
                      ("fill_artist_track", "duration_ms"): 1, ("fill_artist_track", "track_id"): 1}


def test_fill(spark):
    check_fill(spark)


def test_fill_with_hot_keys(spark, monkeypatch):
    """Every key is hot: the salted side must give the same rows."""
    monkeypatch.setattr(skew, "hot_keys", lambda df, column: [
        r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().collect()])
    check_fill(spark)


@pytest.mark.parametrize("limit", [0, 1, 2, 100])
def test_fill_with_few_and_many_fillable_groups(spark, monkeypatch, limit):
    """Broadcast or shuffled: the same rows; rows that no group can fill are never shuffled."""
    monkeypatch.setattr(fill, "RARE_KEYS", limit)
    check_fill(spark)
    full = [{"track_id": str(i % 9), "duration_ms": float(i % 9) if i % 10 else None, "tempo": None} for i in range(90)]
    df = tracks(spark, *full)
    done = fill.fill_from_group(df, "track_id", ["duration_ms", "tempo"], "m")
    assert rows(done.select("track_id", "duration_ms", "m")) == rows(spark.createDataFrame(
        [(str(i % 9), float(i % 9), int(i % 10 == 0)) for i in range(90)], "a string, b double, c int"))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    read = [line for line in plan.splitlines() if "Filter" in line and "isnull(duration_ms" in line]
    assert ("strategy=merge" in plan) == (limit < 9) == bool(read)


def test_hot_keys_and_salting(spark):
    """A third of all rows are copies with one key; they spread over the salts."""
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                   F.lit(1).alias("v"))
    assert skew.hot_keys(hot, "k") == ["hot"]
    lookup = hot.groupBy("k").agg(F.sum("v").alias("total"))
    joined = skew.left_join_salted(hot.repartition(16), lookup, "k")
    assert joined.where("k = 'hot' and total = 1000").count() == 1000
    assert joined.count() == 3000 and joined.where("total is null").count() == 0


def test_conservation_identity(spark):
    """null_final = null_raw + text_to_null + invalid_to_null - fills - default."""
    given = GROUPED + [{"track_name": "  ", "tempo": -1.0, "track_id": "b", "explicit": 1.0}, {"track_id": "b", "valence": 2.0}]
    raw = tracks(spark, *given)
    result = cleaning.pre_imputation(raw)
    report = {(r["stage"], r["metric"], r["column"]): r["value"] for r in result.report.collect()}
    texted = {r["column"]: r["value"] for r in quality.null_counts(clean.normalise_identity_text(raw)).collect()}
    for c in RAW_TRACK_COLUMNS:
        expected = (texted[c] + report.get(("invalid_to_null", "invalid", c), 0)
                    - report.get(("deterministic_fill", "fill_track_id", c), 0)
                    - report.get(("deterministic_fill", "fill_artist_track", c), 0)
                    - report.get(("default_fill", "default_fill", c), 0))
        assert report[("final", "nulls", c)] == expected, c
    assert report[("final", "duplicate_track_ids", "")] == report[("raw", "duplicate_track_ids", "")] + report[
        ("deterministic_fill", "fill_artist_track", "track_id")]


def test_fill_plan_has_one_aggregate_and_no_expand(spark):
    lookup = fill.unique_values(tracks(spark, *GROUPED), "track_id", fill.BY_TRACK_ID)
    plan = lookup._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 1


def test_most_complete_and_zero_signal(spark):
    df = tracks(spark, {"track_id": "a", "track_name": "one"}, {"track_id": "a", "track_name": "two", "tempo": 1.0},
                {"track_id": "a", "track_name": "three", "tempo": 2.0}, {"track_name": "none"}, {"track_name": "none"},
                {"track_id": " ", "track_name": "blank"}).withColumn("ord", F.monotonically_increasing_id())
    assert rows(clean.keep_most_complete(df, ["ord"]).select("track_name")) == [
        ("blank",), ("none",), ("none",), ("two",)]
    kept = clean.drop_zero_signal(tracks(spark, {"energy": None}, {"energy": 0.5}, {"tempo": 1.0}), "energy")
    assert kept.count() == 2


def test_postprocess(spark):
    df = tracks(spark, {"artist_name": "['A', 'B']", "key": 3.0, "mode": 1.0}, {"artist_name": "[x]", "key": 0.0, "mode": 0.0})
    done = clean.postprocess_final(df)
    assert rows(done.select("artist_name", "key", "mode")) == [("A; B", 3, 1), ("x", 0, 0)]
    assert dict(done.dtypes)["key"] == "tinyint"
    report = {r["metric"]: r["value"] for r in clean.postprocess_report(df, done).collect()}
    assert report == {"artist_name_full_bracket_wrappers_before": 2, "rows": 2, "artist_name_nulls": 0,
                      "artist_name_full_bracket_wrappers_after": 0}
    with pytest.raises(Exception, match="key is null"):
        clean.postprocess_final(tracks(spark, {"mode": 1.0})).collect()


def test_graph_cleaning(spark):
    df = spark.createDataFrame(
        [(0, "a", "x", "rock", 1.0), (1, " a ", "x", "pop", 9.0), (2, "nan", "y", None, 5.0), (3, "b", "z", None, None),
         (4, "c", "w", "g", 7.0)], "ord int, artist string, track_name string, genre string, popularity double")
    assert rows(clean.clean_songs(df, None, ["ord"]).select("artist", "genre", "popularity")) == [
        ("a", "rock", 1.0), ("b", "", None), ("c", "g", 7.0)]
    assert rows(clean.clean_songs(df, 2, ["ord"]).select("artist")) == [("a",), ("c",)]
    unpopular = df.withColumn("popularity", F.lit(None).cast("double"))
    assert clean.clean_songs(unpopular, 2, ["ord"]).count() == 2
    with pytest.raises(ValueError, match="track_name"):
        clean.clean_songs(df.drop("track_name"))


def test_schema_normalisation(spark):
    df = spark.createDataFrame([("n", "['A']", "g")], "name string, artists string, track_genre string")
    done = clean.normalise_schema(df)
    assert rows(done.select("track_name", "artist", "genre", "popularity")) == [("n", "A", "g", None)]


def test_flags(spark):
    flagged = clean.add_missing_flags(tracks(spark, {"key": 1.0}))
    assert flagged.select(*[f"{c}_missing" for c in MODELLED_COLUMNS]).first()["key_missing"] == 0
    assert dict(flagged.dtypes)["key_missing"] == "tinyint"


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_partition_invariance(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        check_fill(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
