"""Lifetime of intermediate tables, restartable jobs, folds, and plans without needless shuffles."""

import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from trackloom.operators import audit, explore, fill, impute, skew, softboost, splits
from trackloom.plans import cleaning, stages
from trackloom.schemas import MODELLED_COLUMNS, RAW_TRACK_COLUMNS, RAW_TRACKS, REGRESSION_TARGETS
from trackloom.session import Scope, cut_lineage, result_of, shared_folder


def tables(spark):
    return set(os.listdir(shared_folder(spark)))


def test_a_scope_deletes_what_it_wrote(spark):
    before = tables(spark)
    with Scope(spark) as scope:
        held = cut_lineage(spark.range(10))
        with Scope(spark) as inner:
            cut_lineage(spark.range(5))
            kept = inner.keep(held.where("id > 3"))
        assert len(tables(spark) - before) == 2 and kept.count() == 6  # the inner one's own table is gone
        scope.drop(held)
        assert len(tables(spark) - before) == 1
        final = scope.keep(kept.where("id > 7"))
    assert rows(final) == [(8,), (9,)] and len(tables(spark) - before) == 1
    with pytest.raises(RuntimeError), Scope(spark):
        cut_lineage(spark.range(3))
        raise RuntimeError
    assert len(tables(spark) - before) == 1


def test_tables_do_not_grow_with_rounds(spark):
    """A job of many rounds leaves one table, however many rounds it took."""
    nodes = spark.createDataFrame([("s", "n0", 0)], "session_id string, id string, position int")
    seen = spark.createDataFrame([], "session_id string, id string")
    songs = spark.createDataFrame([(f"n{k}", f"n{k}", "a", "g") for k in range(9)],
                                  "song_id string, song_name string, artist_name string, genre string")
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", 1) for k in range(8)],
                                  "source_song_id string, target_song_id string, neighbor_rank int")
    before = tables(spark)
    left = []
    for rounds in (2, 5):
        found = result_of(spark, lambda n=rounds: explore.expand_until_cap(nodes, seen, songs, edges, n)[0])
        assert found.count() == rounds + 1
        left.append(len(tables(spark) - before))
    assert left == [1, 2]


def test_sessions_without_nodes_stay(spark):
    nodes = spark.createDataFrame([("s", "n0", 0)], "session_id string, id string, position int")
    seen = spark.createDataFrame([], "session_id string, id string")
    songs = spark.createDataFrame([("n0", "n0", "a", "g")], "song_id string, song_name string, artist_name string, genre string")
    edges = spark.createDataFrame([], "source_song_id string, target_song_id string, neighbor_rank int")
    asked = spark.createDataFrame([("s",), ("empty",)], "session_id string")
    meta = explore.expand_until_cap(nodes, seen, songs, edges, 2, sessions=asked)[2]
    assert rows(meta.select("session_id", "visible_node_count")) == [("empty", 0), ("s", 1)]


def test_a_stopped_run_goes_on(spark, tmp_path):
    ran, source = [], spark.range(20)

    def stage(name, change, fails=False):
        def run(df):
            ran.append(name)
            if fails:
                raise RuntimeError(name)
            return change(cut_lineage(df))
        return name, run

    first = stage("even", lambda df: df.where("id % 2 = 0"))
    last = stage("double", lambda df: df.select((F.col("id") * 2).alias("id")))
    before, folder = tables(spark), str(tmp_path / "job")
    with pytest.raises(RuntimeError):
        stages.run_stages(spark, source, [first, stage("large", None, fails=True), last], folder)
    assert tables(spark) == before
    again = [first, stage("large", lambda df: df.where("id > 10")), last]
    done = stages.run_stages(spark, source, again, folder)
    assert ran == ["even", "large", "large", "double"]
    assert rows(done) == rows(stages.run_stages(spark, source, again, folder)) == rows(spark.createDataFrame(
        [(24,), (28,), (32,), (36,)], "id long")) and len(ran) == 4
    with pytest.raises(ValueError):
        stages.run_stages(spark, source, [first, last], folder)


def test_the_whole_chain(spark, tmp_path, monkeypatch):
    """Raw files to the finished table, stopped once on the way; no gap is left in what is imputed."""
    base = spark.range(400).select("id", *[
        (F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(1000)) / 1000).alias(c) for c in MODELLED_COLUMNS if c not in ("key", "mode")],
        F.when(F.col("id") % 7 > 0, (F.col("id") % 12).cast("double")).alias("key"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 2).cast("double")).alias("mode"))
    raw = base.withColumns({"track_id": F.col("id").cast("string"), "artist_name": F.lit("['A b']"), "track_name": F.col("id").cast("string"),
                            "duration_ms": F.lit(1000.0), "explicit": F.lit(None).cast("double"), "time_signature": F.lit(4.0),
                            "energy": F.when(F.col("id") % 9 > 0, F.col("energy")), "tempo": F.when(F.col("id") % 8 > 0, F.col("tempo") + 90)})
    path, folder = str(tmp_path / "raw"), str(tmp_path / "chain")
    raw.select(*[F.col(c).cast(RAW_TRACKS[c].dataType) for c in RAW_TRACK_COLUMNS]).write.parquet(path)
    few, tried = impute.TreeParams(rounds=1, depth=2, max_bins=16), []
    real = impute.impute

    def failing(df, target, key, params):
        tried.append(target.name)
        if target.name == "mode" and tried.count("mode") == 1:
            raise RuntimeError("stopped")
        return real(df, target, key, params)

    monkeypatch.setattr(impute, "impute", failing)
    with pytest.raises(RuntimeError, match="stopped"):
        cleaning.run_chain(spark, path, folder, params=few, boost=softboost.LinearParams(3), order=["energy"])
    table, report = cleaning.run_chain(spark, path, folder, params=few, boost=softboost.LinearParams(3), order=["energy"])
    assert tried == ["energy", "mode", "mode", "tempo"]
    assert table.count() == 400 and report.count() > 0
    assert table.where("energy is null or key is null or mode is null or tempo is null").isEmpty()
    assert dict(table.dtypes)["key"] == "tinyint" and table.select("artist_name").distinct().collect()[0][0] == "A b"


def test_reports_carry_types(spark, tmp_path):
    source = spark.createDataFrame([tuple(None for _ in RAW_TRACK_COLUMNS)], RAW_TRACKS)
    source.write.parquet(str(tmp_path / "raw"))
    cleaning.run_pre_imputation(spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "report"))
    found = {(r["stage"], r["column"]): r["dtype"] for r in spark.read.json(str(tmp_path / "report_dtypes")).collect()}
    assert found["raw", "tempo"] == "double" and found["final", "track_id"] == "string" and len(found) == 2 * len(RAW_TRACK_COLUMNS)


def test_stratified_folds_are_even_and_layout_free(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("k"),
                                  F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 900, (F.col("id") % 7).cast("string")).alias("label"))
    one = splits.stratified_folds(df, "label", "k", 5)
    assert one.columns == ["k", "label", "fold"] and one.count() == 1003
    sizes = one.groupBy("label", "fold").count().groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), (F.max("count") - F.min("count")).alias("off")).collect()
    assert all(r["n"] == 5 and r["off"] <= 1 for r in sizes) and len(sizes) == 9
    for bits in (2, 16):
        other = splits.stratified_folds(df.repartition(13), "label", "k", 5, bucket_bits=bits)
        assert rows(one) == rows(other)
    assert splits.stratified_folds(df.limit(0), "label", "k").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_without_key_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(skew, "hot_keys", lambda df, column: [])
    frame = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"),
                                    F.when(F.col("id") > 50, F.lit(1.0)).alias("v"))
    with_keys = fill.fill_from_group(frame, "k", ["v"])
    union = with_keys._jdf.queryExecution().optimizedPlan()
    while union.nodeName() != "Union":
        union = union.children().apply(0)
    alone = union.children().apply(1).toString()
    assert "Filter" in alone and "Join" not in alone and "Aggregate" not in alone
    assert with_keys.count() == 100 and with_keys.where("k is null").count() == 50


def test_correlations_expand_no_rows(spark):
    df = spark.range(50).select(*[(F.col("id") % (k + 3)).cast("double").alias(c) for k, c in enumerate(REGRESSION_TARGETS)])
    below = plan(audit._mean_abs_correlations(df)).rsplit("HashAggregate", 1)[1]  # what the lowest aggregate reads
    assert "Range" in below and "Generate" not in below and "Expand" not in below
    wide = df.toPandas().corr().abs()
    found = {r["target"]: r[1] for r in audit._mean_abs_correlations(df).collect()}
    for c in REGRESSION_TARGETS:
        assert found[c] == pytest.approx(wide[c].drop(c).mean())
