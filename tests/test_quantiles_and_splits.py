import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import audit, quantiles, splits


@pytest.mark.parametrize("thin", [1, 50, 100_000])
def test_sliced_quantiles_match_numpy(spark, thin):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=997), "heavy": np.exp(rng.normal(size=800) * 6), "tied": np.repeat([1.0, 2.0], [600, 1]),
        "one": np.array([4.0]), "tiny_then_huge": np.concatenate([rng.uniform(0, 1e-9, 700), [1e9]]),
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None)],
                               "g string, v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in quantiles.exact_quantiles(df, ["g"], "v", probs, thin=thin).collect()}
    for g, values in groups.items():
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(values, p), rel=1e-12), (g, p)


@pytest.mark.parametrize("thin", [1, 5])
def test_quantiles_of_infinities_huge_ranges_and_null_keys(spark, thin):
    inf = float("inf")
    groups = {None: [*range(20)], "both": [-inf, -inf, *range(9), inf, inf], "up": [*range(30), inf],
              "down": [-inf, *range(30)], "huge": [-1.7e308, -1.0, 0.0, 1.0, 2.0, 3.0, 1.7e308],
              "small": [0.0, 5e-324, 1e-323, 1.5e-323, 1.0], "nan": [1.0, 2.0, float("nan")]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(3)
    got = {(r["g"], r["p"]): r["q"] for r in quantiles.exact_quantiles(df, ["g"], "v", [0.0, 0.5, 1.0], thin=thin).collect()}
    assert len(got) == 3 * len(groups)
    for g, values in groups.items():
        ordered = sorted(values, key=lambda v: (v != v, v))
        assert got[(g, 0.0)] == ordered[0]
        low, high = ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2]
        assert got[(g, 0.5)] == (low if low == high else 0.5 * low + 0.5 * high), g
        assert got[(g, 1.0)] == ordered[-1] or g == "nan"


def test_sliced_quantiles_without_groups(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    got = quantiles.exact_quantiles(df, [], "v", [0.5, 0.33], thin=3)
    assert sorted(r["q"] for r in got.collect()) == pytest.approx([33.0, 50.0])


def test_stratified_hold_out_is_exact_and_layout_free(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.sqrt("id") % 3).cast("int").alias("label"))
    one = splits.stratified_hold_out(df, "label", "k")
    sizes = {r["label"]: (r["n"], r["h"]) for r in one.groupBy("label").agg(
        F.count("k").alias("n"), F.count_if("held_out").alias("h")).collect()}
    assert all(h == round(n * 0.2) for n, h in sizes.values())
    other = splits.stratified_hold_out(df.repartition(13), "label", "k")
    assert one.exceptAll(other.select(*one.columns)).isEmpty()


def test_samples(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).alias("label"))
    assert splits.sample_rows(df, "k", 137).count() == 137
    assert splits.sample_rows(df, "k", 5000).count() == 1000
    assert splits.stratified_sample(df, "label", "k", 100).groupBy("label").count().where("count = 50").count() == 2
    assert splits.stratified_sample(df, "label", "k", 5000).count() == 1000


def test_storage_and_min_max(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [r[0] for r in df.select(audit.min_max(F.col("v"))).collect()] == [0.0, 0.0]
    table = spark.createDataFrame([(3.0, 2.0, "a", "b", "c")], "key double, mode double, track_id string, artist_name string, track_name string")
    got = {r["metric"]: r["value"] for r in audit.storage_recommendations(table).collect()}
    assert got["key_can_be_int8"] == 1 and got["mode_can_be_int8"] == 0 and got["track_id_can_be_string_dtype"] == 0
