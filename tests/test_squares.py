import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tests.test_modelling import learnable
from trackloom.operators import impute, squares
from trackloom.operators.impute import TreeParams

WHOLE = TreeParams(rounds=3, depth=3, step=0.3, row_share=1.0, feature_share=1.0, max_bins=16)


def made(spark, n=700):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 5, n), rng.random(n) < 0.1, np.full(n, 2)], axis=1).astype(float)
    y = np.stack([np.sin(x[:, 0]) + x[:, 1] + rng.normal(size=n) / 9, x[:, 2] - x[:, 0] * x[:, 1]], axis=1)
    return spark.createDataFrame([(v.tolist(), *map(float, t)) for v, t in zip(x, y)], "f array<double>, a double, b double").withColumn(
        "features", array_to_vector("f")).repartition(3).cache()


def test_trees_grow_together_and_equal_spark_trees(spark, monkeypatch):
    """A target's trees are those of Spark's own boosting; rows in short blocks, several a batch."""
    df = made(spark)
    monkeypatch.setattr(squares, "BLOCK", 37)
    found = squares.fit(df, ["a", "b"], WHOLE).transform(df, ["pa", "pb"])
    for c in ("a", "b"):
        plain = GBTRegressor(labelCol=c, maxIter=3, maxDepth=3, stepSize=0.3, maxBins=16, predictionCol=f"spark_{c}").fit(df)
        found = plain.transform(found)
    for r in found.collect():
        assert r["pa"] == pytest.approx(r["spark_a"], abs=1e-6) and r["pb"] == pytest.approx(r["spark_b"], abs=1e-6)
    assert found.columns[:6] == [*df.columns, "pa", "pb"] and squares.fit(df, ["a"], WHOLE).transform(df.limit(0), ["p"]).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        squares.fit(df.limit(0), ["a"], WHOLE)


def test_rows_and_features_are_drawn_by_their_share(spark):
    """Every round and node draws anew, and the same way each time."""
    numbers = np.arange(100_000) + (3 << 40)
    one, two = (squares._drawn(numbers, 0.8, 42, turn) for turn in (0, 1))
    assert one.mean() == pytest.approx(0.8, abs=0.01) and (one & two).mean() == pytest.approx(0.64, abs=0.01)
    assert (squares._drawn(numbers, 0.8, 42, 0) == one).all()
    df, params = made(spark), TreeParams(rounds=2, depth=2, row_share=0.5, feature_share=0.5, max_bins=16)
    first, again = (squares.fit(df, ["a"], params) for _ in range(2))
    for s, t in zip(first.stages, again.stages):
        assert all(np.allclose(p, q) for p, q in zip(s[0], t[0]))
    assert squares.fit(df, ["a"], TreeParams(rounds=1, depth=2, max_bins=16, min_gain=1e9)).stages[0][0][0].max() == -1


def test_points_are_fitted_from_blocks_that_are_not_held_in_memory(spark, monkeypatch):
    """Three Spark fits, as before, hold every row in memory three times."""
    monkeypatch.setattr(impute, "GBTRegressor", None)
    tables, write = [], squares.cut_lineage
    monkeypatch.setattr(squares, "cut_lineage", lambda df: tables.append(write(df)) or tables[-1])
    params = TreeParams(rounds=2, depth=2, max_bins=16)
    done = impute.impute_key_mode_xyz(learnable(spark, 300), "k", params, ["loudness", "tempo"])
    assert done.table.where("key is null or mode is null").isEmpty()
    # per fit the bins, and the predictions of the first round
    assert len(tables) == 4 and all(t.columns == ["at", "x", "g"] for t in tables)
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        tables[0].agg(F.count("x")).collect()
