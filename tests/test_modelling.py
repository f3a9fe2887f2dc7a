import datetime
import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from checks import modelling
from trackloom import session
from trackloom.functions import circle, decode
from trackloom.operators import clean, impute, metrics, softboost
from trackloom.plans import experiments
from trackloom.schemas import MODELLED_COLUMNS

FEW = impute.TreeParams(rounds=8, depth=4, step=0.3, feature_share=1.0, row_share=1.0)


def test_distance_matrices():
    ring = np.array(circle.distance_matrix("key"))
    assert ring[0, 6] == pytest.approx(2) and ring[0, 3] == pytest.approx(2 ** 0.5)
    assert np.array(circle.distance_matrix("key", "fifths"))[0, 7] == pytest.approx(ring[0, 1])
    joint = np.array(circle.distance_matrix("joint"))
    assert joint[0, 12] == pytest.approx(2) and joint[0, 18] == pytest.approx(8 ** 0.5)
    soft = np.array(circle.soft_targets(circle.distance_matrix("key"), 0.4, 2.0))
    assert np.allclose(soft.sum(axis=1), 1) and soft[0].argmax() == 0 and soft[0, 1] > soft[0, 2]
    assert np.allclose(circle.soft_targets(circle.distance_matrix("key"), 0.0, 1.0), np.eye(12))


def numpy_decoders(p, threshold, k):
    steps = np.array(circle.distance_matrix("steps"))
    expected = p @ steps
    order = np.lexsort((np.arange(12)[None].repeat(len(p), 0), -p), axis=1)[:, :k]
    top = [min(sorted(o), key=lambda c: (expected[i, c], c)) for i, o in enumerate(order)]
    best = p.argmax(axis=1)
    return best, expected.argmin(axis=1), np.array(top), np.where(p.max(axis=1) < threshold, top, best), expected


def test_decoders(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(12) * 0.3, size=200)
    p[0] = [0.5, 0.5] + [0] * 10  # a tie goes to the first class
    p[1] = [0.34, 0, 0, 0, 0, 0.22, 0.22, 0.22, 0, 0, 0, 0]  # argmax and least distance differ
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(p)], "i int, probs array<double>")
    ranked, expected = F.col("ranked"), F.col("expected")
    got = decode.with_ranking(df).select(
        "i", decode.argmax(F.col("probs")), decode.min_expected_distance(expected),
        decode.top_k_min_expected_distance(ranked, 3), decode.gated_top_k(ranked, 0.4, 3),
        decode.most_probable(ranked), decode.confidence(ranked)).orderBy("i").collect()
    best, nearest, top, gated, _ = numpy_decoders(p, 0.4, 3)
    assert [r[1] for r in got] == list(best) == [r[5] for r in got]
    assert [r[2] for r in got] == list(nearest)
    assert [r[3] for r in got] == list(top)
    assert [r[4] for r in got] == list(gated)
    assert [r[6] for r in got] == pytest.approx(list(p.max(axis=1)))
    soft = spark.createDataFrame([([1000.0, 1001.0],)], "m array<double>").select(decode.softmax(F.col("m"), 2)).first()[0]
    assert soft == pytest.approx([1 / (1 + np.e), np.e / (1 + np.e)])


def test_decoders_stay_compiled_and_lines_are_told_apart_by_key(spark, tmp_path, capsys):
    """The JVM leaves methods over 8000 bytes of code uncompiled."""
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate date"
    day = datetime.date(1995, 3, 1)
    rows = [(1, 2, 3, 4, day), (1, 2, 3, 4, day), (1, 2, None, 4, day), (1, 2, 3, 5, day), (None, 1, 3, 2, day), (2, None, 3, 1, day),
            (5, 6, 7, 1, day), (5, 6, 7, 1, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = modelling.decoded_keys(spark, str(tmp_path))
    assert sorted(r["line"] for r in found.collect()) == ["1:4:2", "1:4:2:3", "1:5:2:3", "2:1:3", "5:1:6:7"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        modelling.decoded_keys(spark, str(tmp_path)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000
    odd = spark.createDataFrame([(None,), ([0.5, None],), ([0.25, 0.75],)], "probs array<double>")
    got = [r[0] for r in odd.select(decode.expected_distances(F.col("probs"), [[0.0, 2.0], [2.0, 0.0]])).collect()]
    assert got == [[None, None], [None, None], [1.5, 0.5]]


def test_key_metrics(spark):
    pairs = [(0, 11), (0, 0), (3, 5), (3, 3), (6, 0)]
    df = spark.createDataFrame(pairs, "true_key int, predicted_key int")
    got = metrics.key_metrics(df, planar=True).first()
    assert got["accuracy"] == pytest.approx(0.4)
    assert got["mean_key_distance"] == pytest.approx((1 + 0 + 2 + 0 + 6) / 5) and got["median_key_distance"] == 1.0
    # labels seen anywhere: 0, 3, 5, 6, 11
    assert got["f1_macro"] == pytest.approx((2 / (2 + 2) + 2 / (2 + 1) + 0 + 0 + 0) / 5)
    assert got["within_1_semitone"] == pytest.approx(0.6) and got["within_2_semitones"] == pytest.approx(0.8)


def test_regression_and_weights(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    got = metrics.regression_metrics(df, "y", "p").first()
    y, p = np.array([1, 2, 4.0]), np.array([1.5, 2, 3])
    assert got["mae"] == pytest.approx(0.5) and got["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    weights = spark.range(7).select(circle.error_weight(F.col("id")).alias("w"))
    assert [r[0] for r in weights.collect()] == [1.0, 1.25, 1.5, 1.75, 2.0, 2.0, 2.0]


def learnable(spark, n=1500):
    """energy follows valence; key and mode follow loudness and tempo; some gaps."""
    base = spark.range(n).select(F.col("id").cast("string").alias("k"), "id", *[
        F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(1000)).cast("double").alias(c) for c in MODELLED_COLUMNS])
    unit = base.withColumns({c: F.col(c) / 1000 for c in MODELLED_COLUMNS})
    made = unit.withColumns({
        "energy": 0.2 + 0.6 * F.col("valence"), "key": F.floor(F.col("loudness") * 12).cast("double"),
        "mode": (F.col("tempo") > 0.5).cast("double")})
    gaps = {"energy": 7, "key": 11, "mode": 13, "tempo": 17}
    # tempo keeps its value where mode depends on it; liveness loses some
    holes = made.withColumns({c: F.when(F.col("id") % m != 0, F.col(c)) for c, m in gaps.items() if c != "tempo"})
    return clean.add_missing_flags(holes.drop("id"))


def test_regression_imputation(spark):
    df = learnable(spark)
    done = impute.impute_regression(df, impute.targets()["energy"], "k", FEW)
    assert done.metrics.first()["r2"] > 0.9
    filled = done.table.join(df.select("k", F.col("energy").alias("was")), "k")
    assert filled.where("energy is null").isEmpty() and filled.where("was is not null and was != energy").isEmpty()
    far = filled.where("was is null").select(F.max(F.abs(0.2 + 0.6 * F.col("valence") - F.col("energy")))).first()[0]
    assert far < 0.2
    assert done.table.columns == df.columns and done.counts.first()["imputed_rows"] == 215


def test_clipping(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (2.0,)], "p double")
    known = impute.targets()

    def clipped(name):
        t = known[name]
        return [r[0] for r in df.select(impute.clip(F.col("p"), t.lower, t.upper)).collect()]

    assert clipped("valence") == [0.0, 0.5, 1.0]
    assert clipped("loudness") == [-1.0, 0.5, 2.0]
    assert clipped("tempo") == [0.0, 0.5, 2.0]


def test_mode_imputation_and_folds(spark):
    df = learnable(spark)
    done = impute.impute_classification(df, impute.targets()["mode"], "k", FEW)
    assert done.metrics.first()["accuracy"] > 0.95
    assert done.table.where("mode is null").isEmpty()
    scores = impute.cross_validate(df, impute.targets()["energy"], "k", 3, FEW).first()
    assert scores["folds"] == 3 and scores["r2"] > 0.9


def test_soft_boost_learns_and_leaves_match(spark):
    df = learnable(spark, 800)
    params = softboost.BoostParams(rounds=2, depth=5, step=0.5, row_share=1.0)
    done = softboost.impute_key(df, "k", params, features=["loudness", "valence"])
    assert done.metrics.first()["accuracy"] > 0.7
    assert dict(done.table.dtypes)["key"] == "int" and done.table.where("key is null").isEmpty()
    # one depth-0 step equals the closed form -sum(g) / (sum(h) + l2)
    rows = spark.createDataFrame([(str(i), [float(i)], i % 3) for i in range(9)], "k string, f array<double>, y int")
    rows = rows.withColumn("features", array_to_vector("f"))
    model = softboost.fit(rows, "y", "k", np.eye(3).tolist(), softboost.BoostParams(
        rounds=1, depth=0, step=1.0, row_share=1.0, l2=1.0))
    g = 9 * (1 / 3) - 3
    h = 9 * (1 / 3) * (2 / 3)
    scored = model.transform(rows).first()["probs"]
    assert scored == pytest.approx([1 / 3] * 3) and g == pytest.approx(0) and model.stages[0][0][1][0.0] == pytest.approx(h / (h + 1))


def test_boosted_trees_of_a_round_grow_in_one_pass_a_level_and_equal_spark_trees(spark):
    """Against one Spark tree per class over the Newton steps; a row is not read once per class."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 9, 500), rng.integers(0, 5, 500), rng.random(500) < 0.1], axis=1).astype(float)
    y = (x[:, 0] // 3 + x[:, 2]).astype(int) % 3
    df = spark.createDataFrame([(str(i), v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))],
                               "k string, f array<double>, y int").withColumn("features", array_to_vector("f")).repartition(3).cache()
    goal = np.eye(3) * 0.7 + 0.1
    params = softboost.BoostParams(rounds=2, depth=3, step=0.5, row_share=1.0, l2=0.0, max_bins=16)
    model = softboost.fit(df, "y", "k", goal.tolist(), params)
    margin = np.zeros((500, 3))
    rows = df.select("f", "y").collect()
    xs, ys = np.array([r["f"] for r in rows]), np.array([r["y"] for r in rows])
    for stage in model.stages:
        p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
        for c, (tree, factors) in enumerate(stage):
            h = p[:, c] * (1 - p[:, c])
            made = spark.createDataFrame([(v.tolist(), float(-(q - t) / w), float(w)) for v, q, t, w in zip(
                xs, p[:, c], goal[ys, c], h)], "f array<double>, l double, w double").withColumn("features", array_to_vector("f"))
            plain = DecisionTreeRegressor(labelCol="l", weightCol="w", maxDepth=3, maxBins=16).fit(made)
            wanted = np.array([r[0] for r in plain.transform(made).select("prediction").collect()])
            leaf = softboost._descend(xs, tree.feature, tree.threshold, 3)
            assert factors == {} and tree.value[leaf] == pytest.approx(wanted, abs=1e-6)
            margin[:, c] += 0.5 * wanted
    found = np.array([r[0] for r in model.transform(df).select("probs").collect()])
    assert found == pytest.approx(np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True), abs=1e-6)
    assert model.transform(df.limit(0)).count() == 0
    wide = spark.range(1000).select(F.array(F.col("id").cast("double"), (F.col("id") > 998).cast("double")).alias("_x"))
    many, few = softboost._thresholds(wide, 16)
    assert len(many) == 16 and np.abs(np.diff(many) - 62.5).max() < 15 and list(few) == [0.5]


def test_linear_soft_targets_and_joint(spark):
    df = learnable(spark, 1200)
    done = softboost.impute_joint(df, "k", softboost.LinearParams(20), features=["loudness", "tempo"])
    assert {r["model"] for r in done.metrics.collect()} == {"baseline", "geometric"}
    assert done.table.where("key is null or mode is null").isEmpty()
    assert done.metrics.where("model = 'geometric'").first()["mode_accuracy"] > 0.7


@pytest.mark.parametrize("iterations, off", [(5, 0.02), (30, 0.005)])
def test_linear_fit_reads_a_row_once_and_equals_the_repeated_fit(spark, iterations, off):
    """Against Spark's own regression over rows repeated once per class."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 20, 0] + [5, -3, 2]
    y = (np.abs(x[:, 0] - 5) * 2 + rng.random(400)).astype(int) % 4
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "f array<double>, y int").withColumn(
        "features", array_to_vector("f")).coalesce(2).cache()
    goal = (np.eye(5) * 0.6 + 0.08)[:4].tolist() + [[0.08] * 4 + [0.68]]
    model = softboost.fit_linear(df, "y", goal, iterations)
    counts, sums, squares = softboost._moments(df.select("f", "y"), 5)
    assert list(counts) == [*np.bincount(y), 0] and sums.sum(axis=0) == pytest.approx(x.sum(axis=0))
    assert squares == pytest.approx((x * x).sum(axis=0))
    repeated = df.select("features", F.posexplode(circle.as_literal(goal)[F.col("y")]).alias("c", "w"))
    plain = LogisticRegression(labelCol="c", weightCol="w", family="multinomial", maxIter=iterations).fit(repeated)
    found = np.array([r[0] for r in model.transform(df).select("probs").collect()])
    wanted = np.array([r[0].toArray() for r in plain.transform(df).select("probability").collect()])
    assert np.abs(found - wanted).max() < off
    assert "probs" in model.transform(df).columns and model.transform(df).columns[:3] == df.columns


def test_xyz(spark):
    df = learnable(spark, 1200)
    done = impute.impute_key_mode_xyz(df, "k", FEW, ["loudness", "tempo"])
    assert done.metrics.first()["mode_accuracy"] > 0.95 and done.metrics.first()["within_1_semitone"] > 0.7
    assert done.table.where("key is null or mode is null").isEmpty()


def test_experiments(spark):
    df = learnable(spark, 900)
    sweep, decoded = experiments.gated_key_imputation(df, "k", FEW, ["loudness", "valence"])
    assert sweep.count() == 19 and decoded.where("chosen_key is null").isEmpty() and decoded.count() == 82
    analysis = experiments.mode_analysis(df, "k", FEW)
    assert analysis.count() == 15 and analysis.first()["f1_macro"] > 0.9
    table, gains = experiments.compare_versions({"one": df, "two": df}, "mode", "k", FEW)
    assert table.count() == 2 and gains.first()["accuracy_gain"] == 0
    grid = experiments.geometric_grid(df, "k", [0.2], [1.0, 2.0], softboost.LinearParams(5), features=["loudness"])
    assert grid.count() == 3 and grid.where("model = 'baseline'").count() == 1
    scores, spread = experiments.error_weighted_experiment(df, "k", FEW, 2, features=["loudness", "valence"])
    assert scores.count() == 2 and 1.0 <= spread.first()["mean"] <= 2.0


def written(monkeypatch, module):
    """Columns of the tables that a module writes."""
    tables, write = [], module.cut_lineage

    def noted(df):
        tables.append(set(df.columns))
        return write(df)

    monkeypatch.setattr(module, "cut_lineage", noted)
    return tables


def test_filled_versions_write_what_they_read(spark, monkeypatch):
    """A version's fit is the only one, and only what a fit reads is written for it."""
    df = learnable(spark, 600).withColumn("text", F.lit("x"))
    fits, fit = [], impute.fit_regressor
    monkeypatch.setattr(impute, "fit_regressor", lambda *a: fits.append(a[1]) or fit(*a))
    held, compared = written(monkeypatch, impute), written(monkeypatch, experiments)
    filled = impute.fill_regression(df, impute.targets()["energy"], "k", FEW)
    assert fits == ["energy"] and held == [{"energy", "held_out", "features"}]
    assert filled.columns == df.columns and filled.where("energy is null").isEmpty()
    table, _ = experiments.compare_versions({"one": df, "two": filled}, "mode", "k", FEW)
    assert table.count() == 2 and not any("text" in c for c in compared)
    assert compared.count({"mode", "valence_missing", "held_out", "features"}) == 2


def test_gated_keys_write_what_they_read(spark, monkeypatch):
    tables = written(monkeypatch, experiments)
    experiments.gated_key_imputation(learnable(spark, 600), "k", FEW, ["loudness", "valence"])
    assert [c for c in tables if "features" in c] == [{"key", "held_out", "features"}]


def test_folds_write_what_they_read(spark, monkeypatch):
    tables = written(monkeypatch, impute)
    impute.cross_validate(learnable(spark, 600), impute.targets()["energy"], "k", 2, FEW)
    assert tables == [{"energy", "fold", "features"}]


def test_points_write_what_they_read(spark, monkeypatch):
    df = learnable(spark, 600).withColumn("text", F.lit("x"))
    tables = written(monkeypatch, impute)
    done = impute.impute_key_mode_xyz(df, "k", FEW, ["loudness", "tempo"])
    assert tables == [{"key", "mode", "held_out", "features", "x", "y", "z"}]
    assert done.table.columns == df.columns and done.table.where("key is null or mode is null").isEmpty()
    assert done.counts.first()["imputed_rows"] == df.where("key is null or mode is null").count()


def test_linear_key_query_does_the_whole_fit(spark, monkeypatch):
    """All steps and features of the operator, whatever the smaller queries take."""
    asked = {}

    def noted(df, key, params, **others):
        asked.update(others, params=params)
        raise StopIteration

    monkeypatch.setattr(modelling, "_features", lambda spark, d: None)
    monkeypatch.setattr(softboost, "impute_key", noted)
    with pytest.raises(StopIteration):
        modelling.key_linear_imputation(spark, "")
    assert asked == {"params": softboost.LinearParams()} and asked["params"].iterations == 50


def test_linear_fit_goes_on_after_a_small_step():
    """Along a bent valley the first steps gain little."""
    def valley(w):
        a, b = w[0]
        return (2.5 + 1e-4 * ((1 - a) ** 2 + 100 * (b - a * a) ** 2),
                1e-4 * np.array([[-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)]]))

    found = softboost._lbfgs(valley, np.array([[-1.2, 1.0]]), 50)
    assert found[0] == pytest.approx([1, 1], abs=0.02)
    assert softboost._lbfgs(lambda w: (1.0, np.zeros((1, 2))), np.zeros((1, 2)), 50).tolist() == [[0, 0]]


def test_linear_fit_deletes_its_blocks_and_takes_few_rows(spark, monkeypatch):
    tables, write = [], softboost.cut_lineage
    monkeypatch.setattr(softboost, "cut_lineage", lambda df: tables.append(write(df)) or tables[-1])
    rows = spark.createDataFrame([([float(i), 1.0], i % 2) for i in range(7)], "f array<double>, y int").withColumn(
        "features", array_to_vector("f")).repartition(3)
    monkeypatch.setattr(softboost, "BLOCK", 32)
    model = softboost.fit_linear(rows, "y", np.eye(2).tolist(), 5)
    assert model.weights.shape == (2, 2) and len(tables) == 1
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        tables[0].count()


def test_tempo_query_does_the_whole_fit(spark, monkeypatch):
    """All rounds of the operator's trees at their depth, from all features."""
    asked = []

    def brief(train, label, params):
        asked.append((label, params, train.count()))
        return GBTRegressor(labelCol=label, maxIter=1, maxDepth=1).fit(train)

    monkeypatch.setattr(modelling, "_features", lambda spark, d: learnable(spark, 200).withColumnRenamed("k", "row_id"))
    monkeypatch.setattr(impute, "fit_regressor", brief)
    found = {r["metric"]: r["value"] for r in modelling.tempo_imputation(spark, "").collect()}
    assert [(label, params) for label, params, _ in asked] == [("tempo", impute.TreeParams())] * 2
    assert asked[0][1].rounds == 600 and asked[0][1].depth == 6 and asked[0][1].max_bins == 64
    assert max(n for *_, n in asked) == found["observed_rows"] > min(n for *_, n in asked)


def test_long_fits_cut_their_lineage(spark, monkeypatch, tmp_path):
    """Spark ML does so only if there is a folder for it."""
    asked = []
    monkeypatch.setattr(impute, "allow_checkpoints", asked.append)
    rows = learnable(spark, 50).withColumn("features", array_to_vector(F.array("valence"))).where("energy is not null")
    impute.fit_regressor(rows, "energy", impute.TreeParams(rounds=1, depth=1))
    assert asked == [rows.sparkSession]
    named = []
    for known in (None, "there"):
        context = SimpleNamespace(getCheckpointDir=lambda: known, setCheckpointDir=named.append, master="local[2]")
        session.allow_checkpoints(SimpleNamespace(sparkContext=context, conf={"spark.checkpoint.dir": str(tmp_path)}))
    assert named == [str(tmp_path)]
