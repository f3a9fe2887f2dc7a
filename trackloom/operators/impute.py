"""Imputation of features with Spark ML trees.

Spark ML trees take no missing values: a gap becomes one less than the feature's
minimum, which lets a tree send "missing" left, next to the _missing flags.
"""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import circle
from trackloom.operators import metrics, splits, squares
from trackloom.schemas import (
    AUDIO_NUMERIC_COLUMNS, CLASS_TARGETS, MODELLED_COLUMNS, REGRESSION_TARGETS, SEED,
)
from trackloom.session import allow_checkpoints, cut_lineage

FLAG_COLUMNS = [f"{c}_missing" for c in MODELLED_COLUMNS]
FEATURE_POOL = MODELLED_COLUMNS + FLAG_COLUMNS
# Every modelled column by its role, and all raw audio columns usable as features.


@dataclass(frozen=True)
class TreeParams:
    """Boosting parameters: number, depth and step of trees, row and feature share."""

    rounds: int = 600
    depth: int = 6
    step: float = 0.03
    row_share: float = 0.8
    feature_share: float = 0.8
    max_bins: int = 64
    min_gain: float = 0.0
    seed: int = SEED


# The parameter set of the diagnostics fits.
DIAGNOSTIC_PARAMS = TreeParams(
    rounds=300, depth=10, step=0.08960785365368121, row_share=0.8394633936788146,
    feature_share=0.6624074561769746, min_gain=0.002570603566117596)


@dataclass(frozen=True)
class Target:
    """What to impute: its kind, the range its values are clipped to, its features."""

    name: str
    kind: str
    lower: float | None = None
    upper: float | None = None

    @property
    def features(self) -> list[str]:
        """All modelled columns and flags but the target itself and its flag,
        which is constant on the rows a model is trained on."""
        return [c for c in FEATURE_POOL if c not in (self.name, f"{self.name}_missing")]


def targets() -> dict[str, Target]:
    """The registry: unit-interval features are clipped, loudness is not, tempo
    is kept from going below zero."""
    found = {c: Target(c, "regression", 0.0, 1.0) for c in REGRESSION_TARGETS}
    found["loudness"] = replace(found["loudness"], lower=None, upper=None)
    found |= {c: Target(c, "classification") for c in CLASS_TARGETS}
    found["tempo"] = Target("tempo", "regression", 0.0, None)
    return found


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Add the ``features`` vector. The minima are one aggregate of one row."""
    floors = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in features]).first()
    filled = {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit((floors[c] if floors[c] is not None else 0.0) - 1.0))
              for c in features}
    assembler = VectorAssembler(inputCols=list(filled), outputCol="features")
    return assembler.transform(df.withColumns(filled)).drop(*filled)


def prepare(df: DataFrame, features: list[str], key: str, share: float = 0.2) -> DataFrame:
    """Vectors and the hold-out mark, written once: every fit and every boosting
    round reads them again."""
    return cut_lineage(splits.hold_out(assemble(df, features), key, share))


def clip(value: Column, lower: float | None, upper: float | None) -> Column:
    if lower is not None:
        value = F.greatest(value, F.lit(float(lower)))
    if upper is not None:
        value = F.least(value, F.lit(float(upper)))
    return value


def _common(params: TreeParams) -> dict:
    return {"maxDepth": params.depth, "maxBins": params.max_bins, "minInfoGain": params.min_gain,
            "subsamplingRate": params.row_share, "featureSubsetStrategy": str(params.feature_share),
            "seed": params.seed, "featuresCol": "features"}


def fit_regressor(train: DataFrame, label: str, params: TreeParams) -> Model:
    # A round's errors come from those of the round before; hundreds are too deep a plan unless they are cut.
    allow_checkpoints(train.sparkSession)
    return GBTRegressor(labelCol=label, maxIter=params.rounds, stepSize=params.step,
                        predictionCol="prediction", **_common(params)).fit(train)


def fit_classifier(train: DataFrame, label: str, params: TreeParams, weight: str | None = None,
                   classes: int | None = None) -> Model:
    """Boosted trees for two classes; Spark's boosting is binary only, so more
    classes get a random forest (or the soft-target boosting)."""
    extra = {"weightCol": weight} if weight else {}
    names = {"labelCol": label, "predictionCol": "prediction"}
    if (classes or 2) > 2:
        return RandomForestClassifier(numTrees=params.rounds, **names, **extra, **_common(params)).fit(train)
    return GBTClassifier(maxIter=params.rounds, stepSize=params.step, **names, **extra, **_common(params)).fit(train)


def probabilities(model: Model, df: DataFrame, out: str = "probs") -> DataFrame:
    """Class probabilities as an array column."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class Imputed:
    """The filled table, hold-out metrics and (observed, imputed) row counts."""

    table: DataFrame
    metrics: DataFrame
    counts: DataFrame


def row_counts(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count(target).alias("observed_rows"), F.count_if(F.col(target).isNull()).alias("imputed_rows"))


def _filled(df: DataFrame, target: str, predicted: Column, columns: list[str]) -> DataFrame:
    kind = df.schema[target].dataType
    return df.withColumn(target, F.coalesce(target, predicted.cast(kind))).select(*columns)


def impute_regression(df: DataFrame, target: Target, key: str, params: TreeParams = TreeParams(),
                      features: list[str] | None = None, clip_scored: bool = True, at_once: bool = False) -> Imputed:
    """Score on a hold-out, refit on all observed rows, fill the nulls. Filled values
    stay within the target's bounds; so do scored ones, unless ``clip_scored`` is off.
    The filled table reads ``df`` again. With ``at_once`` both fits run side by side,
    which holds their rows twice but hides the gaps between a long fit's many jobs."""
    whole, observed = _observed(df, target, key, features)
    bounded = clip(F.col("prediction"), target.lower, target.upper)
    trial, model = together([lambda: fit_regressor(observed.where(~F.col("held_out")), target.name, params),
                             lambda: fit_regressor(observed, target.name, params)], 2 if at_once else 1)
    scored = trial.transform(observed.where("held_out")).withColumn(
        "_scored", bounded if clip_scored else F.col("prediction"))
    return Imputed(
        _refilled(df, whole, target, model),
        metrics.regression_metrics(scored, target.name, "_scored"),
        row_counts(df, target.name))


def fill_regression(df: DataFrame, target: Target, key: str, params: TreeParams = TreeParams(),
                    features: list[str] | None = None) -> DataFrame:
    """The table of ``impute_regression``, where its scores are not asked for."""
    whole, observed = _observed(df, target, key, features)
    return _refilled(df, whole, target, fit_regressor(observed, target.name, params))


def _observed(df: DataFrame, target: Target, key: str, features: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """All rows with vectors and hold-out mark, and of the observed ones what a fit
    reads, written once: every fit and every boosting round reads it again."""
    whole = splits.hold_out(assemble(df, features or [c for c in target.features if c in df.columns]), key)
    observed, _ = splits.split_observed(whole, target.name)
    return whole, cut_lineage(observed.select(target.name, "held_out", "features"))


def _refilled(df: DataFrame, whole: DataFrame, target: Target, model: Model) -> DataFrame:
    return _filled(model.transform(whole), target.name, clip(F.col("prediction"), target.lower, target.upper), df.columns)


def impute_tempo(df: DataFrame, key: str, params: TreeParams = TreeParams()) -> Imputed:
    """Tempo is scored by what the model predicts, before its bounds are applied."""
    return impute_regression(df, targets()["tempo"], key, params, clip_scored=False, at_once=True)


def impute_classification(df: DataFrame, target: Target, key: str, params: TreeParams = TreeParams(),
                          features: list[str] | None = None) -> Imputed:
    ready = prepare(df, features or [c for c in target.features if c in df.columns], key)
    observed, _ = splits.split_observed(ready, target.name)
    classes = circle.KEYS if target.name == "key" else circle.MODES
    trial = fit_classifier(observed.where(~F.col("held_out")), target.name, params, classes=classes)
    scored = trial.transform(observed.where("held_out"))
    model = fit_classifier(observed, target.name, params, classes=classes)
    return Imputed(
        _filled(model.transform(ready), target.name, F.col("prediction"), df.columns),
        metrics.class_metrics(scored, target.name, "prediction"),
        row_counts(ready, target.name))


def impute(df: DataFrame, target: Target, key: str, params: TreeParams = TreeParams()) -> Imputed:
    if target.name == "tempo":
        return impute_tempo(df, key, params)
    step = impute_regression if target.kind == "regression" else impute_classification
    return step(df, target, key, params)


def impute_key_mode_xyz(df: DataFrame, key: str, params: TreeParams = TreeParams(),
                        features: list[str] | None = None) -> Imputed:
    """Key and mode as one point in space: three regressors, decoded by angle.
    Their trees grow together, from rows that are kept as bins.

    Trained on rows that have both; fills whichever of the two is missing. What the fits
    and scores read is written once; the filled table reads ``df`` again.
    """
    hidden = {"key", "mode", "key_missing", "mode_missing"}
    whole = splits.hold_out(assemble(df, features or [c for c in FEATURE_POOL if c in df.columns and c not in hidden]), key)
    both = F.col("key").isNotNull() & F.col("mode").isNotNull()
    x, y, z = circle.key_mode_to_xyz(F.col("key"), F.col("mode"))
    trained = cut_lineage(whole.where(both).select(
        "key", "mode", "held_out", "features", x.alias("x"), y.alias("y"), z.alias("z")))

    def predicted(train, rows):
        rows = squares.fit(train, ["x", "y", "z"], params).transform(rows, ["_x", "_y", "_z"])
        return rows.withColumns({"predicted_key": circle.xyz_to_key(F.col("_x"), F.col("_y")),
                                 "predicted_mode": circle.z_to_mode(F.col("_z"))})

    scored = predicted(trained.where(~F.col("held_out")), trained.where("held_out"))
    filled = predicted(trained, whole)
    for name in ("key", "mode"):
        filled = filled.withColumn(name, F.coalesce(name, F.col(f"predicted_{name}").cast(df.schema[name].dataType)))
    return Imputed(
        filled.select(*df.columns),
        metrics.key_mode_metrics(scored, ("key", "mode")),
        df.agg(F.count_if(both).alias("observed_rows"), F.count_if(~both).alias("imputed_rows")))


def together(tasks: list, parallelism: int = 4) -> list:
    """Run independent fits at the same time; each is a chain of small Spark jobs
    that leaves most of a cluster idle on its own."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(inherit(t)) for t in tasks]]


def cross_validate(df: DataFrame, target: Target, key: str, k: int = 5, params: TreeParams = TreeParams(),
                   features: list[str] | None = None) -> DataFrame:
    """Mean of the fold metrics: mae, rmse, r2 or accuracy, f1_macro."""
    whole = assemble(df.where(F.col(target.name).isNotNull()), features or [c for c in target.features if c in df.columns])
    folded = splits.folds(whole, key, k) if target.kind == "regression" else splits.stratified_folds(whole, target.name, key, k)
    ready = cut_lineage(folded.select(target.name, "fold", "features"))
    scored = out_of_fold(ready, target.name, k, params, None if target.kind == "regression" else
                         (circle.KEYS if target.name == "key" else circle.MODES))
    if target.kind == "regression":
        clipped = scored.withColumn("prediction", clip(F.col("prediction"), target.lower, target.upper))
        per_fold = metrics.regression_metrics(clipped, target.name, "prediction", ["fold"])
        names = ["mae", "rmse", "r2"]
    else:
        per_fold = metrics.class_metrics(scored, target.name, "prediction", ["fold"])
        names = ["accuracy", "f1_macro"]
    return per_fold.agg(F.count("fold").alias("folds"), *[F.avg(c).alias(c) for c in names])


def out_of_fold(ready: DataFrame, label: str, k: int, params: TreeParams, classes: int | None,
                weight: str | None = None) -> DataFrame:
    """Each row's prediction by the model that did not see its fold."""
    def one(fold):
        train = ready.where(F.col("fold") != fold)
        model = fit_classifier(train, label, params, weight, classes) if classes else fit_regressor(train, label, params)
        return model.transform(ready.where(F.col("fold") == fold)).select(*ready.columns, "prediction")

    parts = together([lambda f=f: one(f) for f in range(k)])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
