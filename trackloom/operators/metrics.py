"""Model metrics.

Class metrics all come from one confusion count, at most classes x classes rows
per group, so the predictions are read once and shrink on the map side.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import circle


def confusion(df: DataFrame, true: list[str], predicted: list[str], by: list[str] | None = None,
              rows: str | None = None) -> DataFrame:
    """Counts per (true, predicted); ``rows`` names a column of counts to sum."""
    counted = F.sum(rows) if rows else F.count(F.lit(1))
    return df.groupBy(*(by or []), *true, *predicted).agg(counted.alias("n"))


def _mean(value: Column) -> Column:
    return F.sum(value * F.col("n")) / F.sum("n")


def _share(condition: Column) -> Column:
    return _mean(condition.cast("double"))


def _median(value: Column) -> Column:
    # A few distinct distances at most, so the percentile buffer stays tiny.
    return F.percentile(value, 0.5, F.col("n"))


def _distance_columns(distance: Column) -> list[Column]:
    return [
        _mean(distance).alias("mean_key_distance"),
        _median(distance).cast("double").alias("median_key_distance"),
        _share(distance <= 1).alias("within_1_semitone"),
        _share(distance <= 2).alias("within_2_semitones"),
    ]


def macro_f1(counts: DataFrame, true: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Unweighted mean F1 over the labels seen in truth or prediction."""
    by = by or []
    n, hit = F.col("n"), F.col(true) == F.col(predicted)
    sides = F.array(
        F.struct(F.col(true).alias("label"), F.when(hit, n).otherwise(0).alias("tp"),
                 F.when(hit, 0).otherwise(n).alias("off")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(hit, 0).otherwise(n).alias("off")))
    per_label = (
        counts.select(*by, F.explode(sides).alias("s")).groupBy(*by, "s.label")
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.off").alias("off")))
    f1 = 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("off"))
    return per_label.groupBy(*by).agg(F.avg(F.coalesce(f1, F.lit(0.0))).alias("f1_macro"))


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join two small per-group tables; without groups both have one row."""
    if by:
        return left.join(right, by)
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def class_metrics(df: DataFrame, true: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """accuracy and f1_macro per group."""
    by = by or []
    counts = confusion(df, [true], [predicted], by)
    accuracy = counts.groupBy(*by).agg(_share(F.col(true) == F.col(predicted)).alias("accuracy"))
    return _joined(accuracy, macro_f1(counts, true, predicted, by), by)


def key_metrics(df: DataFrame, true: str = "true_key", predicted: str = "predicted_key",
                by: list[str] | None = None, ordering: str = "chromatic", planar: bool = False,
                rows: str | None = None) -> DataFrame:
    """Accuracy, macro F1 and circular distances; ``planar`` adds chord lengths."""
    by = by or []
    counts = confusion(df, [true], [predicted], by, rows)
    distance = circle.circular_distance(F.col(true), F.col(predicted))
    columns = [_share(F.col(true) == F.col(predicted)).alias("accuracy"), *_distance_columns(distance)]
    if planar:
        chord = circle.chord(F.col(true), F.col(predicted), ordering)
        columns += [_mean(chord).alias("mean_2d_distance"), _median(chord).alias("median_2d_distance")]
    return _joined(counts.groupBy(*by).agg(*columns), macro_f1(counts, true, predicted, by), by)


def key_mode_metrics(df: DataFrame, true: tuple[str, str] = ("true_key", "true_mode"),
                     predicted: tuple[str, str] = ("predicted_key", "predicted_mode"),
                     by: list[str] | None = None, spatial: bool = False) -> DataFrame:
    """Key, mode and joint accuracy with key distances; ``spatial`` adds the
    distances of the 24 points on two circles."""
    counts = confusion(df, list(true), list(predicted), by)
    key_hit = F.col(true[0]) == F.col(predicted[0])
    mode_hit = F.col(true[1]) == F.col(predicted[1])
    distance = circle.circular_distance(F.col(true[0]), F.col(predicted[0]))
    columns = [
        _share(key_hit).alias("key_accuracy"), _share(mode_hit).alias("mode_accuracy"),
        _share(key_hit & mode_hit).alias("joint_accuracy"), *_distance_columns(distance)]
    if spatial:
        apart = circle.joint_chord(*[F.col(c) for c in (*true, *predicted)])
        columns += [_mean(apart).alias("mean_3d_distance"), _median(apart).alias("median_3d_distance")]
    return counts.groupBy(*(by or [])).agg(*columns)


def regression_metrics(df: DataFrame, true: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """mae, rmse and r2 in one aggregate. A target without variance has r2 1 if it
    is met exactly, else 0."""
    error = F.col(true) - F.col(predicted)
    left, spread = F.avg(error * error), F.var_pop(true)
    return df.groupBy(*(by or [])).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(spread > 0, 1 - F.try_divide(left, spread)).when(spread == 0, (left == 0).cast("double")).alias("r2"))


def threshold_metrics(scored: DataFrame, missing: DataFrame, thresholds: list[float],
                      true: str = "mode", probability: str = "probability_one",
                      by: list[str] | None = None) -> DataFrame:
    """Binary metrics per threshold on ``scored`` rows, with the predicted zero
    rate there and on ``missing`` rows. All thresholds share one pass."""
    by = by or []

    def predicted(df, *keep):
        options = F.array(*[F.struct(F.lit(t).alias("threshold"),
                                     (F.col(probability) >= t).cast("int").alias("predicted")) for t in thresholds])
        return df.select(*by, *keep, F.explode(options).alias("o")).select(*by, *keep, "o.*")

    keys = [*by, "threshold"]
    counts = confusion(predicted(scored, true), [true], ["predicted"], keys)
    t, p, n = F.col(true), F.col("predicted"), F.col("n")

    def total(condition):
        return F.sum(F.when(condition, n).otherwise(0))

    rates = counts.groupBy(*keys).agg(
        _share(t == p).alias("accuracy"),
        F.coalesce(F.try_divide(total((t == 0) & (p == 0)), total(p == 0)), F.lit(0.0)).alias("precision_zero"),
        F.coalesce(F.try_divide(total((t == 0) & (p == 0)), total(t == 0)), F.lit(0.0)).alias("recall_zero"),
        _share(p == 0).alias("predicted_zero_rate_test"))
    on_missing = predicted(missing).groupBy(*keys).agg(
        F.avg((F.col("predicted") == 0).cast("double")).alias("predicted_zero_rate_missing"))
    return (
        rates.join(macro_f1(counts, true, "predicted", keys), keys).join(on_missing, keys, "left")
        .withColumn("predicted_zero_rate_missing", F.coalesce("predicted_zero_rate_missing", F.lit(0.0))))


def weight_summary(df: DataFrame, weight: str) -> DataFrame:
    """Spread of the error weights, which take five distinct values."""
    return df.agg(
        F.min(weight).alias("min"), F.max(weight).alias("max"), F.avg(weight).alias("mean"),
        F.stddev_pop(weight).alias("std"), F.percentile(weight, 0.5).alias("p50"),
        F.percentile(weight, 0.9).alias("p90"), F.percentile(weight, 0.99).alias("p99"))
