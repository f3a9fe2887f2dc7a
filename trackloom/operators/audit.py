"""Audit of a finished table, target priorities and diagnostics."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators.clean import non_null_count
from trackloom.operators.quality import invalid_masks
from trackloom.operators.quantiles import exact_quantiles
from trackloom.schemas import (
    CLASS_TARGETS, IDENTITY_COLUMNS, MODELLED_COLUMNS, REGRESSION_TARGETS, UNIT_INTERVAL_COLUMNS,
)

DECIMALS = 6
QUARTILES = [0.25, 0.5, 0.75]
DEEP_QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
DIAGNOSTIC_FEATURES = MODELLED_COLUMNS + [f"{c}_missing" for c in MODELLED_COLUMNS]


def rounded(c: Column) -> Column:
    return F.bround(c.cast("double"), DECIMALS)


def _long(wide: DataFrame) -> DataFrame:
    """One row of ``metric|column`` counts as (metric, column, value)."""
    name = F.split("name", r"\|")
    return wide.unpivot([], wide.columns, "name", "value").select(
        name[0].alias("metric"), name[1].alias("column"), F.col("value").cast("bigint").alias("value"))


def basic_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, non-zero null counts and invalid counts, in one pass."""
    known = df if "time_signature" in df.columns else df.withColumn("time_signature", F.lit(None).cast("double"))
    wide = known.agg(
        F.count(F.lit(1)).alias("rows|"), F.lit(len(df.columns)).cast("bigint").alias("columns|"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls|{c}") for c in df.columns],
        *[F.count_if(m).alias(f"invalid|{c}") for c, m in invalid_masks().items()])
    return _long(wide).where((F.col("metric") != "nulls") | (F.col("value") > 0))


def _non_empty(c: str) -> Column:
    return text.strip_or_empty(F.col(c)) != ""


def metadata_profile(df: DataFrame) -> DataFrame:
    """Eleven counts over the identity text as (metric, value).

    Repeats are counted from per-key counts, each a plain grouped count that
    shrinks before its shuffle; distinct aggregates side by side would copy
    every row per aggregate.
    """
    def edge_space(c):
        value = F.coalesce(c, F.lit(""))
        return F.count_if(value != text.strip(value)).alias(f"{c}_leading_trailing_space_count")

    artist = F.coalesce("artist_name", F.lit(""))
    plain = df.agg(
        F.count_if(~_non_empty("track_id")).alias("missing_track_id"),
        F.count_if(~_non_empty("artist_name")).alias("missing_artist_name"),
        F.count_if(~_non_empty("track_name")).alias("missing_track_name"),
        F.count_if(artist.startswith("[")).alias("artist_name_list_like_prefix"),
        F.count_if(artist.contains(";")).alias("artist_name_semicolon_count"),
        F.count_if(artist.contains(",")).alias("artist_name_comma_count"),
        *[edge_space(c) for c in ("artist_name", "track_name", "track_id")])

    def repeats(rows, keys, name):
        per_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("value")).select(
            F.lit(name).alias("metric"), "value")

    return (
        plain.unpivot([], plain.columns, "metric", "value")
        .unionByName(repeats(df.where(_non_empty("track_id")), ["track_id"], "duplicate_nonempty_track_id_rows"))
        .unionByName(repeats(df.where(_non_empty("track_name") & _non_empty("artist_name")),
                             ["track_name", "artist_name"], "duplicate_nonempty_track_name_artist_pairs")))


def _values_by_flag(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_missing").cast("int").alias("flag"),
                               F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def _wide_quantiles(df: DataFrame, keys: list[str], value: str, names: dict[float, str]) -> DataFrame:
    quantiles = exact_quantiles(df, keys, value, list(names))
    return quantiles.groupBy(*keys).agg(*[
        rounded(F.max(F.when(F.col("p") == p, F.col("q")))).alias(name) for p, name in names.items()])


def numeric_summary(df: DataFrame, keys: list[str], value: str, also: tuple[Column, ...] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of the non-null values;
    ``also`` are more aggregates of the same pass."""
    v = F.col(value)
    moments = df.groupBy(*keys).agg(
        F.count(v).alias("count"), rounded(F.avg(v)).alias("mean"), rounded(F.stddev_samp(v)).alias("std"),
        rounded(F.min(v)).alias("min"), rounded(F.max(v)).alias("max"), *also)
    return moments.join(_wide_quantiles(df, keys, value, dict(zip(QUARTILES, ["p25", "p50", "p75"]))), keys, "left")


def numeric_summary_by_flag(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per (feature, flag): summary, nulls, and shares of 0 and 1 for bounded features."""
    columns = columns or [c for c in MODELLED_COLUMNS if c not in CLASS_TARGETS and f"{c}_missing" in df.columns]
    cells = _values_by_flag(df, columns)
    bounded = F.col("feature").isin(UNIT_INTERVAL_COLUMNS)

    def share(of):
        return rounded(F.try_divide(F.count_if(bounded & (F.col("value") == of)),
                                    F.nullif(F.count_if(bounded & F.col("value").isNotNull()), F.lit(0))))

    return numeric_summary(cells, ["feature", "flag"], "value", (
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"),
        share(0).alias("zero_fraction"), share(1).alias("one_fraction")))


def class_distribution_by_flag(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, flag, value, rows), nulls counted as a value."""
    columns = columns or [c for c in CLASS_TARGETS if f"{c}_missing" in df.columns]
    return _values_by_flag(df, columns).groupBy("feature", "flag", "value").agg(F.count(F.lit(1)).alias("rows"))


def storage_recommendations(df: DataFrame) -> DataFrame:
    """(metric, value 0/1): which columns could be stored narrower."""
    types = dict(df.dtypes)
    checks = []
    if "key" in types:
        checks.append(("key_can_be_int8", F.bool_and(F.col("key").between(0, 11)), types["key"] != "tinyint"))
    if "mode" in types:
        checks.append(("mode_can_be_int8", F.bool_and(F.col("mode").isin(0, 1)), types["mode"] != "tinyint"))
    checks += [(f"{c}_can_be_string_dtype", F.lit(True), types[c] != "string") for c in IDENTITY_COLUMNS]
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        (F.coalesce(fits, F.lit(True)) & F.lit(wider)).cast("bigint").alias(name) for name, fits, wider in checks])
    names = [name for name, _, _ in checks]
    return wide.unpivot([], names, "metric", "value")


def full_audit(df: DataFrame) -> DataFrame:
    """All audit tables as one (section, column, metric, label, value) report."""
    def rows(table, section, column, metric, label, value):
        return table.select(F.lit(section).alias("section"), column.alias("column"), metric.alias("metric"),
                            label.alias("label"), value.cast("double").alias("value"))

    nothing = F.lit(None).cast("string")
    summary = numeric_summary_by_flag(df)
    measures = [c for c in summary.columns if c not in ("feature", "flag")]
    tall = summary.select("feature", "flag", *[F.col(c).cast("double") for c in measures]).unpivot(
        ["feature", "flag"], measures, "measure", "value")
    return (
        rows(basic_profile(df), "basic", F.col("column"), F.col("metric"), nothing, F.col("value"))
        .unionByName(rows(metadata_profile(df), "metadata", nothing, F.col("metric"), nothing, F.col("value")))
        .unionByName(rows(tall, "numeric", F.col("feature"), F.col("measure"),
                          F.when(F.col("flag") == 1, "imputed").otherwise("observed"), F.col("value")))
        .unionByName(rows(class_distribution_by_flag(df), "class", F.col("feature"),
                          F.when(F.col("flag") == 1, "imputed").otherwise("observed"),
                          F.col("value").cast("string"), F.col("rows")))
        .unionByName(rows(storage_recommendations(df), "storage", nothing, F.col("metric"), nothing, F.col("value"))))


def min_max(c: Column) -> Column:
    """Scale over a small report table; all values equal gives 0."""
    everything = W.partitionBy()
    low, high = F.min(c).over(everything), F.max(c).over(everything)
    return F.when(high == low, 0.0).otherwise((c - low) / (high - low))


def _mean_abs_correlations(df: DataFrame) -> DataFrame:
    """(target, mean absolute correlation with the other regression targets)."""
    pairs = [(a, b) for i, a in enumerate(REGRESSION_TARGETS) for b in REGRESSION_TARGETS[i + 1:]]
    # All pairs side by side in one aggregate of one row; a pair's nulls drop out of it alone.
    wide = df.agg(*[F.abs(F.corr(a, b)).alias(f"{a}|{b}") for a, b in pairs])
    name = F.split("name", r"\|")
    found = wide.unpivot([], wide.columns, "name", "r").select(name[0].alias("a"), name[1].alias("b"), "r")
    return found.where(F.col("r").isNotNull() & ~F.isnan("r")).select(F.explode(F.array("a", "b")).alias("target"), "r").groupBy("target").agg(
        F.avg("r").alias("mean_abs_corr_with_other_regression_targets"))


def target_priority(df: DataFrame) -> DataFrame:
    """Heuristic order in which to impute the ten targets.

    One pass counts missing targets by how many features a row has, at most
    twelve rows; another gives the 28 pairwise correlations, one row per
    task. The rest works on those small tables.
    """
    others = len(MODELLED_COLUMNS) - 1
    targets = REGRESSION_TARGETS + CLASS_TARGETS
    by_present = df.groupBy(non_null_count(MODELLED_COLUMNS).alias("present")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(t).isNull()).alias(t) for t in targets])
    cells = by_present.select("present", "n", F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).alias("missing")) for t in targets])).alias("x")).select(
        "present", "n", "x.*")
    share = F.col("present") / others
    facts = cells.groupBy("target").agg(
        F.sum("missing").alias("missing_count"),
        (F.sum("missing") / F.sum("n")).alias("missing_pct"),
        F.coalesce(F.try_divide(F.sum(share * F.col("missing")), F.sum("missing")), F.lit(1.0)).alias(
            "avg_non_null_fraction_on_missing_rows"),
        F.coalesce(F.percentile(share, 0.5, F.col("missing")), F.lit(1.0)).alias(
            "median_non_null_fraction_on_missing_rows"),
        F.coalesce(F.sum(F.when(F.col("present") == 0, F.col("missing"))), F.lit(0)).alias("zero_signal_missing_rows"))
    kind = F.when(F.col("target").isin(REGRESSION_TARGETS), "regression").otherwise("classification")
    table = facts.join(_mean_abs_correlations(df), "target", "left").withColumn("target_type", kind)
    scored = table.withColumns({
        "readiness_score": 0.6 * min_max(F.col("avg_non_null_fraction_on_missing_rows"))
        + 0.4 * (1 - min_max(F.col("zero_signal_missing_rows"))),
        "benefit_score": 0.6 * min_max(F.coalesce("mean_abs_corr_with_other_regression_targets", F.lit(0.0)))
        + 0.4 * min_max(F.col("missing_count")),
    })
    ranked = (F.col("target_type") == "regression") & (F.col("missing_count") > 0)
    return scored.withColumn(
        "overall_priority_score", F.when(ranked, F.col("readiness_score") * F.col("benefit_score"))
    ).orderBy(F.desc_nulls_last("overall_priority_score"), F.desc("missing_count"), "target")


def _distinct_per_feature(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    return cells.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.lit(1)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_count"))


def target_diagnostics(df: DataFrame, target: str, order: list[str],
                       features: list[str] | None = None) -> dict[str, DataFrame]:
    """Diagnostic tables of one target; ``order`` sorts the sample rows."""
    features = [c for c in features or [c for c in DIAGNOSTIC_FEATURES if c in df.columns] if c != target]
    missing = df.where(F.col(target).isNull())
    regression = target in REGRESSION_TARGETS + ["tempo"]

    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(target).isNull()).alias("missing_count"),
                    F.count(target).alias("observed_count"))
    summary = counts.select(F.lit(target).alias("target"), "*",
                            (F.col("missing_count") / F.col("rows")).alias("missing_pct"),
                            F.lit(len(features)).alias("feature_count"))

    if regression:
        distribution = numeric_summary(df.select(F.lit(target).alias("feature"), F.col(target).alias("value")),
                                       ["feature"], "value")
    else:
        distribution = df.groupBy(F.col(target).alias("value")).agg(F.count(F.lit(1)).alias("rows")).orderBy("value")

    cells = missing.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("x"))
    cells = cells.select("x.*")
    coverage = (
        cells.groupBy("feature").agg(F.count("value").alias("non_null_count"),
                                     F.count_if(F.col("value").isNull()).alias("null_count"))
        .join(_distinct_per_feature(cells, ["feature"], "value"), "feature", "left")
        .na.fill(0, ["distinct_count"])
        .orderBy(F.desc("null_count"), "distinct_count", "feature"))

    rows_covered = missing.groupBy(non_null_count(features).alias("non_null_features")).agg(
        F.count(F.lit(1)).alias("rows"))

    every = missing.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    null_ranking = every.unpivot([], every.columns, "column", "null_count").orderBy(F.desc("null_count"), "column")

    shown = [c for c in IDENTITY_COLUMNS if c in df.columns]
    sample = missing.orderBy(*order).select(*shown, target).limit(20)

    tables = {"summary": summary, "distribution": distribution, "missing_features": coverage,
              "row_coverage": rows_covered, "null_ranking": null_ranking, "sample": sample}
    if target in REGRESSION_TARGETS:
        rest = [c for c in REGRESSION_TARGETS if c != target]
        corr = df.agg(*[F.corr(target, c).alias(c) for c in rest])
        tables["correlation"] = corr.unpivot([], rest, "feature", "correlation").orderBy(
            F.desc_nulls_last(F.abs("correlation")))
    return tables


def deep_quantiles(df: DataFrame, column: str, flag: str | None = None) -> DataFrame:
    """Seven quantiles, moments and distinct values of a column, by its flag."""
    cells = df.select(F.col(flag or f"{column}_missing").cast("int").alias("flag"),
                      F.col(column).cast("double").alias("value"))
    names = {p: f"q{round(p * 100):02d}" for p in DEEP_QUANTILES}
    moments = cells.groupBy("flag").agg(
        F.count("value").alias("count"), rounded(F.avg("value")).alias("mean"),
        rounded(F.stddev_samp("value")).alias("std"), rounded(F.min("value")).alias("min"),
        rounded(F.max("value")).alias("max"))
    tables = [moments, _wide_quantiles(cells, ["flag"], "value", names),
              _distinct_per_feature(cells, ["flag"], "value")]
    return reduce(lambda a, b: a.join(b, "flag", "left"), tables)
