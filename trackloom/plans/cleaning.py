"""From raw tracks to the finished table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import audit, clean, fill, impute, quality, softboost
from trackloom.schemas import RAW_TRACK_COLUMNS, RAW_TRACKS, REGRESSION_TARGETS
from trackloom.plans.stages import run_stages
from trackloom.session import cut_lineage
from trackloom.sources import io


@dataclass(frozen=True)
class PreImputation:
    table: DataFrame
    report: DataFrame
    dtypes: DataFrame


def pre_imputation(raw: DataFrame) -> PreImputation:
    """Text, invalid values, both fills, defaults, and the report of all of it.

    The report is (stage, metric, column, value). Fill counts come from bit masks
    carried beside the rows, so no stage runs twice to be counted. The raw rows are
    written once: their profile and the fills read them several times.
    """
    raw = cut_lineage(clean.nan_to_null(raw.select(*RAW_TRACK_COLUMNS)))
    texted = clean.normalise_identity_text(raw)
    filled = cut_lineage(fill.deterministic_fill(quality.invalid_to_null(texted), marks=True))
    table = quality.fill_defaults(filled).select(*RAW_TRACK_COLUMNS)
    defaulted = quality.long_counts(filled, "default_fill", {"explicit": F.count_if(F.col("explicit").isNull())})

    def stage(df, name):
        return df.select(F.lit(name).alias("stage"), "metric", "column", "value")

    report = (
        stage(quality.profile(raw), "raw")
        .unionByName(stage(quality.invalid_counts(raw), "invalid_to_null"))
        .unionByName(stage(fill.fill_counts(filled), "deterministic_fill"))
        .unionByName(stage(defaulted, "default_fill"))
        .unionByName(stage(quality.profile(table), "final")))
    dtypes = quality.dtypes_report(raw).withColumn("stage", F.lit("raw")).unionByName(
        quality.dtypes_report(table).withColumn("stage", F.lit("final")))
    return PreImputation(table, report, dtypes.select("stage", "column", "dtype"))


def run_pre_imputation(spark: SparkSession, input_path: str, output_path: str, report_path: str) -> DataFrame:
    """Files in, files out; returns the report."""
    result = pre_imputation(io.read_table(spark, input_path, schema=RAW_TRACKS, columns=RAW_TRACK_COLUMNS))
    io.write_table(result.table, output_path)
    report = cut_lineage(result.report)
    io.write_json_report(report.orderBy("stage", "metric", "column"), report_path)
    io.write_json_report(result.dtypes.orderBy("stage", "column"), f"{report_path}_dtypes")
    return report


def consolidate(df: DataFrame, order: list[str]) -> DataFrame:
    """Drop zero-signal and unnamed rows, then keep the most complete per id."""
    return clean.keep_most_complete(clean.drop_blank_tracks(clean.drop_zero_signal(df, "energy")), order)


def impute_all(flagged: DataFrame, key: str, params: impute.TreeParams = impute.TreeParams(),
               boost: softboost.BoostParams | softboost.LinearParams = softboost.BoostParams(),
               order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Impute one target after the other, each from the table the last one left.

    Regression targets, then mode, key by soft-target boosting, tempo last.
    Returns (table, report) with the report as (target, metric, value).
    """
    known = impute.targets()
    table, report = flagged, None
    for name in [*(order or REGRESSION_TARGETS), "mode", "key", "tempo"]:
        done = softboost.impute_key(table, key, boost) if name == "key" else impute.impute(
            table, known[name], key, params)
        numbers = done.metrics.unpivot([], done.metrics.columns, "metric", "value").unionByName(
            done.counts.select(*[F.col(c).cast("double") for c in done.counts.columns]).unpivot(
                [], done.counts.columns, "metric", "value"))
        row = cut_lineage(numbers.select(F.lit(name).alias("target"), "metric", "value"))
        report = row if report is None else report.unionByName(row)
        table = cut_lineage(done.table)
    return table, report


def run_chain(spark: SparkSession, input_path: str, folder: str, key: str = "row_id",
              params: impute.TreeParams = impute.TreeParams(),
              boost: softboost.BoostParams | softboost.LinearParams = softboost.BoostParams(),
              order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw tracks to the finished table, a stage at a time, restartable: (table, counts).

    Stages: deterministic cleaning, flags with a row key, one per imputed target
    (regression targets in ``order``, mode, key, tempo), and the final spelling and
    types. Every stage's table stays below ``folder``; a run that was stopped goes on
    after the last one that was committed. Rows get their key once, from the table
    that the first stage wrote, so a resumed run knows them by the same keys.
    """
    known = impute.targets()

    def one(name):
        def fill(df):
            done = softboost.impute_key(df, key, boost) if name == "key" else impute.impute(df, known[name], key, params)
            return done.table
        return fill

    targets = [*(order or REGRESSION_TARGETS), "mode", "key", "tempo"]
    raw = io.read_table(spark, input_path, schema=RAW_TRACKS, columns=RAW_TRACK_COLUMNS)
    stages = [("cleaned", lambda df: pre_imputation(df).table),
              ("keyed", lambda df: df.withColumn(key, F.monotonically_increasing_id())),
              ("flagged", clean.add_missing_flags),
              *[(f"imputed_{name}", one(name)) for name in targets],
              ("finished", clean.postprocess_final)]
    table = run_stages(spark, raw, stages, folder)
    before = run_stages(spark, raw, stages[:-1], folder)
    return table, clean.postprocess_report(before, table)


def finish(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(finished table, its postprocess counts, the audit of what came in)."""
    finished = clean.postprocess_final(df)
    return finished, clean.postprocess_report(df, finished), audit.full_audit(df)
