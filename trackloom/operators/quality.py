"""Invalid values, default fills and table profiles.

Reports are long tables (metric, column, value) so that they stay DataFrames.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.schemas import POSITIVE_COLUMNS, UNIT_INTERVAL_COLUMNS


def invalid_masks() -> dict[str, Column]:
    masks = {c: F.col(c).isNotNull() & ~F.col(c).between(0, 1) for c in UNIT_INTERVAL_COLUMNS}
    masks |= {c: F.col(c).isNotNull() & (F.col(c) <= 0) for c in POSITIVE_COLUMNS}
    return masks


def long_counts(df: DataFrame, metric: str, counts: dict[str, Column]) -> DataFrame:
    """One aggregate pass over ``df``, one output row per count."""
    wide = df.agg(*[e.alias(c) for c, e in counts.items()])
    return wide.unpivot([], list(counts), "column", "value").select(
        F.lit(metric).alias("metric"), "column", F.col("value").cast("bigint").alias("value"))


def invalid_counts(df: DataFrame) -> DataFrame:
    return long_counts(df, "invalid", {c: F.count_if(m) for c, m in invalid_masks().items()})


def invalid_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~m, F.col(c)) for c, m in invalid_masks().items()})


def fill_defaults(df: DataFrame) -> DataFrame:
    return df.withColumn("explicit", F.coalesce("explicit", F.lit(0.0)))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return long_counts(df, "nulls", {c: F.count_if(F.col(c).isNull()) for c in columns or df.columns})


def dtypes_report(df: DataFrame) -> DataFrame:
    """Column types, known from the plan: no data is read."""
    rows = [(c, t) for c, t in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string")


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns, null and invalid counts per column, track_id repeats.

    Two passes: one plain aggregate, and one that counts ids per id, where a
    hot id has already collapsed on the map side.
    """
    columns = list(df.columns)
    masks = invalid_masks()
    wide = df.agg(
        F.count(F.lit(1)).alias("rows|"),
        F.lit(len(columns)).cast("bigint").alias("columns|"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls|{c}") for c in columns],
        *[F.count_if(m).alias(f"invalid|{c}") for c, m in masks.items() if c in columns],
    )
    ids = (
        df.where(F.col("track_id").isNotNull()).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_track_ids|"),
             F.count(F.lit(1)).alias("distinct_track_ids|"))
    )
    long = wide.unpivot([], wide.columns, "name", "value").unionByName(
        ids.unpivot([], ids.columns, "name", "value"))
    name = F.split("name", r"\|")
    return long.select(name[0].alias("metric"), name[1].alias("column"), F.col("value").cast("bigint").alias("value"))
