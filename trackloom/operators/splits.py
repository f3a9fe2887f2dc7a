"""Seeded splits, folds and samples that do not depend on the data's layout."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import sampling
from trackloom.operators.skew import mark_smallest_hashes
from trackloom.schemas import SEED


def split_observed(df: DataFrame, target: str, flag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(observed, missing) rows by the flag, or by the target being null."""
    missing = F.col(flag) == 1 if flag else F.col(target).isNull()
    return df.where(~missing), df.where(missing)


def hold_out(df: DataFrame, key: str, share: float = 0.2, seed: int | str = SEED) -> DataFrame:
    """Add boolean ``held_out``; no shuffle."""
    return df.withColumn("held_out", sampling.is_held_out(F.col(key), share, seed))


def stratified_hold_out(df: DataFrame, label: str, key: str, share: float = 0.2,
                        seed: int | str = SEED) -> DataFrame:
    """Add boolean ``held_out``: exactly round(share * n) rows of each label."""
    hashed = df.withColumn("_hash", sampling.hash32(F.col(key), seed))
    wanted = F.round(F.col("n") * share).cast("bigint")
    return mark_smallest_hashes(hashed, [label], "_hash", key, wanted, "held_out").drop("_hash")


def folds(df: DataFrame, key: str, k: int = 5, seed: int | str = SEED) -> DataFrame:
    return df.withColumn("fold", sampling.fold(F.col(key), k, seed))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int | str = SEED,
                     bucket_bits: int = 16) -> DataFrame:
    """Add ``fold``: the rows of each label, in the order of their hash, go to the
    folds in turn, so a label's fold sizes differ by one at most.

    ``key`` is unique per row; rows without a label are a label of their own. A row's
    place is that of its hash bucket, from a running sum over the label's bucket
    counts (at most 2**bucket_bits), plus its rank in the bucket. So no label is
    sorted in one task, and the ranked groups are the label's share of a bucket.
    """
    bucket = F.shiftright(sampling.hash32(F.col(key), seed), 32 - bucket_bits)
    bucketed = df.withColumn("_b", bucket).withColumn("_l", F.struct(label))
    counts = bucketed.groupBy("_l", "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy("_l").orderBy("_b"))
    before = counts.select("_l", "_b", (upto - F.col("_c")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_l", "_b").orderBy(sampling.hash32(F.col(key), seed), key))
    placed = bucketed.withColumn("_rank", rank).join(before, ["_l", "_b"])
    return placed.withColumn("fold", F.pmod(F.col("_before") + F.col("_rank") - 1, F.lit(k)).cast("int")).select(*df.columns, "fold")


def sample_rows(df: DataFrame, key: str, size: int, seed: int | str = SEED) -> DataFrame:
    """Exactly min(size, n) rows, without sorting the table."""
    hashed = df.withColumn("_hash", sampling.hash32(F.col(key), seed)).withColumn("_all", F.lit(1))
    wanted = F.least(F.col("n"), F.lit(size))
    return mark_smallest_hashes(hashed, ["_all"], "_hash", key, wanted, "_in").where("_in").drop("_hash", "_all", "_in")


def stratified_sample(df: DataFrame, label: str, key: str, size: int, seed: int | str = SEED) -> DataFrame:
    """About ``size`` rows: each label keeps round(size * its share); all rows
    when there are no more than ``size``."""
    total = df.count()
    if total <= size:
        return df
    hashed = df.withColumn("_hash", sampling.hash32(F.col(key), seed))
    wanted = F.round(F.col("n") * size / total).cast("bigint")
    return mark_smallest_hashes(hashed, [label], "_hash", key, wanted, "_in").where("_in").drop("_hash", "_in")
