"""Exact quantiles with linear interpolation, for value sets of any size.

The built-in ``percentile`` keeps every distinct value of a group in one task, so
equal values collapse to (value, count) here; histograms narrow each wanted rank
down to one thin slice of the value range, and only the slices that hold a wanted
rank are sorted. Every size takes this path.
"""

from functools import reduce
from math import ceil, floor
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.session import cut_lineage

SLICES = 4096
# Distinct values of a slice that one task may sort.
THIN = 200_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], thin: int = THIN) -> DataFrame:
    """(keys, p, q) of the non-null values per key.

    ``keys`` must have few distinct values, such as feature names and flags:
    the ranks under way, keys x 2 x len(probs), are kept on the driver. Null is a
    key like others. Infinities are values; NaN counts as larger than all.
    """
    present = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    if not keys:
        return _by_slices(present.withColumn("_all", F.lit(1)), ["_all"], probs, thin).drop("_all")
    return _by_slices(present, keys, probs, thin)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Join on equal names, null being equal to null; the names come from ``left``."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in names})
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names])
    return left.join(F.broadcast(renamed), on).drop(*[f"_r_{c}" for c in names])


def _cell() -> Column:
    """Cell of v among SLICES equal ones between the least and the largest finite
    value of its slice; infinities and NaN have cells of their own, in order."""
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    by = F.when(high - low == float("inf"), F.lit(0.5)).otherwise(F.lit(1.0))  # a width beyond the largest double
    part = F.try_divide(v * by - low * by, high * by - low * by)
    inner = F.coalesce(F.least(F.floor(part * SLICES), F.lit(SLICES - 1)), F.lit(0))
    return (F.when(F.isnan(v), SLICES + 1).when(v == float("inf"), SLICES).when(v == float("-inf"), -1).otherwise(inner)
            .cast("long"))


def _by_slices(present: DataFrame, keys: list[str], probs: list[float], thin: int) -> DataFrame:
    spark = present.sparkSession
    counts = cut_lineage(present.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")))
    bounds = counts.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("d")).collect()
    sizes = {tuple(b[k] for k in keys): b["n"] for b in bounds}
    wanted = {
        (*key, rank): None for key, n in sizes.items() for p in probs
        for rank in (floor(p * (n - 1)), ceil(p * (n - 1)))}
    spans = {tuple(b[k] for k in keys): (b["lo"], b["hi"], 0, b["d"]) for b in bounds}
    slices = {target: spans[target[:-1]] for target in wanted}

    key_types = ", ".join(f"{k} {present.schema[k].dataType.simpleString()}" for k in keys)

    def table(picked):
        rows = [(*t, lo, hi, start) for t, (lo, hi, start, _d) in picked.items()]
        return spark.createDataFrame(rows, f"{key_types}, rank bigint, lo double, hi double, start bigint")

    def holding(picked, cell, measure):
        """For each picked rank the cell of its slice that the rank falls into."""
        ranks = table(picked)
        spans_ = ranks.select(*keys, "lo", "hi", "start").distinct()
        inside = _same(counts, spans_, keys).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        if measure:
            finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
            edges = inside.groupBy(*keys, "lo", "hi", "start").agg(F.min(finite).alias("low"), F.max(finite).alias("high"))
            inside = _same(inside, edges, [*keys, "lo", "hi", "start"])
        cells = inside.groupBy(*keys, "lo", "hi", "start", cell.alias("cell")).agg(F.sum("c").alias("c"), *measure)
        upto = F.col("start") + F.sum("c").over(W.partitionBy(*keys, "lo", "hi").orderBy("cell"))
        ends = _same(cells.withColumn("upto", upto), ranks, [*keys, "lo", "hi", "start"])
        return ends.where((F.col("rank") >= F.col("upto") - F.col("c")) & (F.col("rank") < F.col("upto"))).collect()

    measure = [F.min("v").alias("lo2"), F.max("v").alias("hi2"), F.count(F.lit(1)).alias("d")]
    while True:
        # A slice ends at real values, so rounding cannot move one across a border.
        wide = {t: s for t, s in slices.items() if s[3] > max(thin, 1)}
        if not wide:
            break
        for r in holding(wide, _cell(), measure):
            slices[(*[r[k] for k in keys], r["rank"])] = (r["lo2"], r["hi2"], r["upto"] - r["c"], r["d"])
    for r in holding(slices, F.col("v"), []):
        wanted[(*[r[k] for k in keys], r["rank"])] = r["cell"]

    def at(key, p):
        position = p * (sizes[key] - 1)
        low, high = wanted[(*key, floor(position))], wanted[(*key, ceil(position))]
        return low if low == high or position == floor(position) else (
            (ceil(position) - position) * low + (position - floor(position)) * high)

    rows = [(*key, float(p), at(key, p)) for key in sizes for p in probs]
    return spark.createDataFrame(rows, f"{key_types}, p double, q double")
