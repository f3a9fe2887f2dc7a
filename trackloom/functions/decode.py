"""Decoding of class-probability arrays (``array<double>``, class id = index)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import circle


def softmax(margin: Column, classes: int) -> Column:
    """Unrolled: a lambda would work out the maximum and the sum per element,
    generated code shares them."""
    exps = [F.exp(margin[c] - F.array_max(margin)) for c in range(classes)]
    total = sum(exps[1:], exps[0])
    return F.array(*[e / total for e in exps])


def argmax(p: Column) -> Column:
    """First class with the largest value."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def argmin(p: Column) -> Column:
    return (F.array_position(p, F.array_min(p)) - 1).cast("int")


def expected_distances(p: Column, distances: list[list[float]]) -> Column:
    """Expected distance of choosing each class, as an array; all null where a
    probability is.

    Blocks of rows at once: as one generated method the sums are too long for the JVM to
    compile. They are added up in the order of the classes.
    """
    size = len(distances)

    def sums(probs: pa.Array) -> pa.Array:
        whole = not probs.null_count and not probs.flatten().null_count and len(probs.flatten()) == size * len(probs)
        rows = None if whole else [v is not None and len(v) == size and None not in v for v in probs.to_pylist()]
        held = probs if whole else probs.filter(pa.array(rows, pa.bool_()))
        x = np.asarray(held.flatten(), dtype=float).reshape(-1, size)
        out = np.empty(x.shape)
        for k in range(size):
            total = x[:, 0] * distances[0][k]
            for c in range(1, size):
                total = total + x[:, c] * distances[c][k]
            out[:, k] = total
        if whole:
            return pa.ListArray.from_arrays(pa.array(np.arange(0, (len(out) + 1) * size, size, dtype=np.int32)), pa.array(out.ravel()))
        found = iter(out.tolist())
        return pa.array([next(found) if good else [None] * size for good in rows], pa.list_(pa.float64()))

    return F.arrow_udf(sums, "array<double>")(p)


def with_ranking(df: DataFrame, probs: str = "probs", distances: list[list[float]] | None = None) -> DataFrame:
    """Add what the distance-aware decoders below read: ``expected`` (expected
    distance per class) and ``ranked`` (classes by falling probability; equal
    ones by class). Two steps, so that each is computed once per row however
    many decoders use it.
    """
    distances = distances or circle.distance_matrix("steps")
    ranked = F.sort_array(F.transform(probs, lambda x, c: F.struct(
        (-x).alias("neg"), c.alias("cls"), F.get(F.col("expected"), c).alias("d"))))
    return df.withColumn("expected", expected_distances(F.col(probs), distances)).withColumn("ranked", ranked)


def min_expected_distance(expected: Column) -> Column:
    return argmin(expected)


def most_probable(ranked: Column) -> Column:
    return ranked[0]["cls"]


def confidence(ranked: Column) -> Column:
    return -ranked[0]["neg"]


def top_k_min_expected_distance(ranked: Column, k: int) -> Column:
    """Smallest expected distance among the ``k`` most probable classes; equal
    distances go to the lower class."""
    if k <= 1:
        return most_probable(ranked)
    return F.array_min(F.array(*[
        F.struct(ranked[i]["d"].alias("d"), ranked[i]["cls"].alias("cls")) for i in range(k)]))["cls"]


def gated_top_k(ranked: Column, threshold: float, k: int) -> Column:
    """Top-k decoding for rows less sure than ``threshold``, argmax for the rest."""
    return F.when(confidence(ranked) < threshold, top_k_min_expected_distance(ranked, k)).otherwise(
        most_probable(ranked))


def expected_distance_of(expected: Column, chosen: Column) -> Column:
    return F.element_at(expected, chosen + 1)
