"""Rows as bins of their features, for trees that are grown by histograms."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What tasks run travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row is in after ``depth`` steps."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]))
    return node


def matrix(column: pa.Array, kind=float) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=kind).reshape(len(column), -1)


def thresholds(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Where each feature may be split: between all of its values if they are ``bins``
    at most, else at quantiles of all rows."""
    def run(batches):
        seen: list = []
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                seen = seen or [np.empty(0)] * x.shape[1]
                # A feature of more values than bins needs no further look.
                seen = [old if len(old) > bins else np.unique(np.concatenate([old, x[:, f]])) for f, old in enumerate(seen)]
        if seen:
            kept = [old[:bins + 1] for old in seen]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(kept)), pa.int32()), pa.array(kept, pa.list_(pa.float64()))], ["f", "v"])

    found = rows.mapInArrow(run, "f int, v array<double>").select("f", F.explode("v").alias("v")).groupBy("f").agg(
        F.array_sort(F.collect_set("v")).alias("v")).orderBy("f").collect()
    if not found:
        raise ValueError("no rows to fit on")
    out = [(np.array(r["v"])[:-1] + np.array(r["v"])[1:]) / 2 for r in found]
    wide = [r["f"] for r in found if len(r["v"]) > bins]
    if wide:
        probs = [k / bins for k in range(bins + 1)]
        spread = rows.select(*[F.col("_x")[f].alias(f"_{f}") for f in wide])
        for f, q in zip(wide, spread.approxQuantile([f"_{f}" for f in wide], probs, 0.1 / bins)):
            out[f] = np.unique(q)[:-1]
    return out
