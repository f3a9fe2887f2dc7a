"""Boosted trees of the squared loss, for several targets of the same rows.

The trees of one round, one per target, grow together: a level is one pass over the rows,
in which tasks add up residuals and rows per target, node, feature and bin, and a node's
split is chosen where its sums meet. Rows are written as bins, in blocks; no task holds
more than a few blocks. Rounds are those of Spark's boosting: the first tree fits the
target, each other one twice the residual, and counts ``step``.
"""

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.bins import descend, matrix, thresholds
from trackloom.session import Scope, cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 64  # rows of a block; a batch holds thousands of blocks
CHUNK = 32  # blocks that are worked on at a time
STATE = "at long, x binary, g binary"


@dataclass(frozen=True)
class Boosted:
    """(feature, threshold, what the prediction gains) of the nodes of each tree, by round and target."""

    stages: list
    targets: int
    depth: int

    def transform(self, df: DataFrame, outs: list[str]) -> DataFrame:
        """Add a prediction per target."""
        stages, targets, depth = self.stages, self.targets, self.depth

        def predictions(vectors: pa.Array) -> pa.Array:
            n = len(vectors)
            x = matrix(vectors) if n else np.zeros((0, 1))
            found = np.zeros((n, targets))
            for stage in stages:
                found += _step(x, stage, depth)
            ends = np.arange(0, (n + 1) * targets, targets, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

        scored = df.withColumn("_found", F.arrow_udf(predictions, "array<double>")(vector_to_array("features")))
        return scored.withColumns({out: F.col("_found")[k] for k, out in enumerate(outs)}).drop("_found")


def _step(x: np.ndarray, stage: list[tuple], depth: int) -> np.ndarray:
    return np.stack([gain[descend(x, feature, cut, depth)] for feature, cut, gain in stage], axis=1)


def fit(train: DataFrame, labels: list[str], params) -> Boosted:
    """``train`` has ``features`` and the ``labels``; ``params`` are the tree parameters."""
    rows = train.select(vector_to_array("features").alias("_x"), F.array(*[F.col(c).cast("double") for c in labels]).alias("_y"))
    cuts = thresholds(rows.select("_x"), params.max_bins)
    shape = len(labels), len(cuts), max(map(len, cuts)) + 1
    kind = "u1" if shape[2] <= 256 else "<u2"
    stages = []
    with Scope(train.sparkSession):
        state = cut_lineage(_blocks(rows, cuts, kind))
        for turn in range(params.rounds):
            feature, cut, value = _grow(state, shape, kind, params, turn)
            gain = value if turn == 0 else 2 * params.step * value
            real = np.zeros(cut.shape)
            for c, node in zip(*np.nonzero(feature >= 0)):
                real[c, node] = cuts[feature[c, node]][cut[c, node]]
            stages.append([(feature[c], real[c], gain[c]) for c in range(shape[0])])
            if turn + 1 < params.rounds:
                done = [(feature[c], cut[c], gain[c]) for c in range(shape[0])]
                state = cut_lineage(_advance(state, done, shape, kind, params.depth))
    return Boosted(stages, shape[0], params.depth)


def _blocks(rows: DataFrame, cuts: list[np.ndarray], kind: str) -> DataFrame:
    """Blocks of rows: the first one's number, bins, and prediction less target, at first of 0."""
    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            if batch.num_rows:
                x, g = matrix(batch.column(0)), -matrix(batch.column(1))
                x = np.stack([np.searchsorted(t, x[:, f]) for f, t in enumerate(cuts)], axis=1).astype(kind)
                starts = range(0, len(x), BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at + k for k in starts], pa.int64()), *[pa.array([a[k:k + BLOCK].tobytes() for k in starts], pa.binary())
                                                                       for a in (x, g)]], ["at", "x", "g"])
                at += len(x)

    return rows.mapInArrow(run, STATE)


def _chunks(batches, shape: tuple[int, int, int], kind: str):
    """(numbers, bins, prediction less target, block sizes) of the rows of a few blocks at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, CHUNK):
            at, xs, gs = (c.to_pylist() for c in batch.slice(k, CHUNK).columns)
            x = np.frombuffer(b"".join(xs), kind).reshape(-1, shape[1])
            g = np.frombuffer(b"".join(gs)).reshape(-1, shape[0])
            sizes = [len(b) // (8 * shape[0]) for b in gs]
            yield np.concatenate([a + np.arange(n) for a, n in zip(at, sizes)]), x, g, sizes


def _drawn(numbers: np.ndarray, share: float, seed: int, turn: int) -> np.ndarray:
    """The rows of a round: a hash of seed, round and number is below the share."""
    z = numbers.astype(np.uint64) + np.uint64((seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) / 2.0**64 < share


def _advance(state: DataFrame, stage: list[tuple], shape: tuple[int, int, int], kind: str, depth: int) -> DataFrame:
    """Add one round to the predictions."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                moved = []
                for _, x, g, sizes in _chunks([batch], shape, kind):
                    moved += [part.tobytes() for part in np.split(g + _step(x, stage, depth), np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(moved, pa.binary())], ["at", "x", "g"])

    return state.mapInArrow(run, STATE)


def _grow(state: DataFrame, shape: tuple[int, int, int], kind: str, params, turn: int) -> tuple[np.ndarray, ...]:
    """Feature (-1 at a leaf), bin and mean residual of each target's nodes; node k has the children 2k + 1 and 2k + 2."""
    nodes = (1 << params.depth + 1) - 1
    feature, cut = np.full((shape[0], nodes), -1), np.zeros((shape[0], nodes), np.int64)
    g, h = np.zeros(feature.shape), np.zeros(feature.shape)
    for level in range(max(params.depth, 1)):
        parts = state.mapInArrow(_level(feature, cut, level, shape, kind, params, turn), "slot int, part int, v binary")
        best = parts.groupBy("slot").applyInPandas(
            _best(shape, level, params, turn), "slot int, feature int, bin int, g double, h double, gl double, hl double").collect()
        split = False
        for r in best:
            c, node = r["slot"] >> level, (r["slot"] & (1 << level) - 1) + (1 << level) - 1
            g[c, node], h[c, node] = r["g"], r["h"]
            if r["feature"] >= 0 and level < params.depth:
                feature[c, node], cut[c, node], split = r["feature"], r["bin"], True
                g[c, 2 * node + 1:2 * node + 3] = r["gl"], r["g"] - r["gl"]
                h[c, 2 * node + 1:2 * node + 3] = r["hl"], r["h"] - r["hl"]
        if not split:
            break
    return feature, cut, np.where(h > 0, -g / np.where(h > 0, h, 1), 0.0)


def _level(feature: np.ndarray, cut: np.ndarray, level: int, shape: tuple[int, int, int], kind: str, params, turn: int):
    """Sums of prediction less target, and rows, per feature and bin; a row per target and node of the level."""
    targets, features, width = shape

    def run(batches):
        size = width << level
        total = np.zeros((targets, 2, features, size + width))  # the last width is for rows in a leaf above
        for at, x, g, _ in _chunks(batches, shape, kind):
            drawn = _drawn(at, params.row_share, params.seed, turn) if params.row_share < 1 else np.ones(len(x), bool)
            x, g = x[drawn], g[drawn]
            places = x.T.astype(np.int64)
            for c in range(targets):
                node = descend(x, feature[c], cut[c], level) - ((1 << level) - 1)
                start, residual = np.where(node < 0, 1 << level, node) * width, np.ascontiguousarray(g[:, c])
                for f in range(features):
                    place = places[f] + start
                    total[c, 0, f] += np.bincount(place, residual, size + width)
                    total[c, 1, f] += np.bincount(place, minlength=size + width)
        sums = total[..., :size].reshape(targets, 2, features, 1 << level, width).transpose(0, 3, 1, 2, 4).reshape(-1, 2, features, width)
        slots = np.flatnonzero(sums[:, 1].any(axis=(1, 2)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(slots), pa.int32()),
             pa.array([sums[k].tobytes() for k in slots], pa.binary())], ["slot", "part", "v"])

    return run


def _best(shape: tuple[int, int, int], level: int, params, turn: int):
    """The split of a node that lowers the variance most, among the features drawn for it, if any does."""
    _, features, width = shape
    wanted = int(np.ceil(params.feature_share * features - 1e-9))

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        g, h = sum(np.frombuffer(v).reshape(2, features, width) for v in parts.sort_values("part")["v"])
        slot = int(parts["slot"].iloc[0])
        used = np.zeros((features, 1), bool)
        used[np.random.default_rng([params.seed, turn, level, slot]).permutation(features)[:wanted]] = True
        gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
        whole = g[0].sum(), h[0].sum()
        gr, hr = whole[0] - gl, whole[1] - hl
        both = used & (hl > 0) & (hr > 0)
        apart = np.where(both, gl / np.where(both, hl, 1) - gr / np.where(both, hr, 1), 0)
        # Trees after the first fit twice the residual.
        gain = (1 if turn == 0 else 4) * apart ** 2 * hl * hr / whole[1] ** 2
        if not gain.size or gain.max() <= 0 or gain.max() < params.min_gain:
            row = (slot, -1, 0, *whole, 0.0, 0.0)
        else:
            f, k = np.unravel_index(gain.argmax(), gain.shape)
            row = (slot, int(f), int(k), *whole, gl[f, k], hl[f, k])
        return pd.DataFrame([row], columns=["slot", "feature", "bin", "g", "h", "gl", "hl"])

    return run
