"""Hard negatives by exact inner products, several candidates to a number.

Vectors become integers and lie in blocks. Anchors meet candidates block by block in
cells of a grid: first those of their own label, which gives each anchor's positives,
then those of all labels for the negatives in each positive's score range. In a pair
of blocks the components are made non-negative by a bias and those of several
candidates stand in separate fields of one wide number (Kronecker's substitution), so
one multiplication per anchor component serves all of them; the sum is unpacked into
exact scores. Only the best of each pair of blocks are shuffled.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import prepare
from trackloom.session import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # hundredths of the positive's score
# Rows of a block, and blocks of a cell.
CANDIDATES, ANCHORS = 2048, 256
CELL_CANDIDATES, CELL_ANCHORS = 4, 16
_LEAST = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def _integers(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, in the smallest kind that holds them."""
    found = np.floor(scale * np.array(vectors, np.float64))
    if found.size and np.abs(found).max() >= 2.0 ** 62:
        return np.array([[int(x) for x in row] for row in found.tolist()], object)
    whole = found.astype(np.int64)
    low, high = (int(whole.min()), int(whole.max())) if whole.size else (0, 0)
    return whole.astype(np.promote_types(np.min_scalar_type(low), np.min_scalar_type(high))
                        if low < 0 else np.min_scalar_type(high))


def _wide(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Products of any size, by numbers as wide as all candidates' fields together."""
    low_a, low_c = int(anchors.min()), int(candidates.min())
    a = [[int(x) - low_a for x in row] for row in anchors.tolist()]
    c = [[int(x) - low_c for x in row] for row in candidates.tolist()]
    dims = len(a[0])
    field = (dims * max(map(max, a)) * max(map(max, c))).bit_length() // 8 + 1
    packed = [int.from_bytes(b"".join(row[d].to_bytes(field, "little") for row in c), "little") for d in range(dims)]
    sums, out = [sum(row) for row in c], []
    for row in a:
        total = sum(x * k for x, k in zip(row, packed)).to_bytes(field * len(c), "little")
        base = low_c * sum(row) + dims * low_a * low_c
        out.append([min(max(int.from_bytes(total[field * j:field * (j + 1)], "little") + base + low_a * sums[j],
                            _LEAST + 1), _MOST) for j in range(len(c))])
    return np.array(out, np.int64)


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner product of every anchor with every candidate, as 64-bit integers; a
    product beyond them is the nearest of them."""
    count, dims = candidates.shape
    if not dims or not count or not len(anchors):
        return np.zeros((len(anchors), count), np.int64)
    low_a, low_c = int(anchors.min()), int(candidates.min())
    high_a, high_c = int(anchors.max()) - low_a, int(candidates.max()) - low_c
    field = max((dims * high_a * high_c).bit_length(), 1)
    if field > 64 or 4 * dims * max(-low_a, high_a + abs(low_a)) * max(-low_c, high_c + abs(low_c)) > _MOST:
        return _wide(anchors, candidates)
    a = (anchors.astype(np.int64) - low_a).astype(np.uint64)
    c = (candidates.astype(np.int64) - low_c).astype(np.uint64)
    fields = 64 // field
    words = -(-count // fields)
    packed = np.zeros((dims, words), np.uint64)
    for f in range(fields):
        part = c[f * words:(f + 1) * words]
        packed[:, :len(part)] |= part.T << np.uint64(f * field)
    out, rows = np.empty((len(a), fields * words), np.int64), max((1 << 13) // words, 1)
    mask = np.uint64((1 << field) - 1)
    for s in range(0, len(a), rows):  # as many anchors at once as stay in the processor's cache
        some = a[s:s + rows]
        total, product = np.zeros((len(some), words), np.uint64), np.empty((len(some), words), np.uint64)
        for d in range(dims):
            np.multiply(some[:, d, None], packed[d], out=product)
            total += product
        for f in range(fields):
            out[s:s + rows, f * words:(f + 1) * words] = total >> np.uint64(f * field) & mask
    out = out[:, :count]
    out += low_c * a.sum(axis=1).astype(np.int64)[:, None]
    out += low_a * c.sum(axis=1).astype(np.int64)[None, :] + dims * low_a * low_c
    return out


def _blocker(scale: int):
    """Blocks of rows sorted by label and id: of one label (pure) and of any, of
    candidates and of anchors. Of rows equal in label and id the first stays."""
    def run(batches):
        part, made, before = TaskContext.get().partitionId(), 0, None
        held = {}  # (pure, anchors, label or None, dims) -> rows

        def block(key):
            nonlocal made
            pure, anchors, label, dims = key
            rows = held.pop(key)
            made += 1
            return ((part << 32) + made, pure, anchors, label, dims, len(rows), [x[0] for x in rows], [x[1] for x in rows],
                    pickle.dumps(_integers([x[2] for x in rows], scale).reshape(len(rows), dims), protocol=5))

        def table(rows):
            kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()),
                     pa.list_(pa.int64()), pa.binary()]
            names = ["block", "pure", "anchors", "label", "dims", "n", "ids", "labels", "vectors"]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            for label, number, anchor, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if (label, number) == before:
                    continue
                out = []
                if before is not None and before[0] != label:
                    out += [block(k) for k in [k for k in held if k[0]]]
                before = (label, number)
                for pure in (True, False):
                    for anchors in ((True, False) if anchor else (False,)):
                        key = (pure, anchors, label if pure else None, len(vector))
                        held.setdefault(key, []).append((number, label, vector))
                        if len(held[key]) == (ANCHORS if anchors else CANDIDATES):
                            out.append(block(key))
                if len(held) > 64:  # many lengths of vectors
                    out += [block(k) for k in list(held)]
                if out:
                    yield table(out)
        if held:
            for k in list(held):
                yield table([block(k)])

    return run


def _cells(candidates: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Every block of anchors beside every block of candidates with equal keys, in
    cells of a bounded number of blocks: each side goes to all cells of its row."""
    counts = [t.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for t, n in ((candidates, "_c"), (anchors, "_a"))]
    sides = (counts[0].join(counts[1], keys)
             .select(*keys, F.ceil(F.col("_c") / CELL_CANDIDATES).cast("int").alias("_c"),
                     F.ceil(F.col("_a") / CELL_ANCHORS).cast("int").alias("_a")))
    sides = cut_lineage(sides)

    def dealt(table, own, other):
        lane = F.pmod(F.xxhash64("block"), F.col(own)).cast("int")
        return (table.join(sides, keys).withColumn(f"{own}_lane", lane)
                .withColumn(f"{other}_lane", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_c", "_a"))

    left = dealt(candidates.select(*keys, "block", "ids", "labels", "vectors"), "_c", "_a")
    right = dealt(anchors.select(*keys, "block", F.struct(*[c for c in anchors.columns if c not in keys]).alias("a")), "_a", "_c")
    return left.join(right.drop("block"), [*keys, "_c_lane", "_a_lane"]).select("ids", "labels", "vectors", "a")


def _pairs(batches):
    """Products of each pair of blocks with what tells the rows apart."""
    last = None
    for batch in batches:
        for k in range(batch.num_rows):
            ids, labels, vectors, anchor = (batch.column(c)[k] for c in range(4))
            blob = vectors.as_py()
            if last is None or blob != last[0]:
                last = (blob, pickle.loads(blob), ids.values.to_numpy(), labels.values.to_numpy())
            own = anchor.as_py()
            found = scores(pickle.loads(own["vectors"]), last[1])
            yield own, np.array(own["ids"], np.int64), np.array(own["labels"], np.int64), last[2], last[3], found


def _first(rows: np.ndarray, most: int) -> np.ndarray:
    """Whether a place is among the first ``most`` of its run in ``rows``."""
    heads = np.flatnonzero(np.diff(rows, prepend=-1))
    return np.arange(len(rows)) - np.repeat(heads, np.diff(heads, append=len(rows))) < most


def _batch(names, columns):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


_POSITIVE = ["anchor_id", "label", "positive_id", "positive_score"]
_NEGATIVE = [*_POSITIVE, "negative_id", "negative_score"]


def _positives(most: int):
    def run(batches):
        for _, ids, labels, others, _, found in _pairs(batches):
            found[ids[:, None] == others[None, :]] = _LEAST
            if found.shape[1] > most:
                least = np.partition(found, found.shape[1] - most, axis=1)[:, found.shape[1] - most]
            else:
                least = np.full(len(ids), _LEAST)
            a, c = np.nonzero((found >= least[:, None]) & (found > _LEAST))
            got = found[a, c]
            order = np.lexsort((others[c], -got, a))
            a, c, got = a[order], c[order], got[order]
            some = _first(a, most)
            yield _batch(_POSITIVE, [ids[a[some]], labels[a[some]], others[c[some]], got[some]])

    return run


def _negatives(most: int, low: int, high: int):
    def run(batches):
        for own, ids, labels, others, other_labels, found in _pairs(batches):
            ranges = [[] for _ in ids]
            for x in own["positives"]:
                score = x["positive_score"]
                ranges[x["at"]].append((-(-low * score // 100), high * score // 100, x["positive_id"], score))
            width = max(map(len, ranges))
            table = np.array([r + [(1, 0, 0, 0)] * (width - len(r)) for r in ranges], np.int64)
            lowest = np.where(table[:, :, 0] <= table[:, :, 1], table[:, :, 0], _MOST).min(axis=1)
            a, c = np.nonzero((found >= lowest[:, None]) & (found <= table[:, :, 1].max(axis=1)[:, None])
                              & (labels[:, None] != other_labels[None, :]))
            got = found[a, c]
            order = np.lexsort((others[c], -got, a))
            a, c, got = a[order], c[order], got[order]
            for p in range(width):
                some = np.flatnonzero((got >= table[a, p, 0]) & (got <= table[a, p, 1]))
                some = some[_first(a[some], most)]
                at = a[some]
                yield _batch(_NEGATIVE, [ids[at], labels[at], table[at, p, 2], table[at, p, 3], others[c[some]], got[some]])

    return run


def _best(found: DataFrame, keys: list[str], score: str, number: str, most: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), number))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchor: Column, scale: int = SCALE, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and embedding; ``anchor`` tells which rows are anchors.
    A component x counts as floor(``scale`` * x). An anchor's positives are the
    ``positives`` best other rows of its label; for each of them the ``negatives``
    best rows of other labels come, whose score lies from ``low`` to ``high``
    hundredths of the positive's. Equal scores go by the smaller vec_id.

    Rows without id, label or vector, and vectors with a component that is null or
    not finite (also once scaled), take no part. Rows equal in id and label are one
    row, that of the least vector; rows equal in id only are not each other's
    positives. Vectors meet those of their own length only; those of length 0 score
    0. Scores beyond 64 bits are the nearest of them. An empty table gives an empty
    result; other columns are not read.
    """
    prepare(rows.sparkSession)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * F.lit(float(scale))) < float("inf")))
    taken = (rows.select(F.col("label").cast("long").alias("label"), F.col("vec_id").cast("long").alias("vec_id"),
                         F.coalesce(anchor, F.lit(False)).alias("anchor"), "embedding")
             .where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite))
    blocks = cut_lineage(
        taken.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id", "embedding")
        .mapInArrow(_blocker(scale), "block long, pure boolean, anchors boolean, label long, dims int, n int, "
                                     "ids array<long>, labels array<long>, vectors binary"))
    columns = ["block", "ids", "labels", "vectors"]

    own = blocks.where("pure")
    near = _cells(own.where("not anchors"), own.where("anchors").select("label", "dims", *columns), ["label", "dims"])
    found = near.mapInArrow(_positives(positives), "anchor_id long, label long, positive_id long, positive_score long")
    best = cut_lineage(_best(found, ["anchor_id", "label"], "positive_score", "positive_id", positives).drop("rank"))

    mixed = blocks.where("not pure")
    asked = mixed.where("anchors").select("dims", *columns)
    places = asked.select("block", F.posexplode(F.arrays_zip("ids", "labels")).alias("at", "x"))
    given = (places.select("block", "at", F.col("x.ids").alias("anchor_id"), F.col("x.labels").alias("label"))
             .join(best, ["anchor_id", "label"]).groupBy("block")
             .agg(F.collect_list(F.struct("at", "positive_id", "positive_score")).alias("positives")))
    far = _cells(mixed.where("not anchors"), cut_lineage(asked.join(given, "block")), ["dims"])
    found = far.mapInArrow(_negatives(negatives, low, high), "anchor_id long, label long, positive_id long, "
                           "positive_score long, negative_id long, negative_score long")
    return (_best(found, ["anchor_id", "label", "positive_id"], "negative_score", "negative_id", negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
