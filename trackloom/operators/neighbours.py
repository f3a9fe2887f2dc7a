"""Exact cosine top-k for every row, without an all-pairs join.

Published idea: pivot partitioning for kNN joins (Lu et al., VLDB 2012).

1. Equal vectors collapse to one, with their k+1 smallest ids.
2. Vectors go to the cell of their nearest pivot and to blocks of bounded size.
   Ranking inside the own block gives each vector a bound on its k-th best.
3. The triangle inequality rules out every cell that cannot beat the bound; a
   vector visits only the tiles (runs of blocks) with cells that remain, once each.

Every task holds two tiles, whatever the skew, and only local winners are
shuffled besides. No candidate is dropped except by proof, so the result is exact.
Where nothing can be ruled out, every vector is sent to every tile: to TILES of
them, up to TILES * TILE_VALUES numbers in all, and beyond that to as many tiles as
bounded memory takes.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import sampling
from trackloom.operators.skew import left_join_salted
from trackloom.session import cut_lineage

BLOCK_ROWS = 2048
MAX_PIVOTS = 1024
# Tiles are what meets in a task: so many, or more where one would hold more numbers.
TILES = 12
TILE_VALUES = 1 << 23
# Sources and targets scored at once inside a task.
STRIP = 1024
CHUNK = 4096
# Cosines are compared at this many decimals, so that the order of equal ones
# is by id and does not hang on the last bits of a sum.
COSINE_DECIMALS = 12
_SLACK = 1e-9


def unit_vector(column: str) -> "F.Column":
    """Vector over its length; a zero vector stays zero. ``+ 0.0`` drops -0.0."""
    v = F.col(column)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    safe = F.when(norm == 0, 1.0).otherwise(norm)
    return F.transform(v, lambda x: x / safe + F.lit(0.0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy())


def cosine_top_k(df: DataFrame, k: int, id_column: str = "id", vector_column: str = "vec",
                 block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(source, target, cosine, rank) with min(k, n - 1) rows per source."""
    if k < 1:
        raise ValueError("k must be positive")
    rows = df.select(F.col(id_column).alias("id"), unit_vector(vector_column).alias("unit"))
    rows = rows.withColumn("zero", F.array_max(F.transform("unit", F.abs)) == 0)
    id_type = rows.schema["id"].dataType.simpleString()

    few = W.partitionBy("unit", "zero").orderBy("id")
    heads = (
        rows.withColumn("rn", F.row_number().over(few)).where(F.col("rn") <= k + 1)
        .groupBy("unit", "zero").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    sizes = rows.groupBy("unit", "zero").agg(F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(heads.join(sizes, ["unit", "zero"]).withColumn("rid", F.col("ids")[0]))

    facts = groups.agg(
        F.count_if(~F.col("zero")).alias("groups"),
        F.count_if(F.col("zero")).alias("zero_groups"),
        F.count_if(~F.col("zero") & (F.col("n") > k + 1)).alias("large")).first()

    found = _group_hits(groups.where(~F.col("zero")), facts["groups"], k, block_rows, max_pivots, id_type)
    if facts["zero_groups"]:
        # Everything is at cosine 0 from the zero vector: one extra candidate.
        ids = F.lit(groups.where("zero").select("ids").first()["ids"])  # k + 1 ids
        found = found.unionByName(groups.where(~F.col("zero")).select(
            "rid", F.lit(0.0).alias("cosine"), ids.cast(f"array<{id_type}>").alias("other")))
    own = groups.where(~F.col("zero")).select("rid", F.lit(1.0).alias("cosine"), F.col("ids").alias("other"))
    listed = (
        found.unionByName(own)
        .select("rid", "cosine", F.explode("other").alias("target"))
        .withColumn("at", F.row_number().over(W.partitionBy("rid").orderBy(F.desc("cosine"), "target")))
        .where(F.col("at") <= k + 1)
        .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("at", "cosine", "target"))).alias("near")))
    answers = groups.where(~F.col("zero")).join(listed, "rid")

    members = answers.where(F.col("n") <= k + 1).select(F.explode("ids").alias("id"), "near")
    if facts["large"]:
        lookup = answers.where(F.col("n") > k + 1).select("unit", F.xxhash64("unit").alias("_h"), "near")
        copies = rows.where(~F.col("zero")).select("unit", F.xxhash64("unit").alias("_h"), "id")
        joined = left_join_salted(copies, lookup, "unit", "_h")
        members = members.unionByName(joined.where(F.col("near").isNotNull()).select("id", "near"))
    if facts["zero_groups"]:
        lowest = [r["id"] for r in rows.select("id").orderBy("id").limit(k + 1).collect()]
        near = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(0.0).alias("cosine"),
                                  F.lit(t).cast(id_type).alias("target")) for at, t in enumerate(lowest, 1)])
        members = members.unionByName(rows.where("zero").select("id", near.alias("near")))

    others = F.slice(F.filter("near", lambda x: x["target"] != F.col("id")), 1, k)
    return members.select(F.col("id").alias("source"), F.posexplode(others).alias("pos", "hit")).select(
        "source", "hit.target", "hit.cosine", (F.col("pos") + 1).cast("int").alias("rank"))


def _group_hits(groups: DataFrame, n: int, k: int, block_rows: int, max_pivots: int, id_type: str) -> DataFrame:
    """(rid, cosine, other): at least the k best other groups of each group."""
    rows = groups.select("rid", "unit", "ids")
    if n <= block_rows:
        open_cells = None
        placed = rows.withColumns({"cell": F.lit(0), "tile": F.lit(0), "bound": F.lit(float("-inf")),
                                   "to_tiles": F.array(F.lit(0))})
    else:
        blocked, cells = _assign(rows, min(max(1, n // block_rows), max_pivots), block_rows)

        def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
            unit = _matrix(pdf["unit"])
            scores = np.round(unit @ unit.T, COSINE_DECIMALS)
            np.fill_diagonal(scores, -np.inf)
            found = np.partition(scores, -k, axis=1)[:, -k] if k < len(pdf) else np.full(len(pdf), -np.inf)
            return pdf.assign(bound=found)

        schema = f"rid {id_type}, unit array<double>, ids array<{id_type}>, cell int, block int, bound double"
        bounded = blocked.groupBy("cell", "block").applyInPandas(bounds, schema)
        width = rows.select(F.size("unit")).first()[0]
        tile_rows = min(max(block_rows, -(-n // TILES)), max(block_rows, TILE_VALUES // max(width, 1)))
        open_cells, to_tiles = _routes(cells, tile_rows)
        placed = cut_lineage(bounded.mapInPandas(
            to_tiles, f"rid {id_type}, unit array<double>, ids array<{id_type}>, cell int, bound double, tile int, to_tiles array<int>"))

    visits = placed.select("rid", "unit", "cell", "bound", "tile", F.explode("to_tiles").alias("to_tile"))
    # One row for each two tiles that meet.
    routes = F.broadcast(placed.select("tile", F.explode("to_tiles").alias("to_tile")).distinct())
    routed = placed.select(F.col("tile").alias("to_tile"), "rid", "unit", "cell", "ids").join(routes, "to_tile")
    routed = routed.select(*[F.col(c).alias(c) for c in routed.columns])  # keys of its own for the cogroup
    key = ["tile", "to_tile"]
    return visits.groupBy(*key).cogroup(routed.groupBy(*key)).applyInArrow(
        _across(k, open_cells), f"rid {id_type}, cosine double, other array<{id_type}>")


def _across(k: int, open_cells):
    """The k best targets of each source of a tile in another (or the same) tile.

    A strip of sources meets the cells that are open to any of them, a bounded number
    of targets at a time. Single precision only rules out what is below the k-th best
    by more than its error; the rest is scored in full.
    """
    def flat(column: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"rid": left["rid"].slice(0, 0), "cosine": pa.array([], pa.float64()),
                             "other": right["ids"].slice(0, 0)})
        left, right = left.sort_by("cell"), right.sort_by([("cell", "ascending"), ("rid", "ascending")])
        source, target = flat(left["unit"]), flat(right["unit"])
        rids, others = left["rid"].to_numpy(), right["rid"].to_numpy()
        place = np.empty(len(others), np.int64)
        place[np.argsort(others, kind="stable")] = np.arange(len(others))
        cell, to_cell = left["cell"].to_numpy(), right["cell"].to_numpy()
        bound = left["bound"].to_numpy()
        fine, error = target.astype(np.float32), 1.2e-7 * (target.shape[1] + 8)
        rows, cols, values = [], [], []
        for low in range(0, len(source), STRIP):
            part = slice(low, low + STRIP)
            columns = None
            if open_cells is not None:
                columns = np.flatnonzero(open_cells(source[part], cell[part], bound[part], to_cell))
                if len(columns) == len(target):
                    columns = None
            r, c, v = _strip(source[part], rids[part], bound[part], target, fine, others, place, columns, k, error)
            rows.append(r + low)
            cols.append(c)
            values.append(v)
        return pa.table({"rid": left["rid"].take(pa.array(np.concatenate(rows))),
                         "cosine": pa.array(np.concatenate(values)),
                         "other": right["ids"].take(pa.array(np.concatenate(cols)))})

    return run


def _strip(source, rids, bound, target, fine, others, place, columns, k, error):
    """(row, target, cosine) of the k best of every row; equal cosines by id."""
    single, floor = source.astype(np.float32), bound.copy()
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    total = len(target) if columns is None else len(columns)
    share = max(1, (1 << 22) // target.shape[1])
    for low in range(0, total, CHUNK):
        some = np.arange(low, min(low + CHUNK, total)) if columns is None else columns[low:low + CHUNK]
        scores = single @ (fine[low:low + CHUNK] if columns is None else fine[some]).T
        least = floor - error
        if len(some) > 4 * k and np.isneginf(floor).any():
            least = np.maximum(least, np.partition(scores, -k - 1, axis=1)[:, -k - 1] - 2 * error)
        close = np.flatnonzero(scores >= least[:, None].astype(np.float32) - np.float32(1e-7))
        for at in range(0, len(close), share):
            r, c = np.divmod(close[at:at + share], len(some))
            c = some[c]
            v = np.round(np.einsum("ij,ij->i", source[r], target[c]), COSINE_DECIMALS)
            keep = (v >= floor[r] - _SLACK) & (rids[r] != others[c])
            r, c, v = (np.concatenate(x) for x in zip(held, (r[keep], c[keep], v[keep])))
            order = np.lexsort((place[c], -v, r))
            r, c, v = r[order], c[order], v[order]
            turn = np.arange(len(r)) - np.searchsorted(r, r)
            held = r[turn < k], c[turn < k], v[turn < k]
            last = turn == k - 1
            floor[r[last]] = np.maximum(floor[r[last]], v[last])
    return held


def _assign(groups: DataFrame, cells_wanted: int, block_rows: int):
    """Add cell and block. Returns also the pivots and, by cell, its rows, blocks,
    nearest and farthest distance."""
    # At most max_pivots vectors come to the driver, however large the table is.
    pivots = np.array([r["unit"] for r in groups.orderBy(sampling.hash32(F.col("rid")), "rid")
                       .limit(cells_wanted).select("unit").collect()])

    def nearest(batches):
        for pdf in batches:
            unit = _matrix(pdf["unit"])
            gaps = _distances(unit, pivots)
            cell = gaps.argmin(axis=1)
            yield pdf.assign(cell=cell.astype("int32"), gap=gaps[np.arange(len(pdf)), cell])

    schema = T.StructType([*groups.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    placed = cut_lineage(groups.mapInPandas(nearest, schema))
    cells = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("gap").alias("near"), F.max("gap").alias("far"))
    facts = {r["cell"]: (r["n"], max(1, -(-r["n"] // block_rows)), r["near"], r["far"]) for r in cells.collect()}
    sizes = F.create_map(*[F.lit(v) for c, (_, blocks, _, _) in facts.items() for v in (c, blocks)])
    block = (sampling.hash32(F.col("rid")) % sizes[F.col("cell")]).cast("int")
    blocked = placed.withColumn("block", block).drop("gap")
    return blocked, (pivots, facts)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _routes(cells, tile_rows: int):
    """A test of the cells that may hold better targets, and a step that adds to
    batches of rows their tile and the tiles of such cells.

    Tiles are runs of blocks, in the order of their cells, of about ``tile_rows`` rows.
    """
    pivots, facts = cells
    ids = np.array(sorted(facts))
    pivots = pivots[ids]
    count, blocks, near, far = (np.array([facts[c][i] for c in ids]) for i in range(4))
    between = _distances(pivots, pivots)
    begin = np.cumsum(count) - count

    def tile(at, block):
        return (begin[at] + block * count[at] // blocks[at]) // tile_rows

    first, last = tile(np.arange(len(ids)), 0), tile(np.arange(len(ids)), blocks - 1)
    spans = (first[:, None] <= np.arange(last.max() + 1)) & (np.arange(last.max() + 1) <= last[:, None])

    def reached(unit, cell, bound):
        home = np.searchsorted(ids, cell)
        gaps = _distances(unit, pivots)
        own = gaps[np.arange(len(unit)), home]
        apart = between[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (gaps ** 2 - own[:, None] ** 2) / (2 * apart), 0.0)
        least = np.maximum.reduce([gaps - far[None, :], near[None, :] - gaps, plane])
        return least <= (np.sqrt(2.0 - 2.0 * np.maximum(bound, -1.0)) + 1e-6)[:, None]

    def open_cells(unit, cell, bound, to_cell):
        return reached(unit, cell, bound).any(axis=0)[np.searchsorted(ids, to_cell)]

    def to_tiles(batches):
        for pdf in batches:
            for start in range(0, len(pdf), STRIP):
                part = pdf.iloc[start:start + STRIP]
                found = reached(_matrix(part["unit"]), part["cell"].to_numpy(), part["bound"].to_numpy())
                met = found.astype(np.float32) @ spans > 0
                own = tile(np.searchsorted(ids, part["cell"].to_numpy()), part["block"].to_numpy())
                yield part[["rid", "unit", "ids", "cell", "bound"]].assign(
                    tile=own.astype("int32"), to_tiles=[np.flatnonzero(x).astype("int32") for x in met])

    return open_cells, to_tiles
