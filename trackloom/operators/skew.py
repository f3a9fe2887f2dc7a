"""Joins and ordered selections that stay balanced when one key is very common."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A key is hot when it owns more than 1/HOT_KEYS of all rows, so there are
# fewer than HOT_KEYS hot keys whatever the data.
HOT_KEYS = 512
# Size of the frequent-items sketch: its error, about 3.5 / TRACKED of all rows,
# stays well below the share that makes a key hot.
TRACKED = 16384
SALTS = 64


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input: dealt by key, never sent whole
    to the driver and to every executor. The planner would do that where few columns
    of a compressed file seem small, whatever rows are made of them later."""
    return df.hint("shuffle_merge")


def hot_keys(df: DataFrame, column: str) -> list:
    """Keys that own more than 1/HOT_KEYS of the non-null rows, by one sketch
    aggregate over this column alone. It only steers the layout of a join."""
    row = df.select(column).agg(
        F.count(column).alias("n"), F.expr(f"approx_top_k({column}, {HOT_KEYS}, {TRACKED})").alias("top")).first()
    return [item["item"] for item in row["top"] if item["count"] * HOT_KEYS > row["n"]]


def left_join_salted(rows: DataFrame, lookup: DataFrame, key: str, hot_by: str | None = None) -> DataFrame:
    """Left join of ``rows`` to a lookup that is unique on ``key``.

    Rows without a key match nothing and are not shuffled at all. Rows of a hot key
    are spread over SALTS shuffle partitions; only the lookup rows of hot keys are
    repeated. The salt mixes in
    the map partition number, so exact copies of one row spread too, and a
    retried task salts the same way. ``hot_by`` names a column of both sides that
    stands for the key in the hot test (for keys of a nested type).
    """
    by = hot_by or key
    added = [f for f in lookup.schema if f.name not in (key, by)]
    joined = join_salted(rows.where(F.col(by).isNotNull()), lookup, key, hot_by)
    alone = rows.where(F.col(by).isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    return joined.unionByName(alone)


def join_salted(rows: DataFrame, lookup: DataFrame, key: str, hot_by: str | None = None) -> DataFrame:
    """``left_join_salted`` of rows that all have a key."""
    by = hot_by or key
    hot = hot_keys(rows, by)
    is_hot = F.col(by).isin(hot) if hot else F.lit(False)
    mixed = F.xxhash64(*[c for c in rows.columns if c not in (key, by)][:4])
    salt = F.pmod(F.spark_partition_id() + mixed, F.lit(SALTS)).cast("int")
    salted = rows.withColumn("_salt", F.when(is_hot, salt).otherwise(F.lit(0)))
    if hot:
        spread = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        lookup = lookup.withColumn("_salt", F.explode(spread))
    else:
        lookup = lookup.withColumn("_salt", F.lit(0))
    if hot_by and hot_by != key:
        lookup = lookup.drop(hot_by)
    return salted.join(lookup, [key, "_salt"], "left").drop("_salt")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key group under ``order``.

    A mergeable minimum, so a group shrinks to one row per map task before the
    shuffle; a window would sort a hot group in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return picked.select(*[f"_row.{c}" if c in rest else c for c in df.columns])


def mark_smallest_hashes(df: DataFrame, labels: list[str], hashed: str, tie: str, wanted: Column,
                         out: str, bits: int = 32, bucket_bits: int = 16) -> DataFrame:
    """Add boolean ``out``: true for exactly the ``wanted`` smallest hashes per label.

    ``hashed`` is the hash of ``tie``, which is unique per row.
    ``wanted`` is a column over the label's row count ``n``; ``labels`` must have
    few distinct values (classes). Counting hashes in 2**bucket_bits buckets finds
    the bucket where each quota ends; only its rows, about n / 2**bucket_bits, are
    ranked, and the last row taken becomes the label's cut.
    """
    bucketed = df.select(*labels, hashed, tie, F.shiftright(hashed, bits - bucket_bits).alias("_b"))
    counts = bucketed.groupBy(*labels, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.col("_upto") - F.col("_c")
    edges = (
        counts.withColumn("_upto", F.sum("_c").over(W.partitionBy(*labels).orderBy("_b")))
        .withColumn("n", F.sum("_c").over(W.partitionBy(*labels)))
        .withColumn("_want", wanted)
        .where((upto < F.col("_want")) & (F.col("_upto") >= F.col("_want")))
        .select(*labels, "_b", (F.col("_want") - upto).alias("_room"))
    )
    rank = F.row_number().over(W.partitionBy(*labels, "_b").orderBy(hashed, tie))
    cuts = (
        bucketed.join(F.broadcast(edges), [*labels, "_b"]).withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_room"))
        .select(*labels, F.struct(F.col(hashed).alias("h"), F.col(tie).alias("t")).alias("_cut")))
    marked = df.join(F.broadcast(cuts), labels, "left")
    inside = F.struct(F.col(hashed).alias("h"), F.col(tie).alias("t")) <= F.col("_cut")
    return marked.withColumn(out, F.coalesce(inside, F.lit(False))).drop("_cut")
