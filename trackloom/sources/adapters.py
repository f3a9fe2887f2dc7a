"""Views of the benchmark tables as track, catalogue and request tables.

Each benchmark table is one file with one row group, which a single task must read. Its
rows are dealt by their key behind the scan, to as many partitions as there are cores or
as the session names in ``trackloom.adapters.partitions``; tables of more files than
cores are dealt by themselves. The library's readers (``io``) never do that.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.schemas import NEIGHBOURS_PER_SONG, RAW_TRACK_COLUMNS


DEALT = "trackloom.adapters.partitions"
_KEYS = {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey"]}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    parts = spark.conf.get(DEALT, None)
    if parts:
        return found.repartition(int(parts))
    cores = spark.sparkContext.defaultParallelism
    if len(found.inputFiles()) >= cores:
        return found
    # By a hash of the key, since dealing rows in turn sorts them in the task that reads them.
    return found.repartition(cores, *_KEYS.get(name, found.columns[:1]))


def dirty_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as track rows with gaps; ``row_id`` is unique and orders them."""
    # Joined by a shuffle, whatever the size of part, which deals the lines to all tasks.
    line = spark.read.parquet(f"{folder}/lineitem.parquet")
    part = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_retailprice").hint("shuffle_hash")
    col = F.col

    def unless(condition, value):
        return F.when(~condition, value)

    joined = line.join(part, col("l_partkey") == col("p_partkey"))
    return joined.select(
        unless(col("l_orderkey") % 11 == 0, col("p_brand")).alias("artist_name"),
        col("p_name").alias("track_name"),
        unless(col("l_orderkey") % 5 == 0, col("p_retailprice") * 1000).alias("duration_ms"),
        (col("l_discount") * 12).alias("valence"),
        (-col("l_extendedprice") / 5000).alias("loudness"),
        (col("l_tax") * 12.5).alias("danceability"),
        unless(col("l_orderkey") % 97 == 0, col("l_quantity") / 50).alias("energy"),
        (col("l_quantity") * 4 - 20).alias("tempo"),
        unless(col("l_partkey") % 23 == 0, (col("l_suppkey") % 101) / 100).alias("acousticness"),
        unless(col("l_partkey") % 29 == 0, (col("l_partkey") % 211) / 210).alias("instrumentalness"),
        ((col("l_orderkey") % 89) / 88).alias("liveness"),
        unless(col("l_orderkey") % 17 == 0, (col("l_orderkey") % 53) / 52).alias("speechiness"),
        F.when(col("l_returnflag") == "A", 1.0).when(col("l_returnflag") == "R", 0.0).alias("explicit"),
        unless(col("l_orderkey") % 13 == 0, (F.month("l_shipdate") - 1).cast("double")).alias("key"),
        (col("l_linenumber") % 5).cast("double").alias("time_signature"),
        unless(col("l_linenumber") == 7, col("l_partkey").cast("string")).alias("track_id"),
        unless(col("l_orderkey") % 19 == 0, (col("l_linestatus") == "F").cast("double")).alias("mode"),
        F.concat_ws(
            ":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", col("l_quantity").cast("bigint"),
            F.round(col("l_extendedprice") * 100).cast("bigint"), F.round(col("l_discount") * 100).cast("bigint"),
            F.round(col("l_tax") * 100).cast("bigint"), "l_returnflag", "l_linestatus",
            F.unix_date(col("l_shipdate").cast("date"))).alias("row_id"),
    )


def raw_tracks(spark: SparkSession, folder: str) -> DataFrame:
    return dirty_tracks(spark, folder).select(*RAW_TRACK_COLUMNS)


def catalogue_source(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("track_id"), F.col("p_name").alias("track_name"),
        F.col("p_brand").alias("artist_name"), F.col("p_type").alias("genre"))


def similar_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Five made-up neighbours per part, spread evenly over all parts."""
    part = table(spark, folder, "part")
    total = part.agg(F.count(F.lit(1))).scalar()
    return part.select(
        F.col("p_partkey").cast("string").alias("track_id"),
        *[((F.col("p_partkey") * 31 + r * 17) % total).cast("string").alias(f"sim_song_{r}")
          for r in range(1, NEIGHBOURS_PER_SONG + 1)])


def graph_input(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as graph tracks, with a few numeric features derived from the keys."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("artist"), F.col("p_type").alias("track_genre"),
        F.when(key % 10 != 0, F.col("p_size").cast("double")).alias("popularity"),
        ((key * 7919 % 1009) / 1008).alias("danceability"),
        F.when(key % 37 != 0, (key * 104729 % 997) / 996).alias("energy"),
        (60 + key * 1299709 % 1201 / 10).alias("tempo"),
        F.when(key % 41 != 0, (key * 15485863 % 991) / 990).alias("valence"),
        key.alias("ord"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
