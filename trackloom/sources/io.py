"""Reading and writing of track, catalogue and report tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from trackloom.operators import clean
from trackloom.schemas import CATALOGUE_SOURCE, SEED, SIMILAR_WIDE, SONG_NEIGHBOURS, SONGS

FORMATS = ["parquet", "csv", "json", "orc"]


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """Scan with an explicit column list. CSV has a header and, without a schema,
    string columns: types are never guessed from a second pass over the data.
    A quoted CSV field may hold line breaks, so one CSV file is one split: write
    large tables as many files."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {FORMATS}")
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False).option("escape", '"').option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.format(fmt).load(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"{fmt} path does not exist: {path}") from problem
        raise RuntimeError(f"Failed to load dataset from {path}: {problem}") from problem
    return df.select(*columns) if columns else df


def load_tracks(spark: SparkSession, path: str | None = None, fmt: str = "csv", table: str | None = None,
                load_limit: int | None = None, key: str | None = None) -> DataFrame:
    """Graph input from a file, else from a named table, of which a seeded sample
    of ``load_limit`` rows is taken (by ``key``, or by all columns)."""
    if path:
        return clean.normalise_schema(read_table(spark, path, fmt))
    if not table:
        raise ValueError("either path or table must be given")
    df = spark.table(table)
    if load_limit:
        by = F.col(key) if key else F.to_json(F.struct(*df.columns))
        df = clean.seeded_sample(df, by, load_limit, SEED)
    return clean.normalise_schema(df)


def read_catalogue_source(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, columns=CATALOGUE_SOURCE.fieldNames())


def read_similar_wide(spark: SparkSession, path: str) -> DataFrame:
    """All strings, only the id and the five neighbour columns."""
    return read_table(spark, path, "csv", columns=SIMILAR_WIDE.fieldNames())


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """A report is already aggregated to a few rows, so one file holds it."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_csv_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_graph(nodes: DataFrame, links: DataFrame, meta: DataFrame, path: str, fmt: str = "parquet") -> None:
    """nodes/, links/ and meta/ below ``path``, each written by its own tasks."""
    for name, df in (("nodes", nodes), ("links", links), ("meta", meta)):
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


# A catalogue copy is <root>/<stage|runtime>/<version>/{songs,neighbours} plus a
# manifest of versions. A version counts once its manifest row is committed, so a
# reader never sees one table of a new load with the other of an old one.

def _copy_root(root: str, stage: bool) -> str:
    return f"{root}/{'stage' if stage else 'runtime'}"


def write_catalogue(songs: DataFrame, edges: DataFrame, root: str, stage: bool = True,
                    engine: str = "parquet") -> str:
    """Replace a copy. ``engine`` "bulk" writes CSV with empty fields for null.
    Edges are clustered by source so that lookups by source skip row groups."""
    version = uuid.uuid4().hex
    base = f"{_copy_root(root, stage)}/{version}"
    ordered = edges.repartitionByRange("source_song_id", "neighbor_rank").sortWithinPartitions(
        "source_song_id", "neighbor_rank")
    for name, df in (("songs", songs), ("neighbours", ordered)):
        if engine == "bulk":
            df.write.option("header", True).option("nullValue", "").option("escape", '"').csv(f"{base}/{name}")
        elif engine == "parquet":
            df.write.parquet(f"{base}/{name}")
        else:
            raise ValueError(f"unknown engine {engine!r}, expected 'parquet' or 'bulk'")
    spark = songs.sparkSession
    entry = spark.range(1).select(F.lit(version).alias("version"), F.lit(engine).alias("engine"),
                                  F.current_timestamp().alias("loaded_at"))
    entry.write.mode("append").parquet(f"{_copy_root(root, stage)}/manifest")
    return version


def catalogue(spark: SparkSession, root: str, stage: bool = False) -> tuple[DataFrame, DataFrame]:
    """(songs, neighbours) of the newest committed version of a copy."""
    base = _copy_root(root, stage)
    newest = spark.read.parquet(f"{base}/manifest").orderBy(F.desc("loaded_at"), "version").first()
    fmt = "csv" if newest["engine"] == "bulk" else "parquet"
    return tuple(
        read_table(spark, f"{base}/{newest['version']}/{name}", fmt, schema)
        for name, schema in (("songs", SONGS), ("neighbours", SONG_NEIGHBOURS)))
