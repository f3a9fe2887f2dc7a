"""Jobs of several stages that go on from the last finished one."""

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.session import Scope

_MANIFEST = "place int, name string, version string"


def committed(spark: SparkSession, folder: str) -> dict[int, tuple[str, str]]:
    """place -> (stage name, version) of the finished stages below ``folder``. Of a
    stage that was committed twice (two runs at once) the least version counts."""
    try:
        found = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException:
        return {}
    rows = found.groupBy("place").agg(F.min(F.struct("version", "name")).alias("x")).collect()  # one row per stage
    return {r["place"]: (r["x"]["name"], r["x"]["version"]) for r in rows}


def run_stages(spark: SparkSession, source: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]],
               folder: str) -> DataFrame:
    """The table that the last of ``stages`` (name, function) leaves.

    Each stage writes its table below ``folder`` and then, as its commit, one row of
    the manifest. A run that was stopped is resumed by running it again: stages that
    are committed, up to the first that is not or has another name, are read instead
    of run; what an unfinished stage had written is never read. Tables that a stage
    wrote to cut lineage are deleted when it is committed or fails.
    """
    done, current, going = committed(spark, folder), source, True
    for place, (name, stage) in enumerate(stages):
        going = going and done.get(place, ("", ""))[0] == name
        if going:
            current = spark.read.parquet(f"{folder}/{name}-{done[place][1]}")
            continue
        if place in done:
            raise ValueError(f"stage {place} of {folder} is {done[place][0]!r}, not {name!r}: take another folder")
        version = uuid.uuid4().hex
        with Scope(spark):
            stage(current).write.parquet(f"{folder}/{name}-{version}")
        spark.createDataFrame([(place, name, version)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
        current = spark.read.parquet(f"{folder}/{name}-{version}")
    return current
