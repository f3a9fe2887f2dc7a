"""Tables that grow with the input are dealt to tasks and never broadcast."""

import pytest
from pyspark.sql import functions as F

from checks import REGISTRY
from trackloom.sources import adapters

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["seed_song_nodes", "seed_song_meta", "expand_meta", "merged_sessions"])
def test_requests_and_catalogue_are_not_broadcast(spark, name):
    plan = REGISTRY[name][0](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_rows_of_one_file_are_dealt_to_several_tasks(spark):
    rows = adapters.table(spark, FOLDER, "lineitem").withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() > 1


def test_order_lines_are_dealt_by_the_join_with_parts(spark):
    plan = adapters.dirty_tracks(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
