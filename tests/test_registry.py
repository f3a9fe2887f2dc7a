"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from checks import REGISTRY
from checks.compare import differences, oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_query_matches_sql(spark, name):
    query, sql = REGISTRY[name]
    assert differences(query(spark, FOLDER).toPandas(), oracle(FOLDER, sql)) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
