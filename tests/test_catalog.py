import os

import __spark_entry__
import compare
import pytest

SF_DIR = os.environ.get("ALERTLAKE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    return compare.connect(SF_DIR)


def test_library_queries_have_sql():
    from alertlake.catalog import oracles, queries

    assert sorted(queries.all_queries()) == sorted(oracles.all_oracles())


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    frame = __spark_entry__.queries()[name](spark, SF_DIR)
    assert compare.difference(frame, tables, __spark_entry__.oracle_sql()[name]) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
