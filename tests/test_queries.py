"""Every registered core query equals its SQL on the smallest tables."""

import pytest

from lectern.plans import archive_queries, problems, table_queries, text_queries
from tests.oracle import differences

FOLDER = "/root/testdata/sf0.001"
MODULES = (problems, archive_queries, text_queries, table_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], FOLDER) == ([], [])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
