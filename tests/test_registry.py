"""Each registered query against its SQL twin, on whole generated tables."""

import pytest

from tests.oracle import compare
from wordloom import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], FOLDER)


def test_entry_names():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
