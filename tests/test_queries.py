"""Every registered query runs; every oracle belongs to a query."""

import __spark_entry__ as entry


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 180 and len(oracles) > 160


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "npvi" in df.columns
