"""Every query of the engine against its SQL in DuckDB."""

import pytest

from gridwise import catalogue

from .comparing import oracle, rows

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), oracle(sf_dir, SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
