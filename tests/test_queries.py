"""Every query of the library against its SQL, or at least its rows."""

import pytest

from corpusloom.catalogue import ORACLE_SQL, QUERIES

from .oracle import DATA, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE_SQL:
        same(df, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
