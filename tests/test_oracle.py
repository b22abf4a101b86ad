"""Every registered query of the library against its SQL."""

import pytest

from tables import SF
from reelquery import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, same_as_sql, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        same_as_sql(df, catalog.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
