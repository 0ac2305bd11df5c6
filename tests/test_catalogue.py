"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest
from compare import connection, differences

from corpusmill.plans import ENTRIES


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, sf_dir, name):
    entry = ENTRIES[name]
    df = entry.query(spark, sf_dir)
    if entry.sql is None:
        assert df.count() > 0
    else:
        assert differences(df, connection(sf_dir).sql(entry.sql)) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
