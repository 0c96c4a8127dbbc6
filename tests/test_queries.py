import pytest
from compare import connection, same_rows

from corpusloom.plans import core_queries


@pytest.mark.parametrize("name", sorted(core_queries.QUERIES))
def test_query(spark, small_dir, name):
    df = core_queries.QUERIES[name](spark, small_dir)
    if name in core_queries.SQL:
        same_rows(df, connection(small_dir), core_queries.SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark, small_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
