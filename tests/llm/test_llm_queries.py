import pytest
from compare import connection, same_rows

from corpusloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small_dir, name):
    df = queries.QUERIES[name](spark, small_dir)
    if name in queries.SQL:
        same_rows(df, connection(small_dir), queries.SQL[name])
    else:
        assert df.count() > 0
