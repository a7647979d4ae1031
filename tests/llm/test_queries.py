"""Queries of the training-data operators: against their SQL where there is one, else they must run."""

import pytest

from skygrain.llm import queries
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.SQL:
        assert differences(df, con, queries.SQL[name]) == []
    else:
        assert len(df.columns) == len(set(df.columns))
        df.write.format("noop").mode("overwrite").save()


def test_registered():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
