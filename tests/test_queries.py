"""Every registered query against its SQL on the smallest tables; queries without SQL must run."""

import pytest

from skygrain.plans import analysis, dealt, modelling, records, streams
from tests.compare import connect, differences

MODULES = (dealt, records, analysis, modelling, streams)
SQL = {n: (m.QUERIES[n], q) for m in MODULES for n, q in m.SQL.items()}
REST = {n: f for m in MODULES for n, f in m.QUERIES.items() if n not in m.SQL}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, con, name):
    f, sql = SQL[name]
    assert differences(f(spark, sf_dir), con, sql) == []


@pytest.mark.parametrize("name", sorted(REST))
def test_runs(spark, sf_dir, name):
    df = REST[name](spark, sf_dir)
    assert len(df.columns) == len(set(df.columns))
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
