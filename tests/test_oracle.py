"""Every registered query with SQL equals DuckDB on the driver's tables."""

import pytest

import __spark_entry__ as E
from oracle_compare import canon, duck

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    res = con.execute(SQL[name])
    sc, sv = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    dc, dv = canon([d[0] for d in res.description], res.fetchall())
    assert sc == dc
    assert len(sv) == len(dv)
    assert sv == dv


def test_every_query_registered_with_callable():
    q = E.queries()
    assert set(SQL) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "recall_or_specificity" in df.columns
