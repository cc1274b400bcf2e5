"""Every query with oracle SQL matches DuckDB at sf0.001 (row count, column
names, order-insensitive values)."""
import pytest

import __spark_entry__ as E
from quillmask.plans.oracle import ORACLE
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
SQL = ORACLE


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(rows, df.columns)[0] == digest(drows, dcols)[0]


def test_every_query_runs_and_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(SQL) <= set(E.oracle_sql()) <= set(E.queries())
