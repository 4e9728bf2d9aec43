"""Every registered reconciliation query against its SQL, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(frame, columns):
    plain = lambda v: None if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, duck, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.sql(Q.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
