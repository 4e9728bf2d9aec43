"""Registered corpus queries against their SQL, and the pipeline against its parts, at the smallest scale."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from ledgerloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return c


def _plain(v):
    """Nulls as None whatever the frame holds them as, numbers as floats."""
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return None
    return round(float(v), 6) if isinstance(v, numbers.Real) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, duck, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.sql(Q.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(str([_plain(v) for v in r]) for r in f[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_pipeline(spark):
    import corpus_pipeline as P
    from ledgerloom.llm import lines, minhash, mixing, quality
    from ledgerloom.llm.common import table

    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs
    for name, stage in P.STAGES[:4]:
        after = stage(spark, before, SF)
        assert after.columns == columns, name
        after = spark.createDataFrame(after.toPandas(), docs.schema)
        was, now = {r["doc_id"]: r for r in before.collect()}, after.collect()
        if name == "quality":
            scores = quality.score(before, quality.train(before, table(spark, SF, "labels")))
            assert sorted(r["doc_id"] for r in now) == sorted(r["doc_id"] for r in scores.where("predicted = 1").collect())
        elif name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in now} == {r["doc_id"]: r["text"] for r in lines.dedup_lines(before).collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in now)
        elif name == "near_duplicates":
            assert sorted(r["doc_id"] for r in now) == sorted(r["doc_id"] for r in minhash.near_duplicates(before).where("kept").collect())
        else:
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]}
            assert {d: sum(r["doc_id"] == d for r in now) for d in want} == want and len(now) == sum(want.values())
        assert {r["doc_id"] for r in now} <= set(was)
        before = after
    packed = P.STAGES[4][1](spark, before, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in before.collect()}
