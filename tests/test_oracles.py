"""Every registered query with SQL gives the rows the SQL gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def tidy(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == bool:
            frame[c] = frame[c].astype(int)
        if frame[c].dtype.kind in "iuf":
            frame[c] = frame[c].astype(float).fillna(-9.99e99)
        else:
            frame[c] = frame[c].map(lambda x: "<null>" if x is None or x != x else str(x))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    got, want = tidy(got), tidy(want)
    for c in got.columns:
        differs = got[c] != want[c]
        assert not differs.any(), f"{c}: {got[differs].head(3)} against {want[differs].head(3)}"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
