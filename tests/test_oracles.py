"""Every query with SQL gives what DuckDB gives on the smallest tables; the others return rows."""

import math
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

from orrery.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "-"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return str(int(x)) if math.isfinite(x) and x == int(x) else repr(float(x))
    return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x)


def rows(frame):
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    sys.path.insert(0, ".")
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 24
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
