"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from larkgrid.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    cols = sorted(df.columns)
    mine = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str)
    theirs = sorted([tuple(plain(dict(zip(found.columns, r))[c]) for c in cols) for r in found.fetchall()], key=str)
    assert mine == theirs


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and registry.FLAGSHIP in entry.queries()
