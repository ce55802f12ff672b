"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from cueforge.plans.suite import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    return list(df.columns), sorted(repr(tuple(map(plain, r))) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(TABLES):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{TABLES}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = rows(QUERIES[name](spark, TABLES).toPandas()), rows(duck.execute(ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_frames_of_long_part_keys(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"copy (select 100 + k as l_suppkey, k * 12345 as l_partkey, k % 7 as l_linenumber, 1.0 + k % 5 as l_quantity from range(1, 200) t(k)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got, want = rows(QUERIES["g6_sort_frames"](spark, str(tmp_path)).toPandas()), rows(c.execute(ORACLES["g6_sort_frames"]).df())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["track_id", "pos", "begin_ms", "end_ms", "text", "match"]
    assert set(e.oracle_sql()) <= set(e.queries())
