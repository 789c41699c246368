"""Every registered query against its DuckDB twin on the smallest tables."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import canon  # noqa: E402
from tablecraft.session import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
KEYS = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "row_count", "data_size", "index_size", "total_size"]
    assert df.count() == 4


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(key)
    if sql is None:
        return
    res = con.execute(sql)
    sc, sr = canon(df.columns, rows)
    dc, dr = canon([d[0] for d in res.description], res.fetchall())
    assert sc == dc
    assert sr == dr
