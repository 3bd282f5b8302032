"""A part of the registered queries against DuckDB on the smallest tables (tools/check_oracle.py runs all)."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
KEYS = ["prf_03", "val_10", "ftr_09", "imp_05", "fea_10", "rel_12", "spl_02", "met_03", "drf_09", "sta_04", "led_09", "dom_06", "dom_35", "dom_45", "ret_09", "knt_02", "rul_09", "str_03"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    import duckdb

    from tools.check_oracle import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, con, key):
    import __spark_entry__ as entry
    from tools.check_oracle import rows_of

    df = entry.queries()[key](spark, DATA)
    rel = con.execute(entry.oracle_sql()[key])
    want, wc = rows_of([d[0] for d in rel.description], rel.fetchall())
    got, gc = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert gc == wc
    assert got == want


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
