"""Every core query on the smallest tables, against its SQL where it has one."""

import math
import os

import duckdb
import pytest

from loomwright.plans import load_core

CORE = load_core()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{data}/{f}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "None" if isinstance(v, float) and math.isnan(v) else f"{float(v):.5f}".replace("-0.00000", "0.00000")
    return str(v)


@pytest.mark.parametrize("name", sorted(CORE.queries))
def test_query(spark, data, sql, name):
    if name in ("fe_poisson", "macro_poisson"):
        pytest.skip("the operator has its own test on a small frame")
    df = CORE.queries[name](spark, data)
    rows = df.collect()
    if name not in CORE.sql:
        assert df.columns
        return
    want = sql.execute(CORE.sql[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_registry_names_are_unique_and_sql_has_queries():
    assert set(CORE.sql) <= set(CORE.queries)
