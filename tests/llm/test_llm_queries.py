import duckdb
import pytest

from loomwright.llm.queries import LLM

SMALL = sorted(LLM.queries)


@pytest.mark.parametrize("name", SMALL)
def test_query_on_smallest_tables(spark, data, name):
    rows = LLM.queries[name](spark, data).collect()
    assert isinstance(rows, list)
    if name not in LLM.sql:
        return
    con = duckdb.connect()
    import os

    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{data}/{f}')")
    want = con.execute(LLM.sql[name])
    cols = [c[0] for c in want.description]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(key([r[c] for c in cols]) for r in rows) == sorted(map(key, want.fetchall()))
