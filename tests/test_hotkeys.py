import pytest

from loomwright.operators.hotkeys import distinct_per_key, heavy_keys

ROWS = [("hot", 1, i) for i in range(60)] * 2 + [("cold", 1, 1), ("cold", None, 1), (None, 1, 5), ("cold", 1, None)] + [(f"k{i}", 2, i) for i in range(38)]


def test_distinct_per_key(spark):
    df = spark.createDataFrame(ROWS, "k string, y int, p int")
    got = {(r["k"], r["y"]): r["n"] for r in distinct_per_key(df, ["k", "y"], "p").collect()}
    assert got["hot", 1] == 60 and got["cold", 1] == 1 and got["cold", None] == 1 and got[None, 1] == 1
    assert distinct_per_key(df.limit(0), ["k"], "p").count() == 0


def test_heavy_keys_counts_exact_share(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), (None, 7), ("c", None)], "k string, p int")
    # distinct pairs with a key: a1 a2 b1 c-null = 4
    assert {r["k"]: r["n"] for r in heavy_keys(df, "k", "p", 0.5).collect()} == {"a": 2}
    assert {r["k"] for r in heavy_keys(df, "k", "p", 0.25).collect()} == {"a", "b", "c"}
    assert heavy_keys(df.limit(0), "k", "p", 0.5).count() == 0
    with pytest.raises(ValueError):
        heavy_keys(df, "k", "p", 0)
