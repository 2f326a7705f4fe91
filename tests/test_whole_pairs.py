"""Pair queries that leave no vector and no shared reference out."""

import numpy as np
import pytest

from loomwright.operators import graph as G
from loomwright.operators import vector as X
from loomwright.plans import load_core

CORE = load_core()


def test_shared_references_below_the_coupling_limits(spark):
    refs = [(1, 10), (1, 11), (2, 10), (2, 12), (3, 10), (3, 10), (None, 10), (4, None)]
    refs = spark.createDataFrame(refs, "p bigint, r bigint")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 5)], "a bigint, b bigint")
    got = {(r["a"], r["b"]): (r["shared"], r["jaccard"]) for r in G.shared_references(pairs, refs, a="a", b="b", paper="p", ref="r").collect()}
    assert got == {(1, 2): (1, 1 / 3), (1, 3): (1, 0.5), (1, 4): (0, 0.0), (4, 5): (0, None)}


def test_pair_table_all_relates_every_pair(spark, data):
    whole = {(r["a"], r["b"]): r for r in CORE.queries["pair_table_all"](spark, data).collect()}
    cut = {(r["a"], r["b"]): r for r in CORE.queries["pair_table"](spark, data).collect()}
    assert set(cut) <= set(whole) and len(whole) > len(cut)
    assert any(r["shared"] and not r["by_coupling"] for r in whole.values())
    assert any(r["sim"] is not None and not r["by_vector"] for r in whole.values())
    assert all(r["is_strict"] == (not r["a_cites_b"] and not r["b_cites_a"]) for r in whole.values())


def test_percentiles_of_all_pairs_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4)).astype(np.float32)
    label = [None if i % 9 == 0 else i % 3 for i in range(90)]
    df = spark.createDataFrame([(i, [float(a) for a in v], t) for i, (v, t) in enumerate(zip(x, label))], "r bigint, e array<float>, t int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    same = np.array([[a is not None and a == b for b in label] for a in label])
    apart = ~np.eye(90, dtype=bool)
    qs = [0.0, 0.5, 0.9, 0.999, 1.0]
    got = {r["same"]: r for r in X.pair_percentiles(df, key="r", emb="e", dim=4, label="t", quantiles=qs, block=20).collect()}
    for k in (True, False):
        own = s[apart & (same == k)]
        assert got[k]["n"] == len(own)
        assert np.allclose(got[k]["values"], np.quantile(own, qs), atol=1.1e-9)
    assert X.pair_percentiles(df.limit(0), key="r", emb="e", dim=4, label="t", quantiles=qs).count() == 0


def test_percentiles_count_every_vector(spark, data):
    whole, asked = ({r["same_topic"]: r["n"] for r in CORE.queries[k](spark, data).collect()} for k in ("similarity_percentiles_all", "similarity_percentiles"))
    assert sum(whole.values()) > sum(asked.values())


def test_percentiles_of_asked_rows_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)).astype(np.float32)
    label = [None if i % 9 == 0 else i % 3 for i in range(90)]
    df = spark.createDataFrame([(i, [float(a) for a in v], t) for i, (v, t) in enumerate(zip(x, label))], "r bigint, e array<float>, t int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    same = np.array([[a is not None and a == b for b in label] for a in label])
    counts = ~np.eye(90, dtype=bool) & (np.arange(90) % 2 == 0)[:, None]
    qs = [0.0, 0.5, 0.9, 0.999, 1.0]
    got = {r["same"]: r for r in X.pair_percentiles(df, key="r", emb="e", dim=4, label="t", quantiles=qs, block=20, asks=df["r"] % 2 == 0).collect()}
    for k in (True, False):
        own = s[counts & (same == k)]
        assert got[k]["n"] == len(own)
        assert np.allclose(got[k]["values"], np.quantile(own, qs), atol=1.1e-9)
    assert X.pair_percentiles(df, key="r", emb="e", dim=4, label="t", quantiles=qs, asks=df["r"] < 0).count() == 0


def test_blocks_in_turns_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 20)
    monkeypatch.setattr(X, "ROWS_A_TURN", 100)
    monkeypatch.setattr(X, "COPIES", 2)
    made = []
    monkeypatch.setattr(X, "materialise", lambda d, f=X.materialise: made.append(d) or f(d))
    x = np.random.default_rng(4).normal(size=(120, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v], 2000 + i % 3) for i, v in enumerate(x)], "r bigint, e array<float>, y int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {(i, j) for i in range(120) for j in range(120) if i != j and s[i, j] >= 0.5 and 0 <= j % 3 - i % 3 <= 1}
    got = [(r["q"], r["m"]) for r in X.block_pairs(df, df, key="r", emb="e", dim=4, least=0.5, year="y", ahead=1).collect()]
    assert len(got) == len(want) and set(got) == want
    assert len(made) > 3  # the vectors once, and every turn


def test_similarity_percentiles_meet_all_vectors(spark, data):
    from loomwright.plans.similarity import _dated

    n = _dated(spark, data).count()
    got = CORE.queries["similarity_percentiles"](spark, data).collect()
    assert n > 50 and sum(r["n"] for r in got) == n * (n - 1)
    assert "a.r %" not in CORE.sql["similarity_percentiles"]


@pytest.mark.parametrize("asks", [False, True])
def test_percentiles_in_turns_pieces_and_tiles(spark, monkeypatch, asks):
    for name, value in (("PIECE", 7), ("TILE", (8, 16)), ("ROWS_A_TURN", 100), ("COPIES", 2)):
        monkeypatch.setattr(X, name, value)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 4)).astype(np.float32) * rng.choice([1e-3, 1, 1e3], size=(150, 1)).astype(np.float32)
    x[100:130] = x[:30]  # copies
    x[130:] = x[0]
    label = [None if i % 7 == 0 else i % 3 for i in range(150)]
    df = spark.createDataFrame([(i, [float(a) for a in v], t) for i, (v, t) in enumerate(zip(x, label))], "r bigint, e array<float>, t int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    same = np.array([[a is not None and a == b for b in label] for a in label])
    counts = ~np.eye(150, dtype=bool) & ((np.arange(150) % 2 == 0) | (not asks))[:, None]
    qs = [0.0, 0.1, 0.5, 0.9, 0.97, 0.999, 1.0]
    got = {r["same"]: r for r in X.pair_percentiles(df, key="r", emb="e", dim=4, label="t", quantiles=qs, block=40, step=20_000, asks=df["r"] % 2 == 0 if asks else None).collect()}
    for k in (True, False):
        own = s[counts & (same == k)]
        assert got[k]["n"] == len(own)
        assert np.allclose(got[k]["values"], np.quantile(own, qs), atol=1.1e-9)


@pytest.mark.parametrize("label", [1, None])
def test_percentiles_where_all_labels_are_one_or_none(spark, label):
    x = np.random.default_rng(6).normal(size=(40, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v], label) for i, v in enumerate(x)], "r bigint, e array<float>, t int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    own = np.round(u @ u.T, 9)[~np.eye(40, dtype=bool)]
    (got,) = X.pair_percentiles(df, key="r", emb="e", dim=4, label="t", quantiles=[0.0, 0.5, 1.0]).collect()
    assert got["same"] == (label is not None) and got["n"] == len(own)
    assert np.allclose(got["values"], np.quantile(own, [0.0, 0.5, 1.0]), atol=1.1e-9)
