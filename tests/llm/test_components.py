import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomwright.llm.components import connected_components, forest_roots

import numpy as np


def groups(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        for x in (a, b):
            parent.setdefault(x, x)
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def run(spark, edges, **kw):
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "a bigint, b bigint, comp string")
    return {r["member_id"]: r["comp"] for r in connected_components(df, **kw).collect()}


def test_dirt_and_empty(spark):
    edges = [(1, 2), (2, 1), (2, 3), (2, 3), (4, 4), (None, 5), (6, None), (-7, 9)]
    assert run(spark, edges) == groups(edges) == {1: 1, 2: 1, 3: 1, -7: -7, 9: -7}
    assert run(spark, []) == {}


def test_hierarchy_with_bounded_tasks(spark):
    rng = random.Random(3)
    star = [(1, i) for i in range(2, 400)]
    path = [(1000 + i, 1001 + i) for i in range(300)]
    noise = [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(150)]
    edges = star + path + noise
    assert run(spark, edges, task_edges=100) == groups(edges)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=60), st.integers(0, 3))
def test_forest_roots_agree_with_union_find(edges, salt):
    a, b = (np.array(x, np.int64) for x in zip(*edges))
    v, r = forest_roots(a, b, salt)
    want = groups([*edges, *[(x, x) for x in ()]])
    root = dict(zip(v.tolist(), r.tolist()))
    for x in want:
        for y in want:
            assert (root[x] == root[y]) == (want[x] == want[y])
    if not salt:
        assert all(root[x] == want[x] for x in want)
