import math
import random

from loomwright.llm.survivors import truth_discovery

SCHEMA = "entity int, field string, value string, source string"


def test_learns_reliability(spark):
    # good sources agree with each other on many entities; two bad ones agree on a lie about entity 0
    claims = [(e, "f", f"v{e}", s) for e in range(1, 30) for s in ("a", "b")] + [(e, "f", f"w{e}{s}", s) for e in range(1, 30) for s in ("x", "y", "z")]
    claims += [(0, "f", "true", "a"), (0, "f", "lie", "x"), (0, "f", "lie", "y"), (0, "f", None, "a"), (None, "f", "q", "a"), (0, "f", "true", "a")]
    t = truth_discovery(spark.createDataFrame(claims, SCHEMA))
    got = {(r["entity"], r["field"]): r["value"] for r in t.chosen.collect()}
    assert t.converged and got[0, "f"] == "true" and all(got[e, "f"] == f"v{e}" for e in range(1, 30))
    w = {r["source"]: r["weight"] for r in t.weights.collect()}
    assert min(w["a"], w["b"]) > max(w["x"], w["y"], w["z"])


def test_ties_null_source_empty(spark):
    df = spark.createDataFrame([(1, "f", "b", None), (1, "f", "a", "s")], SCHEMA)
    t = truth_discovery(df)
    assert [r["value"] for r in t.chosen.collect()] == ["a"]
    assert {r["source"] for r in t.weights.collect()} == {None, "s"}
    t = truth_discovery(df.limit(0))
    assert t.chosen.count() == 0 and t.weights.count() == 0 and t.converged


def test_recency_and_numbers_settle_ties(spark):
    rows = [(1, "n", "10", "a", 10.0, 5), (1, "n", "9", "b", 9.0, 5), (2, "n", "10", "c", 10.0, 7), (2, "n", "9", "d", 9.0, 6), (3, "n", "10", "e", None, None), (3, "n", "9", "f", None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", number double, recency bigint")
    assert {r["entity"]: r["value"] for r in truth_discovery(df).chosen.collect()} == {1: "9", 2: "10", 3: "10"}


def test_declared_trust_comes_first(spark):
    rows = [(1, "f", "many", s, [1]) for s in "abcd"] + [(1, "f", "trusted", "e", [0]), (1, "f", "unknown", "g", None), (2, "f", "y", "a", [3, 2]), (2, "f", "z", "a", [3, 1]), (3, "f", "only", "a", None)]
    df = spark.createDataFrame(rows, SCHEMA + ", trust array<bigint>")
    assert {r["entity"]: r["value"] for r in truth_discovery(df).chosen.collect()} == {1: "trusted", 2: "z", 3: "only"}


def test_values_near_one_another_support_each_other(spark):
    rows = [(1, "d", str(x), s, float(x)) for s, x in zip("abcde", (100, 101, 99, 500, 500))]
    df = spark.createDataFrame(rows, SCHEMA + ", number double")
    near = {r["value"]: r["support"] for r in truth_discovery(df, widths={"d": 5.0}).chosen.collect()}
    assert set(near) <= {"99", "100", "101"}
    assert {r["value"] for r in truth_discovery(df).chosen.collect()} == {"500"}


def test_planted_truth_is_found(spark):
    rng = random.Random(4)
    skill = {f"s{i}": {"kind": p, "count": q} for i, (p, q) in enumerate([(0.95, 0.4), (0.9, 0.9), (0.5, 0.95), (0.45, 0.9), (0.4, 0.3), (0.9, 0.35), (0.35, 0.4)])}
    rows, truth = [], {}
    for e in range(400):
        truth[e, "kind"], truth[e, "count"] = rng.choice("ABCDE"), rng.randint(100, 5_000)
        for s in rng.sample(sorted(skill), 5):
            kind = truth[e, "kind"] if rng.random() < skill[s]["kind"] else rng.choice("ABCDE")
            n = round(truth[e, "count"] * rng.uniform(0.98, 1.02)) if rng.random() < skill[s]["count"] else rng.randint(100, 5_000)
            rows += [(e, "kind", kind, s, None), (e, "count", str(n), s, math.log(n))]
    t = truth_discovery(spark.createDataFrame(rows, SCHEMA + ", number double"), widths={"count": 0.05})
    got = {(r["entity"], r["field"]): r["value"] for r in t.chosen.collect()}
    kinds = sum(got[e, "kind"] == truth[e, "kind"] for e in range(400)) / 400
    counts = sum(abs(int(got[e, "count"]) / truth[e, "count"] - 1) < 0.05 for e in range(400)) / 400
    assert t.converged and kinds >= 0.9 and counts >= 0.9
    w = {(r["source"], r["field"]): r["weight"] for r in t.weights.collect()}
    assert w["s0", "kind"] > w["s2", "kind"] and w["s2", "count"] > w["s0", "count"]


def test_giant_group_and_clashing_names(spark):
    rows = [(1, "f", f"v{i % 50}", f"s{i % 7}", 9) for i in range(5_000)] + [(2, "f", "x", "s1", 9)]
    df = spark.createDataFrame(rows, SCHEMA + ", weight int").withColumnRenamed("weight", "n_values")
    assert truth_discovery(df).chosen.count() == 2
