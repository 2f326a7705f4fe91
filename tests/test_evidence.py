import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import econ as E
from loomwright.operators import metrics as M
from loomwright.operators import models as L
from loomwright.operators import panel as P
from loomwright.operators import resolve as R
from loomwright.sources import ingest as I


def test_pair_poisson_is_the_regression_with_pair_dummies(spark):
    rng = np.random.default_rng(1)
    pairs = [(float(a), float(b)) for a, b in zip(rng.poisson(4, 40), rng.poisson(3, 40))] + [(0.0, 0.0), (None, 2.0)]
    row = E.pair_poisson(spark.createDataFrame(pairs, "a double, b double"), "a", "b").first()
    live = np.array([p for p in pairs if None not in p and sum(p) > 0])
    n = len(live)
    d = np.zeros((2 * n, n + 1))
    d[np.arange(2 * n), 1 + np.arange(2 * n) // 2] = 1
    d[1::2, 0] = 1
    y, beta = live.ravel(), np.zeros(n + 1)
    for _ in range(60):
        mu = np.exp(d @ beta)
        beta += np.linalg.solve(d.T @ (mu[:, None] * d), d.T @ (y - mu))
    bread = np.linalg.inv(d.T @ (np.exp(d @ beta)[:, None] * d))
    e = d * (y - np.exp(d @ beta))[:, None]
    scores = e[0::2] + e[1::2]
    se = np.sqrt((bread @ scores.T @ scores @ bread)[0, 0] * n / (n - 1))
    assert row["n_pairs"] == n and row["coef"] == pytest.approx(beta[0], abs=1e-8) and row["se"] == pytest.approx(se, rel=1e-6)
    assert E.pair_poisson(spark.createDataFrame(pairs[:10], "a double, b double"), "a", "b").count() == 0


def test_event_effects_are_the_regression_with_dummies(spark):
    rng = np.random.default_rng(2)
    rows = [(g, 10 * g + u, int(u == 0), t, float(rng.normal(u == 0 and t) + g)) for g in range(6) for u in range(1 + g % 3 + 1) for t in range(3)]
    got = {r["rel"]: (r["effect"], r["n_groups"]) for r in E.event_effects(spark.createDataFrame(rows, "grp int, unit int, treated int, rel int, value double")).collect()}
    units = sorted({r[1] for r in rows})
    cols = [[float(r[2] and r[3] == k) for r in rows] for k in (1, 2)] + [[float(r[1] == u) for r in rows] for u in units] + [[float((r[0], r[3]) == (g, t)) for r in rows] for g in range(6) for t in (1, 2)]
    beta = np.linalg.lstsq(np.array(cols).T, np.array([r[4] for r in rows]), rcond=None)[0]
    assert got[0] == (0.0, 6) and got[1][0] == pytest.approx(beta[0], abs=1e-9) and got[2][0] == pytest.approx(beta[1], abs=1e-9)


def test_placebo_tells_an_effect_from_none(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=150), rng.integers(0, 3, 150)
    rows = [(i, int(g), float(a), float(2 * a + g + 0.1 * e), float(e)) for i, (g, a, e) in enumerate(zip(c, x, rng.normal(size=150)))]
    df = spark.createDataFrame([*rows, (999, 1, None, 1.0, 1.0)], "k int, c int, x double, y double, noise double")
    strong = E.placebo(df, "y", "x", "c", "k", draws=40, at_once=20).first()
    assert strong["n_draws"] == 40 and strong["p"] == pytest.approx(1 / 41) and strong["coef"] == pytest.approx(2, abs=0.1) and strong["high"] < 1
    none = E.placebo(df, "noise", "x", "c", "k", draws=40, at_once=40).first()
    assert none["p"] > 0.05 and none["low"] < 0 < none["high"]
    assert E.placebo(df.withColumn("x", F.lit(1.0)), "y", "x", "c", "k", draws=4).first()["coef"] is None


def test_iterations_that_do_not_converge_are_refused(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(rng.integers(0, 9, 60), rng.integers(0, 9, 60), rng.normal(size=60))], "a int, b int, v double")
    with pytest.raises(RuntimeError):
        E.demean(df, ["v"], ["a", "b"], rounds=1)
    with pytest.raises(RuntimeError):
        E.fe_poisson(df.withColumn("y", F.pmod("a", F.lit(3)).cast("double")), "y", ["v"], ["b"], rounds=1)


def test_evaluate_compare_reversals(spark):
    rng = np.random.default_rng(5)
    y = rng.poisson(5, 120)
    df = spark.createDataFrame([(i, i % 3, int(v), float(np.log1p(v)), float(e)) for i, (v, e) in enumerate(zip(y, rng.normal(size=120)))], "k int, g int, y int, good double, bad double")
    got = {r["method"]: r for r in M.evaluate(df, {"good": "good", "bad": "bad"}, y="y", group="g", key="k").collect()}
    assert got["good"]["male"] == pytest.approx(0) and got["good"]["rho_sub"] == pytest.approx(1) and got["good"]["ndcg10"] == pytest.approx(1) and got["good"]["rho_all"] == pytest.approx(1)
    assert got["bad"]["male"] > 0.5 and got["bad"]["rho_all"] < 0.5
    with pytest.raises(ValueError):
        M.evaluate(df.withColumn("good", F.when(F.col("k") > 0, F.col("good"))), {"good": "good"}, y="y", group="g", key="k")
    row = M.compare(df, {"good": "good", "bad": "bad"}, y="y", cluster="g", draws=50).first()
    assert (row["method_a"], row["method_b"]) == ("good", "bad") and row["high"] < 0
    r = spark.createDataFrame([("m1", "a", "b", 0.1, 0.2), ("m2", "a", "b", -0.4, -0.1), ("m3", "a", "b", -0.1, 0.1), ("m1", "a", "c", 0.1, 0.2)], "metric string, method_a string, method_b string, low double, high double")
    assert [tuple(x) for x in M.reversals(r).collect()] == [("a", "b", "m1", "m2")]


def test_quantiles_and_ranks_in_slices(spark):
    rng = np.random.default_rng(6)
    v, w = rng.integers(0, 40, 300).astype(float), rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, w)] + [(None, None)], "v double, w double")
    qs = [0.0, 0.013, 0.5, 0.9, 0.999, 1.0]
    for c, x in (("v", v), ("w", w)):
        assert P.exact_quantiles(df, c, qs, slices=7).first()["values"] == pytest.approx(list(np.quantile(x, qs)))
    assert P.exact_quantiles(df.limit(0), "v", qs).first()["values"] == [None] * 6
    rank = lambda x: np.array([(x < a).sum() + ((x == a).sum() + 1) / 2 for a in x])
    row = M.spearman(df, "v", "w").first()
    assert row["n"] == 300 and row["rho"] == pytest.approx(np.corrcoef(rank(v), rank(w))[0, 1])


def test_kendall_refuses_long_rankings(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_RANKED", 3)
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(4)], "i int, a double, b double")
    assert M.kendall(df.limit(3), "i", "a", "b").first()["tau"] == -1
    with pytest.raises(ValueError):
        M.kendall(df, "i", "a", "b")


def test_codes_by_frequency(spark):
    df = spark.createDataFrame([("a", True)] * 3 + [("b", True)] * 5 + [("c", True)] * 3 + [("d", True), (None, True), ("e", False)], "v string, train boolean")
    got = {r["v"]: r["v_code"] for r in L.frequent_codes(df, "v", F.col("train"), least=2).collect()}
    assert got == {"b": 1, "a": 2, "c": 3, "d": 0, "e": 0, None: 0}


def test_arxiv_identifiers(spark):
    rows = [
        ("https://doi.org/10.48550/arXiv.1905.12345v2", None, "1905.12345"), (None, ["http://x.org", "https://arxiv.org/pdf/math.GT/0309136v1.pdf"], "math.GT/0309136"),
        ("10.48550/arXiv.hep-th/9901001", None, "hep-th/9901001"), (None, ["https://arxiv.org/abs/0704.0001"], "0704.0001"), (None, ["https://arxiv.org/abs/1913.00001", None, "https://arxiv.org/abs/2101.00002v3"], "2101.00002"),
        (None, ["https://arxiv.org/abs/2101.123456789"], None), ("10.1000/arxiv.1905.12345", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, d, u) for i, (d, u, _) in enumerate(rows)], "i int, doi string, urls array<string>")
    got = {r["i"]: r["x"] for r in df.select("i", I.arxiv_id(F.col("doi"), F.col("urls")).alias("x")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(rows)}


def test_entity_files(spark, tmp_path):
    venues = [{"id": "https://x.org/S7", "display_name": "J", "host_organization": "https://x.org/P4", "counts_by_year": [{"year": 2020, "works_count": 2, "cited_by_count": 5}]}, {"id": None}]
    topics = [{"id": "https://x.org/T11", "display_name": "T", "subfield": {"id": "https://x.org/subfields/1702"}, "field": {"id": "https://x.org/fields/17"}}]
    for name, rows in (("s", venues), ("t", topics)):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)) + "\n{bad\n")
    flat, yearly = I.source_tables(I.read_json_lines(spark, str(tmp_path / "s"), I.SOURCE_SCHEMA).cache())
    assert [(r["id"], r["publisher_id"]) for r in flat.collect()] == [(7, 4)] and [tuple(r) for r in yearly.collect()] == [(7, 2020, 2, 5)]
    row = I.subject_table(I.read_json_lines(spark, str(tmp_path / "t"), I.SUBJECT_SCHEMA).cache()).first()
    assert (row["id"], row["subfield_id"], row["field_id"], row["domain_id"]) == (11, 1702, 17, None)


def test_venue_classes(spark):
    df = spark.createDataFrame([(v,) for v in ("Journal of X", "arXiv (Cornell)", "Y eBooks", "book series", "preprint_other", "Z", None)], "v string")
    assert [r["kind"] for r in R.venue_classes(df, "v").collect()] == ["journal", "arxiv", "ebook", "book series", "repository", "none", "none"]


def test_poisson_with_one_effect_keeps_no_state_between_rounds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    g, c, v = rng.integers(0, 6, 240), rng.integers(0, 12, 240), rng.integers(0, 5, 240).astype(float)
    y = rng.poisson(np.exp(0.4 * v + 0.2 * g)) * (g > 0)
    df = spark.createDataFrame([(int(a), int(b), float(t), float(t > 9), float(n)) for a, b, t, n in zip(g, c, v, y)] + [(1, 1, None, 0.0, 3.0)], "g int, c int, v double, flat double, y double")
    made = []
    monkeypatch.setattr(E, "materialise", lambda d, f=E.materialise: made.append(d) or f(d))
    got = {r["term"]: (r["coef"], r["se"]) for r in E.fe_poisson(df, "y", ["v", "flat"], ["g"], "c").collect()}
    assert len(made) == 2  # the rows, and their sums
    live = g > 0
    d = np.column_stack([v[live], *[(g[live] == k).astype(float) for k in range(1, 6)]])
    beta = np.zeros(6)
    beta[1:] = 1
    for _ in range(60):
        mu = np.exp(d @ beta)
        beta += np.linalg.solve(d.T @ (mu[:, None] * d), d.T @ (y[live] - mu))
    bread, e = np.linalg.inv(d.T @ (np.exp(d @ beta)[:, None] * d)), d * (y[live] - np.exp(d @ beta))[:, None]
    scores = np.array([e[c[live] == k].sum(0) for k in np.unique(c[live])])
    se = np.sqrt((bread @ scores.T @ scores @ bread)[0, 0] * len(scores) / (len(scores) - 1))
    assert got["v"][0] == pytest.approx(beta[0], abs=1e-7) and got["v"][1] == pytest.approx(se, rel=1e-6) and got["flat"] == (0.0, 0.0)
    assert E.fe_poisson(df.withColumn("y", F.lit(0.0)), "y", ["v"], ["g"], "c").count() == 0
