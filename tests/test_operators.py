import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import columns as C
from loomwright.operators import econ as E
from loomwright.operators import graph as G
from loomwright.operators import metrics as M
from loomwright.operators import models as L
from loomwright.operators import panel as P
from loomwright.operators import resolve as R
from loomwright.operators import vector as X
from loomwright.sources import ingest as I
from loomwright.streaming import panels as S


def test_array_helpers_with_nulls(spark):
    df = spark.createDataFrame([([1, None, 1], [None, 2]), (None, [1]), ([], []), ([1, 2], [2, 3])], "a array<int>, b array<int>")
    got = [tuple(r) for r in df.select(C.shared("a", "b"), C.overlap("a", "b"), F.round(C.jaccard("a", "b"), 3)).collect()]
    assert got == [(0, False, 0.0), (0, False, 0.0), (0, False, 0.0), (1, True, 0.333)]


def test_dates_and_ids(spark):
    df = spark.createDataFrame([("2020-02-30",), ("2020-02-29",), ("2020-00-00",), ("2020",), (None,), ("0000-01-01",)], "d string")
    assert [str(r[0]) for r in df.select(C.full_date("d")).collect()] == ["None", "2020-02-29", "None", "None", "None", "None"]
    ids = spark.createDataFrame([("https://x/W123",), ("https://x/subfields/1702",), ("55",), ("abc",), (None,)], "u string")
    assert [r[0] for r in ids.select(C.tail_id("u")).collect()] == [123, 1702, 55, None, None]


def test_panel_targets_and_cumulative(spark):
    panel = spark.createDataFrame([(1, 2018, 2), (1, 2017, 5), (1, 2020, 1), (1, 2021, 7), (2, 2010, 3)], "id int, year int, cites int")
    ent = spark.createDataFrame([(1, 2017), (2, 2017), (3, None)], "id int, start int")
    got = {r["id"]: tuple(r)[2:] for r in P.yearly_targets(ent, panel, "id", "start").collect()}
    assert got == {1: (5, 2, 0, 1, 3), 2: (0, 0, 0, 0, 0), 3: (0, 0, 0, 0, 0)}
    cum = {(r["id"], r["as_of"]): r["cum"] for r in P.cumulative_as_of(panel, "id", 2017, 2019).collect()}
    assert cum == {(1, 2017): 5, (1, 2018): 7, (1, 2019): 7, (2, 2017): 3, (2, 2018): 3, (2, 2019): 3}


def test_global_rank_equals_sort(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 101) for i in range(500)], "k int, v int")
    got = {r["k"]: r["rn"] for r in P.global_rank(df, ["v", "k"], "rn", "n", slices=8).collect()}
    want = {k: i + 1 for i, (v, k) in enumerate(sorted(((i * 7919) % 101, i) for i in range(500)))}
    assert got == want


def test_components_and_group_veto(spark):
    edges = [(1, 2), (2, 3), (9, 9), (20, 21)] + [(100 + i, 101 + i) for i in range(6)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    g = R.group_ids(df)
    assert {r["member_id"]: r["comp"] for r in g.collect()} == {1: 1, 2: 1, 3: 1, 20: 20, 21: 20, **{100 + i: 100 for i in range(7)}}
    assert {r["comp"] for r in R.believed_groups(g).collect()} == {1, 20}


def test_components_over_several_tasks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    whole = {tuple(r) for r in R.group_ids(df).collect()}
    monkeypatch.setattr(R, "TASK_LINKS", 3)
    assert {tuple(r) for r in R.group_ids(df).collect()} == whole
    label = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert whole == set(label.items())


def test_date_precision(spark):
    rows = [(1, "2019-01-01", None, 2019), (2, "2019-01-01", "1905.12345", 2019), (3, "2020-05-05", None, 2019), (4, "2019-07-08", "1905.12345", 2019), (5, "bad", "1913.12345", 2019)]
    df = spark.createDataFrame(rows, "id int, publication_date string, arxiv_id string, year int")
    got = {r["id"]: (str(r["first_date"]), r["precision"]) for r in R.date_precision(df, "id").collect()}
    assert got == {1: ("2019-01-01", "year"), 2: ("2019-05-15", "month"), 3: ("2019-01-01", "year"), 4: ("2019-05-15", "month"), 5: ("2019-01-01", "year")}


def test_part_words_keep_series_apart(spark):
    papers = spark.createDataFrame([(1, "Deep rivers, part iv", [1], 2019), (2, "Deep rivers, part v", [1], 2019), (3, "deep rivers part IV!", [1, 2], 2020)], "id int, title string, author_ids array<int>, year int")
    cand = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert [(r["a"], r["b"], r["same_title"]) for r in R.near_duplicate_edges(cand, papers).collect()] == [(1, 3, True)]


def test_coupling_hub_band(spark):
    rows = [(p, r, 2020) for p in (1, 2) for r in (10, 11, 12)] + [(3, r, 2022) for r in (10, 11, 12)] + [(p, 99, 2020) for p in range(1, 9)]
    df = spark.createDataFrame(rows, "p int, r int, y int")
    got = [tuple(r) for r in G.coupling(df, paper="p", ref="r", year="y", hub=5).collect()]
    assert got == [(1, 2, 3, 3 / 5)]


def test_spearman_ndcg_edges(spark):
    rows = [("nine", i, i, i) for i in range(9)] + [("flat", i, 0.0, i) for i in range(12)] + [("down", i, -i, i) for i in range(10)] + [("up", i, i, i) for i in range(20)] + [("zero", i, i, 0) for i in range(20)]
    df = spark.createDataFrame([(g, i, float(p), y) for g, i, p, y in rows], "g string, k int, p double, y int")
    rho = {r["g"]: round(r["rho"], 9) for r in M.group_spearman(df, "g", "p", "y").collect()}
    assert rho == {"flat": 0.0, "down": -1.0, "up": 1.0, "zero": 0.0}
    assert {r["g"]: r["ndcg"] for r in M.group_ndcg(df, "g", "p", "y", "k").collect()} == {"up": 1.0}


def test_bootstrap_of_equal_losses(spark):
    df = spark.createDataFrame([(i % 7, float(i), float(i)) for i in range(50)], "g int, a double, b double")
    assert tuple(M.bootstrap_difference(df, "g", "a", "b", 50).first()) == (0.0, 0.0, 0.0, 7)


def test_block_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 16)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v], 2000 + i % 4) for i, v in enumerate(m)], "r bigint, e array<float>, y int")
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    got = {(r["q"], r["m"]) for r in X.block_pairs(df, df, key="r", emb="e", dim=4, k=3, year="y", back=1, ahead=0).collect()}
    want = set()
    for i in range(60):
        ok = sorted((-s[i, j], j) for j in range(60) if i != j and -1 <= j % 4 - i % 4 <= 0)[:3]
        want |= {(i, j) for _, j in ok}
    assert got == want
    counts = X.threshold_counts(X.block_pairs(df, df, key="r", emb="e", dim=4, least=0.5), [0.5, 0.9], {"n": F.lit(True)})
    assert sum(r["n"] for r in counts.filter("tau = 0.9").collect()) == int(((s >= 0.9).sum() - 60))


def test_fixed_effects_match_dummies(spark):
    rng = np.random.default_rng(2)
    g, h, x = rng.integers(0, 5, 200), rng.integers(0, 3, 200), rng.normal(size=200)
    y = rng.poisson(np.exp(0.4 * x + 0.2 * g - 0.1 * h))
    df = spark.createDataFrame([(float(a), float(b), int(c), int(e)) for a, b, c, e in zip(y, x, g, h)], "y double, x double, g int, h int")
    d = np.column_stack([x, *[(g == k).astype(float) for k in range(5)], *[(h == k).astype(float) for k in range(1, 3)]])
    ols = np.linalg.lstsq(d, y, rcond=None)[0][0]
    assert E.fe_ols(df, "y", ["x"], ["g", "h"], "g").first()["coef"] == pytest.approx(ols, abs=1e-8)
    beta = np.zeros(d.shape[1])
    for _ in range(50):
        mu = np.exp(d @ beta)
        beta += np.linalg.solve(d.T @ (mu[:, None] * d), d.T @ (y - mu))
    row = E.fe_poisson(df, "y", ["x"], ["g", "h"], "g").first()
    assert row["coef"] == pytest.approx(beta[0], abs=1e-6) and row["se"] > 0


def test_permutation_stays_in_cells(spark):
    df = spark.createDataFrame([(i, i % 3, i) for i in range(90)] + [(200, None, 5)], "k int, c int, v int")
    rows = E.permute_within(df, "c", "k", "v", 3).collect()
    assert len(rows) == 91 and all(r["permuted"] % 3 == r["cell"] for r in rows if r["cell"] is not None)
    assert sorted(r["permuted"] for r in rows) == sorted(r["value"] for r in rows) and any(r["permuted"] != r["value"] for r in rows)


def test_stack_is_non_negative(spark):
    df = spark.createDataFrame([(float(i), float(-i), 2.0 * i + 1) for i in range(20)], "a double, b double, y double")
    w = {r["term"]: r["weight"] for r in L.stack(df, ["a", "b"], "y", F.lit(True)).collect()}
    assert 0 <= w["b"] < 1e-9 and w["a"] == pytest.approx(2, abs=1e-3) and w["intercept"] == pytest.approx(1, abs=1e-2)


def test_json_ingest(spark, tmp_path):
    work = {
        "id": "https://x.org/W7", "doi": "https://doi.org/10.48550/arXiv.1905.12345v2", "title": "T", "publication_year": 2019,
        "primary_topic": {"id": "https://x.org/T11", "subfield": {"id": "https://x.org/subfields/1702"}, "field": {"id": "https://x.org/fields/17"}},
        "topics": [{"id": "https://x.org/T11", "score": 0.9}], "authorships": [{"author": {"id": "https://x.org/A5"}, "institutions": [{"id": "https://x.org/I3"}]}],
        "referenced_works": ["https://x.org/W1", "https://x.org/W2"], "counts_by_year": [{"year": 2020, "cited_by_count": 4}], "abstract_inverted_index": {"world": [1], "hello": [0, 2]},
    }
    other = {"id": "https://x.org/W8", "publication_year": 1999, "primary_topic": None, "referenced_works": None}
    (tmp_path / "w.jsonl").write_text(json.dumps(work) + "\n{broken\n" + json.dumps(other) + "\n")
    rec = I.read_json_lines(spark, str(tmp_path / "w.jsonl")).cache()
    assert tuple(I.bad_lines(rec).first()) == (3, 1)
    lite, detail = I.work_tables(rec, [17])
    assert {r["id"]: r["n_refs"] for r in lite.collect()} == {7: 2, 8: 0}
    d = detail.collect()
    assert len(d) == 1 and d[0]["abstract"] == "hello world hello" and d[0]["arxiv_id"] == "1905.12345" and d[0]["institution_ids"] == [3]
    assert [tuple(r) for r in I.yearly_rows(rec.filter("id is not null")).collect()] == [(7, 2020, 4)]
    I.write_parquet(lite, str(tmp_path / "out"), rows=1, sort=["id"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    I.write_report(lite.select("id", "n_refs"), str(tmp_path / "rep"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rep")).count() == 2


def test_streams_resume(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    df = spark.createDataFrame([(1, [2019, 2020], [2, 3]), (2, None, None)], "id bigint, cby_year array<smallint>, cby_count array<int>")
    df.write.parquet(src)
    stream = S.file_stream(spark, src, "id bigint, cby_year array<smallint>, cby_count array<int>")
    S.run_once(stream.select("id", F.inline(F.arrays_zip("cby_year", "cby_count"))), out, ck)
    assert spark.read.parquet(out).count() == 2
    df.write.mode("append").parquet(src)
    S.run_once(S.file_stream(spark, src, "id bigint, cby_year array<smallint>, cby_count array<int>").select("id", F.inline(F.arrays_zip("cby_year", "cby_count"))), out, ck)
    assert spark.read.parquet(out).count() == 4
    running = S.yearly_stream(S.file_stream(spark, src, "id bigint, cby_year array<smallint>, cby_count array<int>"))
    q = running.writeStream.format("memory").queryName("panel_t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["year"], r["cites"]) for r in spark.table("panel_t").collect()} == {(2019, 4), (2020, 6)}
