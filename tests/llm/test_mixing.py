import pytest
from pyspark.sql import functions as F

from loomwright.llm.mixing import Share, allocate, fitting_budget, mix, mix_report, schedule


def frames(spark, n=300):
    docs = [(i, ["big", "big", "big", "mid", "tiny"][i % 5], 5 + i % 7) for i in range(n)] + [(9001, None, 9), (9002, "other", 9), (9003, "big", 0), (9004, "mid", None)]
    sized = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id bigint, source string, n_tokens bigint, position double")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 5), ("tiny", 0.1, 1), ("absent", 0.1, 2), (None, 0.3, 1), ("zero", None, None)], "source string, target_share double, max_repeat int")
    return sized, targets


def test_allocation_fills_caps_and_shares():
    s = allocate([Share("a", 0.5, 1, 100), Share("b", 0.5, 3, 1000), Share("c", 0.0, 3, 10), Share("d", 0.2, 3, 0)], 600)
    assert [x.take for x in s] == [100, 500, 0, 0]
    schedule(s)
    for end in (0, 1):
        assert sum(x.knots[end][1] for x in s) == pytest.approx(1) and all(x.knots[end][1] >= 0 for x in s)
    assert s[0].capped and not s[1].capped


def test_fitting_budget_caps_no_source():
    s = [Share("a", 0.5, 1, 100), Share("b", 0.5, 3, 1000), Share("c", 0.3, 3, 0), Share("d", 0.0, 1, 50)]
    assert fitting_budget(s) == 200
    assert [x.take for x in allocate(s, 200)] == [100, 100, 0, 0]
    assert fitting_budget([Share("a", 1.0, 5, 100)]) == 100 and fitting_budget([]) == 0


def test_schedules_must_be_curves():
    for knots in ([(0, 1)], [(0, 1), (0.9, 1)], [(0, 1), (0.5, 1), (0.5, 2), (1, 1)], [(0, -1), (1, 1)], [(0, 0), (1, 0)]):
        with pytest.raises(ValueError):
            schedule([Share("a", 1.0, 1, 10, 10.0)], {"a": knots})


def test_positions_follow_a_given_schedule(spark):
    sized = spark.createDataFrame([(i, s, 10) for s in ("late", "flat") for i in range(400)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("late", 0.5, 1), ("flat", 0.5, 1)], "source string, target_share double, max_repeat int")
    rows = mix(sized, targets, schedules={"late": [(0, 0), (0.5, 0), (0.75, 1), (1, 1)], "flat": [(0, 1), (1, 1)]}).collect()
    late = sorted(r["position"] for r in rows if r["source"] == "late")
    assert len(late) == 400 and late[0] > 0.5
    # a third of the demand lies on the rise, which ends at 0.75, and half of it before 0.8125
    assert sum(p <= 0.75 for p in late) == pytest.approx(400 / 3, abs=2) and sum(p <= 0.8125 for p in late) == pytest.approx(200, abs=2)
    flat = sorted(r["position"] for r in rows if r["source"] == "flat")
    assert all(abs(p - (i + 0.5) / 400) < 1e-6 for i, p in enumerate(flat))


def test_every_source_of_the_tables_holds_its_share(spark, data):
    from loomwright.llm.queries_text import p9_mix

    rows = p9_mix(spark, data).collect()
    total = sum(r["used_tokens"] for r in rows)
    assert total > 0
    for r in rows:
        if r["possible_share"] is not None:
            # as near as whole documents allow
            longest = 2 * r["supply_tokens"] / max(1, r["n_docs"]) + 12_000
            assert abs(r["actual_share"] - r["possible_share"]) <= longest / total
            assert r["max_uses_of_a_document"] <= r["max_repeat"]
        else:
            assert r["used_tokens"] == 0


def test_shares_repeats_and_order(spark):
    sized, targets = frames(spark)
    uses = mix(sized, targets).collect()
    pos = [r["position"] for r in uses]
    assert pos == sorted(pos) and 0 <= min(pos) and max(pos) <= 1
    per = {}
    for r in uses:
        per.setdefault((r["source"], r["doc_id"]), []).append(r["pass"])
    assert all(len(set(p)) == len(p) for p in per.values())
    assert max(len(p) for (s, _), p in per.items() if s == "mid") <= 5
    assert max(len(p) for (s, _), p in per.items() if s in ("big", "tiny")) == 1
    rep = {r["source"]: r for r in mix_report(mix(sized, targets), sized, targets).collect()}
    assert rep["mid"]["actual_share"] == pytest.approx(0.4 / 0.9, abs=0.05) and rep["tiny"]["actual_share"] == pytest.approx(0.1 / 0.9, abs=0.02) and rep["absent"]["n_uses"] == 0 and rep["other"]["used_tokens"] == 0
    assert sum(r["actual_share"] for r in rep.values()) == pytest.approx(1, abs=1e-4)
    # the mixture moves over the run, and its middle is the target
    first = [r for r in uses if r["position"] < 0.2]
    assert sum(r["n_tokens"] for r in first if r["source"] == "big") / sum(r["n_tokens"] for r in first) > rep["big"]["actual_share"]


def test_schedule_is_repeatable_and_empty(spark):
    sized, targets = frames(spark)
    a = [(r["doc_id"], r["pass"]) for r in mix(sized, targets, budget=500, seed=2).collect()]
    assert a == [(r["doc_id"], r["pass"]) for r in mix(sized.repartition(7), targets, budget=500, seed=2).collect()]
    assert mix(sized.limit(0), targets).count() == 0
    assert mix(sized, targets.limit(0)).count() == 0
    assert mix_report(mix(sized.limit(0), targets), sized.limit(0), targets).agg(F.sum("used_tokens")).first()[0] == 0
