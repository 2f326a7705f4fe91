from loomwright.llm import queries_records as Q


def test_election_runs_no_rounds_of_votes(spark, data, monkeypatch):
    def rounds(*a, **k):
        raise AssertionError("votes can't change what the declared order elects")

    monkeypatch.setattr(Q, "truth_discovery", rounds)
    rows = Q.p3_found(spark, data).collect()
    assert rows and all(r["paper_id"] for r in rows) and len({r["comp"] for r in rows}) == len(rows)
