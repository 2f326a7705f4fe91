import datetime as dt
import random

from loomwright.operators.asof import Lookup, known_at, known_together

E = "e bigint, t timestamp_ntz"
L = "e bigint, valid timestamp_ntz, known timestamp_ntz, v string, t string"  # t clashes with the event time on purpose


def day(n):
    return None if n is None else dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def run(spark, events, log, **kw):
    ev = spark.createDataFrame([(e, day(t)) for e, t in events], E)
    lg = spark.createDataFrame([(e, day(a), day(b), v, "x") for e, a, b, v in log], L)
    out = known_at(ev, lg, entity=[("e", "e")], time="t", order=["valid", "known"], values=["v"], **kw)
    return {(r["e"], (r["t"] - day(0)).days): (r["known"], r["v"]) for r in out.collect()}


def right(events, log):
    out = {}
    for e, t in events:
        if e is None or t is None:
            continue
        seen = [(a, b, v is not None, v or "") for k, a, b, v in log if k == e and a is not None and b is not None and max(a, b) <= t]
        out[e, t] = (bool(seen), (max(seen)[3] if max(seen)[2] else None) if seen else None)
    return out


def test_bitemporal_rules(spark):
    log = [(1, 0, 0, "a"), (1, 5, 9, "late"), (1, 3, 4, "b"), (1, 3, 4, "b"), (2, 0, None, "never"), (None, 0, 0, "x"), (1, 6, 6, None)]
    events = [(1, -1), (1, 0), (1, 4), (1, 5), (1, 8), (1, 9), (1, 9), (2, 9), (3, 1), (None, 1), (1, None)]
    assert run(spark, events, log) == right(events, log)


def test_ties_and_empty(spark):
    log = [(1, 2, 2, "a"), (1, 2, 2, "b"), (1, 2, 2, None)]
    assert run(spark, [(1, 2)], log) == {(1, 2): (True, "b")}
    assert run(spark, [(1, 2)], []) == {(1, 2): (False, None)}
    assert run(spark, [], log) == {}


def test_hot_entities_sliced_like_brute_force(spark):
    rng = random.Random(5)
    log = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(300), rng.randrange(300), rng.choice("abc")) for _ in range(900)]
    log += [(e, a, b, v) for e, a, b, v in log[:50]]
    events = [(rng.choice([1, 1, 2, 3, 4]), rng.randrange(320)) for _ in range(400)]
    assert run(spark, events, log, hot_rows=100) == run(spark, events, log) == right(events, log)


def test_several_attributes_together(spark):
    rng = random.Random(5)
    venues = [(rng.randint(1, 12), rng.randint(0, 30), rng.randint(0, 30), rng.choice("abc"), "x") for _ in range(200)]
    people = [(rng.randint(1, 9), rng.randint(0, 30), rng.randint(0, 30), rng.choice([None, *range(50)]), "x") for _ in range(200)]
    samples = [(i, rng.choice([None, *range(1, 15)]), rng.choice([None, *range(0, 35)]), rng.choice([None, [], [None], *[rng.choices([None, *range(1, 12)], k=rng.randint(1, 4)) for _ in range(6)]])) for i in range(120)]
    log = lambda rows, kind: spark.createDataFrame([(e, day(a), day(b), v, w) for e, a, b, v, w in rows], f"e bigint, valid timestamp_ntz, known timestamp_ntz, v {kind}, t string")
    ev = spark.createDataFrame([(i, e, day(t), team) for i, e, t, team in samples], "i bigint, e bigint, t timestamp_ntz, team array<bigint>")
    lookups = [
        Lookup("venue", log(venues, "string"), [("e", "e")], ["valid", "known"], "v"),
        Lookup("best", log(people, "int"), [("a", "e")], ["valid", "known"], "v", each="team", default=0),
    ]

    def one(rows, e, t):
        seen = [(a, b, v is not None, v if v is not None else 0) for k, a, b, v, _ in rows if k == e and t is not None and max(a, b) <= t]
        return (max(seen)[3] if max(seen)[2] else None) if seen else "unknown"

    want = {}
    for i, e, t, team in samples:
        venue = one(venues, e, t) if e is not None else None
        best = [0 if (v := one(people, a, t)) == "unknown" else v for a in team] if team else []
        best = [v for v in best if v is not None]
        want[i] = (None if venue == "unknown" else venue, max(best) if best else None)
    for hot in (200_000, 5):
        got = {r["i"]: (r["venue"], r["best"]) for r in known_together(ev, lookups, id="i", time="t", hot_rows=hot).collect()}
        assert got == want
    empty = [Lookup("venue", log([], "string"), [("e", "e")], ["valid", "known"], "v")]
    assert {r["venue"] for r in known_together(ev, empty, id="i", time="t").collect()} == {None}
    assert known_together(ev.limit(0), lookups, id="i", time="t").count() == 0
