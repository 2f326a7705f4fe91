import random

import loomwright.llm.triejoin as T


def grams(s):
    return {s[i : i + 4] for i in range(len(s) - 3)}


def brute(rows):
    out = set()
    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            x, y = grams(s), grams(t)
            if 5 * len(x & y) >= 3 * len(x | y):
                out.add((min(a, b), max(a, b)))
    return out


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh01", k=rng.randint(3, 9))) for _ in range(60)]
    base = ["".join(rng.choices(words, k=rng.randint(3, 9))) for _ in range(n)]
    out = set()
    for s in base:
        out.add(s)
        for _ in range(rng.randint(0, 2)):
            t = list(s)
            for _ in range(rng.randint(1, 6)):
                p = rng.randrange(len(t))
                t[p : p + 1] = rng.choice([[], [rng.choice("xyz")], [t[p], "q"]])
            out.add("".join(t))
    return [(i, s) for i, s in enumerate(sorted(out)) if len(s) >= 20]


def run(spark, rows):
    return {(r["a"], r["b"]) for r in T.similar_strings(spark.createDataFrame(rows, "cid bigint, s string")).collect()}


def test_exact_against_brute_force(spark):
    rows = texts(220, 1)
    want = brute(rows)
    assert len(want) > 100 and run(spark, rows) == want


def test_split_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    rows = texts(150, 2)
    assert run(spark, rows) == brute(rows)


def test_three_of_five_counts(spark):
    # 3 common grams of 5
    assert run(spark, [(1, "abcdefg"), (2, "abcdefhi")]) == brute([(1, "abcdefg"), (2, "abcdefhi")])
    assert run(spark, [(1, "abcdefg"), (2, "abcdefh")]) == {(1, 2)}


def test_titles_nulls_ties_long_empty(spark):
    long = "alpha beta gamma delta " * 3000
    rows = [(1, "The Same, Title of 20 chars!"), (2, "the same title of 20 CHARS"), (2, "the same title of 20 CHARS"), (3, None), (None, "the same title of 20 chars"), (4, "short"), (5, ""), (6, long), (7, long + "z"), (8, "éé" * 30)]
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "id bigint, title string, cid int, s string")
    members, classes = T.title_classes(df, "id", "title")
    assert {(r["cid"], r["id"]) for r in members.collect()} == {(1, 1), (1, 2), (6, 6), (7, 7)}
    assert {(r["a"], r["b"]) for r in T.similar_strings(classes).collect()} == {(6, 7)}
    members, classes = T.title_classes(df.limit(0), "id", "title")
    assert members.count() == 0 and T.similar_strings(classes).count() == 0


def test_tree_in_turns_leaves_no_shuffle_behind(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS_A_STRING", 2)
    monkeypatch.setattr(T, "ROWS_A_TURN", 50)
    rows = texts(150, 3)
    made = []
    monkeypatch.setattr(T, "_insert_kernel", lambda *a, f=T._insert_kernel: made.append(a[1:]) or f(*a))
    shuffles = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    strings = spark.createDataFrame(rows, "cid bigint, s string")
    before = shuffles.size()
    pairs = T.similar_strings(strings)
    assert len(made) > 3 and all(a[1] == b[0] for a, b in zip(made, made[1:]))
    assert {(r["a"], r["b"]) for r in pairs.select("a", "b").collect()} == brute(rows)
    assert shuffles.size() - before <= 4  # the counts' own, not one for each turn
