import numpy as np

import loomwright.llm.neighbours as N

DIM = 8


def brute(vectors, k, least):
    keys = sorted(vectors)
    m = np.array([vectors[i] for i in keys], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    np.fill_diagonal(s, -9)
    out = set()
    for i, a in enumerate(keys):
        # keys are sorted, so a stable order settles ties by key
        top = np.argsort(-s[i], kind="stable")[: min(k, len(keys) - 1)]
        out |= {(a, keys[j]) for j in top if s[i, j] >= least}
    return out


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, DIM))
    return {i: (centres[i % len(centres)] + 0.1 * rng.normal(size=DIM)) * rng.uniform(0.2, 4) for i in range(n)}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for k, v in rows], "emb_row bigint, emb array<float>, vec string, rank int")
    return {(r["row"], r["other"]) for r in N.nearest(df, key="emb_row", emb="emb", dim=DIM, **kw).collect()}


def test_recall_with_several_parts(spark):
    vectors = clustered(1500, 4)
    got, want = run(spark, vectors.items(), k=5, least=0.85, part_rows=100, sample=700, probes=4), brute(vectors, 5, 0.85)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_exact_when_one_part_and_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    vectors = clustered(300, 5)
    assert run(spark, vectors.items(), k=3, least=0.8) == brute(vectors, 3, 0.8)


def test_copies_unusable_and_repeated(spark):
    one = [1.0, 0, 0, 0, 0, 0, 0, 0]
    rows = [(i, one) for i in range(1, 10)] + [(1, one), (20, [2.0, 0.1] + [0] * 6), (30, None), (31, [1.0] * 7), (32, [0.0] * 8), (33, [float("nan")] * 8), (34, [float("inf")] + [1.0] * 7), (35, [None] + [1.0] * 7), (None, one)]
    usable = {k: v for k, v in rows if k is not None and k <= 20}
    assert run(spark, rows, k=5, least=0.85) == brute(usable, 5, 0.85)
    assert run(spark, [], k=5, least=0.85) == set()


def test_query_gives_every_vector_its_neighbours_below_the_floor_of_p6_found(spark, data):
    from loomwright.llm.queries_records import TOP, p6_neighbours
    from loomwright.sources.tables import table

    vectors = {}
    for r in table(spark, data, "paper_vector").select("emb_row", "emb").collect():
        v = r["emb"]
        if r["emb_row"] is not None and v is not None and len(v) == 96 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            vectors[r["emb_row"]] = min(v, vectors.get(r["emb_row"], v))
    got = p6_neighbours(spark, data).collect()
    assert {(r["row"], r["other"]) for r in got} == brute(vectors, TOP, -1.0)
    assert len(got) == len(vectors) * min(TOP, len(vectors) - 1) and min(r["cosine"] for r in got) < 0.85


def test_every_part_probed_misses_no_low_neighbour(spark):
    vectors = clustered(600, 6)
    assert run(spark, vectors.items(), k=5, least=-1.0, part_rows=60, sample=400, probes=N.FANOUT, mass=2.0) == brute(vectors, 5, -1.0)


def test_parts_of_parts_are_exact_when_all_are_probed(spark, monkeypatch):
    monkeypatch.setattr(N, "FANOUT", 4)
    vectors = clustered(600, 7)
    assert run(spark, vectors.items(), k=4, least=0.5, part_rows=15, sample=200, probes=4, mass=2.0) == brute(vectors, 4, 0.5)


def test_recall_at_more_than_a_thousand_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "FANOUT", 32)
    monkeypatch.setattr(N, "PART_SAMPLE", 300)
    seen = []
    split = N._split
    monkeypatch.setattr(N, "_split", lambda *a: seen.append(split(*a)) or seen[-1])
    vectors = clustered(6_000, 8)
    got, want = run(spark, vectors.items(), k=5, least=0.85, part_rows=3, sample=2_000), brute(vectors, 5, 0.85)
    assert seen and seen[-1].filter("own").select("part").distinct().count() > 1_000
    assert len(got & want) >= 0.95 * len(want)


def test_packed_vectors_keep_values_and_order():
    m = np.array([[-1.5, 2, 0, 0, 0, 0, 0, 0], [-1.5, -3, 1, 0, 0, 0, 0, 0], [0, 1e-30, 0, 0, 0, 0, 0, 7], [3, 0, 0, 0, 0, 0, 0, 0]], np.float32)
    packed = N._pack(m)
    assert (N._unpack(packed, 8) == m).all()
    assert sorted(range(4), key=lambda i: packed[i].as_py()) == sorted(range(4), key=lambda i: m[i].tolist())


def test_turns_and_half_floats_change_nothing(spark, monkeypatch):
    m = np.array([[0.5, -1.25, 0, 3, 0, 0, 0, 0], [0.1, 1e-30, 1e30, 7, 0, 0, 0, 1]], np.float32)
    short = N._shrink(m)
    assert [len(x.as_py()) for x in short] == [16, 32] and (N._load(short, 8) == m).all()
    monkeypatch.setattr(N, "ROWS_A_TURN", 40)
    turns = []
    monkeypatch.setattr(N, "_first", lambda *a, f=N._first: turns.append(a[1]) or f(*a))
    vectors = clustered(300, 9)
    assert run(spark, vectors.items(), k=5, least=-1.0, part_rows=60, sample=400, probes=N.FANOUT, mass=2.0) == brute(vectors, 5, -1.0)
    assert turns.count("row") > 4
