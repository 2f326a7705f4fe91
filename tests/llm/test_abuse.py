import random

import numpy as np

from loomwright.llm import abuse as A

INSULTS = ["idiot", "moron", "imbecile", "cretin"]
CLEAN = ["We study the convergence of the method.", "The error bound is not described.", "Proofs rely on a sparse inequality.", "The word list holds insults that raters counted.", "This is a weak result and Theorem 2 is wrong."]


def corpus(n, seed):
    rng = random.Random(seed)
    texts, y = [], []
    for _ in range(n):
        s = rng.choices(CLEAN, k=rng.randint(1, 6))
        bad = rng.random() < 0.3
        if bad:
            w = rng.choice(INSULTS)
            w = rng.choice([w, w.upper(), "-".join(w), " ".join(w), w.replace("i", "1").replace("o", "0"), w[0] + w[1] * 4 + w[2:]])
            s.insert(rng.randrange(len(s) + 1), f"Only a stupid {w} would write this.")
        texts.append(" ".join(s))
        y.append(float(bad if rng.random() > 0.03 else not bad))
    return texts, np.array(y)


def scores(m, texts):
    parts = [A.sentences(t) for t in texts]
    z = A.logits(m.weights, m.bias, *A.letters([s for p in parts for s in p]))
    return A.document_scores(z, np.array([len(p) for p in parts]), m.leak)


def test_spellings_fold_to_one():
    plain = A.fold("you idiot")
    for s in ("you i-d-i-o-t", "you i d i o t", "you IDIOT", "you 1d10t", "you idіоt", "you i​diot", "you id_iot", "you idiiiiot"):
        assert A.fold(s) == plain, s
    assert A.fold("") == " " and A.fold("n=2, 38 minutes").strip() == "n 0 0 minutes"


def test_sentences():
    assert A.sentences("<jats:p>One is here. Two is there!</jats:p>") == ["One is here.", "Two is there!"]
    assert A.sentences("   ") == []
    assert all(len(s) <= 2 * A.STRETCH for s in A.sentences("x" * 5000 + " y" * 3000))


def test_learns_from_document_labels_held_out():
    texts, y = corpus(600, 1)
    m = A.fit(texts, y)
    held, clean_y = corpus(300, 2)
    truth = np.array(["Only a stupid" in t for t in held])
    hit = scores(m, held) >= A.THRESHOLD
    assert (hit == truth).mean() > 0.97


def test_scoring_defined_cases(spark):
    texts, y = corpus(300, 3)
    m = A.fit(texts, y)
    rows = [(1, "Only a stupid moron would write this. We study the convergence of the method."), (2, None), (3, ""), (4, "  <b></b> "), (5, CLEAN[0] * 3000), (None, CLEAN[1]), (1, CLEAN[0])]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, score double")
    got = A.score(df, m, located=True).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 1)}
    assert by[2]["score"] == by[3]["score"] == by[4]["score"] == 0
    bad = next(r for r in got if r["doc_id"] == 1 and r["score"] > 0.5)
    assert bad["offending"][0]["sentence"] == 0 and "moron" in bad["offending"][0]["text"]
    assert A.score(df.limit(0), m).count() == 0


def test_training_without_labels(spark):
    docs = spark.createDataFrame([(1, "You are a moron."), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, None, "r"), (None, 1, "r"), (2, 1, "r"), (1, 7, "r")], "doc_id bigint, toxic int, rater string")
    m = A.train(docs, labels)
    assert m.n_labelled == 0 and max(r["score"] for r in A.score(docs, m).collect()) < 0.01


def test_only_tags_are_taken_out():
    for s in (r"Let $1 < p \le 5$ hold. Only a stupid moron would write this. Take $\lambda > 0$.", "It is < 3. You are an idiot. It is > 2.", "<you stupid moron>", "<idiot>", "<p you are an idiot>"):
        assert " ".join(A.sentences(s)) == s
    for s in ('<jats:p>', '</mml:mi>', '<a href="http://x.y/z" class=\'k\'>', "<br/>", "<TD colspan=2>", "&lt;", "&#39;"):
        assert A.sentences(f"One {s}two.") == ["One  two."], s


def test_folding_letter_runs_digits_blanks():
    text, n = A.letters(["aaab  bb,c 12 345", "", "ß Ĳ ...", "xx\n12"])
    at = np.concatenate([[0], np.cumsum(n)])
    assert [text[s:e].tobytes().decode() for s, e in zip(at[:-1], at[1:])] == [" ab bb c 0 0 ", " ", " ss ij ", " xx 0 "]


def test_length_alone_adds_up_to_nothing():
    texts, y = corpus(600, 1)
    m = A.fit(texts, y)
    long = [" ".join(CLEAN * 400), " ".join(CLEAN * 400) + " Only a stupid moron would write this."]
    clean, bad = scores(m, long)
    assert clean < A.THRESHOLD <= bad


def test_labelled_documents_fit_the_bound_of_characters(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(1, 9)] + [(9, None), (10, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, "r") for i in range(1, 11)] * 2, "doc_id bigint, toxic int, rater string")
    texts, y = A.labelled(docs, labels)
    assert len(texts) == len(y) == 8
    texts, _ = A.labelled(docs, labels, chars=100)
    assert 0 < sum(map(len, texts)) <= 100
    assert len(A.labelled(docs, labels, most=3)[0]) <= 3 and A.labelled(docs.limit(0), labels)[0] == []
