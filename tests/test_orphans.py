import pytest

from loomwright.operators.orphans import orphan_references, resolve_references

REFS = [(1, 1, 10), (2, 1, None), (3, None, None), (4, 9, 9), (5, None, 20), (6, None, 99), (4, 9, 9)]


def frames(spark):
    refs = spark.createDataFrame(REFS, "n int, a int, b int")
    targets = spark.createDataFrame([(1, 10, "x"), (1, 10, "w"), (2, 20, "y"), (None, 9, "z")], "a int, b int, n string")
    return refs, targets


@pytest.mark.parametrize(("match", "orphans"), [("simple", [4, 4]), ("full", [2, 4, 4, 5, 6]), ("partial", [4, 4, 6])])
def test_match_semantics(spark, match, orphans):
    refs, targets = frames(spark)
    out = orphan_references(refs, targets, on=[("a", "a"), ("b", "b")], match=match)
    assert sorted(r["n"] for r in out.collect()) == orphans
    assert out.columns == ["n", "a", "b"]


def test_carry_empty_and_clashes(spark):
    refs, targets = frames(spark)
    got = resolve_references(refs, targets.withColumnRenamed("n", "label"), on=[("a", "a"), ("b", "b")], carry=["label"])
    assert {r["n"]: r["label"] for r in got.collect()}[1] == "w"
    assert orphan_references(refs, targets.limit(0), on=[("a", "a")]).count() == 4  # every row with an a, repeated ones too
    assert orphan_references(refs.limit(0), targets, on=[("a", "a")]).count() == 0
    with pytest.raises(ValueError):
        resolve_references(refs, targets, on=[("a", "a")], carry=["n"])
    with pytest.raises(ValueError):
        orphan_references(refs, targets, on=[("a", "a")], match="other")
