"""References to records that do not exist, for single and composite keys with declared match semantics."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "full", "partial")


def resolve_references(
    refs: DataFrame,
    targets: DataFrame,
    *,
    on: list[tuple[str, str]],
    match: str = "simple",
    carry: list[str] = (),
) -> DataFrame:
    """``refs`` with ``matched`` and the ``carry`` columns of the target each row refers to.

    ``on`` pairs reference columns with target columns. References are grouped by null mask, and each mask is matched on its
    non-null columns against the targets' distinct values of those columns, under the declared semantics:

    * ``simple``: a reference with any null column refers to nothing and counts as matched;
    * ``full``: all columns null counts as matched, some null is a violation (not matched);
    * ``partial``: all null counts as matched, else the non-null columns must occur together in some target.

    Defined cases: repeated reference rows stay; repeated targets match once (``carry`` takes the least value of each
    column); targets with a null key column match only partial references that do not use it; an empty ``targets`` leaves
    every all-non-null reference unmatched; an empty ``refs`` gives no row. Only the key and carry columns of ``targets``
    are read, so other clashing names do no harm; ``matched`` and the ``carry`` names must be free in ``refs``.

    Scale: targets are aggregated to one row per key before the join, so a join never multiplies rows; a hot referenced key
    is a skewed stream side, which AQE splits. The join is one shuffle per mask that really needs matching (one for
    ``simple``).
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    clash = {"matched", *carry} & set(refs.columns)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    parts = []
    for mask in product((True, False), repeat=len(on)):
        own = refs
        for (r, _), given in zip(on, mask):
            own = own.filter(F.col(r).isNotNull() if given else F.col(r).isNull())
        used = [pair for pair, given in zip(on, mask) if given]
        if len(used) == len(on) or (used and match == "partial"):
            parts.append(_matched(own, targets, used, carry))
        else:
            fixed = not used or match == "simple"
            nulls = [F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in carry]
            parts.append(own.select("*", F.lit(fixed).alias("matched"), *nulls))
    return reduce(DataFrame.unionByName, parts)


def _matched(refs: DataFrame, targets: DataFrame, used: list[tuple[str, str]], carry: list[str]) -> DataFrame:
    keys = [f"_t{i}" for i in range(len(used))]
    side = targets.dropna(subset=[t for _, t in used]).groupBy(*[F.col(t).alias(k) for (_, t), k in zip(used, keys)])
    side = side.agg(F.lit(True).alias("_hit"), *[F.min(c).alias(f"_c_{c}") for c in carry])
    on = reduce(lambda a, b: a & b, [F.col(r) == F.col(k) for (r, _), k in zip(used, keys)])
    joined = refs.join(side, on, "left")
    return joined.select(*refs.columns, F.coalesce("_hit", F.lit(False)).alias("matched"), *[F.col(f"_c_{c}").alias(c) for c in carry])


def orphan_references(refs: DataFrame, targets: DataFrame, *, on: list[tuple[str, str]], match: str = "simple") -> DataFrame:
    """The rows of ``refs`` that :func:`resolve_references` leaves unmatched."""
    return resolve_references(refs, targets, on=on, match=match).filter(~F.col("matched")).drop("matched")
