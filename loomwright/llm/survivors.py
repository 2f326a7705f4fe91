"""Best representative of each duplicate group, field by field, by iterative truth discovery.

Rounds alternate: every (entity, field) takes the value of highest support, the sum of its sources' weights, where values near to
it count in part; and every source gets a weight for each field from how far its claims lie from the values taken. An order of trust
that is declared beforehand comes first: only the claims of the best trust of an (entity, field) have a vote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.session import BROADCAST_ROWS, materialise

#: Part of the weight that a value near another one lends to it.
NEAR = 0.5
#: Rounds from which on weights move only half of the way, so that claims that would alternate come to rest.
DAMPED = 6
_NO_SOURCE = "\0none"


@dataclass(frozen=True)
class Truth:
    """``chosen(entity, field, value, support, n_values)``, ``weights(source, field, n, loss, weight)``, and how the rounds ended."""

    chosen: DataFrame
    weights: DataFrame
    rounds: int
    converged: bool


def truth_discovery(claims: DataFrame, *, widths: dict[str, float] | None = None, max_rounds: int = 50, tolerance: float = 1e-3) -> Truth:
    """Chosen values and source weights from ``claims(entity, field, value[, source][, number][, trust][, recency])``.

    ``value`` is a string; ``number`` (double) is its place on a scale, by which values of a field with an entry in ``widths`` are near
    one another: they are put into bins of that width, and those of its own and the two next bins lend a value ``NEAR`` of their
    weight. ``trust`` (array<bigint>, least is best, a null one worst) is the declared order: claims that are not of the best
    trust of their entity and field have no vote, so a trust that tells all claims apart decides alone. ``recency`` (bigint) and then
    the least number and value settle equal support.

    A source's weight for a field is ``ln((n + 2) / (loss + 1))``; a claim loses 0 by the chosen value, 1 - ``NEAR`` by one near it and
    else 1. The rounds end when no weight moves by ``tolerance``; if some still do after ``max_rounds``, ``converged`` is false.

    Defined cases: claims with a null entity, field or value are ignored; a null source is a source of its own; a source counts
    once for a value of an entity, however often it repeats it; a null or missing number has no near ones; an entity and field
    with one value keeps it; an empty table gives two empty tables; other columns are ignored.

    Scale: claims, bins and votes are algebraic aggregates, so neither the claims of a giant group nor their pairs ever meet in one
    task. Weights join by source: broadcast while counted to be few, else shuffled with AQE splitting hot sources. Each round is
    checkpointed; the driver sees one number a round.
    """
    widths = widths or {}
    has = set(claims.columns)
    own = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind)
    source = F.coalesce(own("source", "string"), F.lit(_NO_SOURCE))
    base = claims.select("entity", "field", "value", source.alias("source"), own("number", "double").alias("number"), own("trust", "array<bigint>").alias("trust"), own("recency", "bigint").alias("recency"))
    base = base.dropna(subset=["entity", "field", "value"])
    if "trust" in has:
        base = base.withColumn("trust", F.coalesce("trust", F.array(F.lit(2**63 - 1))))
        best = base.groupBy("entity", "field").agg(F.min("trust").alias("trust"))
        base = base.join(best, ["entity", "field", "trust"], "left_semi")
    base = base.groupBy("entity", "field", "value", "source").agg(F.min("number").alias("number"), F.max("recency").alias("recency"))
    base = materialise(base.withColumn("bin", _bin(widths)))
    weights = materialise(base.groupBy("source", "field").agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("loss"), F.lit(1.0).alias("weight")))
    # every round has the same sources and fields, so what is few once stays few
    hint = F.broadcast if weights.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)
    for done in range(1, max_rounds + 1):
        chosen = _vote(base, hint(weights), bool(widths))
        judged = base.join(chosen.select("entity", "field", F.col("value").alias("truth"), F.col("bin").alias("truth_bin")), ["entity", "field"])
        near = F.coalesce(F.abs(F.col("bin") - F.col("truth_bin")) <= 1, F.lit(False))
        loss = F.when(F.col("value") == F.col("truth"), 0.0).when(near, 1 - NEAR).otherwise(1.0)
        scored = judged.groupBy("source", "field").agg(F.count(F.lit(1)).alias("n"), F.sum(loss).alias("loss"))
        after = scored.join(hint(weights.select("source", "field", F.col("weight").alias("old"))), ["source", "field"])
        goal = F.log((F.col("n") + 2) / (F.col("loss") + 1))
        after = materialise(after.withColumn("weight", goal if done < DAMPED else (goal + F.col("old")) / 2))
        moved = after.agg(F.max(F.abs(F.col("weight") - F.col("old")))).first()[0]
        weights = after.drop("old")
        if moved is None or moved < tolerance:
            break
    converged = moved is None or moved < tolerance
    final = materialise(_vote(base, hint(weights), bool(widths))).drop("bin")
    return Truth(final, weights.withColumn("source", F.nullif(F.col("source"), F.lit(_NO_SOURCE))), done, converged)


def _bin(widths: dict[str, float]) -> Column:
    out = F.lit(None).cast("bigint")
    for name, width in widths.items():
        out = F.when(F.col("field") == name, F.floor(F.col("number") / width)).otherwise(out)
    return out


def _vote(base: DataFrame, weights: DataFrame, near: bool) -> DataFrame:
    votes = base.join(weights.select("source", "field", "weight"), ["source", "field"])
    votes = votes.groupBy("entity", "field", "value").agg(F.sum("weight").alias("w"), F.min("number").alias("number"), F.max("recency").alias("recency"), F.min("bin").alias("bin"))
    if near:
        # every bin sends its weight to itself and the two next to it, and each value looks up its own bin
        bins = votes.filter("bin is not null").groupBy("entity", "field", "bin").agg(F.sum("w").alias("w"))
        sent = bins.select("entity", "field", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin"), "w")
        around = sent.groupBy("entity", "field", "bin").agg(F.sum("w").alias("around"))
        votes = votes.join(around, ["entity", "field", "bin"], "left")
        votes = votes.withColumn("s", F.col("w") + NEAR * (F.coalesce("around", "w") - F.col("w"))).drop("around")
    else:
        votes = votes.withColumn("s", F.col("w"))
    # rounding keeps the order of summation out of ties
    key = F.struct(F.round(-F.col("s"), 9).alias("o"), (-F.col("recency")).alias("r"), F.col("number").alias("x"), F.col("value").alias("v"), F.col("bin").alias("b"))
    best = votes.groupBy("entity", "field").agg(F.min(key).alias("k"), F.sum("w").alias("total"), F.count(F.lit(1)).alias("n_values"))
    support = F.least(F.lit(1.0), F.try_divide(-F.col("k.o"), F.col("total")))
    return best.select("entity", "field", F.col("k.v").alias("value"), support.alias("support"), "n_values", F.col("k.b").alias("bin"))
