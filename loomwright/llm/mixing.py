"""Mixing sources to target weights over a training run, as a time-varying curriculum.

Every source gets a share of the token budget, as near its target as its repeats allow. Its weight follows a schedule over the run,
given as knots between which it is linear; without one it moves from near its natural share to the mirror image of that, so that
its integral is the share. Integrating the weights gives the cumulative token demand; each use of a document takes an interval of
its source's demand, and the inverse of the demand at the interval's middle is the document's position in training, by which
the documents are range-sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Slices of a source's random order, summed on their own; the prefix sums of a source have as many rows a pass.
SLICES_LOG2 = 10
#: Sources with a target that the plan may hold; more are refused rather than brought to the driver.
MAX_SOURCES = 100_000


@dataclass
class Share:
    """Plan of one source: tokens to take, and the knots (time, weight) of its schedule."""

    source: str
    target: float
    max_repeat: int
    supply: int
    take: float = 0.0
    knots: list[tuple[float, float]] = field(default_factory=list)

    @property
    def capped(self) -> bool:
        """Whether the source is used as often as it may be."""
        return self.take >= self.supply * self.max_repeat


def fitting_budget(shares: list[Share]) -> float:
    """The greatest number of tokens, up to those of all sources that can be used, at which every one of them holds its share within its repeats."""
    usable = [s for s in shares if s.target > 0 and s.supply > 0 and s.max_repeat > 0]
    total = sum(s.target for s in usable)
    return min([float(sum(s.supply for s in usable)), *[s.supply * s.max_repeat * total / s.target for s in usable]])


def allocate(shares: list[Share], budget: float) -> list[Share]:
    """Fill ``take``: the target share of ``budget``, sources at their cap giving what they lack to the others in proportion."""
    open_, left = [s for s in shares if s.target > 0 and s.supply > 0 and s.max_repeat > 0], float(budget)
    while open_:
        weight = sum(s.target for s in open_)
        capped = [s for s in open_ if s.target / weight * left >= s.supply * s.max_repeat]
        if not capped:
            for s in open_:
                s.take = s.target / weight * left
            break
        for s in capped:
            s.take = float(s.supply * s.max_repeat)
        left -= sum(s.take for s in capped)
        full = {id(s) for s in capped}
        open_ = [s for s in open_ if id(s) not in full]
    return shares


def schedule(shares: list[Share], given: dict[str, list[tuple[float, float]]] | None = None) -> list[Share]:
    """Fill the knots: those ``given`` for a source, else a line. The lines sum to 1 at every moment and have the taken shares as means.

    They start as near the natural shares of the supply as weights that stay positive allow. Given knots must start at time 0, end
    at 1 and rise in between, with weights that are not negative and not all zero; only their shape counts, as a source's tokens are
    settled by its share.
    """
    for name, knots in (given or {}).items():
        times = [t for t, _ in knots]
        if len(knots) < 2 or times[0] != 0 or times[-1] != 1 or any(b <= a for a, b in zip(times, times[1:])) or min(w for _, w in knots) < 0 or not any(w for _, w in knots):
            raise ValueError(f"the schedule of {name} must have rising times from 0 to 1 and weights that are not negative and not all zero")
    taken, supply = sum(s.take for s in shares), sum(s.supply for s in shares if s.take > 0)
    if not taken:
        return shares
    pairs = [(s, s.take / taken, s.supply / supply if s.take > 0 else 0.0) for s in shares]
    tilt = min([1.0, *[0.95 * a / abs(n - a) for _, a, n in pairs if a > 0 and abs(n - a) > 1e-12]])
    for s, a, n in pairs:
        s.knots = (given or {}).get(s.source) or [(0.0, a + tilt * (n - a)), (1.0, a - tilt * (n - a))]
    return shares


def plan(sized: DataFrame, targets: DataFrame, *, budget: int | None = None, schedules: dict[str, list[tuple[float, float]]] | None = None) -> list[Share]:
    """What is taken of every source with a target, and its schedule; one row a source reaches the driver."""
    wanted = (
        targets.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("t"), F.min(F.coalesce("max_repeat", F.lit(0))).alias("r"))
    )
    supply = sized.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("supply"))
    rows = wanted.join(supply, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with a target")
    shares = [Share(r["source"], r["t"], max(0, r["r"]), r["supply"] or 0) for r in sorted(rows, key=lambda r: r["source"])]
    return schedule(allocate(shares, fitting_budget(shares) if budget is None else budget), schedules)


def uses(sized: DataFrame, shares: list[Share], *, seed: int = 0) -> DataFrame:
    """``doc_id, source, pass, n_tokens, position`` of the plan, in no order."""
    rows = []
    for s in shares:
        if s.take > 0:
            times, weights = [float(t) for t, _ in s.knots], [float(w) for _, w in s.knots]
            steps = [(w + v) / 2 * (u - t) for t, u, w, v in zip(times, times[1:], weights, weights[1:])]
            area = sum(steps)
            demand = [sum(steps[:i]) / area for i in range(len(steps))]
            rows.append((s.source, float(s.supply), s.take, int(-(-s.take // s.supply)), times, [w / area for w in weights], demand))
    plan_df = sized.sparkSession.createDataFrame(rows, "source string, supply double, take double, passes int, times array<double>, weights array<double>, demand array<double>")
    docs = sized.select("doc_id", "source", "n_tokens").filter("n_tokens > 0")
    used = docs.join(F.broadcast(plan_df), "source").withColumn("pass", F.explode(F.sequence(F.lit(1), "passes")))  # at most MAX_SOURCES rows
    hashed = used.withColumn("h", F.xxhash64("doc_id", "pass", F.lit(seed))).withColumn("slice", F.shiftrightunsigned("h", 64 - SLICES_LOG2))
    sums = hashed.groupBy("source", "pass", "slice").agg(F.sum("n_tokens").alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("source", "pass").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = sums.select("source", "pass", "slice", earlier.alias("before"))
    inside = W.partitionBy("source", "pass", "slice").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = hashed.join(before, ["source", "pass", "slice"]).withColumn("within", F.sum("n_tokens").over(inside))
    middle = (F.col("pass") - 1) * F.col("supply") + F.col("before") + F.col("within") - F.col("n_tokens") / 2
    kept = placed.withColumn("middle", middle).filter(F.col("middle") <= F.col("take")).withColumn("x", F.col("middle") / F.col("take"))
    # the stretch between knots in which the demand reaches x
    kept = kept.withColumn("i", F.greatest(F.size(F.filter("demand", lambda c: c <= F.col("x"))), F.lit(1)))
    at = lambda c, i: F.element_at(c, i)
    t0, t1, w0, w1 = at("times", F.col("i")), at("times", F.col("i") + 1), at("weights", F.col("i")), at("weights", F.col("i") + 1)
    rest, slope = F.col("x") - at("demand", F.col("i")), (w1 - w0) / (t1 - t0)
    # rest = w0 t + slope t^2 / 2, solved for t in the form without cancellation
    root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0)))
    position = F.least(t1, t0 + F.coalesce(F.try_divide(2 * rest, w0 + root), F.lit(0.0)))
    return kept.select("doc_id", "source", "pass", "n_tokens", position.alias("position"))


def mix(sized: DataFrame, targets: DataFrame, *, budget: int | None = None, schedules: dict[str, list[tuple[float, float]]] | None = None, seed: int = 0) -> DataFrame:
    """Uses of documents in training order: ``doc_id, source, pass, n_tokens, position`` with position in [0, 1].

    ``sized`` has ``doc_id, source, n_tokens``; ``targets`` has ``source, target_share, max_repeat``. ``budget`` is the number of
    tokens wanted, by default :func:`fitting_budget`, at which no source falls short of its share. ``schedules`` has knots by source,
    see :func:`schedule`. A source is passed through once after another in a new random order each time, at most ``max_repeat``
    times; the last pass stops at the document nearest the source's share.

    Defined cases: documents without tokens, of a source without a target, or with a null source are not used; a target without
    documents stays unused and its share goes to the others in proportion; several targets of one source add up, with the least
    max_repeat; null or negative shares and repeats count as 0; repeated document rows are documents of their own; empty tables
    give no row; other columns are ignored.

    Scale: the per-source plan (one row per target source) is all the driver sees. Prefix sums are two-level: token sums per
    slice of a source's hashed order, then within a slice, so a source with most of the documents is spread over 1024 slices.
    """
    return uses(sized, plan(sized, targets, budget=budget, schedules=schedules), seed=seed).orderBy("position", "source", "doc_id", "pass")


def mix_report(uses: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with documents or a target: supply, what was used, and the shares and repeats really reached.

    ``possible_share`` is the target's part of the targets of all sources that have tokens and may be used.
    """
    used = uses.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_uses"), F.sum("n_tokens").alias("used_tokens"), F.max("pass").alias("max_uses_of_a_document")
    )
    supply = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("supply_tokens"))
    wanted = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeat").alias("max_repeat"))
    total = used.agg(F.sum("used_tokens").alias("total"))
    able = wanted.join(supply.filter("supply_tokens > 0"), "source", "left_semi").filter("max_repeat > 0").agg(F.sum("target_share").alias("able"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = supply.join(wanted, supply["source"].eqNullSafe(wanted["source"]), "full").select(F.coalesce(supply["source"], wanted["source"]).alias("source"), "n_docs", "supply_tokens", "target_share", "max_repeat")
    joined = joined.join(used, "source", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(able))  # one row each
    share = F.coalesce(F.try_divide("used_tokens", "total"), F.lit(0.0))
    possible = F.when((F.col("supply_tokens") > 0) & (F.col("max_repeat") > 0), F.try_divide("target_share", "able"))
    return joined.select(
        "source", n("n_docs"), n("supply_tokens"), "target_share", "max_repeat", n("n_uses"), n("used_tokens"), n("max_uses_of_a_document"),
        F.round(possible, 6).alias("possible_share"), F.round(share, 6).alias("actual_share"), F.round(F.coalesce(F.try_divide("used_tokens", "supply_tokens"), F.lit(0.0)), 6).alias("mean_repeats"),
    )
