"""Competition between similar papers: pre-emption, twins, waves, descriptors, matched controls and event panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.functions.columns import overlap


def with_ends(pairs: DataFrame, papers: DataFrame, key: str, a: str, b: str, cols: list[str]) -> DataFrame:
    """``pairs`` with the papers' ``cols`` of both ends, suffixed by the end's name; pairs with an unknown end are dropped."""
    for end in (a, b):
        pairs = pairs.join(papers.select(F.col(key).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in cols]), end)
    return pairs


def precise(precision: str) -> Column:
    return F.col(precision) != "year"


def preempted(pairs: DataFrame, *, least: float, days: int = 183) -> DataFrame:
    """``q, n_preempted, min_days`` of pairs(q, m, sim, date_q, date_m, precision_*, year_*, author_ids_*, cites flags).

    A rival pre-empts if it is similar enough, of the same or the year before, 1 to ``days`` days earlier with both dates
    precise, by other authors, and neither cites the other.
    """
    gap = F.datediff("date_q", "date_m")
    lag = F.col("year_m") - F.col("year_q")
    fits = (F.col("sim") >= least) & lag.between(-1, 0) & gap.between(1, days) & precise("precision_q") & precise("precision_m")
    apart = ~overlap("author_ids_q", "author_ids_m") & ~F.col("a_cites_b") & ~F.col("b_cites_a")
    return pairs.filter(fits & apart).groupBy("q").agg(F.count(F.lit(1)).alias("n_preempted"), F.min(gap).alias("min_days"))


def twin_pairs(pairs: DataFrame, *, days: int = 183, coarse_days: int = 31) -> DataFrame:
    """``early_id, late_id, sim, gap, same_year, both_day``: unordered pairs by disjoint authors, 1 to ``days`` days apart.

    Both dates are precise; a gap with a month-precise end must be at least ``coarse_days``.
    """
    gap = F.abs(F.datediff("date_q", "date_m"))
    both_day = (F.col("precision_q") == "day") & (F.col("precision_m") == "day")
    fits = precise("precision_q") & precise("precision_m") & gap.between(1, days) & (both_day | (gap >= coarse_days)) & ~overlap("author_ids_q", "author_ids_m")
    q_first = F.col("date_q") < F.col("date_m")
    rows = pairs.filter(fits).select(
        F.when(q_first, F.col("q")).otherwise(F.col("m")).alias("early_id"), F.when(q_first, F.col("m")).otherwise(F.col("q")).alias("late_id"),
        "sim", gap.alias("gap"), (F.col("year_q") == F.col("year_m")).alias("same_year"), both_day.alias("both_day"),
    )
    return rows.groupBy("early_id", "late_id", "gap", "same_year", "both_day").agg(F.max("sim").alias("sim"))


def wave_position(pairs: DataFrame) -> DataFrame:
    """``q`` with its rivals of the year before, independent ones of the same and next year, followers, and the share before."""
    lag = F.col("year_m") - F.col("year_q")
    apart = ~F.col("a_cites_b") & ~F.col("b_cites_a")
    n = lambda c: F.count(F.when(c, 1))
    w = pairs.groupBy("q").agg(n(lag == -1).alias("prior"), n((lag == 0) & apart).alias("same_year_independent"), n((lag == 1) & apart).alias("next_year_independent"), n((lag == 1) & F.col("b_cites_a")).alias("followers"))
    wave = F.col("prior") + F.col("same_year_independent") + F.col("next_year_independent")
    return w.withColumn("wave", wave).withColumn("share_before", F.when(wave > 0, F.try_divide("prior", "wave")))


def descriptors(rivals: DataFrame, strength: str, top: int = 10) -> DataFrame:
    """``q`` with the size, mean similarity of the ``top`` best, and the mean and greatest log strength of its rivals(q, sim, rank)."""
    s = F.log1p(F.coalesce(F.col(strength), F.lit(0)))
    return rivals.groupBy("q").agg(F.count(F.lit(1)).alias("n_rivals"), F.avg(F.when(F.col("rank") <= top, F.col("sim"))).alias("sim_top"), F.avg(s).alias("strength_mean"), F.max(s).alias("strength_max"))


def matched_controls(treated: DataFrame, controls: DataFrame, *, key: str, within: list[str], on: list[str], n: int = 3, caliper: float = 0.3, scale: float = 100.0) -> DataFrame:
    """``treated_id, control_id, distance, rank``: the n nearest controls of the same ``within`` cell, with replacement.

    Distance is Euclidean over ``on`` and at most ``caliper``. The first feature is part of the join key: a unit meets only the
    controls whose first feature falls in its own or a neighbouring caliper-wide bin, so a giant cell is never joined whole.
    """
    bin_ = lambda c: F.floor(F.col(c) / caliper)
    t = treated.select(F.col(key).alias("treated_id"), *within, *[F.col(c).alias(f"t_{c}") for c in on]).withColumn("_b", F.explode(F.sequence(bin_(f"t_{on[0]}") - 1, bin_(f"t_{on[0]}") + 1)))
    c = controls.select(F.col(key).alias("control_id"), *within, *[F.col(c).alias(f"c_{c}") for c in on]).withColumn("_b", bin_(f"c_{on[0]}"))
    distance = F.sqrt(sum(((F.col(f"t_{k}") - F.col(f"c_{k}")) ** 2 for k in on), F.lit(0.0)))
    near = t.join(c, [*within, "_b"]).filter("treated_id <> control_id").withColumn("distance", F.round(distance, 9)).filter(F.col("distance") <= caliper)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("treated_id").orderBy("distance", "control_id"))).filter(F.col("rank") <= n).select("treated_id", "control_id", "distance", "rank")


def event_panel(matches: DataFrame, panel: DataFrame, starts: DataFrame, *, key: str, start: str, value: str, last: int) -> DataFrame:
    """``grp, unit, treated, rel, value``: every matched unit's yearly value on the dense offsets 0..last from its start."""
    units = matches.select(F.col("treated_id").alias("grp"), F.col("treated_id").alias(key), F.lit(1).alias("treated")).unionByName(
        matches.select(F.col("treated_id").alias("grp"), F.col("control_id").alias(key), F.lit(0).alias("treated"))
    ).distinct()
    grid = units.join(starts.select(key, start), key).withColumn("rel", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn("year", F.col(start).cast("int") + F.col("rel"))
    return grid.join(panel.select(key, "year", value), [key, "year"], "left").select("grp", F.col(key).alias("unit"), "treated", "rel", F.coalesce(value, F.lit(0)).alias("value"))
