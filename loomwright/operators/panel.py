"""Entity-by-year panels and the features derived from them, none of which looks past its own time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def current_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of every key the row with the greatest ``order`` columns (nulls least). Combined map-side, so hot keys are no matter.

    Each column is an aggregate of its own, so columns that nobody asks for are pruned down to the scan. Rows equal in ``order``
    must be repeats of one another.
    """
    latest = F.struct(*order)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(c, latest).alias(c) for c in df.columns if c != key]).select(*df.columns)


def yearly_counts(df: DataFrame, key: str, years: str, counts: str, out: str = "cites") -> DataFrame:
    """``key, year, out`` from two parallel arrays; elements with a null year or count are left out."""
    flat = df.select(F.col(key), F.inline(F.arrays_zip(F.col(years).alias("year"), F.col(counts).alias("n"))))
    return flat.dropna(subset=["year", "n"]).groupBy(key, F.col("year").cast("int").alias("year")).agg(F.sum("n").alias(out))


def edge_counts(edges: DataFrame, key: str, year: str, out: str = "cites") -> DataFrame:
    """``key, year, out``: edges per target and year."""
    return edges.dropna(subset=[key, year]).groupBy(key, F.col(year).cast("int").alias("year")).agg(F.count(F.lit(1)).alias(out))


def yearly_targets(entities: DataFrame, panel: DataFrame, key: str, start: str, value: str = "cites", ahead: int = 3) -> DataFrame:
    """``key, start, y0..y{ahead}, total`` with the value 0..ahead years after ``start`` and the sum of years 1..ahead.

    One join and one conditional aggregate; an entity without panel rows has zeros, one with a null start has zeros too.
    """
    lag = F.col("year") - F.col(start)
    at = [F.coalesce(F.sum(F.when(lag == k, F.col(value))), F.lit(0)).alias(f"y{k}") for k in range(ahead + 1)]
    total = F.coalesce(F.sum(F.when(lag.between(1, ahead), F.col(value))), F.lit(0)).alias("total")
    return entities.select(key, start).join(panel, key, "left").groupBy(key, start).agg(*at, total)


def cumulative_as_of(panel: DataFrame, key: str, first: int, last: int, value: str = "cites") -> DataFrame:
    """``key, as_of, cum`` for the years ``first..last``: the sum up to and including ``as_of``; no row before the first value.

    Every panel row is carried to the years it counts in (a bounded number), so no cross join is needed.
    """
    carried = panel.filter(F.col("year") <= last).select(key, value, F.explode(F.sequence(F.greatest(F.col("year"), F.lit(first)), F.lit(last))).alias("as_of"))
    return carried.groupBy(key, "as_of").agg(F.sum(value).alias("cum"))


def member_history(papers: DataFrame, cum: DataFrame, *, paper: str, members: str, year: str, first: int, last: int) -> DataFrame:
    """``member, as_of, n_prior, cites_prior``: papers of a member before ``as_of`` and what they had gathered by then."""
    held = papers.select(paper, F.col(year).alias("_y"), F.explode(members).alias("member")).filter(F.col("member").isNotNull() & (F.col("_y") < last))
    grid = held.withColumn("as_of", F.explode(F.sequence(F.greatest(F.col("_y").cast("int") + 1, F.lit(first)), F.lit(last))))
    joined = grid.join(cum, [paper, "as_of"], "left")
    return joined.groupBy("member", "as_of").agg(F.count(F.lit(1)).alias("n_prior"), F.coalesce(F.sum("cum"), F.lit(0)).alias("cites_prior"))


def team_history(papers: DataFrame, history: DataFrame, *, paper: str, members: str, year: str) -> DataFrame:
    """Per paper the greatest and mean history of its members in its own year, of the first member, and the share of new ones.

    Members count as often as they are listed.
    """
    listed = papers.select(paper, F.col(year).cast("int").alias("as_of"), F.posexplode(members).alias("pos", "member"))
    joined = listed.join(history, ["member", "as_of"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_prior", "cites_prior")})
    first = lambda c: F.max(F.when(F.col("pos") == 0, F.col(c)))
    per = F.coalesce(F.try_divide("cites_prior", "n_prior"), F.lit(0.0))
    return joined.groupBy(paper).agg(
        F.max("cites_prior").alias("cites_max"), F.avg("cites_prior").alias("cites_mean"), F.max("n_prior").alias("papers_max"), F.avg("n_prior").alias("papers_mean"),
        first("cites_prior").alias("first_cites"), first("n_prior").alias("first_papers"), F.avg((F.col("n_prior") == 0).cast("int")).alias("share_new"),
        F.log1p(F.max(per)).alias("log_per_paper_max"), F.log1p(F.avg(per)).alias("log_per_paper_mean"),
    )


def cohort_stats(entities: DataFrame, panel: DataFrame, *, key: str, group: str, year: str, value: str = "cites") -> DataFrame:
    """``group, at, age1_mean, n_age1, y3_mean, n_papers``: what the cohorts of a group show at the end of year ``at``.

    age1: mean log1p of the value one year on, of the cohort of ``at - 1``; y3: mean log1p of the three years' sum, of the
    cohort of ``at - 3``; n_papers: the cohort of ``at`` itself. A row exists where any of the three does.
    """
    lag = F.col("year") - F.col(year)
    own = (
        entities.select(key, F.col(group).alias("group"), year).filter(F.col(year).isNotNull())
        .join(panel, key, "left").groupBy(key, "group", year)
        .agg(F.coalesce(F.sum(F.when(lag == 1, F.col(value))), F.lit(0)).alias("one"), F.coalesce(F.sum(F.when(lag.between(1, 3), F.col(value))), F.lit(0)).alias("three"))
    )
    per = own.groupBy("group", year).agg(F.avg(F.log1p("one")).alias("one"), F.avg(F.log1p("three")).alias("three"), F.count(F.lit(1)).alias("n"))
    # each cohort row is read at three later years: one small explode instead of three joins
    none = lambda t: F.lit(None).cast(t)
    at = F.array(
        F.struct((F.col(year) + 1).alias("at"), F.col("one").alias("age1_mean"), F.col("n").alias("n_age1"), none("double").alias("y3_mean"), none("bigint").alias("n_papers")),
        F.struct((F.col(year) + 3).alias("at"), none("double").alias("age1_mean"), none("bigint").alias("n_age1"), F.col("three").alias("y3_mean"), none("bigint").alias("n_papers")),
        F.struct(F.col(year).cast("int").alias("at"), none("double").alias("age1_mean"), none("bigint").alias("n_age1"), none("double").alias("y3_mean"), F.col("n").alias("n_papers")),
    )
    cols = ["age1_mean", "n_age1", "y3_mean", "n_papers"]
    return per.select("group", F.inline(at)).groupBy("group", "at").agg(*[F.max(c).alias(c) for c in cols])


def dense_grid(panel: DataFrame, key: str, first: int, last: int, values: list[str]) -> DataFrame:
    """``key, year, values`` for every key and every year ``first..last``, missing values as 0. One shuffle, no cross join."""
    years = panel.filter(F.col("year").between(first, last)).select(key, "year", *values)
    grid = panel.select(key).distinct().select(key, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return grid.unionByName(years, allowMissingColumns=True).groupBy(key, "year").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])


def lagged(panel: DataFrame, key: str, value: str, lags: list[int]) -> DataFrame:
    """``key, year, value`` with ``value_lag{k}``: the value k years before (negative: after), from one aggregate.

    Each row is sent to the years that look at it; years without a row of their own are left out.
    """
    sent = F.array(*[F.struct((F.col("year") + k).alias("year"), F.lit(k).alias("k"), F.col(value).alias("v")) for k in [0, *lags]])
    pick = lambda k: F.sum(F.when(F.col("k") == k, F.col("v")))
    out = panel.select(key, F.inline(sent)).groupBy(key, "year").agg(F.max((F.col("k") == 0).cast("int")).alias("_own"), pick(0).alias(value), *[pick(k).alias(f"{value}_lag{k}") for k in lags])
    return out.filter("_own = 1").drop("_own")


def group_shift(df: DataFrame, group: str, year: str, value: str) -> DataFrame:
    """``group, year, previous``: the group's mean of the year before, else that year's mean over all groups, else null."""
    means = df.dropna(subset=[year, value]).groupBy(group, year).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    overall = means.groupBy(year).agg((F.sum("s") / F.sum("n")).alias("overall")).withColumn(year, F.col(year) + 1)
    before = means.select(F.col(group).alias("_g"), (F.col(year) + 1).alias("_y"), F.col("m").alias("own"))
    own = means.select(group, year)
    joined = own.join(before, own[group].eqNullSafe(F.col("_g")) & (own[year] == F.col("_y")), "left").join(overall, year, "left")
    return joined.select(group, year, F.coalesce("own", "overall").alias("previous"))


def fractional_counts(df: DataFrame, key: str, labels: str, scores: str, weight: Column | None = None) -> DataFrame:
    """``label, n, n_weighted``: each row shares one count (and its ``weight``) over its labels in proportion to their scores.

    Elements with a null label or score and rows whose scores sum to 0 are left out.
    """
    pairs = F.filter(F.arrays_zip(F.col(labels).alias("l"), F.col(scores).alias("s")), lambda x: x["l"].isNotNull() & x["s"].isNotNull())
    own = df.select(key, (F.lit(1.0) if weight is None else weight).alias("w"), pairs.alias("p"))
    own = own.withColumn("total", F.aggregate("p", F.lit(0.0), lambda a, x: a + x["s"].cast("double"))).filter("total > 0")
    flat = own.select("w", "total", F.inline("p"))
    return flat.groupBy(F.col("l").alias("label")).agg(F.sum(F.col("s") / F.col("total")).alias("n"), F.sum(F.col("w") * F.col("s") / F.col("total")).alias("n_weighted"))


def as_of_array_sum(years: Column, counts: Column, upto: Column) -> Column:
    """Sum of the counts whose year is at most ``upto``; 0 for null or empty arrays."""
    pairs = F.filter(F.arrays_zip(years.alias("y"), counts.alias("n")), lambda x: x["y"] <= upto)
    return F.aggregate(F.coalesce(pairs, F.array().cast("array<struct<y:smallint,n:int>>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["n"].cast("bigint"), F.lit(0).cast("bigint")))


def leave_one_out(df: DataFrame, group: str, value: str, fallback: str) -> DataFrame:
    """``df`` with ``loo``: the group's mean without the row itself; a lone row takes the mean of its ``fallback`` group.

    Means come from map-side combined aggregates joined back, not from a window over a possibly giant group.
    """
    own = df.groupBy(group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    wide = df.groupBy(fallback).agg(F.avg(value).alias("_m"))
    joined = df.join(own, group, "left").join(wide, fallback, "left")
    return joined.withColumn("loo", F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1)).otherwise(F.col("_m"))).drop("_s", "_n", "_m")


def variance_share(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``grouping, share``: the part of the value's variance that lies between the groups, for each grouping."""
    parts = []
    for g in groups:
        stats = df.dropna(subset=[value]).groupBy(g).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
        total = stats.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
        mean = F.col("s") * F.col("s") / F.col("n")
        parts.append(total.select(F.lit(g).alias("grouping"), F.try_divide(F.col("b") - mean, F.col("q") - mean).alias("share")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def equal_frequency_bins(df: DataFrame, value: str, tie: str, q: int, out: str = "bin") -> DataFrame:
    """``df`` with a bin 1..q of equal frequency by rank (ties by ``tie``); null values have no bin.

    The global rank is two-level: see :func:`global_rank`.
    """
    ranked = global_rank(df.filter(F.col(value).isNotNull()), [value, tie], "_rn", "_n")
    bin_ = F.greatest(F.lit(1), F.ceil((F.col("_rn") - 1) * q / F.greatest(F.col("_n") - 1, F.lit(1)))).cast("int")
    return ranked.withColumn(out, bin_).drop("_rn", "_n").unionByName(df.filter(F.col(value).isNull()), allowMissingColumns=True)


def global_rank(df: DataFrame, order: list[str], out: str, total: str, slices: int = 256) -> DataFrame:
    """``df`` with its row number by ``order`` over all rows, and the number of rows.

    Slices are cut at approximate quantiles of the first order column; equal values share a slice, and are ranked within it by
    the other columns.
    """
    first = F.col(order[0])
    cuts = df.agg(F.percentile_approx(first, [i / slices for i in range(1, slices)], 10_000).alias("_cuts"))
    sliced = df.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < first))).drop("_cuts")  # one row
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = sliced.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(W.partitionBy()).alias(total))
    inside = F.row_number().over(W.partitionBy("_b").orderBy(*order))
    return sliced.join(F.broadcast(starts), "_b").withColumn(out, F.col("_start") + inside).drop("_b", "_start")  # at most `slices` rows


def exact_quantiles(df: DataFrame, column: str, quantiles: list[float], slices: int = 256) -> DataFrame:
    """One row with the array ``values``: interpolated quantiles of the non-null values; null elements for an empty column.

    Equal values are counted first. Counts are summed up slice by slice along the values, and only the values that hold a wanted
    rank are kept, so no state holds the column's distinct values.
    """
    counts = df.select(F.col(column).cast("double").alias("v")).dropna().groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    placed = running_counts(counts, "v", "c", slices)
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    upto = F.col("_before") + F.col("c")
    # of each quantile the values at the ranks on either side of it
    wanted = F.transform(at, lambda q, i: F.struct(i.alias("i"), (q * (F.col("_n") - 1)).alias("p")))
    sides = F.flatten(F.transform(wanted, lambda w: F.array(F.struct(w["i"].alias("i"), w["p"].alias("p"), F.floor(w["p"]).alias("r")), F.struct(w["i"].alias("i"), w["p"].alias("p"), F.ceil(w["p"]).alias("r")))))
    mine = F.filter(sides, lambda s: (s["r"] >= F.col("_before")) & (s["r"] < upto))
    hits = placed.select("v", F.inline(mine))
    lo, hi = F.min("v"), F.max("v")
    each = hits.groupBy("i").agg((lo + (F.first("p") - F.floor(F.first("p"))) * (hi - lo)).alias("q"))
    listed = each.agg(F.map_from_entries(F.collect_list(F.struct("i", "q"))).alias("m"))  # one entry a quantile
    return listed.select(F.transform(F.sequence(F.lit(0), F.lit(len(quantiles) - 1)), lambda i: F.try_element_at("m", i)).alias("values"))


def running_counts(counts: DataFrame, value: str, count: str, slices: int = 256) -> DataFrame:
    """``counts`` (one row per ``value``) with ``_before``, the sum of ``count`` over the lesser values, and ``_n``, the sum of all."""
    cuts = counts.agg(F.percentile_approx(value, [i / slices for i in range(1, slices)], 10_000).alias("_cuts"))
    sliced = counts.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")  # one row
    sums = sliced.groupBy("_b").agg(F.sum(count).alias("_c"))
    ahead = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_b", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_start"), F.sum("_c").over(W.partitionBy()).alias("_n"))
    inside = F.coalesce(F.sum(count).over(W.partitionBy("_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sliced.join(F.broadcast(starts), "_b").withColumn("_before", F.col("_start") + inside).drop("_b", "_start")  # at most `slices` rows


def percent_rank_in(df: DataFrame, cell: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the percent rank of the value in its cell (least 0, alone 0)."""
    return df.withColumn(out, F.percent_rank().over(W.partitionBy(*cell).orderBy(value)))


def gini_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, gini`` of the non-negative part of the value; null where it sums to 0.

    Equal values are counted first, so a group is ranked over its distinct values.
    """
    x = F.greatest(F.col(value).cast("double"), F.lit(0.0))
    counts = df.dropna(subset=[value]).groupBy(group, x.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(group).orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow))
    # ranks i of the c equal values end at `upto`; the sum of 2i is c (2 upto - c + 1)
    ranked = counts.withColumn("r", F.col("c") * (2 * upto - F.col("c") + 1) * F.col("x"))
    s = ranked.groupBy(group).agg(F.sum("r").alias("r"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("x")).alias("s"))
    return s.select(group, F.try_divide(F.col("r") - (F.col("n") + 1) * F.col("s"), F.col("n") * F.col("s")).alias("gini"))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group (``order`` should end in a unique column). Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)
