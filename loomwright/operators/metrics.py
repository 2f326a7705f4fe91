"""Scores of predictions: errors, within-group rankings, and their uncertainty."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.operators.panel import exact_quantiles, running_counts
from loomwright.session import materialise

#: Rankings that Kendall's tau compares pair by pair.
MAX_RANKED = 5_000


def error_metrics(df: DataFrame, pred: str, y: str) -> DataFrame:
    """One row ``male, rmsle, mae, rmse, n``: ``pred`` is on the log1p scale, ``y`` is not. Null rows are refused by count."""
    e = F.col(pred) - F.log1p(y)
    raw = F.greatest(F.expm1(pred), F.lit(0.0)) - F.col(y)
    return df.agg(
        F.avg(F.abs(e)).alias("male"), F.sqrt(F.avg(e * e)).alias("rmsle"), F.avg(F.abs(raw)).alias("mae"), F.sqrt(F.avg(raw * raw)).alias("rmse"),
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(pred).isNull() | F.col(y).isNull(), 1)).alias("n_missing"),
    )


def _average_ranks(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Average rank of every value in its group: ranks run over distinct values, joined back to the rows."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.join(counts.select(group, value, (upto - (F.col("_c") - 1) / 2).alias(out)), [group, value])


def _overall_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank of every value over all rows, counted in slices of the values, so no task ranks everything."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    placed = running_counts(counts, value, "_c")
    return df.join(placed.select(value, (F.col("_before") + (F.col("_c") + 1) / 2).alias(out)), value)


def _pearson(ranked: DataFrame, group: list[str], least: int) -> DataFrame:
    s = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rp").alias("sp"), F.sum("ry").alias("sy"), F.sum(F.col("rp") * F.col("rp")).alias("pp"),
        F.sum(F.col("ry") * F.col("ry")).alias("yy"), F.sum(F.col("rp") * F.col("ry")).alias("py"),
    ).filter(F.col("n") >= least)
    n = F.col("n")
    cov, vp, vy = n * F.col("py") - F.col("sp") * F.col("sy"), n * F.col("pp") - F.col("sp") ** 2, n * F.col("yy") - F.col("sy") ** 2
    return s.select(*group, "n", F.when((vp <= 0) | (vy <= 0), 0.0).otherwise(F.try_divide(cov, F.sqrt(vp) * F.sqrt(vy))).alias("rho"))


def group_spearman(df: DataFrame, group: str, pred: str, y: str, least: int = 10) -> DataFrame:
    """``group, n, rho`` for groups of at least ``least`` rows; rho is 0 where either side is constant.

    Pearson on average ranks from plain sums, guarded against zero variance. Rows with a null take no part.
    """
    rows = df.select(group, F.col(pred).alias("_p"), F.col(y).alias("_y")).dropna()
    return _pearson(_average_ranks(_average_ranks(rows, group, "_p", "rp"), group, "_y", "ry"), [group], least)


def spearman(df: DataFrame, pred: str, y: str) -> DataFrame:
    """One row ``n, rho`` over all rows."""
    rows = df.select(F.col(pred).alias("_p"), F.col(y).alias("_y")).dropna()
    return _pearson(_overall_ranks(_overall_ranks(rows, "_p", "rp"), "_y", "ry"), [], 2)


def group_ndcg(df: DataFrame, group: str, pred: str, y: str, key: str, k: int = 10, least: int = 20) -> DataFrame:
    """``group, n, ndcg`` at ``k`` for groups of at least ``least`` rows with a positive sum; ties of ``pred`` go to the least key."""
    rows = df.select(group, key, F.col(pred).alias("_p"), F.col(y).cast("double").alias("_y")).dropna(subset=["_p", "_y"])
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s")).filter((F.col("n") >= least) & (F.col("s") > 0))
    gain = F.col("_y") / F.log2(F.col("at") + 1)

    def best(order: list) -> DataFrame:
        top = rows.withColumn("at", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("at") <= k)
        return top.groupBy(group).agg(F.sum(gain).alias("_gain"))

    got, ideal = best([F.desc("_p"), F.col(key)]).withColumnRenamed("_gain", "_dcg"), best([F.desc("_y"), F.col(key)])
    return sizes.join(got, group).join(ideal, group).select(group, "n", (F.col("_dcg") / F.col("_gain")).alias("ndcg"))


def share_l1(df: DataFrame, group: str, pred: str, y: str, least: int = 10) -> DataFrame:
    """``group, n, l1``: distance of predicted and true shares within the group; equal shares where nothing is predicted."""
    r = F.greatest(F.expm1(pred), F.lit(0.0))
    rows = df.select(group, r.alias("_r"), F.col(y).cast("double").alias("_y")).dropna()
    sums = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("sr"), F.sum("_y").alias("sy")).filter((F.col("n") >= least) & (F.col("sy") > 0))
    share = F.when(F.col("sr") > 0, F.try_divide("_r", "sr")).otherwise(1 / F.col("n"))
    return rows.join(sums, group).groupBy(group).agg(F.max("n").alias("n"), F.sum(F.abs(share - F.col("_y") / F.col("sy"))).alias("l1"))


def precision_at_k(df: DataFrame, group: str, pred: str, y: str, key: str, k: int = 10, least: int = 20, q: float = 0.9) -> DataFrame:
    """``group, precision``: part of the k best predicted rows that reach the group's ``q`` quantile of ``y``."""
    rows = df.select(group, key, F.col(pred).alias("_p"), F.col(y).cast("double").alias("_y")).dropna(subset=["_p", "_y"])
    cut = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.percentile("_y", F.lit(q)).alias("cut")).filter((F.col("n") >= least) & (F.col("s") > 0))
    top = rows.withColumn("at", F.row_number().over(W.partitionBy(group).orderBy(F.desc("_p"), key))).filter(F.col("at") <= k)
    return top.join(cut, group).groupBy(group).agg(F.avg((F.col("_y") >= F.col("cut")).cast("int")).alias("precision"))


def early_detection(df: DataFrame, scores: list[str], y: str, shares: list[float]) -> DataFrame:
    """``score, top, recall``: part of the rows in the top share of ``y`` that are also in the top share of each score."""
    cuts = None
    for c in [*scores, y]:
        own = exact_quantiles(df, c, [1 - s for s in shares]).select(*[F.col("values")[i].alias(f"{c}_{i}") for i in range(len(shares))])
        cuts = own if cuts is None else cuts.crossJoin(own)  # one row each
    hit = lambda c, i: F.col(c) >= F.col(f"{c}_{i}")
    wide = df.crossJoin(F.broadcast(cuts)).agg(  # one row
        *[F.try_divide(F.count(F.when(hit(c, i) & hit(y, i), 1)), F.count(F.when(hit(y, i), 1))).alias(f"r_{c}_{i}") for c in scores for i in range(len(shares))]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("score"), F.lit(s).alias("top"), F.col(f"r_{c}_{i}").alias("recall")) for c in scores for i, s in enumerate(shares)])
    return wide.select(F.inline(rows))


def error_decomposition(df: DataFrame, group: str, error: str) -> DataFrame:
    """One row ``mse, bias2, between, within``: the mean squared error as squared bias, variance of group means, and the rest."""
    g = df.dropna(subset=[error]).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(error).alias("s"), F.sum(F.col(error) * F.col(error)).alias("q"))
    t = g.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    n = F.col("n")
    bias2 = (F.col("s") / n) ** 2
    return t.select((F.col("q") / n).alias("mse"), bias2.alias("bias2"), (F.col("b") / n - bias2).alias("between"), ((F.col("q") - F.col("b")) / n).alias("within"))


def kendall(df: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """One row ``tau``: Kendall's tau-a of two scores over the items, for rankings of at most ``MAX_RANKED`` items; more are refused."""
    df = materialise(df.select(item, a, b))
    if df.limit(MAX_RANKED + 1).count() > MAX_RANKED:
        raise ValueError(f"more than {MAX_RANKED} items to rank")
    x, y = df.select(F.col(item).alias("i"), F.col(a).alias("a1"), F.col(b).alias("b1")), df.select(F.col(item).alias("j"), F.col(a).alias("a2"), F.col(b).alias("b2"))
    sign = F.signum(F.col("a1") - F.col("a2")) * F.signum(F.col("b1") - F.col("b2"))
    return x.join(y, F.col("i") < F.col("j")).agg(F.avg(sign).alias("tau"))


def evaluate(df: DataFrame, methods: dict[str, str], *, y: str, group: str, key: str) -> DataFrame:
    """One row per method: ``method, n, male, rmsle, rho_sub, rho_all, ndcg10`` of the prediction columns ``methods`` (on the log1p scale).

    rho_sub is the mean of the groups' Spearman correlations by size, ndcg10 the mean over the groups that can be ranked. Rows
    with a null prediction or outcome are refused: a method is scored on all rows or not at all.
    """
    missing = df.agg(*[F.count(F.when(F.col(c).isNull() | F.col(y).isNull(), 1)).alias(m) for m, c in methods.items()]).first()
    for m in methods:
        if missing[m]:
            raise ValueError(f"{missing[m]} rows without a prediction of {m} or an outcome")
    out = None
    for m, c in methods.items():
        e = error_metrics(df, c, y).select("n", "male", "rmsle")
        g = group_spearman(df, group, c, y).agg((F.sum(F.col("rho") * F.col("n")) / F.sum("n")).alias("rho_sub"))
        a = spearman(df, c, y).select(F.col("rho").alias("rho_all"))
        d = group_ndcg(df, group, c, y, key).agg(F.avg("ndcg").alias("ndcg10"))
        row = e.crossJoin(g).crossJoin(a).crossJoin(d).select(F.lit(m).alias("method"), "n", "male", "rmsle", "rho_sub", "rho_all", "ndcg10")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def compare(df: DataFrame, methods: dict[str, str], *, y: str, cluster: str, draws: int = 1_000, seed: int = 2026) -> DataFrame:
    """``method_a, method_b, diff, low, high, n_groups``: differences in mean absolute log error of every two methods, with the intervals
    of a paired bootstrap over whole clusters, the same draws for all."""
    names = list(methods)
    losses = df.select(cluster, *[F.abs(F.col(c) - F.log1p(y)).alias(m) for m, c in methods.items()])
    out = None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            row = bootstrap_difference(losses, cluster, a, b, draws, seed).select(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def reversals(results: DataFrame) -> DataFrame:
    """Pairs of methods that two metrics rank the other way round, each beyond doubt: of results(metric, method_a, method_b, low, high),
    where low and high bound a - b, the rows ``method_a, method_b, metric_1, metric_2`` with an interval above 0 by one metric and below 0
    by the other."""
    sure = results.select("metric", "method_a", "method_b", F.when(F.col("low") > 0, 1).when(F.col("high") < 0, -1).alias("side")).dropna()
    x, y = (sure.select("method_a", "method_b", F.col("metric").alias(f"metric_{k}"), F.col("side").alias(f"side_{k}")) for k in (1, 2))
    return x.join(y, ["method_a", "method_b"]).filter("metric_1 < metric_2 and side_1 <> side_2").select("method_a", "method_b", "metric_1", "metric_2")


def bootstrap_difference(df: DataFrame, group: str, loss_a: str, loss_b: str, draws: int = 1_000, seed: int = 2026, most: int = 1_000_000) -> DataFrame:
    """One row ``diff, low, high, n_groups``: mean loss difference a - b and its 95 % interval, resampling whole groups.

    Groups are summed in Spark; the (at most ``most``) group sums are weighted by multinomial draws on the driver, the same
    for both losses, as ratios of sums.
    """
    sums = df.dropna(subset=[loss_a, loss_b]).groupBy(group).agg(F.sum(loss_a).alias("a"), F.sum(loss_b).alias("b"), F.count(F.lit(1)).alias("n")).orderBy(group).limit(most + 1).toPandas()
    if len(sums) > most:
        raise ValueError(f"more than {most} groups")
    k = len(sums)
    if not k:
        return df.sparkSession.createDataFrame([], "diff double, low double, high double, n_groups bigint")
    rng = np.random.default_rng(seed)
    diffs = np.empty(draws)
    for i in range(draws):
        w = np.bincount(rng.integers(0, k, k), minlength=k)
        diffs[i] = (w @ (sums["a"] - sums["b"]).to_numpy()) / (w @ sums["n"].to_numpy())
    low, high = np.quantile(diffs, [0.025, 0.975])
    return df.sparkSession.createDataFrame([(float(diffs.mean()), float(low), float(high), k)], "diff double, low double, high double, n_groups bigint")


def signed_rank(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``n, w_plus, w_minus, share_less, share_more``: Wilcoxon's signed ranks of a - b, zero differences left out."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).dropna()
    ranked = _overall_ranks(d.filter("d <> 0").select(F.abs("d").alias("_v"), "d"), "_v", "r")
    sums = ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))
    shares = d.agg(F.avg((F.col("d") < 0).cast("int")).alias("share_less"), F.avg((F.col("d") > 0).cast("int")).alias("share_more"))
    return sums.crossJoin(F.broadcast(shares))  # one row each
