"""Models over features: naive levels, boosting, calibration, stacking, and dense feature assembly."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.panel import global_rank


def standardise(df: DataFrame, columns: list[str], train, clip: float = 8.0) -> DataFrame:
    """``df`` with ``{c}_z`` scaled by the training rows' mean and deviation, missing as 0 beside ``{c}_na``, clipped."""
    row = df.filter(train).agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    wide = df.crossJoin(F.broadcast(row))  # one row
    z = {}
    for c in columns:
        scaled = F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s")), F.lit(0.0))
        z[f"{c}_z"] = F.greatest(F.lit(-clip), F.least(F.lit(clip), scaled))
        z[f"{c}_na"] = F.col(c).isNull().cast("int")
    return wide.withColumns(z).drop(*row.columns)


def frequent_codes(df: DataFrame, column: str, train, least: int = 20) -> DataFrame:
    """``df`` with ``{column}_code``: 1.. by falling training frequency for values seen ``least`` times there, else 0.

    The code book is ranked in slices and joined, whatever its size; the driver sees none of it.
    """
    counts = df.filter(train).filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    ranked = global_rank(counts.withColumn("_f", -F.col("n")), ["_f", column], "_code", "_n")
    book = ranked.select(column, F.col("_code").cast("int").alias(f"{column}_code"))
    return df.join(book, column, "left").withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(0)))


def rival_tensor(rivals: DataFrame, query: str, rank: str, features: list[str], size: int) -> DataFrame:
    """``query, rows, n``: the features of the first ``size`` rivals in rank order, as an array of arrays padded with zeros."""
    row = F.struct(F.col(rank).alias("k"), F.array(*[F.coalesce(F.col(f).cast("float"), F.lit(0.0).cast("float")) for f in features]).alias("x"))
    own = rivals.filter(F.col(rank) <= size).groupBy(query).agg(F.array_sort(F.collect_list(row)).alias("l"))
    zeros = F.array(*[F.lit(0.0).cast("float") for _ in features])
    listed = F.transform("l", lambda s: s["x"])
    return own.select(query, F.concat(listed, F.array_repeat(zeros, F.lit(size) - F.size("l"))).alias("rows"), F.size("l").alias("n"))


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df.fillna(0, features))


def boosted(df: DataFrame, features: list[str], y: str, train, *, trees: int = 20, depth: int = 5, seed: int = 1) -> DataFrame:
    """``df`` with ``pred`` by gradient-boosted trees on the training rows."""
    rows = _assembled(df, features)
    model = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="pred", maxIter=trees, maxDepth=depth, seed=seed).fit(rows.filter(train))
    return model.transform(rows).drop("_x")


def ridge(df: DataFrame, features: list[str], y: str, train, *, penalty: float = 1.0, weight: str | None = None) -> DataFrame:
    """``df`` with ``pred`` by ridge regression on the training rows."""
    rows = _assembled(df, features)
    reg = LinearRegression(featuresCol="_x", labelCol=y, predictionCol="pred", regParam=penalty, elasticNetParam=0.0)
    reg = reg.setWeightCol(weight) if weight else reg
    return reg.fit(rows.filter(train)).transform(rows).drop("_x")


def isotonic(df: DataFrame, pred: str, y: str, fit_on) -> DataFrame:
    """``df`` with ``calibrated``: an isotonic map of the prediction fitted on the validation rows."""
    rows = _assembled(df, [pred])
    return IsotonicRegression(featuresCol="_x", labelCol=y, predictionCol="calibrated").fit(rows.filter(fit_on)).transform(rows).drop("_x")


def stack(df: DataFrame, preds: list[str], y: str, fit_on, *, rounds: int = 500) -> DataFrame:
    """One row per term: non-negative weights of the predictions and a free intercept that fit ``y`` best (least squares).

    One aggregate gives the normal equations; they are solved on the driver by coordinate descent.
    """
    x = [F.lit(1.0), *[F.col(p) for p in preds]]
    k = len(x)
    row = df.filter(fit_on).dropna(subset=[*preds, y]).agg(*[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)], *[F.sum(x[i] * F.col(y)).alias(f"r{i}") for i in range(k)]).first()
    g = np.array([[row[f"g{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
    r = np.array([row[f"r{i}"] or 0.0 for i in range(k)])
    w = np.zeros(k)
    for _ in range(rounds):
        for i in range(k):
            if g[i, i] > 0:
                free = w[i] + (r[i] - g[i] @ w) / g[i, i]
                w[i] = free if i == 0 else max(0.0, free)
    return df.sparkSession.createDataFrame([(t, float(v)) for t, v in zip(["intercept", *preds], w)], "term string, weight double")


def naive_levels(df: DataFrame, *, group: str, year: str, value: str, test) -> DataFrame:
    """``df`` with ``carry`` (mean over all training rows) and ``history`` (the group's training mean, else ``carry``)."""
    known = df.filter(~test)
    groups = known.groupBy(F.col(group).alias("_g")).agg(F.avg(value).alias("_h"))
    overall = known.agg(F.avg(value).alias("carry"))
    joined = df.join(groups, df[group].eqNullSafe(F.col("_g")), "left").crossJoin(F.broadcast(overall))  # one row
    return joined.withColumn("history", F.coalesce("_h", "carry")).drop("_g", "_h")


def segment_log_softmax(df: DataFrame, group: str, score: str) -> DataFrame:
    """``df`` with ``log_share``: the score's log-softmax within its group, from map-side combined sums."""
    top = df.groupBy(F.col(group).alias("_g")).agg(F.max(score).alias("_m"))
    shifted = df.join(top, df[group].eqNullSafe(F.col("_g"))).drop("_g")
    total = shifted.groupBy(F.col(group).alias("_g")).agg(F.log(F.sum(F.exp(F.col(score) - F.col("_m")))).alias("_l"))
    return shifted.join(total, shifted[group].eqNullSafe(F.col("_g"))).withColumn("log_share", F.col(score) - F.col("_m") - F.col("_l")).drop("_g", "_m", "_l")
