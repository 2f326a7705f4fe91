"""Regressions with fixed effects and clustered errors, and within-cell permutation.

All row-level work is grouped sums; only Gram matrices (regressors squared) reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.session import materialise


def demean(df: DataFrame, columns: list[str], effects: list[str], weight: str | None = None, tolerance: float = 1e-10, rounds: int = 500) -> DataFrame:
    """``df`` with the columns cleared of the effects' (weighted) group means by alternating projections.

    One effect takes a single pass; several are swept in turn until no value moves by ``tolerance``. Group means come from
    aggregates joined back; a sweep is checkpointed. Columns that still move after ``rounds`` sweeps raise an error.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    for _ in range(1 if len(effects) == 1 else rounds):
        before = df
        for e in effects:
            means = df.groupBy(e).agg(F.sum(w).alias("_dw"), *[F.sum(w * F.col(c)).alias(f"_m_{c}") for c in columns])
            df = df.join(means, df[e].eqNullSafe(means[e])).drop(means[e]).withColumns({c: F.col(c) - F.coalesce(F.try_divide(f"_m_{c}", "_dw"), F.lit(0.0)) for c in columns}).drop("_dw", *[f"_m_{c}" for c in columns])
        if len(effects) == 1:
            return df
        # carry the size of the last move along, so the sweep needs no join with its predecessor
        df = materialise(df)
        norm = lambda d: d.agg(*[F.sum(F.col(c) * F.col(c)).alias(c) for c in columns]).first()
        now, then = norm(df), norm(before)
        # a projection only shortens a vector: equal lengths mean it no longer moves
        if all((then[c] or 0) - (now[c] or 0) <= tolerance * max(1.0, then[c] or 0) for c in columns):
            return df
    raise RuntimeError(f"the columns still move after {rounds} sweeps")


def _gram(df: DataFrame, x: list[str], y: Column, w: Column) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy by one aggregate."""
    k = len(x)
    row = df.agg(
        *[F.sum(w * F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j >= i],
        *[F.sum(w * F.col(a) * y).alias(f"r_{i}") for i, a in enumerate(x)],
    ).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"] or 0.0
    return g, np.array([row[f"r_{i}"] or 0.0 for i in range(k)])


def _clustered(df: DataFrame, x: list[str], residual: Column, cluster: str | None, bread: np.ndarray) -> np.ndarray:
    """Standard errors from scores summed by cluster with the factor g / (g - 1), or by row with n / (n - k) (HC1)."""
    score = [(residual * F.col(c)).alias(f"s_{i}") for i, c in enumerate(x)]
    scores = df.select(*([cluster] if cluster else []), *score)
    if cluster:
        scores = scores.groupBy(cluster).agg(*[F.sum(f"s_{i}").alias(f"s_{i}") for i in range(len(x))])
    scores = scores.withColumn("_one", F.lit(1.0))
    names = [f"s_{i}" for i in range(len(x))]
    meat, _ = _gram(scores, names, F.lit(0.0), F.lit(1.0))
    g = scores.count()
    least = 1 if cluster else len(x)
    factor = g / (g - least) if g > least else 1.0
    return np.sqrt(np.diag(bread @ meat @ bread) * factor)


def _split_effects(df: DataFrame, effects: list[str], most: int = 100) -> tuple[DataFrame, list[str], list[str]]:
    """The effect with most levels stays to be absorbed; others of at most ``most`` levels become indicator columns.

    With one absorbed effect a single pass demeans exactly. Effects with more levels are absorbed by alternating projections.
    """
    if len(effects) < 2:
        return df, [], effects
    levels = {e: [r[0] for r in df.select(e).distinct().limit(most + 1).collect()] for e in effects}
    absorbed = [e for e in effects if len(levels[e]) > most] or [max(effects, key=lambda e: len(levels[e]))]
    names, columns = [], {}
    for e in effects:
        if e not in absorbed:
            for k, v in enumerate(sorted(levels[e], key=lambda v: (v is None, v))[1:]):
                names.append(f"_d_{e}_{k}")
                columns[names[-1]] = F.col(e).eqNullSafe(F.lit(v)).cast("double")
    return df.withColumns(columns), names, absorbed


def fe_ols(df: DataFrame, y: str, x: list[str], effects: list[str], cluster: str | None = None) -> DataFrame:
    """``term, coef, se`` of least squares with absorbed effects; errors clustered, else robust to heteroskedasticity."""
    cols = [y, *x]
    rows = materialise(df.select(*dict.fromkeys([*cols, *effects, *([cluster] if cluster else [])])).dropna(subset=cols).withColumns({c: F.col(c).cast("double") for c in cols}))
    rows, extra, absorbed = _split_effects(rows, effects)
    terms = [*x, *extra]
    within = materialise(demean(rows, [y, *terms], absorbed))
    gram, right = _gram(within, terms, F.col(y), F.lit(1.0))
    bread = np.linalg.pinv(gram)
    coef = bread @ right
    residual = F.col(y) - sum((F.col(c) * float(b) for c, b in zip(terms, coef)), F.lit(0.0))
    se = _clustered(within, terms, residual, cluster, bread)
    return df.sparkSession.createDataFrame([(t, float(c), float(s)) for t, c, s in zip(x, coef, se)], "term string, coef double, se double")


def fe_poisson(df: DataFrame, y: str, x: list[str], effects: list[str], cluster: str | None = None, tolerance: float = 1e-8, rounds: int = 50) -> DataFrame:
    """``term, coef, se`` of a Poisson regression with absorbed effects, by reweighted least squares on demeaned columns.

    Groups of an effect whose outcome is always 0 say nothing about the terms and are dropped first. Coefficients that still move
    after ``rounds`` rounds raise an error. One effect with clustered errors is fitted by :func:`_one_effect`.
    """
    cols = [y, *x]
    rows = df.select(*dict.fromkeys([*cols, *effects, *([cluster] if cluster else [])])).dropna(subset=cols).withColumns({c: F.col(c).cast("double") for c in cols})
    rows = materialise(rows)  # the lines below read them several times
    if len(effects) == 1 and cluster:
        return _one_effect(rows, y, x, effects[0], cluster, tolerance, rounds)
    for e in effects:
        live = rows.groupBy(e).agg(F.sum(y).alias("_s")).filter("_s > 0").select(F.col(e).alias("_e"))
        rows = rows.join(live, rows[e].eqNullSafe(F.col("_e")), "left_semi")
    rows = materialise(rows)
    mean = rows.agg(F.avg(y)).first()[0]
    if not mean:
        return df.sparkSession.createDataFrame([], "term string, coef double, se double")
    rows, extra, absorbed = _split_effects(rows, effects)
    terms = [*x, *extra]
    inner = [f"_x{i}" for i in range(len(terms))]
    base = materialise(rows)
    state = base.withColumn("_eta", F.log((F.col(y) + float(mean)) / 2))
    coef = np.full(len(terms), np.inf)
    for _ in range(rounds):
        mu = F.exp("_eta")
        work = state.withColumn("_w", mu).withColumn("_z", F.col("_eta") + (F.col(y) - mu) / mu).withColumn("_zz", F.col("_z")).withColumns({n: F.col(c) for n, c in zip(inner, terms)})
        flat = materialise(demean(work, [*inner, "_zz"], absorbed, "_w", tolerance=1e-9))
        gram, right = _gram(flat, inner, F.col("_zz"), F.col("_w"))
        new = np.linalg.pinv(gram) @ right
        residual = F.col("_zz") - sum((F.col(c) * float(b) for c, b in zip(inner, new)), F.lit(0.0))
        # what the terms and effects explain of z: z less its residual
        state = flat.withColumn("_eta", F.col("_z") - residual).select(*base.columns, "_eta")
        done = np.max(np.abs(new - coef)) < tolerance
        coef = new
        if done:
            break
    else:
        raise RuntimeError(f"the coefficients still move after {rounds} rounds")
    scored = flat.withColumn("_e", F.col(y) - F.exp(F.col("_z") - residual))
    se = _clustered(scored, inner, F.col("_e"), cluster, np.linalg.pinv(gram))
    return df.sparkSession.createDataFrame([(t, float(c), float(s)) for t, c, s in zip(x, coef, se)], "term string, coef double, se double")


def _one_effect(rows: DataFrame, y: str, x: list[str], effect: str, cluster: str, tolerance: float, rounds: int) -> DataFrame:
    """Poisson regression with one absorbed effect, by Newton steps on the likelihood in which each group's effect is at its best.

    That effect is known from the group's sums, so a round is one aggregate and its state is the coefficients. Rows of equal
    terms, group and cluster are summed up first, which changes nothing. A step that lowers the likelihood is halved.
    """
    names = [f"_x{i}" for i in range(len(x))]
    own = rows.select(F.col(effect).alias("_g"), F.col(cluster).alias("_c"), *[F.col(c).alias(n) for n, c in zip(names, x)], F.col(y).alias("_y"))
    sums = materialise(own.groupBy("_g", "_c", *names).agg(F.sum("_y").alias("_y"), F.count(F.lit(1)).cast("double").alias("_n")))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]

    def groups(b: np.ndarray) -> DataFrame:
        """Per group its outcome, the sum of exp(x b), and the means of the terms and their products by these weights."""
        line = sum((F.col(n) * float(v) for n, v in zip(names, b)), F.lit(0.0))
        weighed = sums.withColumn("_l", line).withColumn("_w", F.col("_n") * F.exp("_l"))
        each = weighed.groupBy("_g").agg(
            F.sum("_y").alias("_t"), F.sum(F.col("_y") * F.col("_l")).alias("_yl"), F.sum("_w").alias("_s"),
            *[F.sum(F.col("_y") * F.col(n)).alias(f"_y{i}") for i, n in enumerate(names)], *[F.sum(F.col("_w") * F.col(n)).alias(f"_s{i}") for i, n in enumerate(names)],
            *[F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])).alias(f"_s{i}_{j}") for i, j in pairs],
        ).filter("_t > 0")
        return each.withColumns({f"_m{k}": F.col(f"_s{k}") / F.col("_s") for k in [*range(len(x)), *(f"{i}_{j}" for i, j in pairs)]})

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
        """Likelihood, slope and curvature."""
        row = groups(b).agg(
            F.sum(F.col("_yl") - F.col("_t") * F.log("_s")).alias("like"), *[F.sum(F.col(f"_y{i}") - F.col("_t") * F.col(f"_m{i}")).alias(f"d{i}") for i in range(len(x))],
            *[F.sum(F.col("_t") * (F.col(f"_m{i}_{j}") - F.col(f"_m{i}") * F.col(f"_m{j}"))).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        if row["like"] is None:
            return None
        h = np.zeros((len(x), len(x)))
        for i, j in pairs:
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
        return row["like"], np.array([row[f"d{i}"] for i in range(len(x))]), h

    schema = "term string, coef double, se double"
    coef = np.zeros(len(x))
    now = at(coef)
    if now is None:
        return rows.sparkSession.createDataFrame([], schema)
    step = np.linalg.pinv(now[2], hermitian=True) @ now[1]
    for _ in range(rounds):
        if np.max(np.abs(step)) < tolerance:
            break
        new = at(coef + step)
        if np.isfinite(new[0]) and np.isfinite(new[2]).all() and new[0] >= now[0] - 1e-12 * abs(now[0]):
            coef, now = coef + step, new
            step = np.linalg.pinv(now[2], hermitian=True) @ now[1]
        else:
            step = step / 2
    else:
        raise RuntimeError(f"the coefficients still move after {rounds} rounds")
    effects = groups(coef).select(F.col("_g").alias("_e"), (F.col("_t") / F.col("_s")).alias("_a"), *[f"_m{i}" for i in range(len(x))])
    joined = sums.join(effects, sums["_g"].eqNullSafe(F.col("_e")))
    line = sum((F.col(n) * float(v) for n, v in zip(names, coef)), F.lit(0.0))
    scored = joined.withColumn("_r", F.col("_y") - F.col("_n") * F.exp(line) * F.col("_a")).withColumns({n: F.col(n) - F.col(f"_m{i}") for i, n in enumerate(names)})
    se = _clustered(scored, names, F.col("_r"), "_c", np.linalg.pinv(now[2], hermitian=True))
    return rows.sparkSession.createDataFrame([(t, float(c), float(v)) for t, c, v in zip(x, coef, se)], schema)


def _cell_rank(df: DataFrame, salt: str, seed: int, out: str) -> DataFrame:
    """``df`` with its rank in the cell by a hash of the key, counted in 64 slices of the hash so that no cell is one task's."""
    h = F.xxhash64("key", F.lit(salt), F.lit(seed))
    sliced = df.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned("_h", 58))
    counts = sliced.groupBy("cell", "_b").agg(F.count(F.lit(1)).alias("_c"))
    start = F.coalesce(F.sum("_c").over(W.partitionBy("cell").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("cell").alias("_cell"), F.col("_b").alias("_bb"), start.alias("_start"))
    joined = sliced.join(starts, sliced["cell"].eqNullSafe(F.col("_cell")) & (F.col("_b") == F.col("_bb")))
    inside = F.row_number().over(W.partitionBy("cell", "_b").orderBy("_h", "key"))
    return joined.withColumn(out, F.col("_start") + inside).drop("_h", "_b", "_cell", "_bb", "_start")


def permute_within(df: DataFrame, cell: str, key: str, value: str, seed: int) -> DataFrame:
    """``key, cell, value, permuted``: the cell's values dealt out to its rows in another order, fixed by hash and seed.

    Rows and values are ranked by two different hashes of a unique key and matched by rank.
    """
    rows = df.select(F.col(key).alias("key"), F.col(cell).alias("cell"), F.col(value).alias("value"))
    here = _cell_rank(rows, "row", seed, "_r")
    drawn = _cell_rank(rows, "draw", seed, "_d").select(F.col("cell").alias("_c"), "_d", F.col("value").alias("permuted"))
    return here.join(drawn, here["cell"].eqNullSafe(drawn["_c"]) & (F.col("_r") == F.col("_d"))).select("key", "cell", "value", "permuted")


def placebo(df: DataFrame, y: str, x: str, cell: str, key: str, *, draws: int = 200, at_once: int = 25, seed: int = 2026) -> DataFrame:
    """One row ``coef, low, high, p, n_draws``: the slope of ``y`` on ``x`` with cell effects, and how it stands among the slopes after
    the cells' x are dealt out again at random.

    ``low`` and ``high`` bound the middle 95 % of the draws; p is two-sided, (1 + draws at least as far from 0) / (1 + draws). A
    permutation within the cells keeps the cell means, so of each draw only the product sum with the demeaned y is new; ``at_once``
    draws are dealt and summed in one job. Rows with a null y or x take no part; ``key`` is unique. Without variation of x the
    slope and all that follows is null.
    """
    rows = df.select(F.col(key).alias("key"), F.col(cell).alias("cell"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")).dropna(subset=["y", "x"])
    within = materialise(demean(rows, ["y", "x"], ["cell"]))
    xy, xx = within.agg(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).first()
    schema = "coef double, low double, high double, p double, n_draws int"
    if not xx:
        return df.sparkSession.createDataFrame([(None, None, None, None, 0)], schema)
    slopes: list[float] = []
    for first in range(0, draws, at_once):
        dealt = within.withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(min(draws, first + at_once) - 1))))
        dealt = dealt.select(F.struct("draw", "key").alias("key"), F.struct("draw", "cell").alias("cell"), F.struct("x", "y").alias("value"))
        mixed = permute_within(dealt, "cell", "key", "value", seed)
        sums = mixed.groupBy(F.col("key.draw").alias("draw")).agg(F.sum(F.col("permuted.x") * F.col("value.y")).alias("s")).collect()  # `at_once` rows
        slopes += [r["s"] / xx for r in sorted(sums, key=lambda r: r["draw"])]
    coef, b = xy / xx, np.array(slopes)
    low, high = np.quantile(b, [0.025, 0.975])
    p = (1 + int((np.abs(b) >= abs(coef) - 1e-12).sum())) / (1 + len(b))
    return df.sparkSession.createDataFrame([(float(coef), float(low), float(high), float(p), len(b))], schema)


def pair_poisson(pairs: DataFrame, first: str, second: str, *, least: int = 30) -> DataFrame:
    """One row ``coef, se, n_pairs, change``: a Poisson regression of the outcome on "is the second of its pair" with pair effects.

    With pair effects the likelihood is that of the split of each pair's sum, so the coefficient is the log ratio of the sums; the
    error is clustered by pair. Pairs with a null or with two zeros say nothing and are left out; with fewer than ``least`` pairs
    there is no row; ``change`` is the relative change, exp(coef) - 1.
    """
    a, b = F.col(first).cast("double"), F.col(second).cast("double")
    live = pairs.select(a.alias("a"), b.alias("b")).dropna().filter("a + b > 0")
    share = live.agg((F.sum("b") / F.sum(F.col("a") + F.col("b"))).alias("q"), F.log(F.nullif(F.sum("b"), F.lit(0.0)) / F.nullif(F.sum("a"), F.lit(0.0))).alias("coef"))
    n = F.col("a") + F.col("b")
    score = F.col("b") - n * F.col("q")
    s = live.crossJoin(F.broadcast(share)).agg(F.first("coef").alias("coef"), F.sum(score * score).alias("m"), F.sum(n * F.col("q") * (1 - F.col("q"))).alias("h"), F.count(F.lit(1)).alias("n_pairs"))  # one row
    se = F.sqrt(F.col("m") * F.col("n_pairs") / F.greatest(F.col("n_pairs") - 1, F.lit(1))) / F.nullif(F.col("h"), F.lit(0.0))
    return s.filter(F.col("n_pairs") >= least).select("coef", se.alias("se"), "n_pairs", F.expm1("coef").alias("change"))


def event_effects(panel: DataFrame, *, base: int = 0) -> DataFrame:
    """``rel, effect, se, n_groups`` of an event panel(grp, unit, treated, rel, value): how far the treated unit has moved since ``base``
    beyond its controls, with unit and group-by-time effects, and errors clustered by group.

    In each group the regression compares the treated unit with the mean of its controls, and weighs groups by n / (n + 1) for n
    controls; groups without controls or without a treated unit have no say.
    """
    mean = lambda t: F.avg(F.when(F.col("treated") == t, F.col("value")))
    own = panel.groupBy("grp", "rel").agg((mean(1) - mean(0)).alias("gap"), F.count(F.when(F.col("treated") == 0, 1)).alias("n")).dropna(subset=["gap"])
    start = own.filter(F.col("rel") == base).select("grp", F.col("gap").alias("gap0"))
    d = own.join(start, "grp").select("rel", "grp", (F.col("gap") - F.col("gap0")).alias("d"), (F.col("n") / (F.col("n") + 1)).alias("w"))
    means = d.groupBy("rel").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("effect"))
    s = (F.col("w") * (F.col("d") - F.col("effect"))) ** 2
    g = F.count(F.lit(1))
    se = F.sqrt(F.sum(s) * g / F.greatest(g - 1, F.lit(1))) / F.sum("w")
    return d.join(means, "rel").groupBy("rel").agg(F.first("effect").alias("effect"), se.alias("se"), g.alias("n_groups"))


def doubling_effect(coef: float) -> float:
    """Relative change of the outcome if a regressor in logs is doubled."""
    return 2**coef - 1
