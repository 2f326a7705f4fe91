"""Queries that score predictions, and the regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import econ as E
from loomwright.operators import metrics as M
from loomwright.plans.base import SCORED_SQL, scored
from loomwright.registry import query

SC = f"WITH {SCORED_SQL}"
r6 = lambda c: F.round(c, 6)


@query("error_metrics", SC + ", e AS (SELECT pred_a - ln(1 + y) AS e, greatest(exp(pred_a) - 1, 0) - y AS r FROM scored) SELECT round(avg(abs(e)), 6) AS male, round(sqrt(avg(e * e)), 6) AS rmsle, round(avg(abs(r)), 6) AS mae, round(sqrt(avg(r * r)), 6) AS rmse, count(*) AS n, 0::BIGINT AS n_missing FROM e")
def q_errors(spark: SparkSession, d: str) -> DataFrame:
    return M.error_metrics(scored(spark, d), "pred_a", "y").withColumns({c: r6(c) for c in ("male", "rmsle", "mae", "rmse")})


RANK_SQL = """rk AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY pred_a) + (count(*) OVER (PARTITION BY g, pred_a) - 1) / 2 AS rp, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM scored WHERE g IS NOT NULL),
rho AS (SELECT g, count(*) AS n, CASE WHEN max(rp) = min(rp) OR max(ry) = min(ry) THEN 0.0 ELSE corr(rp, ry) END AS rho FROM rk GROUP BY g HAVING count(*) >= 10)"""


@query("group_spearman", f"{SC}, {RANK_SQL} SELECT g, n, round(rho, 6) AS rho FROM rho")
def q_spearman(spark: SparkSession, d: str) -> DataFrame:
    return M.group_spearman(scored(spark, d), "g", "pred_a", "y").withColumn("rho", r6("rho"))


@query("mean_spearman", f"{SC}, {RANK_SQL} SELECT round(sum(rho * n) / sum(n), 6) AS rho_sub, CAST(sum(n) AS BIGINT) AS n FROM rho")
def q_mean_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Within-group Spearman averaged with the groups' sizes."""
    g = M.group_spearman(scored(spark, d), "g", "pred_a", "y")
    return g.agg(r6(F.sum(F.col("rho") * F.col("n")) / F.sum("n")).alias("rho_sub"), F.sum("n").alias("n"))


@query("spearman_all", SC + ", r AS (SELECT rank() OVER (ORDER BY pred_a) + (count(*) OVER (PARTITION BY pred_a) - 1) / 2 AS rp, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM scored) SELECT count(*) AS n, round(corr(rp, ry), 6) AS rho FROM r")
def q_spearman_all(spark: SparkSession, d: str) -> DataFrame:
    return M.spearman(scored(spark, d), "pred_a", "y").withColumn("rho", r6("rho"))


@query(
    "group_ndcg10",
    SC
    + """, s AS (SELECT g, count(*) AS n, sum(y) AS s FROM scored WHERE g IS NOT NULL GROUP BY g HAVING count(*) >= 20 AND sum(y) > 0),
a AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY pred_a DESC, paper_id) AS p, row_number() OVER (PARTITION BY g ORDER BY y DESC, paper_id) AS i FROM scored)
SELECT s.g, s.n, round((SELECT sum(y / log2(p + 1)) FROM a WHERE a.g = s.g AND p <= 10) / (SELECT sum(y / log2(i + 1)) FROM a WHERE a.g = s.g AND i <= 10), 6) AS ndcg FROM s""",
)
def q_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return M.group_ndcg(scored(spark, d), "g", "pred_a", "y", "paper_id").withColumn("ndcg", r6("ndcg"))


@query(
    "share_l1",
    SC
    + """, q AS (SELECT g, greatest(exp(pred_a) - 1, 0) AS r, y FROM scored WHERE g IS NOT NULL), s AS (SELECT g, count(*) AS n, sum(r) AS sr, sum(y) AS sy FROM q GROUP BY g HAVING count(*) >= 10 AND sum(y) > 0)
SELECT q.g, max(n) AS n, round(sum(abs(CASE WHEN sr > 0 THEN r / sr ELSE 1.0 / n END - y / sy)), 6) AS l1 FROM q JOIN s ON s.g = q.g GROUP BY q.g""",
)
def q_share(spark: SparkSession, d: str) -> DataFrame:
    return M.share_l1(scored(spark, d), "g", "pred_a", "y").withColumn("l1", r6("l1"))


@query(
    "precision_at_10",
    SC
    + """, c AS (SELECT g, quantile_cont(CAST(y AS DOUBLE), 0.9) AS cut FROM scored WHERE g IS NOT NULL GROUP BY g HAVING count(*) >= 20 AND sum(y) > 0), t AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY pred_a DESC, paper_id) AS p FROM scored)
SELECT c.g, round(avg(CAST(y >= cut AS INT)), 6) AS precision FROM t JOIN c ON c.g = t.g WHERE p <= 10 GROUP BY c.g""",
)
def q_precision(spark: SparkSession, d: str) -> DataFrame:
    return M.precision_at_k(scored(spark, d), "g", "pred_a", "y", "paper_id").withColumn("precision", r6("precision"))


@query(
    "early_detection",
    SC
    + ", "
    + ", ".join(f"c{i} AS (SELECT quantile_cont(pred_a, {1 - s}) AS a, quantile_cont(pred_b, {1 - s}) AS b, quantile_cont(y, {1 - s}) AS y FROM scored)" for i, s in enumerate((0.01, 0.05)))
    + " "
    + " UNION ALL ".join(
        f"SELECT 'pred_{p}' AS score, CAST({s} AS DOUBLE) AS top, round(count(*) FILTER (WHERE pred_{p} >= c{i}.{p} AND scored.y >= c{i}.y) / count(*) FILTER (WHERE scored.y >= c{i}.y), 6) AS recall FROM scored, c{i}" for p in "ab" for i, s in enumerate((0.01, 0.05))
    ),
)
def q_early(spark: SparkSession, d: str) -> DataFrame:
    return M.early_detection(scored(spark, d), ["pred_a", "pred_b"], "y", [0.01, 0.05]).withColumn("recall", r6("recall"))


@query(
    "mse_decomposition",
    SC
    + """, e AS (SELECT topic, pred_a - ln(1 + y) AS e FROM scored), g AS (SELECT topic, count(*) AS n, avg(e) AS m FROM e GROUP BY 1), t AS (SELECT avg(e) AS m, avg(e * e) AS q, count(*) AS n FROM e)
SELECT round(max(t.q), 6) AS mse, round(max(t.m) * max(t.m), 6) AS bias2, round(sum(g.n * (g.m - t.m) * (g.m - t.m)) / max(t.n), 6) AS between, round(max(t.q) - sum(g.n * g.m * g.m) / max(t.n), 6) AS within FROM g, t""",
)
def q_mse(spark: SparkSession, d: str) -> DataFrame:
    e = scored(spark, d).withColumn("e", F.col("pred_a") - F.log1p("y"))
    return M.error_decomposition(e, "topic", "e").withColumns({c: r6(c) for c in ("mse", "bias2", "between", "within")})


@query(
    "kendall_tau",
    SC + ", m AS (SELECT venue, avg(pred_a) AS a, avg(y) AS b FROM scored WHERE venue IS NOT NULL GROUP BY 1) SELECT round(avg(sign(x.a - y.a) * sign(x.b - y.b)), 6) AS tau FROM m x JOIN m y ON x.venue < y.venue",
)
def q_kendall(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two rankings of the venues."""
    m = scored(spark, d).filter("venue is not null").groupBy("venue").agg(F.avg("pred_a").alias("a"), F.avg("y").alias("b"))
    return M.kendall(m, "venue", "a", "b").withColumn("tau", r6("tau"))


@query("bootstrap_compare")
def q_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Difference of two predictions' absolute log errors, resampling whole topics (seeded)."""
    s = scored(spark, d).filter("topic is not null")
    loss = {f"loss_{p}": F.abs(F.col(f"pred_{p}") - F.log1p("y")) for p in "ab"}
    return M.bootstrap_difference(s.withColumns(loss), "topic", "loss_a", "loss_b")


@query(
    "signed_rank",
    SC
    + """, q AS (SELECT pred_a - pred_b AS d FROM scored), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM q WHERE d <> 0)
SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS w_minus, (SELECT round(avg(CAST(d < 0 AS INT)), 6) FROM q) AS share_less, (SELECT round(avg(CAST(d > 0 AS INT)), 6) FROM q) AS share_more FROM k""",
)
def q_signed(spark: SparkSession, d: str) -> DataFrame:
    return M.signed_rank(scored(spark, d), "pred_a", "pred_b").withColumns({c: r6(c) for c in ("share_less", "share_more")})


@query("ensemble_mean", SC + ", m AS (SELECT paper_id, split, pred_a AS p FROM scored UNION ALL SELECT paper_id, split, pred_b FROM scored) SELECT split, paper_id, round(avg(p), 6) AS pred, count(*) AS n_models FROM m GROUP BY 1, 2")
def q_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Mean prediction over models."""
    s = scored(spark, d)
    stacked = s.select("split", "paper_id", F.explode(F.array("pred_a", "pred_b")).alias("p"))
    return stacked.groupBy("split", "paper_id").agg(r6(F.avg("p")).alias("pred"), F.count(F.lit(1)).alias("n_models"))


@query("demeaned_residuals", SC + ", v AS (SELECT paper_id, venue, ln(1 + y) AS ly, pred_a FROM scored) SELECT paper_id, round(ly - avg(ly) OVER (PARTITION BY venue), 6) AS ly, round(pred_a - avg(pred_a) OVER (PARTITION BY venue), 6) AS pred_a FROM v")
def q_demean(spark: SparkSession, d: str) -> DataFrame:
    v = scored(spark, d).select("paper_id", "venue", F.log1p("y").alias("ly"), "pred_a")
    return E.demean(v, ["ly", "pred_a"], ["venue"]).select("paper_id", r6("ly").alias("ly"), r6("pred_a").alias("pred_a"))


@query("fe_ols", SC + ", v AS (SELECT venue, ln(1 + y) AS ly, pred_a AS x FROM scored), w AS (SELECT ly - avg(ly) OVER (PARTITION BY venue) AS ly, x - avg(x) OVER (PARTITION BY venue) AS x FROM v) SELECT 'pred_a' AS term, round(sum(x * ly) / sum(x * x), 6) AS coef FROM w")
def q_fe_ols(spark: SparkSession, d: str) -> DataFrame:
    v = scored(spark, d).withColumn("ly", F.log1p("y"))
    return E.fe_ols(v, "ly", ["pred_a"], ["venue"], "topic").select("term", r6("coef").alias("coef"))


@query("fe_poisson")
def q_fe_poisson(spark: SparkSession, d: str) -> DataFrame:
    """Poisson regression of citations on two logs with venue and year effects, clustered by topic."""
    return E.fe_poisson(scored(spark, d), "y", ["pred_a", "pred_b"], ["venue", "g"], "topic")


@query("permutation_placebo")
def q_permute(spark: SparkSession, d: str) -> DataFrame:
    """The regressor of every paper dealt out again within its year."""
    return E.permute_within(scored(spark, d), "g", "paper_id", "pred_a", 11)
