"""Queries that test for effects of competition: regressions with fixed effects and clustered errors, twins, events, placebos, and
the evaluation of predictions as one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import econ as E
from loomwright.operators import graph as G
from loomwright.operators import metrics as M
from loomwright.operators import panel as P
from loomwright.operators import rivals as V
from loomwright.operators import vector as X
from loomwright.plans.assembly import q_coupled_prior
from loomwright.plans.base import DIM, EDGES_SQL, PANEL_SQL, PAPERS_SQL, SCORED_SQL, edges, paper_year, papers, scored
from loomwright.plans.linking import COUPLING_SQL
from loomwright.plans.scoring import RANK_SQL
from loomwright.plans.similarity import ALL_PAIRS_SQL, MATCH_SQL, STRONG, _dated, _matches
from loomwright.registry import query
from loomwright.session import materialise

r6 = lambda c: F.round(c, 6)

#: Every paper's citations of the three years after its own.
LATER_SQL = "later AS (SELECT p.id, p.topic, p.year, coalesce(p.n_refs, 0) AS n_refs, CAST(coalesce(sum(y.cites) FILTER (WHERE y.year - p.year IN (1, 2, 3)), 0) AS BIGINT) AS y3 FROM papers p LEFT JOIN py y ON y.id = p.id WHERE p.topic IS NOT NULL AND p.year IS NOT NULL GROUP BY ALL)"
MACRO_SQL = f"""WITH {PAPERS_SQL}, {PANEL_SQL}, {EDGES_SQL}, {LATER_SQL},
made AS (SELECT topic, year, count(*) AS supply, CAST(sum(n_refs) AS BIGINT) AS demand, CAST(sum(y3) AS BIGINT) AS cohort_y3 FROM later GROUP BY 1, 2),
got AS (SELECT p.topic, e.year, count(*) AS inflow FROM edges e JOIN papers p ON p.id = e.cited_id WHERE e.year IS NOT NULL GROUP BY 1, 2),
macro AS (SELECT m.*, coalesce(g.inflow, 0) AS inflow FROM made m LEFT JOIN got g ON g.topic = m.topic AND g.year = m.year)"""
MICRO_SQL = f"""WITH {PAPERS_SQL}, {PANEL_SQL}, {COUPLING_SQL}, {LATER_SQL},
near AS (SELECT w.p AS id, count(*) AS n_prior FROM (SELECT a AS p, b AS o FROM cp UNION ALL SELECT b, a FROM cp) w JOIN papers x ON x.id = w.p JOIN papers y ON y.id = w.o WHERE y.year = x.year - 1 GROUP BY 1),
micro AS (SELECT l.id, l.topic, l.year, l.topic * 10000 + l.year AS cell, l.y3, l.n_refs, coalesce(n.n_prior, 0) AS n_prior FROM later l LEFT JOIN near n ON n.id = l.id WHERE l.year BETWEEN 2017 AND 2021)"""


def _two_slopes_sql(table: str, y: str, a: str, b: str, effect: str, cluster: str) -> str:
    """Least squares on two regressors with one effect, solved by Cramer's rule, with errors clustered."""
    return f"""raw AS (SELECT {effect} AS fe, {cluster} AS cl, {y} AS y, {a} AS a, {b} AS b FROM {table}), dm AS (SELECT cl, y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM raw WINDOW w AS (PARTITION BY fe)),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS ky FROM dm), inv AS (SELECT *, aa * bb - ab * ab AS det FROM g), beta AS (SELECT *, (bb * ay - ab * ky) / det AS ba, (aa * ky - ab * ay) / det AS kb FROM inv),
res AS (SELECT cl, a, b, y - ba * a - kb * b AS e FROM dm, beta), cs AS (SELECT cl, sum(a * e) AS sa, sum(b * e) AS sb FROM res GROUP BY 1),
inf AS (SELECT (bb * sa - ab * sb) / det AS ia, (aa * sb - ab * sa) / det AS ib FROM cs, inv), v AS (SELECT sum(ia * ia) * count(*) / (count(*) - 1) AS va, sum(ib * ib) * count(*) / (count(*) - 1) AS vb FROM inf)"""


def _later(p: DataFrame) -> DataFrame:
    """``id, topic, year, n_refs, y3`` of the papers with a topic and a year."""
    own = p.dropna(subset=["topic", "year"]).select("id", "topic", "year", F.coalesce("n_refs", F.lit(0)).alias("n_refs"))
    t = P.yearly_targets(own.select("id", F.col("year").alias("start")), paper_year(p), "id", "start").select("id", F.col("total").alias("y3"))
    return own.join(t, "id")


def _macro(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    made = _later(p).groupBy("topic", "year").agg(F.count(F.lit(1)).alias("supply"), F.sum("n_refs").alias("demand"), F.sum("y3").alias("cohort_y3"))
    cited = edges(spark, d).filter("year is not null").select(F.col("cited_id").alias("id"), "year").join(p.select("id", "topic"), "id")
    got = cited.groupBy("topic", "year").agg(F.count(F.lit(1)).alias("inflow"))
    return made.join(got, ["topic", "year"], "left").withColumn("inflow", F.coalesce("inflow", F.lit(0)))


@query("macro_table", MACRO_SQL + " SELECT topic, year, supply, demand, cohort_y3, inflow FROM macro")
def q_macro_table(spark: SparkSession, d: str) -> DataFrame:
    """Topic and year: papers, references made, citations received, and what the year's cohort received in three years."""
    return _macro(spark, d).select("topic", "year", "supply", "demand", "cohort_y3", "inflow")


def _macro_logs(spark: SparkSession, d: str) -> DataFrame:
    return _macro(spark, d).withColumns({"log_supply": F.log("supply"), "log_demand": F.log1p("demand"), "log_inflow": F.log1p("inflow"), "log_y3": F.log1p("cohort_y3")})


@query("macro_ols", MACRO_SQL + ", " + _two_slopes_sql("macro", "ln(1 + cohort_y3)", "ln(supply)", "ln(1 + demand)", "topic", "topic") + " SELECT 'log_supply' AS term, round(ba, 6) AS coef, round(sqrt(va), 6) AS se FROM beta, v UNION ALL SELECT 'log_demand', round(kb, 6), round(sqrt(vb), 6) FROM beta, v")
def q_macro_ols(spark: SparkSession, d: str) -> DataFrame:
    """A cohort's log citations on log supply and log demand with topic effects, clustered by topic."""
    return E.fe_ols(_macro_logs(spark, d), "log_y3", ["log_supply", "log_demand"], ["topic"], "topic").withColumns({c: r6(c) for c in ("coef", "se")})


@query("macro_poisson")
def q_macro_poisson(spark: SparkSession, d: str) -> DataFrame:
    """A cohort's citations on log supply and log demand with topic and year effects, clustered by topic, for both notions of demand."""
    m = materialise(_macro_logs(spark, d))
    runs = [E.fe_poisson(m, "cohort_y3", ["log_supply", x], ["topic", "year"], "topic").withColumn("demand", F.lit(n)) for n, x in (("references", "log_demand"), ("inflow", "log_inflow"))]
    return runs[0].unionByName(runs[1]).select("demand", "term", "coef", "se")


def _micro(spark: SparkSession, d: str) -> DataFrame:
    own = _later(papers(spark, d)).filter(F.col("year").between(2017, 2021))
    near = q_coupled_prior(spark, d)
    wide = own.join(near, "id", "left").withColumn("n_prior", F.coalesce("n_prior", F.lit(0)))
    return wide.withColumns({"cell": F.col("topic") * 10_000 + F.col("year"), "log_prior": F.log1p("n_prior"), "log_refs": F.log1p("n_refs"), "log_y3": F.log1p("y3")})


@query("micro_ols", MICRO_SQL + ", " + _two_slopes_sql("micro", "ln(1 + y3)", "ln(1 + n_prior)", "ln(1 + n_refs)", "cell", "topic") + " SELECT 'log_prior' AS term, round(ba, 6) AS coef, round(sqrt(va), 6) AS se FROM beta, v UNION ALL SELECT 'log_refs', round(kb, 6), round(sqrt(vb), 6) FROM beta, v")
def q_micro_ols(spark: SparkSession, d: str) -> DataFrame:
    """A paper's log citations on its coupled rivals of the year before, with topic-by-year effects, clustered by topic."""
    return E.fe_ols(_micro(spark, d), "log_y3", ["log_prior", "log_refs"], ["cell"], "topic").withColumns({c: r6(c) for c in ("coef", "se")})


@query("micro_poisson")
def q_micro_poisson(spark: SparkSession, d: str) -> DataFrame:
    """The same as a Poisson regression, with the change of the outcome if the rivals double."""
    fit = E.fe_poisson(_micro(spark, d), "y3", ["log_prior", "log_refs"], ["cell"], "topic")
    return fit.withColumn("if_doubled", F.pow(F.lit(2.0), F.col("coef")) - 1)


@query("micro_placebo")
def q_micro_placebo(spark: SparkSession, d: str) -> DataFrame:
    """The slope on the rivals against 200 random dealings of them within topic and year (seeded)."""
    return E.placebo(_micro(spark, d), "log_y3", "log_prior", "cell", "id")


@query(
    "cross_topic_table",
    f"""WITH {PAPERS_SQL}, {EDGES_SQL}, away AS (SELECT p.id, q.topic, count(*) AS n FROM papers p JOIN edges e ON e.citing_id = p.id JOIN papers q ON q.id = e.cited_id WHERE q.topic <> p.topic GROUP BY 1, 2),
tot AS (SELECT p.id, count(*) AS n FROM papers p JOIN edges e ON e.citing_id = p.id JOIN papers q ON q.id = e.cited_id WHERE q.topic IS NOT NULL AND p.topic IS NOT NULL GROUP BY 1),
pick AS (SELECT id, topic, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, topic) AS k FROM away) WHERE k = 1)
SELECT pick.id, pick.topic AS second_topic, round(pick.n / tot.n, 6) AS match_score FROM pick JOIN tot USING (id)""",
)
def q_second_topic(spark: SparkSession, d: str) -> DataFrame:
    """The topic other than its own that a paper cites most, and that topic's part of its citations."""
    t = papers(spark, d).select("id", "topic").dropna()
    e = edges(spark, d).select("citing_id", "cited_id")
    both = e.join(t.select(F.col("id").alias("citing_id"), F.col("topic").alias("own")), "citing_id").join(t.select(F.col("id").alias("cited_id"), "topic"), "cited_id")
    per = both.groupBy(F.col("citing_id").alias("id"), "own", "topic").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("topic") != F.col("own"), F.struct((-F.col("n")).alias("o"), F.col("topic").alias("t"))))
    return per.groupBy("id").agg(best.alias("b"), F.sum("n").alias("total")).filter("b is not null").select("id", F.col("b.t").alias("second_topic"), r6(-F.col("b.o") / F.col("total")).alias("match_score"))


TWINS_SQL = (
    ALL_PAIRS_SQL
    + f""", {EDGES_SQL}, {PANEL_SQL}, tw AS (SELECT qi AS early, mi AS late FROM pr WHERE sim >= {STRONG} AND dm > dq AND pq <> 'year' AND pm <> 'year' AND abs(ym - yq) <= 2 AND dm - dq <= 183 AND ((pq = 'day' AND pm = 'day') OR dm - dq >= 31) AND NOT same_team AND qi <> mi),
kept AS (SELECT early, late FROM tw WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE (e.citing_id = early AND e.cited_id = late) OR (e.citing_id = late AND e.cited_id = early)) GROUP BY ALL),
o AS (SELECT p.id, coalesce(sum(y.cites) FILTER (WHERE y.year - p.year IN (1, 2, 3)), 0) AS y3 FROM papers p LEFT JOIN py y ON y.id = p.id GROUP BY 1),
pp AS (SELECT CAST(a.y3 AS DOUBLE) AS a, CAST(b.y3 AS DOUBLE) AS b FROM kept JOIN o a ON a.id = early JOIN o b ON b.id = late WHERE a.y3 + b.y3 > 0),
sh AS (SELECT sum(b) / sum(a + b) AS q, ln(sum(b) / sum(a)) AS coef FROM pp)"""
)


def _twins(spark: SparkSession, d: str) -> DataFrame:
    """Twins among all vectors: ``early, late`` works and their citations of three years."""
    v = _dated(spark, d)
    # the later or equal year of a pair is looked at from the earlier one: that meets every pair
    near = X.block_pairs(v, v, key="r", emb="e", dim=DIM, least=STRONG, year="year", back=0, ahead=2)
    twins = V.twin_pairs(V.with_ends(near, v, "r", "q", "m", ["id", "year", "date", "precision", "author_ids"]))
    ids = v.select(F.col("r"), "id")
    pairs = twins.join(ids.select(F.col("r").alias("early_id"), F.col("id").alias("early")), "early_id").join(ids.select(F.col("r").alias("late_id"), F.col("id").alias("late")), "late_id")
    pairs = pairs.filter("early <> late").select("early", "late").distinct()
    free = G.mutual_flags(pairs, edges(spark, d), "early", "late").filter("not a_cites_b and not b_cites_a")
    p = papers(spark, d)
    t = P.yearly_targets(p.select("id", F.col("year").alias("start")), paper_year(p), "id", "start").select("id", "total")
    return free.join(t.select(F.col("id").alias("early"), F.col("total").alias("y_early")), "early").join(t.select(F.col("id").alias("late"), F.col("total").alias("y_late")), "late")


@query(
    "twins_poisson",
    TWINS_SQL
    + """ SELECT round(max(coef), 6) AS coef, round(sqrt(sum((b - (a + b) * q) ** 2) * count(*) / greatest(count(*) - 1, 1)) / sum((a + b) * q * (1 - q)), 6) AS se, count(*) AS n_pairs, round(exp(max(coef)) - 1, 6) AS change FROM pp, sh HAVING count(*) >= 5""",
)
def q_twins_poisson(spark: SparkSession, d: str) -> DataFrame:
    """What being the later of two twins does to a paper's citations, with pair effects, clustered by pair."""
    return E.pair_poisson(_twins(spark, d), "y_early", "y_late", least=5).withColumns({c: r6(c) for c in ("coef", "se", "change")})


@query(
    "event_effects",
    MATCH_SQL
    + """, u AS (SELECT treated_id AS grp, treated_id AS unit, 1 AS treated FROM mt WHERE rank <= 3 UNION SELECT treated_id, control_id, 0 FROM mt WHERE rank <= 3),
vals AS (SELECT u.grp, u.treated, r.rel, coalesce(y.cites, 0) AS v FROM u JOIN papers p ON p.id = u.unit CROSS JOIN (SELECT CAST(unnest(range(6)) AS INT) AS rel) r LEFT JOIN py y ON y.id = u.unit AND y.year = p.year + r.rel),
gap AS (SELECT grp, rel, avg(v) FILTER (WHERE treated = 1) - avg(v) FILTER (WHERE treated = 0) AS gap, count(*) FILTER (WHERE treated = 0) AS n FROM vals GROUP BY 1, 2),
dd AS (SELECT g.rel, g.gap - z.gap AS d, g.n / (g.n + 1) AS w FROM gap g JOIN gap z ON z.grp = g.grp AND z.rel = 0), ef AS (SELECT rel, sum(w * d) / sum(w) AS effect FROM dd GROUP BY 1)
SELECT dd.rel, round(max(effect), 6) AS effect, round(sqrt(sum((w * (d - effect)) ** 2) * count(*) / greatest(count(*) - 1, 1)) / sum(w), 6) AS se, count(*) AS n_groups FROM dd JOIN ef ON ef.rel = dd.rel GROUP BY 1""",
)
def q_event_effects(spark: SparkSession, d: str) -> DataFrame:
    """Citations of retracted papers beyond those of their matched controls, by years since publication."""
    p, m = _matches(spark, d)
    panel = V.event_panel(m, paper_year(p), p, key="id", start="year", value="cites", last=5)
    return E.event_effects(panel).withColumns({c: r6(c) for c in ("effect", "se")})


def _evaluate_sql(m: str) -> str:
    rank = RANK_SQL.replace("pred_a", f"pred_{m}").replace("rk AS", f"rk_{m} AS").replace("FROM rk ", f"FROM rk_{m} ").replace("rho AS (", f"rho_{m} AS (", 1)
    return f"""{rank}, all_{m} AS (SELECT rank() OVER (ORDER BY pred_{m}) + (count(*) OVER (PARTITION BY pred_{m}) - 1) / 2 AS rp, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM scored),
big_{m} AS (SELECT g FROM scored WHERE g IS NOT NULL GROUP BY g HAVING count(*) >= 20 AND sum(y) > 0), at_{m} AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY pred_{m} DESC, paper_id) AS p, row_number() OVER (PARTITION BY g ORDER BY y DESC, paper_id) AS i FROM scored WHERE g IN (FROM big_{m})),
nd_{m} AS (SELECT g, sum(y / log2(p + 1)) FILTER (WHERE p <= 10) / sum(y / log2(i + 1)) FILTER (WHERE i <= 10) AS ndcg FROM at_{m} GROUP BY g)"""


@query(
    "evaluate_methods",
    f"WITH {SCORED_SQL}, {_evaluate_sql('a')}, {_evaluate_sql('b')} "
    + " UNION ALL ".join(
        f"SELECT 'pred_{m}' AS method, (SELECT count(*) FROM scored) AS n, (SELECT round(avg(abs(pred_{m} - ln(1 + y))), 6) FROM scored) AS male, (SELECT round(sqrt(avg((pred_{m} - ln(1 + y)) ** 2)), 6) FROM scored) AS rmsle, "
        f"(SELECT round(sum(rho * n) / sum(n), 6) FROM rho_{m}) AS rho_sub, (SELECT round(corr(rp, ry), 6) FROM all_{m}) AS rho_all, (SELECT round(avg(ndcg), 6) FROM nd_{m}) AS ndcg10"
        for m in "ab"
    ),
)
def q_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """All headline metrics of both predictions by one call."""
    e = M.evaluate(materialise(scored(spark, d)), {"pred_a": "pred_a", "pred_b": "pred_b"}, y="y", group="g", key="paper_id")
    return e.withColumns({c: r6(c) for c in ("male", "rmsle", "rho_sub", "rho_all", "ndcg10")})


@query("compare_methods")
def q_compare(spark: SparkSession, d: str) -> DataFrame:
    """Every two methods, the mean of both among them, with a paired bootstrap over topics (seeded)."""
    s = materialise(scored(spark, d).filter("topic is not null").withColumn("mean", (F.col("pred_a") + F.col("pred_b")) / 2))
    return M.compare(s, {"pred_a": "pred_a", "pred_b": "pred_b", "mean": "mean"}, y="y", cluster="topic")
