"""Queries over entity-by-year panels and point-in-time features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.columns import log_growth
from loomwright.operators import panel as P
from loomwright.plans.base import EDGES_SQL, FIRST, LAST, PANEL_SQL, PAPERS_SQL, SCORED_SQL, edge_year, edges, paper_year, papers, scored
from loomwright.registry import query
from loomwright.sources.tables import table

PP = f"WITH {PAPERS_SQL}, {PANEL_SQL}"
r6 = lambda c: F.round(c, 6)


@query("paper_year", PP + " SELECT id, year, cites FROM py")
def q_paper_year(spark: SparkSession, d: str) -> DataFrame:
    return paper_year(papers(spark, d))


@query("paper_year_in_corpus", f"WITH {EDGES_SQL} SELECT cited_id, year, count(*) AS cites FROM edges WHERE year IS NOT NULL GROUP BY 1, 2")
def q_edge_year(spark: SparkSession, d: str) -> DataFrame:
    return edge_year(edges(spark, d))


@query("paper_year_no_self", f"WITH {EDGES_SQL} SELECT cited_id, year, count(*) AS cites FROM edges WHERE year IS NOT NULL AND NOT coalesce(is_self, false) GROUP BY 1, 2")
def q_edge_year_no_self(spark: SparkSession, d: str) -> DataFrame:
    return edge_year(edges(spark, d).filter(~F.coalesce("is_self", F.lit(False))))


@query(
    "yearly_targets",
    PP
    + """ SELECT p.id, p.year AS start, CAST(coalesce(sum(cites) FILTER (WHERE y.year = p.year), 0) AS BIGINT) AS y0, CAST(coalesce(sum(cites) FILTER (WHERE y.year = p.year + 1), 0) AS BIGINT) AS y1,
  CAST(coalesce(sum(cites) FILTER (WHERE y.year = p.year + 2), 0) AS BIGINT) AS y2, CAST(coalesce(sum(cites) FILTER (WHERE y.year = p.year + 3), 0) AS BIGINT) AS y3,
  CAST(coalesce(sum(cites) FILTER (WHERE y.year BETWEEN p.year + 1 AND p.year + 3), 0) AS BIGINT) AS total FROM papers p LEFT JOIN py y ON y.id = p.id GROUP BY 1, 2""",
)
def q_yearly_targets(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    return P.yearly_targets(p.withColumnRenamed("year", "start"), paper_year(p), "id", "start")


#: The years panels are looked back from, and each paper's running total at them.
RUN_SQL = """looks AS (SELECT CAST(unnest([2017, 2018, 2019, 2020, 2021]) AS INT) AS as_of), run AS (SELECT id, year, CAST(sum(cites) OVER (PARTITION BY id ORDER BY year) AS BIGINT) AS total FROM py)"""


@query("cumulative_as_of", f"{PP}, {RUN_SQL} SELECT g.id, g.as_of, r.total AS cum FROM (SELECT id, as_of FROM (SELECT DISTINCT id FROM py), looks) g ASOF JOIN run r ON r.id = g.id AND g.as_of >= r.year")
def q_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return P.cumulative_as_of(paper_year(papers(spark, d)), "id", 2017, 2021)


def _story_sql(members: str) -> str:
    """History of the members in ``members(member, id, year)`` as events: a paper counts from the year after its own, a citation from then or its own year on."""
    return f"""{PP}, looks AS (SELECT CAST(unnest([2017, 2018, 2019, 2020, 2021]) AS INT) AS as_of), owned AS ({members}),
happened AS (SELECT member, year + 1 AS since, 1 AS paper, 0 AS cites FROM owned UNION ALL SELECT o.member, greatest(o.year + 1, y.year), 0, y.cites FROM owned o JOIN py y ON y.id = o.id),
story AS (SELECT member, since, sum(sum(paper)) OVER w AS n_prior, sum(sum(cites)) OVER w AS cites_prior FROM happened GROUP BY member, since WINDOW w AS (PARTITION BY member ORDER BY since)),
hist AS (SELECT g.member, g.as_of, CAST(s.n_prior AS BIGINT) AS n_prior, CAST(s.cites_prior AS BIGINT) AS cites_prior FROM (SELECT member, as_of FROM (SELECT DISTINCT member FROM owned), looks) g ASOF JOIN story s ON s.member = g.member AND g.as_of >= s.since)"""


HISTORY_SQL = _story_sql("SELECT member, id, year FROM (SELECT unnest(author_ids) AS member, id, year FROM papers WHERE year IS NOT NULL) WHERE member IS NOT NULL")


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = papers(spark, d)
    cum = P.cumulative_as_of(paper_year(p), "id", 2017, 2021)
    return p, P.member_history(p, cum, paper="id", members="author_ids", year="year", first=2017, last=2021)


@query("author_history", HISTORY_SQL + " SELECT member, as_of, n_prior, cites_prior FROM hist")
def q_author_history(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d)[1]


@query(
    "team_history",
    HISTORY_SQL
    + """, seats AS (SELECT id, year, generate_subscripts(author_ids, 1) AS seat, unnest(author_ids) AS member FROM papers),
teams AS (SELECT s.id, list(coalesce(h.cites_prior, 0) ORDER BY seat) AS cs, list(coalesce(h.n_prior, 0) ORDER BY seat) AS ns FROM seats s LEFT JOIN hist h ON h.member = s.member AND h.as_of = s.year GROUP BY s.id),
rated AS (SELECT *, list_transform(list_zip(cs, ns), lambda z: CASE WHEN z[2] > 0 THEN z[1] / z[2] ELSE 0 END) AS per FROM teams)
SELECT id, list_max(cs) AS cites_max, round(list_avg(cs), 6) AS cites_mean, list_max(ns) AS papers_max, round(list_avg(ns), 6) AS papers_mean, cs[1] AS first_cites, ns[1] AS first_papers,
  round(len(list_filter(ns, lambda n: n = 0)) / len(ns), 6) AS share_new, round(ln(1 + list_max(per)), 6) AS log_per_paper_max, round(ln(1 + list_avg(per)), 6) AS log_per_paper_mean FROM rated""",
)
def q_team_history(spark: SparkSession, d: str) -> DataFrame:
    p, hist = _history(spark, d)
    t = P.team_history(p, hist, paper="id", members="author_ids", year="year")
    return t.withColumns({c: r6(c) for c in ("cites_mean", "papers_mean", "share_new", "log_per_paper_max", "log_per_paper_mean")})


@query("venue_history", _story_sql("SELECT source_id AS member, id, year FROM papers WHERE source_id IS NOT NULL AND year IS NOT NULL") + " SELECT * FROM hist")
def q_venue_history(spark: SparkSession, d: str) -> DataFrame:
    """The member history operator over another array: the record's venue, as institutions are treated."""
    p = papers(spark, d).withColumn("venues", F.array("source_id"))
    cum = P.cumulative_as_of(paper_year(p), "id", 2017, 2021)
    return P.member_history(p, cum, paper="id", members="venues", year="year", first=2017, last=2021)


def _cohort_sql(g: str) -> str:
    return (
        PP
        + f""", own AS (SELECT p.id, p.{g} AS g, p.year, coalesce(sum(cites) FILTER (WHERE y.year = p.year + 1), 0) AS one, coalesce(sum(cites) FILTER (WHERE y.year BETWEEN p.year + 1 AND p.year + 3), 0) AS three
  FROM papers p LEFT JOIN py y ON y.id = p.id WHERE p.year IS NOT NULL GROUP BY 1, 2, 3),
per AS (SELECT g, year, avg(ln(1 + one)) AS one, avg(ln(1 + three)) AS three, count(*) AS n FROM own GROUP BY 1, 2),
stacked AS (SELECT g, year + 1 AS "at", one AS a, n AS b, NULL AS c, NULL AS e FROM per UNION ALL SELECT g, year + 3, NULL, NULL, three, NULL FROM per UNION ALL SELECT g, year, NULL, NULL, NULL, n FROM per)
SELECT g AS "group", "at", round(max(a), 6) AS age1_mean, max(b) AS n_age1, round(max(c), 6) AS y3_mean, max(e) AS n_papers FROM stacked GROUP BY 1, 2"""
    )


def _cohorts(spark: SparkSession, d: str, g: str) -> DataFrame:
    p = papers(spark, d).select("id", F.col("year").alias("cohort"), "topic", "source_id", "cby_year", "cby_count")
    return P.cohort_stats(p, paper_year(p), key="id", group=g, year="cohort").withColumns({c: r6(c) for c in ("age1_mean", "y3_mean")})


@query("cohort_stats_topic", _cohort_sql("topic"))
def q_cohort_topic(spark: SparkSession, d: str) -> DataFrame:
    return _cohorts(spark, d, "topic")


@query("cohort_stats_venue", _cohort_sql("source_id"))
def q_cohort_venue(spark: SparkSession, d: str) -> DataFrame:
    return _cohorts(spark, d, "source_id")


SUPPLY_SQL = f"""WITH {PAPERS_SQL}, {EDGES_SQL},
s AS (SELECT topic, year, count(*) AS n_papers, count(*) FILTER (WHERE coalesce(n_refs, 0) >= 5) AS n_rule, CAST(coalesce(sum(n_refs), 0) AS BIGINT) AS refs_made FROM papers WHERE topic IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2),
i AS (SELECT p.topic, e.year, count(*) AS inflow FROM edges e JOIN papers p ON p.id = e.cited_id WHERE p.topic IS NOT NULL AND e.year IS NOT NULL GROUP BY 1, 2),
born AS (SELECT topic, min(year) AS born FROM s GROUP BY 1),
panel AS (SELECT coalesce(s.topic, i.topic) AS topic, coalesce(s.year, i.year) AS year, coalesce(n_papers, 0) AS n_papers, coalesce(n_rule, 0) AS n_rule, coalesce(refs_made, 0) AS refs_made, coalesce(inflow, 0) AS inflow
  FROM s FULL JOIN i ON s.topic = i.topic AND s.year = i.year)"""


def _supply(spark: SparkSession, d: str) -> DataFrame:
    """Topic and year: papers, papers with references, references made, and citations received."""
    p = papers(spark, d).filter("topic is not null")
    s = p.filter("year is not null").groupBy("topic", "year").agg(F.count(F.lit(1)).alias("n_papers"), F.count(F.when(F.coalesce("n_refs", F.lit(0)) >= 5, 1)).alias("n_rule"), F.coalesce(F.sum("n_refs"), F.lit(0)).alias("refs_made"))
    e = edges(spark, d).filter("year is not null").select("cited_id", "year")
    i = e.join(p.select(F.col("id").alias("cited_id"), "topic"), "cited_id").groupBy("topic", "year").agg(F.count(F.lit(1)).alias("inflow"))
    return s.join(i, ["topic", "year"], "full").na.fill(0, ["n_papers", "n_rule", "refs_made", "inflow"])


@query("supply_demand_panel", SUPPLY_SQL + " SELECT p.*, p.year - b.born AS age FROM panel p LEFT JOIN born b ON b.topic = p.topic")
def q_supply(spark: SparkSession, d: str) -> DataFrame:
    s = _supply(spark, d)
    born = s.filter("n_papers > 0").groupBy("topic").agg(F.min("year").alias("born"))
    return s.join(born, "topic", "left").withColumn("age", F.col("year") - F.col("born")).drop("born")


@query(
    "dense_panel",
    SUPPLY_SQL
    + f""" SELECT k.topic, t.year, coalesce(p.n_papers, 0) AS n_papers, coalesce(p.refs_made, 0) AS refs_made, coalesce(p.inflow, 0) AS inflow FROM (SELECT DISTINCT topic FROM panel) k
CROSS JOIN (SELECT CAST(unnest(range({FIRST}, {LAST + 1})) AS INT) AS year) t LEFT JOIN panel p ON p.topic = k.topic AND p.year = t.year""",
)
def q_dense(spark: SparkSession, d: str) -> DataFrame:
    return P.dense_grid(_supply(spark, d), "topic", FIRST, LAST, ["n_papers", "refs_made", "inflow"])


@query(
    "growth_ratio",
    SUPPLY_SQL
    + """ SELECT p.topic, p.year, p.n_papers, a.n_papers AS n_papers_lag1, b.n_papers AS n_papers_lag2, round(ln((p.n_papers + 1) / (coalesce(a.n_papers, 0) + 1)), 6) AS log_growth
FROM panel p LEFT JOIN panel a ON a.topic = p.topic AND a.year = p.year - 1 LEFT JOIN panel b ON b.topic = p.topic AND b.year = p.year - 2""",
)
def q_growth(spark: SparkSession, d: str) -> DataFrame:
    return P.lagged(_supply(spark, d), "topic", "n_papers", [1, 2]).withColumn("log_growth", r6(log_growth("n_papers", "n_papers_lag1")))


@query(
    "window_ahead",
    SUPPLY_SQL + " SELECT p.topic, p.year, CAST((SELECT coalesce(sum(x.inflow), 0) FROM panel x WHERE x.topic = p.topic AND x.year BETWEEN p.year + 1 AND p.year + 3) AS BIGINT) AS inflow_ahead FROM panel p",
)
def q_window_ahead(spark: SparkSession, d: str) -> DataFrame:
    """Sum over the next three years, sent backwards instead of correlated."""
    lags = P.lagged(_supply(spark, d), "topic", "inflow", [-1, -2, -3])
    return lags.select("topic", "year", sum((F.coalesce(f"inflow_lag{k}", F.lit(0)) for k in (-1, -2, -3)), F.lit(0)).cast("bigint").alias("inflow_ahead"))


@query(
    "fractional_counts",
    f"""WITH {PAPERS_SQL}, t AS (SELECT id, cited_by_count, list_zip(cby_year, cby_count) AS z FROM papers), u AS (SELECT id, coalesce(cited_by_count, 0) AS w, unnest(z) AS p FROM t),
v AS (SELECT id, w, CAST(p[1] AS SMALLINT) AS l, CAST(p[2] AS DOUBLE) AS s FROM u WHERE p[1] IS NOT NULL AND p[2] IS NOT NULL), tot AS (SELECT id, sum(s) AS total FROM v GROUP BY 1 HAVING sum(s) > 0)
SELECT l AS label, round(sum(s / total), 6) AS n, round(sum(w * s / total), 6) AS n_weighted FROM v JOIN tot USING (id) GROUP BY 1""",
)
def q_fractional(spark: SparkSession, d: str) -> DataFrame:
    w = F.coalesce(F.col("cited_by_count"), F.lit(0)).cast("double")
    return P.fractional_counts(papers(spark, d), "id", "cby_year", "cby_count", w).withColumns({c: r6(c) for c in ("n", "n_weighted")})


@query(
    "reference_quality",
    f"""WITH {PAPERS_SQL}, r AS (SELECT id, year, topic, unnest(refs) AS ref FROM papers WHERE year IS NOT NULL),
y AS (SELECT id, CAST(unnest(cby_year) AS INT) AS cy, unnest(cby_count) AS n FROM papers),
j AS (SELECT r.id, r.year, t.id AS ref, t.year AS ryear, (t.topic IS NOT NULL AND r.topic IS NOT NULL AND t.topic = r.topic) AS same FROM r JOIN papers t ON t.id = r.ref WHERE t.year <= r.year),
c AS (SELECT j.id, j.year, j.ref, j.ryear, j.same, count(*) AS times FROM j GROUP BY ALL),
s AS (SELECT c.id, c.year, c.ref, c.ryear, c.same, c.times, coalesce(sum(n) FILTER (WHERE cy <= c.year), 0) AS cum FROM c LEFT JOIN y ON y.id = c.ref GROUP BY ALL),
f AS (SELECT s.*, unnest(range(times)) AS k FROM s)
SELECT id, count(*) AS ref_found, round(avg(ln(1 + cum)), 6) AS ref_log_mean, round(max(ln(1 + cum)), 6) AS ref_log_max, round(quantile_cont(ln(1 + cum), 0.75), 6) AS ref_log_p75,
  round(avg(CAST(cum >= 5 AS INT)), 6) AS share_cited, round(avg(CAST(ryear BETWEEN year - 2 AND year AS INT)), 6) AS share_recent, round(avg(year - ryear), 6) AS age_mean, round(avg(CAST(same AS INT)), 6) AS share_same_topic FROM f GROUP BY id""",
)
def q_reference_quality(spark: SparkSession, d: str) -> DataFrame:
    """What a paper's references had gathered by its own year; only references of that year or before."""
    p = papers(spark, d)
    refs = p.filter("year is not null").select("id", "year", "topic", F.explode("refs").alias("ref"))
    cited = p.select(F.col("id").alias("ref"), F.col("year").alias("ryear"), F.col("topic").alias("rtopic"), "cby_year", "cby_count")
    j = refs.join(cited, "ref").filter("ryear <= year").withColumn("cum", P.as_of_array_sum(F.col("cby_year"), F.col("cby_count"), F.col("year")))
    lc, share = F.log1p("cum"), lambda c: r6(F.avg(c.cast("int")))
    return j.groupBy("id").agg(
        F.count(F.lit(1)).alias("ref_found"), r6(F.avg(lc)).alias("ref_log_mean"), r6(F.max(lc)).alias("ref_log_max"), r6(F.percentile(lc, F.lit(0.75))).alias("ref_log_p75"),
        share(F.col("cum") >= 5).alias("share_cited"), share(F.col("ryear") >= F.col("year") - 2).alias("share_recent"), r6(F.avg(F.col("year") - F.col("ryear"))).alias("age_mean"),
        share(F.coalesce(F.col("topic") == F.col("rtopic"), F.lit(False))).alias("share_same_topic"),
    )


SC = f"WITH {SCORED_SQL}"


@query("loo_means", SC + ", w AS (SELECT *, sum(y) OVER (PARTITION BY topic) AS s, count(*) OVER (PARTITION BY topic) AS n, avg(y) OVER (PARTITION BY split) AS m FROM scored WHERE topic IS NOT NULL) SELECT paper_id, round(CASE WHEN n > 1 THEN (s - y) / (n - 1) ELSE m END, 6) AS loo FROM w")
def q_loo(spark: SparkSession, d: str) -> DataFrame:
    return P.leave_one_out(scored(spark, d).filter("topic is not null"), "topic", "y", "split").select("paper_id", r6("loo").alias("loo"))


@query(
    "variance_shares",
    SC
    + ", v AS (SELECT *, ln(1 + y) AS ly FROM scored), "
    + ", ".join(f"s_{g} AS (SELECT '{g}' AS grouping, sum(n * (m - t) * (m - t)) / max(tot) AS share FROM (SELECT {g}, count(*) AS n, avg(ly) AS m FROM v GROUP BY 1), (SELECT avg(ly) AS t, sum(ly * ly) - count(*) * avg(ly) * avg(ly) AS tot FROM v))" for g in ("topic", "venue", "g"))
    + " SELECT grouping, round(share, 6) AS share FROM (SELECT * FROM s_topic UNION ALL SELECT * FROM s_venue UNION ALL SELECT * FROM s_g)",
)
def q_variance(spark: SparkSession, d: str) -> DataFrame:
    return P.variance_share(scored(spark, d).withColumn("ly", F.log1p("y")), ["topic", "venue", "g"], "ly").withColumn("share", r6("share"))


@query(
    "gini_by_group",
    SC
    + """, r AS (SELECT venue, greatest(CAST(y AS DOUBLE), 0) AS x, row_number() OVER (PARTITION BY venue ORDER BY y) AS i, count(*) OVER (PARTITION BY venue) AS n FROM scored)
SELECT venue, round(sum((2 * i - n - 1) * x) / nullif(max(n) * sum(x), 0), 6) AS gini FROM r GROUP BY venue""",
)
def q_gini(spark: SparkSession, d: str) -> DataFrame:
    return P.gini_by(scored(spark, d), "venue", "y").withColumn("gini", r6("gini"))


@query("percent_rank_in_cell", SC + " SELECT paper_id, g, venue, round(percent_rank() OVER (PARTITION BY g, venue ORDER BY y), 6) AS pr FROM scored")
def q_percent_rank(spark: SparkSession, d: str) -> DataFrame:
    return P.percent_rank_in(scored(spark, d), ["g", "venue"], "y", "pr").select("paper_id", "g", "venue", r6("pr").alias("pr"))


@query("quantile_bins", SC + ", r AS (SELECT paper_id, y, row_number() OVER (ORDER BY y, paper_id) AS rn, count(*) OVER () AS n FROM scored) SELECT paper_id, y, CAST(greatest(1, ceil((rn - 1) * 5 / greatest(n - 1, 1))) AS INT) AS bin FROM r")
def q_bins(spark: SparkSession, d: str) -> DataFrame:
    return P.equal_frequency_bins(scored(spark, d).select("paper_id", "y"), "y", "paper_id", 5)


@query("top_k_per_group", SC + ", r AS (SELECT paper_id, g, y, CAST(row_number() OVER (PARTITION BY g ORDER BY y DESC, paper_id) AS INT) AS rank FROM scored) SELECT * FROM r WHERE rank <= 10")
def q_top_k(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the ten most cited papers of every year."""
    return P.top_k(scored(spark, d).select("paper_id", "g", "y"), ["g"], [F.desc("y"), F.col("paper_id")], 10)


@query(
    "group_shift",
    SC
    + """, m AS (SELECT topic, g, avg(y) AS m FROM scored WHERE g IS NOT NULL GROUP BY 1, 2), o AS (SELECT g, avg(y) AS m FROM scored WHERE g IS NOT NULL GROUP BY 1)
SELECT a.topic, a.g, round(coalesce(b.m, o.m), 6) AS previous FROM m a LEFT JOIN m b ON b.topic IS NOT DISTINCT FROM a.topic AND b.g = a.g - 1 LEFT JOIN o ON o.g = a.g - 1""",
)
def q_group_shift(spark: SparkSession, d: str) -> DataFrame:
    return P.group_shift(scored(spark, d), "topic", "g", "y").withColumn("previous", r6("previous"))


@query("pivot_years", SC + " SELECT venue, " + ", ".join(f"CAST(sum(y) FILTER (WHERE g = {k}) AS BIGINT) AS \"{k}\"" for k in range(2017, 2022)) + " FROM scored GROUP BY venue")
def q_pivot(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("venue").pivot("g", list(range(2017, 2022))).agg(F.sum("y"))


@query("splits", SC + " SELECT paper_id, CASE WHEN g <= 2019 THEN 'train' WHEN g = 2020 THEN 'val' WHEN g = 2021 THEN 'test' END AS main, CASE WHEN g <= 2018 THEN 'train' WHEN g = 2019 THEN 'val' WHEN g = 2020 THEN 'test' END AS shifted FROM scored")
def q_splits(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda y: F.when(F.col("g") <= y, "train").when(F.col("g") == y + 1, "val").when(F.col("g") == y + 2, "test")
    return scored(spark, d).select("paper_id", cut(2019).alias("main"), cut(2018).alias("shifted"))


@query("heavy_tails", SC + ", t AS (SELECT * FROM scored WHERE split = 'train') SELECT 'y' AS feature, min(y) >= 0 AND quantile_cont(y, 0.99) > 20 AS heavy FROM t UNION ALL SELECT 'pred_a', min(pred_a) >= 0 AND quantile_cont(pred_a, 0.99) > 20 FROM t")
def q_heavy(spark: SparkSession, d: str) -> DataFrame:
    """Features of the training rows that call for a log transform."""
    t = scored(spark, d).filter("split = 'train'")
    heavy = lambda c: (F.min(c) >= 0) & (F.percentile(c, F.lit(0.99)) > 20)
    row = t.agg(*[heavy(c).alias(c) for c in ("y", "pred_a")])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("heavy")) for c in ("y", "pred_a")])))


@query("drift_scores", SC + ", s AS (SELECT split, avg(y) AS m FROM scored GROUP BY 1), t AS (SELECT avg(y) AS m, stddev_samp(y) AS s FROM scored WHERE split = 'train') SELECT s.split, round((s.m - t.m) / nullif(t.s, 0), 6) AS z FROM s, t")
def q_drift(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    train = s.filter("split = 'train'").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s"))
    means = s.groupBy("split").agg(F.avg("y").alias("own"))
    return means.crossJoin(F.broadcast(train)).select("split", r6(F.try_divide(F.col("own") - F.col("m"), F.col("s"))).alias("z"))  # one row


#: The columns of work_detail that have an order.
SCALARS = tuple("id doi arxiv_id title title_norm type publication_date updated_date publication_year pt_topic source_id n_refs cited_by_count is_retracted is_paratext".split())


@query(
    "column_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS n_null, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM work_detail"
        for c in SCALARS
    ),
)
def q_column_stats(spark: SparkSession, d: str) -> DataFrame:
    """Null counts and extremes of columns in one pass."""
    cols = SCALARS
    aggs = [f(F.col(c)).alias(f"{c}_{k}") for c in cols for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    row = table(spark, d, "work_detail").agg(F.count(F.lit(1)).alias("n"), *aggs)
    stats = [F.struct(F.lit(c).alias("column_name"), F.col("n"), (F.col("n") - F.col(f"{c}_n")).alias("n_null"), F.col(f"{c}_lo").cast("string").alias("least"), F.col(f"{c}_hi").cast("string").alias("greatest")) for c in cols]
    return row.select(F.inline(F.array(*stats)))


@query("candidates", f"WITH {PAPERS_SQL} SELECT id, year, (year BETWEEN 2016 AND 2024 AND n_refs >= 5) AS is_sample, (year BETWEEN 2017 AND 2021 AND n_refs >= 5) AS is_focal FROM papers WHERE NOT coalesce(is_retracted, false) AND NOT coalesce(is_paratext, false) AND length(title) > 0 AND year IS NOT NULL AND n_refs IS NOT NULL AND lower(trim(type)) IN ('article', 'preprint', 'book-chapter')")
def q_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    kept = p.filter(no("is_retracted") & no("is_paratext") & (F.length("title") > 0) & F.col("year").isNotNull() & F.col("n_refs").isNotNull() & F.lower(F.trim("type")).isin("article", "preprint", "book-chapter"))
    enough = F.col("n_refs") >= 5
    return kept.select("id", "year", (F.col("year").between(2016, 2024) & enough).alias("is_sample"), (F.col("year").between(2017, 2021) & enough).alias("is_focal"))


@query("sampled_rows", "SELECT id, title FROM work_detail ORDER BY md5(CAST(id AS VARCHAR) || ':7'), id LIMIT 100")
def q_sampled(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 100 records (a sampling operator): the least by hash, the same on every run."""
    return table(spark, d, "work_detail").select("id", "title").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":7"))), "id").limit(100)
