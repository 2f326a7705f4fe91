"""Queries that assemble wide feature tables and node tables, order and check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.columns import full_date, overlap
from loomwright.operators import econ as E
from loomwright.operators import graph as G
from loomwright.operators import models as L
from loomwright.operators import panel as P
from loomwright.operators import rivals as V
from loomwright.operators import vector as X
from loomwright.plans.assembly import q_coupled_prior, q_focal, q_snapshot, q_venue_at
from loomwright.plans.base import EDGES_SQL, PANEL_SQL, PAPERS_SQL, SCORED_SQL, edges, paper_year, papers, scored
from loomwright.plans.linking import COUPLING_SQL
from loomwright.plans.panels import SUPPLY_SQL, _cohorts, _supply, q_reference_quality, q_team_history
from loomwright.plans.similarity import BASE_SQL, PAIRS_SQL, _dated, _pairs
from loomwright.registry import CORE, query
from loomwright.session import materialise
from loomwright.sources.tables import table

r6 = lambda c: F.round(c, 6)
SC = f"WITH {SCORED_SQL}"
LAGGED = ("n_papers", "refs_made", "inflow")


def _feature_sql() -> str:
    lags = ", ".join(f"s{k}.{c} AS {c}_lag{k}" for k in (1, 2) for c in LAGGED)
    old = " ".join(f"LEFT JOIN panel s{k} ON s{k}.topic = s.topic AND s{k}.year = s.year - {k}" for k in (1, 2))
    return f"""SELECT f.*, w.refs_made, w.inflow, {", ".join(f"w.{c}_lag{k}" for k in (1, 2) for c in LAGGED)}, t.cites_max, t.papers_max, t.share_new, t.log_per_paper_max, coalesce(q.ref_found, 0) AS ref_found, q.ref_log_mean, q.share_recent, coalesce(n.n_prior, 0) AS n_prior,
  v.venue, v.has_preprint, h.age1_mean AS venue_age1_mean, h.y3_mean AS venue_y3_mean
FROM ({CORE.sql["focal_table"]}) f LEFT JOIN ({SUPPLY_SQL} SELECT s.topic, s.year, s.refs_made, s.inflow, {lags} FROM panel s {old}) w ON w.topic = f.topic AND w.year = f.year
LEFT JOIN ({CORE.sql["team_history"]}) t ON t.id = f.id LEFT JOIN ({CORE.sql["reference_quality"]}) q ON q.id = f.id LEFT JOIN ({CORE.sql["coupled_prior"]}) n ON n.id = f.id LEFT JOIN ({CORE.sql["venue_at_time"]}) v ON v.id = f.id
LEFT JOIN (WITH {PAPERS_SQL} SELECT id, source_id FROM papers) p ON p.id = f.id LEFT JOIN ({CORE.sql["cohort_stats_venue"]}) h ON h."group" = p.source_id AND h."at" = f.year"""


@query("feature_table", _feature_sql())
def q_features(spark: SparkSession, d: str) -> DataFrame:
    """The focal papers' features in one wide row each, everything as of the paper's own year.

    Every side has one row per key, so the focal rows are neither lost nor multiplied.
    """
    f = q_focal(spark, d)
    supply = _supply(spark, d)
    for c in LAGGED:
        own = P.lagged(supply.select("topic", "year", c), "topic", c, [1, 2]).select("topic", "year", *[f"{c}_lag{k}" for k in (1, 2)], *([c] if c != "n_papers" else []))
        f = f.join(own, ["topic", "year"], "left")
    team = q_team_history(spark, d).select("id", "cites_max", "papers_max", "share_new", "log_per_paper_max")
    refs = q_reference_quality(spark, d).select("id", "ref_found", "ref_log_mean", "share_recent")
    venue = papers(spark, d).select("id", "source_id")
    cohort = _cohorts(spark, d, "source_id").select(F.col("group").alias("source_id"), F.col("at").alias("year"), F.col("age1_mean").alias("venue_age1_mean"), F.col("y3_mean").alias("venue_y3_mean"))
    for side in (team, refs, q_coupled_prior(spark, d), q_venue_at(spark, d).select("id", "venue", "has_preprint"), venue):
        f = f.join(side, "id", "left")
    f = f.join(cohort, ["source_id", "year"], "left").drop("source_id")
    return f.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ref_found", "n_prior")})


RIVALS_SQL = f"""{PAIRS_SQL}, {EDGES_SQL}, {PANEL_SQL}, {COUPLING_SQL}, near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, m) AS rank FROM pr WHERE ym - yq IN (-2, -1, 0)),
cum AS (SELECT k.q, k.m, CAST(coalesce(sum(y.cites) FILTER (WHERE y.year <= k.yq), 0) AS BIGINT) AS rival_cum FROM near k LEFT JOIN py y ON y.id = k.mi WHERE rank <= 50 GROUP BY 1, 2)
SELECT k.q, k.m, CAST(k.rank AS INT) AS rank, round(k.sim, 6) AS sim, ym - yq AS dyear, CASE WHEN pq <> 'year' AND pm <> 'year' THEN CAST(dq - dm AS INT) END AS ddays, coalesce(tq = tm, false) AS same_topic, same_team AS shared_auth, cum.rival_cum,
  x.citing_id IS NOT NULL AS focal_cites, y.citing_id IS NOT NULL AS rival_cites, cp.a IS NOT NULL AS coupled, coalesce(p.n_refs, 0) AS rival_refs,
  CASE WHEN p.pub <= yq AND p.kind <> 'preprint' THEN p.kind WHEN p.arxiv_id IS NOT NULL THEN 'arxiv' ELSE 'preprint_other' END AS rival_venue
FROM near k JOIN cum USING (q, m) LEFT JOIN edges x ON x.citing_id = qi AND x.cited_id = mi LEFT JOIN edges y ON y.citing_id = mi AND y.cited_id = qi LEFT JOIN cp ON cp.a = least(qi, mi) AND cp.b = greatest(qi, mi)
JOIN (SELECT *, lower(trim(type)) AS kind, CASE WHEN regexp_full_match(publication_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND publication_date >= '0001' THEN year(try_cast(publication_date AS DATE)) END AS pub FROM papers) p ON p.id = mi WHERE rank <= 50"""


@query("rival_features", RIVALS_SQL)
def q_rivals(spark: SparkSession, d: str) -> DataFrame:
    """The fifty most similar papers of the same and the two years before with all that relates them to the focal paper, as of its year."""
    v = _dated(spark, d)
    top = X.ranked(_pairs(v, k=50, back=2, ahead=0), 50)
    f = materialise(V.with_ends(top, v, "r", "q", "m", ["id", "year", "date", "precision", "topic", "author_ids"]))
    p = papers(spark, d)
    panel = paper_year(p).select(F.col("id").alias("id_m"), F.col("year").alias("_y"), "cites")
    cum = f.select("q", "m", "id_m", "year_q").join(panel, "id_m", "left").groupBy("q", "m").agg(F.coalesce(F.sum(F.when(F.col("_y") <= F.col("year_q"), F.col("cites"))), F.lit(0)).alias("rival_cum"))
    s3 = G.coupling(table(spark, d, "paper_ref"), paper="paper_id", ref="ref", year="y").select("a", "b", F.lit(True).alias("_c"))
    facts = p.select(F.col("id").alias("id_m"), F.coalesce("n_refs", F.lit(0)).alias("rival_refs"), F.lower(F.trim("type")).alias("kind"), F.col("arxiv_id"), F.year(full_date("publication_date")).alias("pub"))
    wide = G.mutual_flags(f, edges(spark, d).select("citing_id", "cited_id"), "id_q", "id_m").join(cum, ["q", "m"]).join(facts, "id_m")
    wide = wide.withColumns({"a": F.least("id_q", "id_m"), "b": F.greatest("id_q", "id_m")}).join(s3, ["a", "b"], "left")
    no = F.lit(False)
    days = F.when(V.precise("precision_q") & V.precise("precision_m"), F.datediff("date_q", "date_m"))
    out = F.coalesce((F.col("pub") <= F.col("year_q")) & (F.col("kind") != "preprint"), no)
    venue = F.when(out, F.col("kind")).when(F.col("arxiv_id").isNotNull(), "arxiv").otherwise("preprint_other")
    return wide.select(
        "q", "m", "rank", r6("sim").alias("sim"), (F.col("year_m") - F.col("year_q")).alias("dyear"), days.alias("ddays"), F.coalesce(F.col("topic_q") == F.col("topic_m"), no).alias("same_topic"),
        overlap("author_ids_q", "author_ids_m").alias("shared_auth"), "rival_cum", F.col("a_cites_b").alias("focal_cites"), F.col("b_cites_a").alias("rival_cites"), F.coalesce("_c", no).alias("coupled"), "rival_refs", venue.alias("rival_venue"),
    )


@query("rival_tensor")
def q_tensor(spark: SparkSession, d: str) -> DataFrame:
    """The rivals' relation features as a padded array of rows in rank order, flags as 0 and 1, counts as logs, venues one-hot."""
    f = q_rivals(spark, d)
    venues = ("article", "book-chapter", "arxiv", "preprint_other")
    flags = ("same_topic", "shared_auth", "focal_cites", "rival_cites", "coupled")
    cols = {f"{c}_f": F.col(c).cast("int") for c in flags} | {f"venue_{i}": (F.col("rival_venue") == v).cast("int") for i, v in enumerate(venues)}
    cols |= {"days_known": F.col("ddays").isNotNull().cast("int"), "years_ahead": F.coalesce("ddays", F.lit(0)) / 365, "log_cum": F.log1p("rival_cum"), "log_refs": F.log1p("rival_refs"), "log_rank": F.log("rank"), "same_year": (F.col("dyear") == 0).cast("int")}
    return L.rival_tensor(f.withColumns(cols), "q", "rank", ["sim", "dyear", *cols], 50)


NODES_SQL = CORE.sql["snapshot_edges"]
NODES_SQL = f"e AS ({NODES_SQL}), nodes AS (SELECT DISTINCT year, kind, node FROM (SELECT year, 'paper' AS kind, src AS node FROM e UNION ALL SELECT year, CASE kind WHEN 'reference' THEN 'paper' ELSE kind END, dst FROM e))"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """``year, kind, node``: the distinct nodes of every yearly snapshot."""
    e = q_snapshot(spark, d)
    kind = F.when(F.col("kind") == "reference", "paper").otherwise(F.col("kind"))
    ends = F.inline(F.array(F.struct(F.lit("paper").alias("kind"), F.col("src").alias("node")), F.struct(kind.alias("kind"), F.col("dst").alias("node"))))
    return e.select("year", ends).distinct()


@query("snapshot_nodes", f"WITH {NODES_SQL} SELECT year, kind, node, row_number() OVER (PARTITION BY year, kind ORDER BY node) - 1 AS node_id FROM nodes")
def q_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the yearly snapshots, numbered from 0 in each year and kind."""
    return G.dense_ids(_nodes(spark, d), ["year", "kind"], "node", "node_id")


@query("snapshot_alignment", f"WITH {NODES_SQL} SELECT a.year, a.kind, count(*) AS n_nodes, count(b.node) AS n_kept FROM nodes a LEFT JOIN nodes b ON b.year = a.year + 1 AND b.kind = a.kind AND b.node = a.node GROUP BY 1, 2")
def q_alignment(spark: SparkSession, d: str) -> DataFrame:
    """How many of a snapshot's nodes the next year's snapshot holds as well."""
    n = materialise(_nodes(spark, d))
    following = n.select((F.col("year") - 1).alias("year"), "kind", "node", F.lit(1).alias("kept"))
    return n.join(following, ["year", "kind", "node"], "left").groupBy("year", "kind").agg(F.count(F.lit(1)).alias("n_nodes"), F.count("kept").alias("n_kept"))


@query(
    "naive_growth",
    SC
    + """, m AS (SELECT topic, g, avg(ln(1 + y)) AS m FROM scored WHERE g IS NOT NULL GROUP BY 1, 2), o AS (SELECT g, avg(ln(1 + y)) AS m FROM scored WHERE g IS NOT NULL GROUP BY 1)
SELECT m.topic, m.g, round(coalesce(a.m, o.m), 6) AS level, round(greatest(0, coalesce(2 * a.m - b.m, a.m, o.m)), 6) AS growth FROM m LEFT JOIN m a ON a.topic IS NOT DISTINCT FROM m.topic AND a.g = m.g - 1 LEFT JOIN m b ON b.topic IS NOT DISTINCT FROM m.topic AND b.g = m.g - 2 LEFT JOIN o ON o.g = m.g - 1""",
)
def q_growth(spark: SparkSession, d: str) -> DataFrame:
    """A topic's level of the year before, and that carried on by its last growth; where a year is missing the next simpler guess."""
    s = scored(spark, d).filter("g is not null").withColumn("ly", F.log1p("y"))
    m = s.groupBy("topic", "g").agg(F.avg("ly").alias("m"))
    o = s.groupBy((F.col("g") + 1).alias("g")).agg(F.avg("ly").alias("o"))
    before = lambda k, c: m.select(F.col("topic").alias(f"t{k}"), (F.col("g") + k).alias(f"g{k}"), F.col("m").alias(c))
    wide = m
    for k, c in ((1, "a"), (2, "b")):
        b = before(k, c)
        wide = wide.join(b, wide["topic"].eqNullSafe(b[f"t{k}"]) & (wide["g"] == b[f"g{k}"]), "left").drop(f"t{k}", f"g{k}")
    wide = wide.join(o, "g", "left")
    grown = F.coalesce(2 * F.col("a") - F.col("b"), F.col("a"), F.col("o"))
    return wide.select("topic", "g", r6(F.coalesce("a", "o")).alias("level"), r6(F.when(grown.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), grown))).alias("growth"))


@query("split_order", SC + " SELECT paper_id, split, g, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 3 END, coalesce(g, 0), paper_id) AS place FROM scored")
def q_split_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows in the order that tensors are cut from: training, validation and test, then year, then paper."""
    part = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).when(F.col("split") == "test", 2).otherwise(3)
    s = scored(spark, d).select("paper_id", "split", "g", (part * 100_000 + F.coalesce("g", F.lit(0))).alias("_cell"))
    return P.global_rank(s, ["_cell", "paper_id"], "place", "_n").select("paper_id", "split", "g", "place")


@query(
    "cross_topic_demand",
    BASE_SQL
    + f""", {EDGES_SQL}, x AS (SELECT topic, unnest(range(96)) AS i, unnest(e)::DOUBLE AS x FROM vy WHERE topic IS NOT NULL), c AS (SELECT topic AS label, list(m ORDER BY i) AS c FROM (SELECT topic, i, avg(x) AS m FROM x GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT r, topic, label, round(list_cosine_similarity(e::DOUBLE[], c), 9) AS sim FROM vy, c), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY sim DESC, label) AS rank FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY rank) AS nth FROM k WHERE rank <= 4 AND label IS DISTINCT FROM topic), fl AS (SELECT p.topic, count(*) AS inflow FROM edges e JOIN papers p ON p.id = e.cited_id WHERE e.year IS NOT NULL GROUP BY 1)
SELECT r, count(*) AS n_topics, round(sum(exp(10 * (sim - 1)) * ln(1 + coalesce(inflow, 0))) / sum(exp(10 * (sim - 1))), 6) AS demand FROM o LEFT JOIN fl ON fl.topic = o.label WHERE nth <= 3 GROUP BY r""",
)
def q_cross_demand(spark: SparkSession, d: str) -> DataFrame:
    """Log citations received by the three other topics whose mean vectors are nearest to a paper, weighted by a softmax of the cosines."""
    v = _dated(spark, d)
    centres = materialise(X.centroids(v.filter("topic is not null"), "topic", "e"))
    near = X.nearest_centroid(v, centres, key="r", emb="e", k=4).join(v.select("r", "topic"), "r")
    other = P.top_k(near.filter(~F.col("label").eqNullSafe(F.col("topic"))), ["r"], [F.col("rank")], 3, "nth")
    p = papers(spark, d).select(F.col("id").alias("cited_id"), F.col("topic").alias("label"))
    inflow = edges(spark, d).filter("year is not null").select("cited_id").join(p, "cited_id").groupBy("label").agg(F.count(F.lit(1)).alias("inflow"))
    w = F.exp(10 * (F.col("sim") - 1))
    known = other.join(inflow, "label", "left")
    return known.groupBy("r").agg(F.count(F.lit(1)).alias("n_topics"), r6(F.sum(w * F.log1p(F.coalesce("inflow", F.lit(0)))) / F.sum(w)).alias("demand"))


@query(
    "binned_ols",
    SC
    + """, b AS (SELECT ln(1 + y) AS ly, pred_a AS x, greatest(1, ceil((row_number() OVER (ORDER BY pred_b, paper_id) - 1) * 5 / greatest(count(*) OVER () - 1, 1))) AS bin FROM scored),
w AS (SELECT ly - avg(ly) OVER q AS ly, x - avg(x) OVER q AS x FROM b WINDOW q AS (PARTITION BY bin)), c AS (SELECT sum(x * ly) / sum(x * x) AS coef, sum(x * x) AS xx FROM w)
SELECT 'pred_a' AS term, round(max(coef), 6) AS coef, round(sqrt(sum(x * x * (ly - coef * x) ** 2) * count(*) / (count(*) - 1)) / max(xx), 6) AS se FROM w, c""",
)
def q_binned(spark: SparkSession, d: str) -> DataFrame:
    """Least squares within five bins of equal frequency, with errors robust to heteroskedasticity (HC1)."""
    s = P.equal_frequency_bins(scored(spark, d).withColumn("ly", F.log1p("y")), "pred_b", "paper_id", 5)
    return E.fe_ols(s, "ly", ["pred_a"], ["bin"]).withColumns({c: r6(c) for c in ("coef", "se")})


@query(
    "invariants",
    f"""WITH {PAPERS_SQL}, {EDGES_SQL} SELECT 'works: one current row each' AS name, (SELECT count(*) FROM papers) AS n, (SELECT count(*) - count(DISTINCT id) FROM papers) AS n_wrong
UNION ALL SELECT 'edges: each pair once', (SELECT count(*) FROM edges), (SELECT count(*) FROM (SELECT citing_id, cited_id FROM edges GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT 'edges: known ends', (SELECT count(*) FROM edges), (SELECT count(*) FROM edges WHERE cited_id NOT IN (SELECT id FROM papers) OR citing_id NOT IN (SELECT id FROM papers))
UNION ALL SELECT 'edges: not into the future', (SELECT count(*) FROM edges), (SELECT count(*) FROM edges e JOIN papers a ON a.id = e.citing_id JOIN papers b ON b.id = e.cited_id WHERE b.year > a.year)
UNION ALL SELECT 'works: reference count in step', (SELECT count(*) FROM papers), (SELECT count(*) FROM papers WHERE coalesce(n_refs, 0) <> coalesce(len(list_distinct(refs)), 0))""",
)
def q_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Uniqueness, references and time order as counts of rows that break them."""
    p, e = papers(spark, d), edges(spark, d).select("citing_id", "cited_id")
    count, one = lambda df: df.agg(F.count(F.lit(1)).alias("n")), F.lit(1)
    ids = p.select("id", "year")
    ends = e.join(ids.select(F.col("id").alias("cited_id"), F.lit(True).alias("b"), F.col("year").alias("yb")), "cited_id", "left").join(ids.select(F.col("id").alias("citing_id"), F.lit(True).alias("a"), F.col("year").alias("ya")), "citing_id", "left")
    in_step = F.coalesce(F.col("n_refs"), F.lit(0)) == F.coalesce(F.size(F.array_compact(F.array_distinct("refs"))), F.lit(0))
    wrong = lambda c: F.count(F.when(c, 1)).alias("n_wrong")
    rows = [
        ("works: one current row each", p.agg(F.count(one).alias("n"), (F.count(one) - F.countDistinct("id")).alias("n_wrong"))),
        ("edges: each pair once", e.groupBy("citing_id", "cited_id").agg(F.count(one).alias("c")).agg(F.sum("c").alias("n"), wrong(F.col("c") > 1))),
        ("edges: known ends", ends.agg(F.count(one).alias("n"), wrong(F.col("a").isNull() | F.col("b").isNull()))),
        ("edges: not into the future", ends.agg(F.count(one).alias("n"), wrong(F.col("yb") > F.col("ya")))),
        ("works: reference count in step", p.agg(F.count(one).alias("n"), wrong(~in_step))),
    ]
    out = None
    for name, row in rows:
        named = row.select(F.lit(name).alias("name"), "n", "n_wrong")
        out = named if out is None else out.unionByName(named)
    return out
