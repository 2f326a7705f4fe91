"""Queries over vectors and over competition between similar papers.

Searches ask for every vector whose row number is divisible by 50, against all vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import graph as G
from loomwright.operators import panel as P
from loomwright.operators import resolve as R
from loomwright.operators import rivals as V
from loomwright.operators import vector as X
from loomwright.plans.base import DATES_SQL, DIM, EDGES_SQL, PAPERS_SQL, PANEL_SQL, SCORED_SQL, VECTORS_SQL, edges, paper_year, papers, scored, vectors
from loomwright.registry import query
from loomwright.session import materialise

r6 = lambda c: F.round(c, 6)
ASK = 50
#: Similarity from which papers of these tables count as strong rivals, and the thresholds counted at.
STRONG, TAUS = 0.85, [0.85, 0.88, 0.9, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98]

BASE_SQL = f"WITH {PAPERS_SQL}, {VECTORS_SQL}, {DATES_SQL}, vy AS (SELECT v.r, v.e, v.id, dt.year, dt.day, dt.prec, p.topic, p.author_ids FROM vec v JOIN dt ON dt.id = v.id JOIN papers p ON p.id = v.id)"
PAIRS_SQL = BASE_SQL + f""", pr AS (SELECT a.r AS q, b.r AS m, a.id AS qi, b.id AS mi, round(list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]), 9) AS sim, a.year AS yq, b.year AS ym, a.day AS dq, b.day AS dm, a.prec AS pq, b.prec AS pm,
  a.topic AS tq, b.topic AS tm, list_has_any(list_filter(coalesce(a.author_ids, []), lambda x: x IS NOT NULL), list_filter(coalesce(b.author_ids, []), lambda x: x IS NOT NULL)) AS same_team FROM vy a JOIN vy b ON a.r <> b.r WHERE a.r % {ASK} = 0)"""
#: Every vector against every other, not only those asked for.
ALL_PAIRS_SQL = PAIRS_SQL.replace(f" WHERE a.r % {ASK} = 0", "")
FLAGS_SQL = f", {EDGES_SQL}, st AS (SELECT pr.*, x.citing_id IS NOT NULL AS qm, y.citing_id IS NOT NULL AS mq FROM pr LEFT JOIN edges x ON x.citing_id = qi AND x.cited_id = mi LEFT JOIN edges y ON y.citing_id = mi AND y.cited_id = qi WHERE sim >= {STRONG} AND ym - yq BETWEEN -2 AND 2)"


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with their paper's year, date, precision, topic and authors."""
    p = papers(spark, d)
    dates = R.date_precision(p.select("id", "publication_date", "arxiv_id", "year"), "id")
    facts = dates.select("id", F.col("first_year").alias("year"), F.col("first_date").alias("date"), "precision").join(p.select("id", "topic", "author_ids"), "id")
    return materialise(vectors(spark, d).join(facts, "id"))


def _asked(v: DataFrame) -> DataFrame:
    return v.filter(F.col("r") % ASK == 0)


def _pairs(v: DataFrame, least: float = -1.0, k: int | None = None, back: int | None = None, ahead: int = 0) -> DataFrame:
    return X.block_pairs(_asked(v), v, key="r", emb="e", dim=DIM, least=least, k=k, year=None if back is None else "year", back=back or 0, ahead=ahead)


def _facts(v: DataFrame, pairs: DataFrame) -> DataFrame:
    return V.with_ends(pairs, v, "r", "q", "m", ["id", "year", "date", "precision", "topic", "author_ids"])


def _flagged(spark: SparkSession, d: str, v: DataFrame) -> DataFrame:
    """Strong pairs at most two years apart with both ends' facts and citation flags."""
    e = edges(spark, d).select("citing_id", "cited_id")
    return G.mutual_flags(_facts(v, _pairs(v, STRONG, None, 2, 2)), e, "id_q", "id_m")


@query("topk_cosine", PAIRS_SQL + ", k AS (SELECT q, m, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, m) AS rank FROM pr WHERE ym - yq BETWEEN -1 AND 1) SELECT q, m, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM k WHERE rank <= 100")
def q_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _dated(spark, d)
    return X.ranked(_pairs(v, k=100, back=1, ahead=1), 100).withColumn("sim", r6("sim"))


@query(
    "competition_set",
    PAIRS_SQL + f", {EDGES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, m) AS rank FROM pr WHERE ym - yq BETWEEN -2 AND 0) "
    + """SELECT q, m, CAST(rank AS INT) AS rank, round(sim, 6) AS sim, ym - yq AS dyear, CASE WHEN pq <> 'year' AND pm <> 'year' THEN CAST(dq - dm AS INT) END AS ddays, same_team AS shared_auth,
x.citing_id IS NOT NULL AS focal_cites, y.citing_id IS NOT NULL AS rival_cites FROM k LEFT JOIN edges x ON x.citing_id = qi AND x.cited_id = mi LEFT JOIN edges y ON y.citing_id = mi AND y.cited_id = qi WHERE rank <= 50""",
)
def q_competition(spark: SparkSession, d: str) -> DataFrame:
    """The fifty most similar papers of the same and the two years before, with their relations to the focal paper."""
    from loomwright.functions.columns import overlap

    v = _dated(spark, d)
    top = X.ranked(_pairs(v, k=50, back=2, ahead=0), 50)
    f = G.mutual_flags(_facts(v, top), edges(spark, d).select("citing_id", "cited_id"), "id_q", "id_m")
    days = F.when(V.precise("precision_q") & V.precise("precision_m"), F.datediff("date_q", "date_m"))
    return f.select("q", "m", "rank", r6("sim").alias("sim"), (F.col("year_m") - F.col("year_q")).alias("dyear"), days.alias("ddays"), overlap("author_ids_q", "author_ids_m").alias("shared_auth"), F.col("a_cites_b").alias("focal_cites"), F.col("b_cites_a").alias("rival_cites"))


@query("threshold_pairs", PAIRS_SQL + f" SELECT q, m, round(sim, 6) AS sim FROM pr WHERE sim >= {STRONG} AND ym - yq BETWEEN -1 AND 1")
def q_threshold(spark: SparkSession, d: str) -> DataFrame:
    v = _dated(spark, d)
    return _pairs(v, STRONG, None, 1, 1).withColumn("sim", r6("sim"))


@query("later_pairs", PAIRS_SQL + f" SELECT q, m, round(sim, 6) AS sim, ym - yq AS dyear FROM pr WHERE sim >= {STRONG} AND ym - yq BETWEEN 1 AND 2 AND yq <= 2019")
def q_later(spark: SparkSession, d: str) -> DataFrame:
    v = _dated(spark, d)
    pairs = X.block_pairs(_asked(v).filter("year <= 2019"), v, key="r", emb="e", dim=DIM, least=STRONG, year="year", back=-1, ahead=2)
    return V.with_ends(pairs, v, "r", "q", "m", ["year"]).select("q", "m", r6("sim").alias("sim"), (F.col("year_m") - F.col("year_q")).alias("dyear"))


TAU_SQL = ", t AS (SELECT unnest([" + ", ".join(f"CAST({t} AS DOUBLE)" for t in TAUS) + "]) AS tau)"


@query(
    "threshold_counts",
    PAIRS_SQL + TAU_SQL + " SELECT q, tau, " + ", ".join(f"count(*) FILTER (WHERE ym - yq = {k}) AS n_{'m' if k < 0 else 'p'}{abs(k)}" for k in range(-2, 3)) + " FROM pr JOIN t ON sim >= tau WHERE ym - yq BETWEEN -2 AND 2 GROUP BY 1, 2",
)
def q_counts(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by year offset at every threshold, from one pass over the pairs."""
    v = _dated(spark, d)
    f = V.with_ends(_pairs(v, min(TAUS), None, 2, 2), v, "r", "q", "m", ["year"])
    lag = F.col("year_m") - F.col("year_q")
    return X.threshold_counts(f, TAUS, {f"n_{'m' if k < 0 else 'p'}{abs(k)}": lag == k for k in range(-2, 3)})


@query(
    "day_window_counts",
    PAIRS_SQL + TAU_SQL
    + """ SELECT q, tau, count(*) FILTER (WHERE dm < dq) AS before, count(*) FILTER (WHERE dm >= dq) AS after, count(*) FILTER (WHERE dm < dq AND tm = tq) AS before_same, count(*) FILTER (WHERE dm >= dq AND tm = tq) AS after_same
FROM pr JOIN t ON sim >= tau WHERE pq <> 'year' AND pm <> 'year' AND abs(dm - dq) <= 365 GROUP BY 1, 2""",
)
def q_day_counts(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours within 365 days with both dates precise: strictly before, and after including the same day."""
    v = _dated(spark, d)
    f = _facts(v, _pairs(v, min(TAUS), None, 2, 2)).filter(V.precise("precision_q") & V.precise("precision_m") & (F.abs(F.datediff("date_m", "date_q")) <= 365))
    before, same = F.col("date_m") < F.col("date_q"), F.coalesce(F.col("topic_m") == F.col("topic_q"), F.lit(False))
    return X.threshold_counts(f, TAUS, {"before": before, "after": ~before, "before_same": before & same, "after_same": ~before & same})


@query("pair_cosine", f"WITH {VECTORS_SQL}, w AS (SELECT id, e FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS rn FROM vec WHERE id IS NOT NULL) WHERE rn = 1) SELECT m.a, m.b, round(list_cosine_similarity(x.e::DOUBLE[], y.e::DOUBLE[]), 6) AS sim FROM (SELECT DISTINCT a, b FROM merge_edge WHERE a <> b) m LEFT JOIN w x ON x.id = m.a LEFT JOIN w y ON y.id = m.b")
def q_pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every matched pair of records; null where one has no vector."""
    from loomwright.sources.tables import table

    own = vectors(spark, d).filter("id is not null").groupBy("id").agg(F.min_by("e", "r").alias("e"))
    pairs = table(spark, d, "merge_edge").filter("a <> b").select("a", "b").distinct()
    return X.pair_cosine(pairs, own, key="id", emb="e", a="a", b="b").withColumn("sim", r6("sim"))


QS = [0.5, 0.9, 0.95, 0.99, 0.999]


@query("similarity_percentiles", ALL_PAIRS_SQL + " SELECT coalesce(tq = tm, false) AS same_topic, count(*) AS n, " + ", ".join(f"round(quantile_cont(sim, {q}), 6) AS p{str(q)[2:]}" for q in QS) + " FROM pr GROUP BY 1")
def q_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the similarities of all vectors with all others, within and across topics."""
    return _percentiles(_dated(spark, d))


def _percentiles(v: DataFrame) -> DataFrame:
    found = X.pair_percentiles(v, emb="e", dim=DIM, key="r", label="topic", quantiles=QS)
    return found.select(F.col("same").alias("same_topic"), "n", *[r6(F.col("values")[i]).alias(f"p{str(q)[2:]}") for i, q in enumerate(QS)])


@query("similarity_percentiles_all", ALL_PAIRS_SQL + " SELECT coalesce(tq = tm, false) AS same_topic, count(*) AS n, " + ", ".join(f"round(quantile_cont(sim, {q}), 6) AS p{str(q)[2:]}" for q in QS) + " FROM pr GROUP BY 1")
def q_percentiles_all(spark: SparkSession, d: str) -> DataFrame:
    """The same under its earlier name."""
    return _percentiles(_dated(spark, d))


@query(
    "knn_regression",
    PAIRS_SQL
    + f""", {SCORED_SQL}, o AS (SELECT p.emb_row AS r, max(s.y) AS y FROM pred_sample p JOIN scored s ON s.paper_id = p.paper_id WHERE s.split = 'train' AND p.emb_row IS NOT NULL GROUP BY 1),
k AS (SELECT pr.q, pr.sim, o.y, row_number() OVER (PARTITION BY q ORDER BY sim DESC, m) AS rank FROM pr JOIN o ON o.r = pr.m)
SELECT q, round(sum(exp(50 * (sim - 1)) * ln(1 + y)) / sum(exp(50 * (sim - 1))), 6) AS pred, count(*) AS n FROM k WHERE rank <= 20 GROUP BY q""",
)
def q_knn(spark: SparkSession, d: str) -> DataFrame:
    """Citations predicted from the twenty most similar training papers, weighted by exp(50 sim)."""
    from loomwright.sources.tables import table

    v = _dated(spark, d)
    s = scored(spark, d).filter("split = 'train'").select("paper_id", "y")
    known = table(spark, d, "pred_sample").filter("emb_row is not null").join(s, "paper_id").groupBy(F.col("emb_row").alias("r")).agg(F.max("y").alias("y"))
    near = X.block_pairs(_asked(v), v.join(known.select("r"), "r", "left_semi"), key="r", emb="e", dim=DIM, k=20)
    return X.knn_regression(near, known, key="r", y="y", temperature=50.0).withColumn("pred", r6("pred"))


@query(
    "nearest_centroid",
    BASE_SQL
    + """, x AS (SELECT year, unnest(range(96)) AS i, unnest(e)::DOUBLE AS x FROM vy), m AS (SELECT year, i, avg(x) AS m FROM x GROUP BY 1, 2), c AS (SELECT year AS label, list(m ORDER BY i) AS c FROM m GROUP BY 1),
s AS (SELECT r, label, round(list_cosine_similarity(e::DOUBLE[], c), 9) AS sim FROM vy, c), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY sim DESC, label) AS rank FROM s)
SELECT r, label, round(sim, 6) AS sim FROM k WHERE rank = 1""",
)
def q_centroid(spark: SparkSession, d: str) -> DataFrame:
    """The year whose mean vector is nearest to each vector."""
    v = _dated(spark, d)
    near = X.nearest_centroid(v, materialise(X.centroids(v, "year", "e")), key="r", emb="e")
    return near.select("r", "label", r6("sim").alias("sim"))


@query("kmeans_clusters")
def q_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Cosine k-means fitted on the papers up to 2019, everyone assigned."""
    return X.spherical_kmeans(_dated(spark, d), key="r", emb="e", k=20, fit_on=F.col("year") <= 2019)


@query("pca_features")
def q_pca(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen principal components fitted on the papers up to 2019."""
    return X.principal_components(_dated(spark, d), key="r", emb="e", k=16, fit_on=F.col("year") <= 2019)


@query("preempted", PAIRS_SQL + FLAGS_SQL + " SELECT q, count(*) AS n_preempted, CAST(min(dq - dm) AS INT) AS min_days FROM st WHERE sim >= 0.9 AND ym - yq BETWEEN -1 AND 0 AND dq - dm BETWEEN 1 AND 183 AND pq <> 'year' AND pm <> 'year' AND NOT same_team AND NOT qm AND NOT mq GROUP BY q")
def q_preempted(spark: SparkSession, d: str) -> DataFrame:
    return V.preempted(_flagged(spark, d, _dated(spark, d)), least=0.9)


@query(
    "twin_pairs",
    PAIRS_SQL
    + """, tw AS (SELECT CASE WHEN dq < dm THEN q ELSE m END AS early_id, CASE WHEN dq < dm THEN m ELSE q END AS late_id, sim, CAST(abs(dq - dm) AS INT) AS gap, yq = ym AS same_year, pq = 'day' AND pm = 'day' AS both_day FROM pr
  WHERE sim >= 0.85 AND pq <> 'year' AND pm <> 'year' AND ym - yq BETWEEN -2 AND 2 AND abs(dq - dm) BETWEEN 1 AND 183 AND ((pq = 'day' AND pm = 'day') OR abs(dq - dm) >= 31) AND NOT same_team)
SELECT early_id, late_id, gap, same_year, both_day, round(max(sim), 6) AS sim FROM tw GROUP BY early_id, late_id, gap, same_year, both_day""",
)
def q_twins(spark: SparkSession, d: str) -> DataFrame:
    v = _dated(spark, d)
    return V.twin_pairs(_facts(v, _pairs(v, STRONG, None, 2, 2))).withColumn("sim", r6("sim"))


@query(
    "wave_position",
    PAIRS_SQL + FLAGS_SQL
    + """, w AS (SELECT q, count(*) FILTER (WHERE ym - yq = -1) AS prior, count(*) FILTER (WHERE ym = yq AND NOT qm AND NOT mq) AS same_year_independent, count(*) FILTER (WHERE ym - yq = 1 AND NOT qm AND NOT mq) AS next_year_independent,
  count(*) FILTER (WHERE ym - yq = 1 AND mq) AS followers FROM st GROUP BY q)
SELECT *, prior + same_year_independent + next_year_independent AS wave, round(prior / nullif(prior + same_year_independent + next_year_independent, 0), 6) AS share_before FROM w""",
)
def q_wave(spark: SparkSession, d: str) -> DataFrame:
    return V.wave_position(_flagged(spark, d, _dated(spark, d))).withColumn("share_before", r6("share_before"))


@query(
    "competition_descriptors",
    PAIRS_SQL
    + f""", {PANEL_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, m) AS rank FROM pr WHERE ym - yq BETWEEN -2 AND 0),
s AS (SELECT k.q, k.m, k.sim, k.rank, coalesce(sum(y.cites) FILTER (WHERE y.year <= k.yq), 0) AS strength FROM k LEFT JOIN py y ON y.id = k.mi WHERE rank <= 50 GROUP BY 1, 2, 3, 4)
SELECT q, count(*) AS n_rivals, round(avg(sim) FILTER (WHERE rank <= 10), 6) AS sim_top, round(avg(ln(1 + strength)), 6) AS strength_mean, round(max(ln(1 + strength)), 6) AS strength_max FROM s GROUP BY q""",
)
def q_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Competition sets described by similarity and by the rivals' citations up to the focal paper's year."""
    v = _dated(spark, d)
    top = V.with_ends(X.ranked(_pairs(v, k=50, back=2, ahead=0), 50), v, "r", "q", "m", ["id", "year"])
    panel = paper_year(papers(spark, d)).withColumnRenamed("id", "id_m").withColumnRenamed("year", "_y")
    strength = F.sum(F.when(F.col("_y") <= F.col("year_q"), F.col("cites")))
    s = top.join(panel, "id_m", "left").groupBy("q", "m", "sim", "rank").agg(F.coalesce(strength, F.lit(0)).alias("strength"))
    return V.descriptors(s, "strength").withColumns({c: r6(c) for c in ("sim_top", "strength_mean", "strength_max")})


MATCH_SQL = f"""WITH {PAPERS_SQL}, {PANEL_SQL}, f AS (SELECT p.id, p.year, lower(trim(p.type)) AS kind, ln(1 + coalesce(sum(cites) FILTER (WHERE y.year = p.year), 0)) AS lc0, ln(1 + coalesce(sum(cites) FILTER (WHERE y.year = p.year + 1), 0)) AS lc1,
  bool_or(coalesce(p.is_retracted, false)) AS hit FROM papers p LEFT JOIN py y ON y.id = p.id WHERE p.year IS NOT NULL AND p.type IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT t.id AS treated_id, c.id AS control_id, round(sqrt((t.lc0 - c.lc0) ** 2 + (t.lc1 - c.lc1) ** 2), 9) AS distance FROM f t JOIN f c ON t.year = c.year AND t.kind = c.kind WHERE t.hit AND NOT c.hit),
mt AS (SELECT *, CAST(row_number() OVER (PARTITION BY treated_id ORDER BY distance, control_id) AS INT) AS rank FROM k WHERE distance <= 0.3)"""


def _matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = papers(spark, d).filter("year is not null and type is not null").withColumn("kind", F.lower(F.trim("type")))
    t = P.yearly_targets(p.select("id", F.col("year").alias("start")), paper_year(p), "id", "start")
    f = p.join(t.select("id", F.log1p("y0").alias("lc0"), F.log1p("y1").alias("lc1")), "id").select("id", "year", "kind", "lc0", "lc1", F.coalesce("is_retracted", F.lit(False)).alias("hit"))
    f = materialise(f)
    return p, V.matched_controls(f.filter("hit"), f.filter("not hit"), key="id", within=["year", "kind"], on=["lc0", "lc1"])


@query("matched_controls", MATCH_SQL + " SELECT treated_id, control_id, round(distance, 6) AS distance, rank FROM mt WHERE rank <= 3")
def q_matched(spark: SparkSession, d: str) -> DataFrame:
    """Retracted papers and the papers of the same year and type most like them in their first two years."""
    return _matches(spark, d)[1].withColumn("distance", r6("distance"))


@query(
    "event_panel",
    MATCH_SQL
    + """, u AS (SELECT DISTINCT treated_id AS grp, treated_id AS unit, 1 AS treated FROM mt WHERE rank <= 3 UNION SELECT treated_id, control_id, 0 FROM mt WHERE rank <= 3)
SELECT u.grp, u.unit, u.treated, r.rel, coalesce(y.cites, 0) AS value FROM u JOIN papers p ON p.id = u.unit, (SELECT CAST(unnest(range(6)) AS INT) AS rel) r LEFT JOIN py y ON y.id = u.unit AND y.year = p.year + r.rel""",
)
def q_event(spark: SparkSession, d: str) -> DataFrame:
    p, m = _matches(spark, d)
    return V.event_panel(m, paper_year(p), p, key="id", start="year", value="cites", last=5)
