"""Queries that put features of several kinds together: pair tables, focal tables, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.functions.columns import cosine, full_date
from loomwright.operators import graph as G
from loomwright.operators import panel as P
from loomwright.operators import resolve as R
from loomwright.operators import rivals as V
from loomwright.operators import vector as X
from loomwright.plans.base import DIM, EDGES_SQL, PANEL_SQL, PAPERS_SQL, edges, paper_year, papers, vectors
from loomwright.plans.linking import COUPLING_SQL
from loomwright.plans.similarity import ALL_PAIRS_SQL, PAIRS_SQL, STRONG, _dated, _pairs
from loomwright.registry import query
from loomwright.session import materialise
from loomwright.sources.tables import table

r6 = lambda c: F.round(c, 6)


@query(
    "pair_table",
    PAIRS_SQL
    + f""", {EDGES_SQL}, {COUPLING_SQL}, s2 AS (SELECT least(qi, mi) AS a, greatest(qi, mi) AS b, max(sim) AS sim FROM pr WHERE sim >= {STRONG} AND ym - yq BETWEEN -1 AND 1 AND qi <> mi GROUP BY 1, 2),
u AS (SELECT coalesce(s2.a, cp.a) AS a, coalesce(s2.b, cp.b) AS b, s2.a IS NOT NULL AS by_vector, cp.a IS NOT NULL AS by_coupling, s2.sim, coalesce(cp.shared, 0) AS shared, coalesce(cp.jaccard, 0) AS jaccard FROM s2 FULL JOIN cp ON s2.a = cp.a AND s2.b = cp.b)
SELECT u.a, u.b, by_vector, by_coupling, round(sim, 6) AS sim, shared, round(jaccard, 6) AS jaccard, coalesce(x.topic = y.topic, false) AS same_topic, y.year - x.year AS dyear, e.citing_id IS NOT NULL AS a_cites_b, f.citing_id IS NOT NULL AS b_cites_a
FROM u LEFT JOIN papers x ON x.id = u.a LEFT JOIN papers y ON y.id = u.b LEFT JOIN edges e ON e.citing_id = u.a AND e.cited_id = u.b LEFT JOIN edges f ON f.citing_id = u.b AND f.cited_id = u.a""",
)
def q_pair_table(spark: SparkSession, d: str) -> DataFrame:
    """Rivals found by vectors or by shared references in one table, with what relates them."""
    v = _dated(spark, d)
    s2 = V.with_ends(_pairs(v, STRONG, None, 1, 1), v, "r", "q", "m", ["id"]).filter("id_q <> id_m")
    s2 = s2.groupBy(F.least("id_q", "id_m").alias("a"), F.greatest("id_q", "id_m").alias("b")).agg(F.max("sim").alias("sim"))
    s3 = G.coupling(table(spark, d, "paper_ref"), paper="paper_id", ref="ref", year="y")
    u = s2.withColumn("v", F.lit(True)).join(s3.withColumn("c", F.lit(True)), ["a", "b"], "full")
    p = papers(spark, d).select("id", "topic", "year")
    ends = u.join(p.select(F.col("id").alias("a"), F.col("topic").alias("ta"), F.col("year").alias("ya")), "a", "left").join(p.select(F.col("id").alias("b"), F.col("topic").alias("tb"), F.col("year").alias("yb")), "b", "left")
    zero, no = F.lit(0), F.lit(False)
    wide = ends.select(
        "a", "b", F.coalesce("v", no).alias("by_vector"), F.coalesce("c", no).alias("by_coupling"), r6("sim").alias("sim"), F.coalesce("shared", zero).alias("shared"), r6(F.coalesce("jaccard", F.lit(0.0))).alias("jaccard"),
        F.coalesce(F.col("ta") == F.col("tb"), no).alias("same_topic"), (F.col("yb") - F.col("ya")).alias("dyear"),
    )
    return G.mutual_flags(wide, edges(spark, d), "a", "b")


@query(
    "pair_table_all",
    ALL_PAIRS_SQL
    + f""", {EDGES_SQL}, {COUPLING_SQL}, u AS (SELECT least(qi, mi) AS a, greatest(qi, mi) AS b FROM pr WHERE sim >= {STRONG} AND ym - yq BETWEEN -1 AND 1 AND qi <> mi UNION SELECT a, b FROM cp),
rs AS (SELECT DISTINCT paper_id AS p, ref AS r FROM paper_ref WHERE paper_id IS NOT NULL AND ref IS NOT NULL), rn AS (SELECT p, count(*) AS n FROM rs GROUP BY p),
sh AS (SELECT u.a, u.b, count(*) AS shared FROM u JOIN rs x ON x.p = u.a JOIN rs y ON y.p = u.b AND y.r = x.r GROUP BY 1, 2),
sm AS (SELECT u.a, u.b, max(round(list_cosine_similarity(x.e::DOUBLE[], y.e::DOUBLE[]), 9)) AS sim FROM u JOIN vec x ON x.id = u.a JOIN vec y ON y.id = u.b GROUP BY 1, 2)
SELECT u.a, u.b, coalesce(sim >= {STRONG} AND abs(y.year - x.year) <= 1, false) AS by_vector, cp.a IS NOT NULL AS by_coupling, round(sim, 6) AS sim, coalesce(sh.shared, 0) AS shared,
  round(coalesce(sh.shared, 0) / nullif(coalesce(m.n, 0) + coalesce(l.n, 0) - coalesce(sh.shared, 0), 0), 6) AS jaccard, coalesce(x.topic = y.topic, false) AS same_topic, y.year - x.year AS dyear, CAST(dy.day - dx.day AS INT) AS ddays,
  e.citing_id IS NOT NULL AS a_cites_b, f.citing_id IS NOT NULL AS b_cites_a, e.citing_id IS NULL AND f.citing_id IS NULL AS is_strict
FROM u LEFT JOIN cp ON cp.a = u.a AND cp.b = u.b LEFT JOIN sh ON sh.a = u.a AND sh.b = u.b LEFT JOIN sm ON sm.a = u.a AND sm.b = u.b LEFT JOIN rn m ON m.p = u.a LEFT JOIN rn l ON l.p = u.b LEFT JOIN papers x ON x.id = u.a LEFT JOIN papers y ON y.id = u.b
LEFT JOIN dt dx ON dx.id = u.a LEFT JOIN dt dy ON dy.id = u.b LEFT JOIN edges e ON e.citing_id = u.a AND e.cited_id = u.b LEFT JOIN edges f ON f.citing_id = u.b AND f.cited_id = u.a""",
)
def q_pair_table_all(spark: SparkSession, d: str) -> DataFrame:
    """Rivals found by the vectors of all papers or by shared references, with everything that relates them worked out for every pair.

    ``sim`` is the greatest cosine of the two papers' vectors, null where one has none; ``shared`` and ``jaccard`` are of the whole
    reference sets; ``ddays`` is b's date less a's, with dates known to the year only taken as 1 January.
    """
    v = _dated(spark, d)
    near = X.block_pairs(v, v, key="r", emb="e", dim=DIM, least=STRONG, year="year", back=1, ahead=1)
    s2 = V.with_ends(near, v, "r", "q", "m", ["id"]).filter("id_q <> id_m").select(F.least("id_q", "id_m").alias("a"), F.greatest("id_q", "id_m").alias("b")).distinct()
    s3 = G.coupling(table(spark, d, "paper_ref"), paper="paper_id", ref="ref", year="y").select("a", "b", F.lit(True).alias("c"))
    u = materialise(s2.join(s3, ["a", "b"], "full"))
    x, y = (vectors(spark, d).filter("id is not null").select(F.col("id").alias(k), F.col("e").alias(f"_{k}")) for k in ("a", "b"))
    sims = u.select("a", "b").join(x, "a").join(y, "b").groupBy("a", "b").agg(F.max(F.round(cosine("_a", "_b"), X.DECIMALS)).alias("sim"))
    p = papers(spark, d)
    dates = R.date_precision(p.select("id", "publication_date", "arxiv_id", "year"), "id").select("id", F.col("first_date").alias("date"))
    p = p.select("id", "topic", "year").join(dates, "id", "left")
    facts = G.shared_references(u.join(sims, ["a", "b"], "left"), table(spark, d, "paper_ref"), a="a", b="b", paper="paper_id", ref="ref")
    for k in ("a", "b"):
        facts = facts.join(p.select(F.col("id").alias(k), F.col("topic").alias(f"t{k}"), F.col("year").alias(f"y{k}"), F.col("date").alias(f"d{k}")), k, "left")
    no, dyear = F.lit(False), F.col("yb") - F.col("ya")
    wide = facts.select(
        "a", "b", F.coalesce((F.col("sim") >= STRONG) & (F.abs(dyear) <= 1), no).alias("by_vector"), F.coalesce("c", no).alias("by_coupling"), r6("sim").alias("sim"), "shared", r6("jaccard").alias("jaccard"),
        F.coalesce(F.col("ta") == F.col("tb"), no).alias("same_topic"), dyear.alias("dyear"), F.datediff("db", "da").alias("ddays"),
    )
    return G.mutual_flags(wide, edges(spark, d), "a", "b").withColumn("is_strict", ~F.col("a_cites_b") & ~F.col("b_cites_a"))


@query(
    "rival_strength",
    PAIRS_SQL
    + f""", {PANEL_SQL}, s AS (SELECT pr.q, pr.m, coalesce(sum(y.cites) FILTER (WHERE y.year <= pr.yq), 0) AS c FROM pr LEFT JOIN py y ON y.id = pr.mi WHERE sim >= {STRONG} AND ym - yq = -1 GROUP BY 1, 2)
SELECT q, CAST(sum(c) AS BIGINT) AS rival_cites, CAST(max(c) AS BIGINT) AS rival_cites_max FROM s GROUP BY q""",
)
def q_strength(spark: SparkSession, d: str) -> DataFrame:
    """Citations up to the focal year of the strong rivals of the year before."""
    v = _dated(spark, d)
    near = X.block_pairs(v.filter("r % 50 = 0"), v, key="r", emb="e", dim=96, least=STRONG, year="year", back=1, ahead=-1)
    panel = paper_year(papers(spark, d)).withColumnRenamed("id", "id_m").withColumnRenamed("year", "_y")
    s = V.with_ends(near, v, "r", "q", "m", ["id", "year"]).join(panel, "id_m", "left")
    s = s.groupBy("q", "m").agg(F.coalesce(F.sum(F.when(F.col("_y") <= F.col("year_q"), F.col("cites"))), F.lit(0)).alias("c"))
    return s.groupBy("q").agg(F.sum("c").alias("rival_cites"), F.max("c").alias("rival_cites_max"))


@query(
    "coupled_prior",
    f"WITH {PAPERS_SQL}, {COUPLING_SQL}, w AS (SELECT a AS p, b AS o FROM cp UNION ALL SELECT b, a FROM cp) SELECT w.p AS id, count(*) AS n_prior FROM w JOIN papers x ON x.id = w.p JOIN papers y ON y.id = w.o WHERE y.year = x.year - 1 GROUP BY 1",
)
def q_coupled_prior(spark: SparkSession, d: str) -> DataFrame:
    """Coupled papers of the year before."""
    s3 = G.coupling(table(spark, d, "paper_ref"), paper="paper_id", ref="ref", year="y")
    both = s3.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("o")), F.struct(F.col("b").alias("id"), F.col("a").alias("o")))))
    y = papers(spark, d).select("id", "year")
    ends = both.join(y, "id").join(y.select(F.col("id").alias("o"), F.col("year").alias("yo")), "o")
    return ends.filter(F.col("yo") == F.col("year") - 1).groupBy("id").agg(F.count(F.lit(1)).alias("n_prior"))


@query(
    "venue_at_time",
    f"""WITH {PAPERS_SQL}, v AS (SELECT *, CASE WHEN regexp_full_match(publication_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND publication_date >= '0001' THEN year(try_cast(publication_date AS DATE)) END AS py FROM papers)
SELECT id, CASE WHEN out AND kind IS DISTINCT FROM 'preprint' AND kind IS NOT NULL THEN kind WHEN length(arxiv_id) >= 0 THEN 'arxiv' ELSE 'preprint_other' END AS venue, if(out, source_id, NULL) AS source, arxiv_id IS NOT NULL OR coalesce(kind = 'preprint', false) AS has_preprint
FROM (SELECT *, lower(trim(type)) AS kind, coalesce(py <= year, false) AS out FROM v)""",
)
def q_venue_at(spark: SparkSession, d: str) -> DataFrame:
    """The venue as it stood at the end of the paper's first year."""
    out = F.coalesce(F.year(full_date("publication_date")) <= F.col("year"), F.lit(False))
    kind = F.lower(F.trim("type"))
    venue = F.when(out & (kind != "preprint"), kind).when(F.col("arxiv_id").isNotNull(), "arxiv").otherwise("preprint_other")
    return papers(spark, d).select("id", venue.alias("venue"), F.when(out, F.col("source_id")).alias("source"), (F.col("arxiv_id").isNotNull() | F.coalesce(kind == "preprint", F.lit(False))).alias("has_preprint"))


FOCAL_SQL = f"""WITH {PAPERS_SQL}, {PANEL_SQL}, foc AS (SELECT id, year, topic FROM papers WHERE year BETWEEN 2017 AND 2021 AND n_refs >= 5 AND length(title) > 0),
t AS (SELECT f.id, CAST(coalesce(sum(cites) FILTER (WHERE y.year = f.year), 0) AS BIGINT) AS y0, CAST(coalesce(sum(cites) FILTER (WHERE y.year BETWEEN f.year + 1 AND f.year + 3), 0) AS BIGINT) AS y3 FROM foc f LEFT JOIN py y ON y.id = f.id GROUP BY 1),
s AS (SELECT topic, year, count(*) AS n FROM papers WHERE topic IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2),
own AS (SELECT p.id, p.topic, p.year, coalesce(sum(cites) FILTER (WHERE y.year BETWEEN p.year + 1 AND p.year + 3), 0) AS three FROM papers p LEFT JOIN py y ON y.id = p.id WHERE p.year IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT topic, year + 3 AS y, avg(ln(1 + three)) AS m FROM own GROUP BY 1, 2)
SELECT f.id, f.year, f.topic, t.y0, t.y3, coalesce(a.n, 0) AS supply, coalesce(b.n, 0) AS supply_before, round(c.m, 6) AS cohort_y3 FROM foc f JOIN t ON t.id = f.id LEFT JOIN s a ON a.topic = f.topic AND a.year = f.year LEFT JOIN s b ON b.topic = f.topic AND b.year = f.year - 1
LEFT JOIN c ON c.topic = f.topic AND c.y = f.year"""


@query("focal_table", FOCAL_SQL)
def q_focal(spark: SparkSession, d: str) -> DataFrame:
    """One row per focal paper: targets, topic supply now and before, and what the topic's cohort of three years ago had reached."""
    p = papers(spark, d)
    panel = paper_year(p)
    foc = p.filter("year between 2017 and 2021 and n_refs >= 5 and length(title) > 0").select("id", "year", "topic")
    t = P.yearly_targets(foc.select("id", F.col("year").alias("start")), panel, "id", "start").select("id", "y0", F.col("total").alias("y3"))
    s = p.dropna(subset=["topic", "year"]).groupBy("topic", "year").agg(F.count(F.lit(1)).alias("n"))
    sent = s.select("topic", F.inline(F.array(F.struct("year", F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b")), F.struct((F.col("year") + 1).alias("year"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b")))))
    supply = sent.groupBy("topic", "year").agg(F.sum("a").alias("supply"), F.sum("b").alias("supply_before"))
    c = P.cohort_stats(p.select("id", F.col("year").alias("cohort"), "topic"), panel, key="id", group="topic", year="cohort").select(F.col("group").alias("topic"), F.col("at").alias("year"), r6("y3_mean").alias("cohort_y3"))
    wide = foc.join(t, "id").join(supply, ["topic", "year"], "left").join(c, ["topic", "year"], "left")
    return wide.select("id", "year", "topic", "y0", "y3", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("supply", "supply_before")], "cohort_y3")


@query(
    "snapshot_edges",
    f"""WITH {PAPERS_SQL}, x AS (SELECT id, year, unnest(refs) AS ref, unnest(range(len(refs))) AS pos FROM papers WHERE year IS NOT NULL),
k AS (SELECT x.id, x.year, x.ref, row_number() OVER (PARTITION BY x.id ORDER BY pos) AS "at" FROM x JOIN papers t ON t.id = x.ref WHERE t.year <= x.year),
a AS (SELECT id, year, unnest(author_ids) AS au, unnest(range(len(author_ids))) AS pos FROM papers WHERE year IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS "at" FROM a WHERE au IS NOT NULL)
SELECT 'reference' AS kind, year, id AS src, ref AS dst, "at" FROM k WHERE "at" <= 100 UNION ALL SELECT 'author', year, id, au, "at" FROM b WHERE "at" <= 20 UNION ALL SELECT 'venue', year, id, source_id, 1 FROM papers WHERE year IS NOT NULL AND source_id IS NOT NULL""",
)
def q_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges of the yearly snapshot graph: the first found references (none to the future), authors and the venue of each paper."""
    p = papers(spark, d).filter("year is not null")
    refs = p.select("id", "year", F.posexplode("refs").alias("pos", "dst")).join(p.select(F.col("id").alias("dst"), F.col("year").alias("yd")), "dst").filter("yd <= year")
    team = p.select("id", "year", F.posexplode("author_ids").alias("pos", "dst")).filter("dst is not null")
    at = F.row_number().over(W.partitionBy("id").orderBy("pos"))  # a paper's own lists

    def first(df: DataFrame, kind: str, n: int) -> DataFrame:
        return df.withColumn("at", at).filter(F.col("at") <= n).select(F.lit(kind).alias("kind"), "year", F.col("id").alias("src"), "dst", "at")

    venue = p.filter("source_id is not null").select(F.lit("venue").alias("kind"), "year", F.col("id").alias("src"), F.col("source_id").alias("dst"), F.lit(1).alias("at"))
    return first(refs, "reference", 100).unionByName(first(team, "author", 20)).unionByName(venue)


@query(
    "variant_supply",
    f"WITH {PAPERS_SQL}, s AS (SELECT topic, year, count(*) AS n, count(*) FILTER (WHERE lower(trim(type)) IN ('article', 'review')) AS n_variant FROM papers WHERE topic IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2) SELECT * FROM s",
)
def q_variant(spark: SparkSession, d: str) -> DataFrame:
    """Topic supply of all papers and of a variant of types, which can only be smaller."""
    p = papers(spark, d).dropna(subset=["topic", "year"])
    variant = F.lower(F.trim("type")).isin("article", "review")
    return p.groupBy("topic", "year").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(variant, 1)).alias("n_variant"))
