"""Queries over citation graphs and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.columns import title_words
from loomwright.operators import graph as G
from loomwright.operators import resolve as R
from loomwright.plans.base import DATES_SQL, EDGES_SQL, PAPERS_SQL, edges, paper_year, papers
from loomwright.registry import query
from loomwright.session import materialise
from loomwright.sources.tables import table

WP = f"WITH RECURSIVE {PAPERS_SQL}"
r6 = lambda c: F.round(c, 6)

REFS_SQL = "redges AS (SELECT citing_id, cited_id, min(year) AS citing_year FROM (SELECT id AS citing_id, unnest(refs) AS cited_id, year FROM papers) WHERE cited_id IS NOT NULL AND citing_id <> cited_id GROUP BY 1, 2)"


def _ref_edges(p: DataFrame) -> DataFrame:
    return G.reference_edges(p, None, key="id", refs="refs", year="year")


@query("citation_edges", f"{WP}, {REFS_SQL} SELECT * FROM redges")
def q_citation_edges(spark: SparkSession, d: str) -> DataFrame:
    return _ref_edges(papers(spark, d))


@query(
    "self_citations",
    f"""{WP}, {REFS_SQL}, au AS (SELECT DISTINCT id, a FROM (SELECT id, unnest(author_ids) AS a FROM papers) WHERE a IS NOT NULL),
s AS (SELECT DISTINCT r.citing_id, r.cited_id FROM redges r JOIN au x ON x.id = r.citing_id JOIN au y ON y.id = r.cited_id AND x.a = y.a)
SELECT r.*, s.citing_id IS NOT NULL AS is_self_cite FROM redges r LEFT JOIN s ON s.citing_id = r.citing_id AND s.cited_id = r.cited_id""",
)
def q_self(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    return G.self_citations(_ref_edges(p), p, key="id", authors="author_ids")


COUPLING_SQL = """o AS (SELECT DISTINCT paper_id AS p, ref AS r, CAST(y AS INT) AS y FROM paper_ref WHERE paper_id IS NOT NULL AND ref IS NOT NULL AND y IS NOT NULL),
n AS (SELECT p, count(DISTINCT r) AS n FROM o GROUP BY p), k AS (SELECT o.* FROM o WHERE r IN (SELECT r FROM o GROUP BY r HAVING count(DISTINCT p) <= 500)),
c AS (SELECT x.p AS a, y.p AS b, count(DISTINCT x.r) AS shared FROM k x JOIN k y ON x.r = y.r AND x.p < y.p AND abs(x.y - y.y) <= 1 GROUP BY 1, 2 HAVING count(DISTINCT x.r) >= 3),
cp AS (SELECT a, b, shared, shared / (m.n + l.n - shared) AS jaccard FROM c JOIN n m ON m.p = a JOIN n l ON l.p = b WHERE shared / (m.n + l.n - shared) >= 0.05)"""


def _coupled(spark: SparkSession, d: str) -> DataFrame:
    return G.coupling(table(spark, d, "paper_ref"), paper="paper_id", ref="ref", year="y")


@query("coupling_pairs", f"WITH {COUPLING_SQL} SELECT a, b, shared, round(jaccard, 6) AS jaccard FROM cp")
def q_coupling(spark: SparkSession, d: str) -> DataFrame:
    return _coupled(spark, d).withColumn("jaccard", r6("jaccard"))


@query(
    "mutual_citation_flags",
    f"WITH {COUPLING_SQL}, {EDGES_SQL} SELECT a, b, x.citing_id IS NOT NULL AS a_cites_b, y.citing_id IS NOT NULL AS b_cites_a FROM cp LEFT JOIN edges x ON x.citing_id = a AND x.cited_id = b LEFT JOIN edges y ON y.citing_id = b AND y.cited_id = a",
)
def q_mutual(spark: SparkSession, d: str) -> DataFrame:
    return G.mutual_flags(_coupled(spark, d).select("a", "b"), edges(spark, d), "a", "b")


@query("cocitation", f"WITH {COUPLING_SQL}, {EDGES_SQL}, z AS (SELECT a, b, count(*) AS c FROM cp JOIN edges x ON x.cited_id = a JOIN edges y ON y.cited_id = b AND y.citing_id = x.citing_id GROUP BY 1, 2) SELECT cp.a, cp.b, coalesce(c, 0) AS n_cocited FROM cp LEFT JOIN z ON z.a = cp.a AND z.b = cp.b")
def q_cocitation(spark: SparkSession, d: str) -> DataFrame:
    return G.cocitation(_coupled(spark, d).select("a", "b"), edges(spark, d), "a", "b")


@query(
    "graph_export",
    f"""WITH {EDGES_SQL}, n AS (SELECT citing_id AS id FROM edges UNION SELECT cited_id FROM edges), a AS (SELECT citing_id AS id, list_sort(list(cited_id)) AS l FROM edges GROUP BY 1), b AS (SELECT cited_id AS id, list_sort(list(citing_id)) AS l FROM edges GROUP BY 1)
SELECT n.id, coalesce(array_to_string(a.l, ','), '') AS refs, coalesce(array_to_string(b.l, ','), '') AS cites FROM n LEFT JOIN a USING (id) LEFT JOIN b USING (id)""",
)
def q_export(spark: SparkSession, d: str) -> DataFrame:
    return G.export_lists(edges(spark, d)).select("id", *[F.array_join(c, ",").alias(c) for c in ("refs", "cites")])


VE_SQL = """star AS (
  SELECT k, id, 'doi' AS via FROM (SELECT lower(trim(doi)) AS k, id FROM papers) WHERE length(k) > 0 UNION ALL SELECT k, id, 'arxiv' FROM (SELECT lower(trim(arxiv_id)) AS k, id FROM papers) WHERE length(k) > 0),
stars AS (SELECT h.a, s.id AS b, s.via FROM star s JOIN (SELECT k, via, min(id) AS a FROM star GROUP BY 1, 2) h ON h.k = s.k AND h.via = s.via WHERE s.id <> h.a),
tk AS (SELECT id, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g') AS k, year, arxiv_id, list_filter(coalesce(author_ids, []), lambda x: x IS NOT NULL) AS au, (coalesce(lower(trim(type)), '') = 'preprint' OR arxiv_id IS NOT NULL) AS early FROM papers),
tb AS (SELECT * FROM tk WHERE length(k) >= 20 AND k IN (SELECT k FROM tk GROUP BY k HAVING count(*) BETWEEN 2 AND 5)),
te AS (SELECT x.id AS a, y.id AS b, 'title' AS via FROM tb x JOIN tb y ON x.k = y.k AND x.id < y.id WHERE (x.early OR y.early) AND abs(x.year - y.year) <= 3 AND NOT coalesce(x.arxiv_id <> y.arxiv_id, false) AND list_has_any(x.au, y.au)),
ve AS (SELECT * FROM stars UNION ALL SELECT * FROM te)"""
VG_SQL = f"""{VE_SQL}, ue AS (SELECT a AS x, b AS y FROM ve UNION SELECT b, a FROM ve), reach(id, low) AS (SELECT x, x FROM ue UNION SELECT e.y, r.low FROM reach r JOIN ue e ON e.x = r.id WHERE r.low < e.y),
grp AS (SELECT id AS member_id, min(low) AS comp FROM reach GROUP BY id), bel AS (SELECT * FROM grp WHERE comp IN (SELECT comp FROM grp GROUP BY comp HAVING count(*) <= 6))"""


def _version_edges(p: DataFrame) -> DataFrame:
    return R.version_edges(p)


@query("version_edges", f"{WP}, {VE_SQL} SELECT a, b, via FROM ve")
def q_version_edges(spark: SparkSession, d: str) -> DataFrame:
    return _version_edges(papers(spark, d))


@query("version_groups", f"{WP}, {VG_SQL} SELECT member_id, comp FROM grp")
def q_groups(spark: SparkSession, d: str) -> DataFrame:
    return R.group_ids(_version_edges(papers(spark, d)))


@query("believed_groups", f"{WP}, {VG_SQL} SELECT member_id, comp FROM bel")
def q_believed(spark: SparkSession, d: str) -> DataFrame:
    return R.believed_groups(R.group_ids(_version_edges(papers(spark, d))))


REP_SQL = f"""{VG_SQL}, m AS (SELECT b.comp, p.*, CASE lower(trim(p.type)) WHEN 'article' THEN 0 WHEN 'book-chapter' THEN 1 WHEN 'preprint' THEN 2 ELSE 3 END AS tr FROM bel b JOIN papers p ON p.id = b.member_id),
rep AS (SELECT comp, paper_id FROM (SELECT comp, id AS paper_id, row_number() OVER (PARTITION BY comp ORDER BY tr, cited_by_count DESC NULLS LAST, id) AS rn FROM m) WHERE rn = 1)"""


def _members(p: DataFrame) -> DataFrame:
    groups = R.believed_groups(R.group_ids(_version_edges(p)))
    return materialise(groups.join(p, groups["member_id"] == p["id"]).drop("member_id"))


def _reps(m: DataFrame) -> DataFrame:
    kind = F.lower(F.trim("type"))
    rank = F.when(kind == "article", 0).when(kind == "book-chapter", 1).when(kind == "preprint", 2).otherwise(3)
    return R.representatives(m, "comp", [rank, F.col("cited_by_count").isNull(), -F.col("cited_by_count")], "id")


@query("representatives", f"{WP}, {REP_SQL} SELECT comp, paper_id FROM rep")
def q_reps(spark: SparkSession, d: str) -> DataFrame:
    return _reps(_members(papers(spark, d)))


@query(
    "rollup_entities",
    f"""{WP}, {REP_SQL}, au AS (SELECT comp, array_to_string(list_sort(list(DISTINCT a)), ',') AS l FROM (SELECT comp, unnest(author_ids) AS a FROM m) WHERE a IS NOT NULL GROUP BY 1),
rf AS (SELECT comp, count(DISTINCT a) AS n FROM (SELECT comp, unnest(refs) AS a FROM m) WHERE a IS NOT NULL GROUP BY 1)
SELECT m.comp, min(year) AS first_year, coalesce(max(au.l), '') AS authors_union, coalesce(max(rf.n), 0) AS n_refs_union, CAST(coalesce(sum(cited_by_count), 0) AS BIGINT) AS cited_by_count,
coalesce(bool_or(lower(trim(type)) = 'preprint'), false) AS has_preprint, coalesce(bool_or(is_retracted), false) AS any_retracted, count(*) AS n_versions FROM m LEFT JOIN au ON au.comp = m.comp LEFT JOIN rf ON rf.comp = m.comp GROUP BY m.comp""",
)
def q_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = R.roll_up(_members(papers(spark, d)), "comp")
    return r.select("comp", "first_year", F.array_join("authors_union", ",").alias("authors_union"), F.size("refs_union").alias("n_refs_union"), "cited_by_count", "has_preprint", "any_retracted", "n_versions")


@query(
    "merge_remap",
    f"""{WP}, {REP_SQL}, {REFS_SQL}, mm AS (SELECT m.id AS old_id, r.paper_id AS new_id FROM m JOIN rep r ON r.comp = m.comp)
SELECT coalesce(x.new_id, citing_id) AS citing_id, coalesce(y.new_id, cited_id) AS cited_id, min(citing_year) AS citing_year FROM redges LEFT JOIN mm x ON x.old_id = citing_id LEFT JOIN mm y ON y.old_id = cited_id
WHERE coalesce(x.new_id, citing_id) <> coalesce(y.new_id, cited_id) GROUP BY 1, 2""",
)
def q_remap(spark: SparkSession, d: str) -> DataFrame:
    """Citation edges between groups of versions: both ends replaced, edges inside a group dropped, the rest made distinct."""
    p = papers(spark, d)
    m = _members(p)
    mapping = materialise(R.merge_map(m.select("comp", F.col("id").alias("member_id")), _reps(m)))
    return G.reference_edges(p, mapping, key="id", refs="refs", year="year")


@query(
    "remap_panel",
    f"""{WP}, {REP_SQL}, py AS (SELECT id, year, CAST(sum(n) AS BIGINT) AS cites FROM (SELECT id, CAST(unnest(cby_year) AS INT) AS year, unnest(cby_count) AS n FROM papers) WHERE year IS NOT NULL AND n IS NOT NULL GROUP BY 1, 2),
mm AS (SELECT m.id AS old_id, r.paper_id AS new_id FROM m JOIN rep r ON r.comp = m.comp) SELECT coalesce(new_id, id) AS id, year, CAST(sum(cites) AS BIGINT) AS cites FROM py LEFT JOIN mm ON old_id = id GROUP BY 1, 2""",
)
def q_remap_panel(spark: SparkSession, d: str) -> DataFrame:
    """The citation panel summed over versions; its total is that of the versions."""
    p = papers(spark, d)
    m = _members(p)
    mapping = R.merge_map(m.select("comp", F.col("id").alias("member_id")), _reps(m))
    return G.remap(paper_year(p), mapping, "id").groupBy("id", "year").agg(F.sum("cites").alias("cites"))


@query("junk_filter", f"{WP}, t AS (SELECT id, trim(regexp_replace(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS w FROM papers) SELECT id FROM t WHERE length(w) < 10 OR regexp_matches(w, '{R.STOP_TITLES}')")
def q_junk(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).filter(R.is_junk("title")).select("id")


ND_SQL = f"""pw AS (SELECT id, year, trim(regexp_replace(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM papers),
team AS (SELECT DISTINCT id, a FROM (SELECT id, unnest(author_ids) AS a FROM papers) WHERE a IS NOT NULL), heads AS (SELECT id, count(*) AS n FROM team GROUP BY id),
block AS (SELECT t, unnest(list(id)) AS id FROM pw WHERE t <> '' GROUP BY t HAVING count(*) IN (2, 3, 4, 5)),
cand AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT x.id AS a, y.id AS b FROM block x JOIN block y USING (t) UNION ALL SELECT a, b FROM merge_edge) WHERE a <> b AND a IN (FROM (SELECT id FROM pw)) AND b IN (FROM (SELECT id FROM pw))),
numeral AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(string_split(t, ' ')) AS w FROM pw) WHERE regexp_matches(w, '{R.PART_WORD}')),
na AS (SELECT a, b, w FROM cand JOIN numeral ON id = a), nb AS (SELECT a, b, w FROM cand JOIN numeral ON id = b),
apart AS (SELECT DISTINCT a, b FROM ((FROM na EXCEPT FROM nb) UNION ALL (FROM nb EXCEPT FROM na))),
both_sign AS (SELECT c.a, c.b, count(*) AS sh FROM (SELECT a, b FROM cand) c JOIN team x ON x.id = c.a JOIN team y ON y.id = c.b AND y.a = x.a GROUP BY ALL),
ft AS (SELECT c.a, c.b, x.t AS ta, y.t AS tb, abs(x.year - y.year) AS dy, jaro_winkler_similarity(x.t, y.t) AS sim, coalesce(s.sh, 0) AS sh, coalesce(h.n, 0) + coalesce(k.n, 0) - coalesce(s.sh, 0) AS un, z.a IS NOT NULL AS parts
  FROM cand c JOIN pw x ON x.id = c.a JOIN pw y ON y.id = c.b LEFT JOIN both_sign s ON s.a = c.a AND s.b = c.b LEFT JOIN heads h ON h.id = c.a LEFT JOIN heads k ON k.id = c.b LEFT JOIN apart z ON z.a = c.a AND z.b = c.b)"""


@query(
    "near_duplicates",
    f"{WP}, {ND_SQL} SELECT a, b, round(sim, 6) AS title_sim, round(sh / greatest(un, 1), 6) AS auth_jacc, ta = tb AS same_title FROM ft WHERE sh > 0 AND dy <= 3 AND NOT parts AND ((sh / greatest(un, 1) >= 0.5 AND sim >= 0.9) OR ta = tb)",
)
def q_near(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs (equal titles in small blocks, and matched pairs) that are one paper."""
    p = papers(spark, d)
    matched = table(spark, d, "merge_edge").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cand = R.same_title_pairs(p).unionByName(matched)
    return R.near_duplicate_edges(cand, p).withColumns({c: r6(c) for c in ("title_sim", "auth_jacc")})


@query(
    "pair_classes",
    f"""{WP}, {ND_SQL}, k AS (SELECT *, length(ta) < 10 OR length(tb) < 10 OR regexp_matches(ta, '{R.STOP_TITLES}') OR regexp_matches(tb, '{R.STOP_TITLES}') AS junk FROM ft)
SELECT a, b, CASE WHEN junk THEN 'junk' WHEN (sh / greatest(un, 1) >= 0.5 AND sim >= 0.9) OR (ta = tb AND sh > 0) THEN 'same' WHEN sh > 0 THEN 'same team' ELSE 'different team' END AS kind FROM k""",
)
def q_pair_classes(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs as junk, likely the same paper, of the same team, or of different teams."""
    from loomwright.functions.columns import jaccard, shared

    p = papers(spark, d)
    matched = table(spark, d, "merge_edge").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cand = R.same_title_pairs(p).unionByName(matched).distinct()
    own = p.select("id", title_words("title").alias("t"), "author_ids", R.is_junk("title").alias("junk"))
    x, y = (own.select(F.col("id").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("t", "author_ids", "junk")]) for c in ("a", "b"))
    rated = R.title_similarity(cand.join(x, "a").join(y, "b"), "t_a", "t_b")
    n = shared("author_ids_a", "author_ids_b")
    same = ((jaccard("author_ids_a", "author_ids_b") >= 0.5) & (F.col("title_sim") >= 0.9)) | ((F.col("t_a") == F.col("t_b")) & (n > 0))
    kind = F.when(F.col("junk_a") | F.col("junk_b"), "junk").when(same, "same").when(n > 0, "same team").otherwise("different team")
    return rated.select("a", "b", kind.alias("kind"))


@query("date_precision", f"{WP}, {DATES_SQL} SELECT id, year AS first_year, CAST(day AS VARCHAR) AS first_date, prec AS precision FROM dt")
def q_dates(spark: SparkSession, d: str) -> DataFrame:
    return R.date_precision(papers(spark, d), "id").withColumn("first_date", F.col("first_date").cast("string"))


@query(
    "venue_classes",
    """WITH c AS (SELECT paper_id, trim(lower(coalesce(venue_class, ''))) AS v FROM venue_log) SELECT CASE WHEN contains(v, 'arxiv') THEN 'arxiv' WHEN contains(v, 'preprint') OR contains(v, 'repository') THEN 'repository' WHEN contains(v, 'ebook') THEN 'ebook'
WHEN contains(v, 'book') THEN 'book series' WHEN contains(v, 'conference') THEN 'conference' WHEN contains(v, 'journal') THEN 'journal' ELSE 'none' END AS venue_class, count(DISTINCT paper_id) AS n_papers, count(*) AS n_rows FROM c GROUP BY 1""",
)
def q_venue(spark: SparkSession, d: str) -> DataFrame:
    """Recorded venues by class, from patterns over their names, case aside."""
    return R.venue_classes(table(spark, d, "venue_log"), "venue_class").groupBy("kind").agg(F.countDistinct("paper_id").alias("n_papers"), F.count(F.lit(1)).alias("n_rows")).withColumnRenamed("kind", "venue_class")


@query(
    "title_match",
    f"""{WP}, k AS (SELECT id, trim(regexp_replace(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS w FROM papers WHERE lower(trim(type)) IS DISTINCT FROM 'preprint'),
x AS (SELECT min(id) AS preprint_id, trim(regexp_replace(lower(coalesce(title_norm, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS w FROM work_detail WHERE lower(trim(type)) = 'preprint' AND id IS NOT NULL GROUP BY 2) SELECT k.id, x.preprint_id FROM k JOIN x ON x.w = k.w WHERE k.w <> ''""",
)
def q_title_match(spark: SparkSession, d: str) -> DataFrame:
    """Works whose title words equal those of an outer list, here the normalised titles of preprint records, the first of each title."""
    early = F.lower(F.trim("type")) == "preprint"
    outer = table(spark, d, "work_detail").filter(early & F.col("id").isNotNull()).select("id", title_words("title_norm").alias("w")).filter("w <> ''").groupBy("w").agg(F.min("id").alias("preprint_id"))
    return papers(spark, d).filter(~F.coalesce(early, F.lit(False))).select("id", title_words("title").alias("w")).join(outer, "w").select("id", "preprint_id")
