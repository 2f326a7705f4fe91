"""Queries of the general data problems (1, 4 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.asof import Lookup, known_together
from loomwright.operators.hotkeys import distinct_per_key, heavy_keys
from loomwright.operators.orphans import resolve_references
from loomwright.registry import query
from loomwright.session import materialise
from loomwright.sources.tables import table

KEYS_1 = ["paper_id", "pred_time", "topic", "first_public_year", "author_ids"]


def _attributes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct prediction samples with stored values and the values right at their time (``right_*``)."""
    stored = ["venue_at_t", "auth_cites_max", "topic_supply_y"]
    samples = materialise(table(spark, d, "pred_sample").select(*KEYS_1, *stored).distinct().withColumn("_id", F.monotonically_increasing_id()))
    bitemporal = ["valid_from", "known_at"]
    lookups = [
        Lookup("right_venue", table(spark, d, "venue_log"), [("paper_id", "paper_id")], bitemporal, "venue_class"),
        Lookup("right_auth", table(spark, d, "author_log"), [("author", "author_id")], bitemporal, "cites_prior", each="author_ids", default=0),
        Lookup("right_supply", table(spark, d, "topic_year"), [("topic", "topic_id"), ("first_public_year", "year")], ["known_at"], "n_ai_dedup"),
    ]
    return known_together(samples, lookups, id="_id", time="pred_time").drop("_id")


SQL_1 = """
WITH s AS (SELECT DISTINCT paper_id, pred_time, topic, first_public_year, author_ids, venue_at_t, auth_cites_max, topic_supply_y FROM pred_sample),
vk AS (SELECT DISTINCT paper_id, pred_time FROM s WHERE pred_time IS NOT NULL),
v AS (SELECT paper_id, pred_time, venue_class FROM (
  SELECT k.paper_id, k.pred_time, l.venue_class, row_number() OVER (PARTITION BY k.paper_id, k.pred_time ORDER BY l.valid_from DESC, l.known_at DESC, l.venue_class DESC NULLS LAST) AS rn
  FROM vk k JOIN venue_log l ON l.paper_id = k.paper_id AND l.valid_from <= k.pred_time AND l.known_at <= k.pred_time) WHERE rn = 1),
ak AS (SELECT DISTINCT pred_time, author FROM (SELECT pred_time, unnest(author_ids) AS author FROM s)),
a AS (SELECT author, pred_time, cites_prior FROM (
  SELECT k.author, k.pred_time, l.cites_prior, row_number() OVER (PARTITION BY k.author, k.pred_time ORDER BY l.valid_from DESC, l.known_at DESC, l.cites_prior DESC NULLS LAST) AS rn
  FROM ak k JOIN author_log l ON l.author_id = k.author AND l.valid_from <= k.pred_time AND l.known_at <= k.pred_time) WHERE rn = 1),
m AS (SELECT author_ids, e.pred_time, max(CASE WHEN a.author IS NULL THEN 0 ELSE a.cites_prior END) AS right_auth
  FROM (SELECT DISTINCT author_ids, pred_time, unnest(author_ids) AS author FROM s) e
  LEFT JOIN a ON a.author = e.author AND a.pred_time = e.pred_time GROUP BY 1, 2),
tk AS (SELECT DISTINCT topic, first_public_year, pred_time FROM s),
t AS (SELECT topic, first_public_year, pred_time, n_ai_dedup FROM (
  SELECT k.*, l.n_ai_dedup, row_number() OVER (PARTITION BY k.topic, k.first_public_year, k.pred_time ORDER BY l.known_at DESC, l.n_ai_dedup DESC NULLS LAST) AS rn
  FROM tk k JOIN topic_year l ON l.topic_id = k.topic AND l.year = k.first_public_year AND l.known_at <= k.pred_time) WHERE rn = 1),
r AS (SELECT s.*, v.venue_class AS right_venue, m.right_auth, t.n_ai_dedup AS right_supply
  FROM s LEFT JOIN v ON v.paper_id = s.paper_id AND v.pred_time = s.pred_time
  LEFT JOIN m ON m.author_ids = s.author_ids AND m.pred_time IS NOT DISTINCT FROM s.pred_time
  LEFT JOIN t ON t.topic = s.topic AND t.first_public_year = s.first_public_year AND t.pred_time = s.pred_time)
"""


@query(
    "p1_found",
    SQL_1
    + """
SELECT DISTINCT paper_id, 'venue_at_t' AS field FROM r WHERE venue_at_t IS DISTINCT FROM right_venue
UNION ALL SELECT DISTINCT paper_id, 'auth_cites_max' FROM r WHERE auth_cites_max IS DISTINCT FROM right_auth
UNION ALL SELECT DISTINCT paper_id, 'topic_supply_y' FROM r WHERE topic_supply_y IS DISTINCT FROM right_supply""",
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Samples whose stored attribute is not the one known at prediction time."""
    pairs = (("venue_at_t", "right_venue"), ("auth_cites_max", "right_auth"), ("topic_supply_y", "right_supply"))
    wrong = F.array(*[F.when(~F.col(s).eqNullSafe(F.col(r)), F.lit(s)) for s, r in pairs])
    return _attributes(spark, d).select("paper_id", F.explode(F.array_compact(wrong)).alias("field")).distinct()


@query(
    "p1_attributes",
    SQL_1 + "SELECT paper_id, pred_time, right_venue AS venue_at_t, right_auth AS auth_cites_max, right_supply AS topic_supply_y FROM r",
)
def p1_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct sample with the attributes known at its prediction time."""
    right = [F.col(r).alias(s) for s, r in (("venue_at_t", "right_venue"), ("auth_cites_max", "right_auth"), ("topic_supply_y", "right_supply"))]
    return _attributes(spark, d).select("paper_id", "pred_time", *right)


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Distinct references (table_name, citing_id, ref_id, citing_year) with their arrival and their target's state."""
    works = table(spark, d, "work_detail")
    own = works.groupBy("id").agg(F.min("ingested_at").alias("arrived"), F.min("publication_year").alias("citing_year"), F.collect_set("refs").alias("lists"))
    from_works = own.select(F.lit("work_detail").alias("table_name"), F.col("id").alias("citing_id"), F.explode(F.array_distinct(F.flatten("lists"))).alias("ref_id"), "citing_year", "arrived")
    from_citations = (
        table(spark, d, "citation")
        .groupBy("citing_id", "cited_id")
        .agg(F.min("ingested_at").alias("arrived"), F.min("citing_year").alias("citing_year"))
        .select(F.lit("citation").alias("table_name"), "citing_id", F.col("cited_id").alias("ref_id"), "citing_year", "arrived")
    )
    refs = from_works.unionByName(from_citations).filter(F.col("ref_id").isNotNull())
    # rank of the reason a target gives: 0 a work of the corpus, 1 an older work, 2 deleted
    targets = (
        works.groupBy("id").agg(F.min("ingested_at").alias("target_arrived")).withColumn("state", F.lit(0))
        .unionByName(table(spark, d, "ref_work").select("id", F.lit(1).alias("state")), allowMissingColumns=True)
        .unionByName(table(spark, d, "deleted_work").select("id", F.lit(2).alias("state")), allowMissingColumns=True)
    )
    found = resolve_references(refs, targets, on=[("ref_id", "id")], match="simple", carry=["state", "target_arrived"])
    kind = (
        F.when((F.col("state") == 0) & (F.col("target_arrived") > F.col("arrived")), "late")
        .when(~F.col("matched"), "missing")
        .when(F.col("state") == 2, "deleted")
    )
    return found.withColumn("kind", kind)


SQL_4 = """
WITH own AS (SELECT id, min(ingested_at) AS arrived, min(publication_year) AS citing_year FROM work_detail GROUP BY id),
refs AS (
  SELECT 'work_detail' AS table_name, w.id AS citing_id, w.ref_id, o.citing_year, o.arrived
  FROM (SELECT DISTINCT id, unnest(refs) AS ref_id FROM work_detail) w JOIN own o ON o.id = w.id WHERE w.ref_id IS NOT NULL
  UNION ALL
  SELECT 'citation', citing_id, cited_id, min(citing_year), min(ingested_at) FROM citation WHERE cited_id IS NOT NULL GROUP BY citing_id, cited_id),
kinds AS (SELECT r.table_name, r.citing_id, r.ref_id, r.citing_year,
  CASE WHEN o.arrived > r.arrived THEN 'late' WHEN o.id IS NOT NULL OR rw.id IS NOT NULL THEN NULL WHEN dw.id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind
  FROM refs r LEFT JOIN own o ON o.id = r.ref_id LEFT JOIN (SELECT DISTINCT id FROM ref_work) rw ON rw.id = r.ref_id
  LEFT JOIN (SELECT DISTINCT id FROM deleted_work) dw ON dw.id = r.ref_id)
"""


@query("p4_found", SQL_4 + "SELECT table_name, citing_id, ref_id, kind FROM kinds WHERE kind IS NOT NULL")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """References to works that are missing, deleted or later than the citing record."""
    return _references(spark, d).filter(F.col("kind").isNotNull()).select("table_name", "citing_id", "ref_id", "kind")


@query(
    "p4_counts",
    SQL_4
    + """SELECT table_name, citing_year, count(*) AS n_refs, count(*) FILTER (WHERE kind = 'missing') AS n_missing,
  count(*) FILTER (WHERE kind = 'deleted') AS n_deleted, count(*) FILTER (WHERE kind = 'late') AS n_late FROM kinds GROUP BY 1, 2""",
)
def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan counts per table and citing year."""
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("missing", "deleted", "late")]
    return _references(spark, d).groupBy("table_name", "citing_year").agg(F.count(F.lit(1)).alias("n_refs"), *kinds)


#: A ref is heavy from this share of the distinct (paper, ref) pairs on.
HEAVY_SHARE = 0.01


@query(
    "p7_found",
    """WITH p AS (SELECT DISTINCT paper_id, ref FROM paper_ref WHERE ref IS NOT NULL)
SELECT ref FROM p GROUP BY ref HAVING count(*) * 100 >= (SELECT count(*) FROM p)""",
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The few refs that fill most rows."""
    return heavy_keys(table(spark, d, "paper_ref"), "ref", "paper_id", HEAVY_SHARE).select("ref")


@query("p7_counts", "SELECT ref, y, count(DISTINCT paper_id) AS n_papers FROM paper_ref WHERE ref IS NOT NULL AND paper_id IS NOT NULL GROUP BY ref, y")
def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct citing papers per ref and year."""
    return distinct_per_key(table(spark, d, "paper_ref").filter(F.col("ref").isNotNull()), ["ref", "y"], "paper_id", "n_papers")
