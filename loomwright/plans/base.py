"""Frames that several query modules start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.panel import current_rows, edge_counts, yearly_counts
from loomwright.operators.vector import usable_vectors
from loomwright.sources.tables import table

DIM = 96
#: Years the panels of these tables cover.
FIRST, LAST = 2013, 2025

PAPERS_SQL = """papers AS (SELECT id, doi, arxiv_id, title, type, publication_date, CAST(publication_year AS INT) AS year, pt_topic AS topic, author_ids, source_id, n_refs, refs,
  cby_year, cby_count, cited_by_count, is_retracted, is_paratext
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_date DESC NULLS LAST, ingested_at DESC NULLS LAST) AS rn FROM work_detail WHERE id IS NOT NULL) WHERE rn = 1)"""
PANEL_SQL = """py AS (SELECT id, year, CAST(sum(n) AS BIGINT) AS cites FROM (SELECT id, CAST(unnest(cby_year) AS INT) AS year, unnest(cby_count) AS n FROM papers)
  WHERE year IS NOT NULL AND n IS NOT NULL GROUP BY 1, 2)"""
EDGES_SQL = """edges AS (SELECT citing_id, cited_id, min(CAST(citing_year AS INT)) AS year, bool_or(is_self_cite) AS is_self, min(citing_topic) AS topic
  FROM citation WHERE citing_id IS NOT NULL AND cited_id IS NOT NULL AND citing_id <> cited_id GROUP BY 1, 2)"""
SCORED_SQL = """scored AS (SELECT paper_id, max(CAST(first_public_year AS INT)) AS g, max(split) AS split, max(venue_at_t) AS venue, max(topic) AS topic,
  coalesce(max(y1), 0) + coalesce(max(y2), 0) + coalesce(max(y3a), 0) AS y, ln(1 + coalesce(max(auth_cites_max), 0)) AS pred_a, ln(1 + coalesce(max(topic_supply_y), 0)) / 2 AS pred_b
  FROM pred_sample WHERE paper_id IS NOT NULL GROUP BY paper_id)"""
#: Needs PAPERS_SQL: the date of every paper with a year, and how exactly it is known.
DATES_SQL = r"""dt AS (SELECT id, year, coalesce(known.on_day, make_date(year, 1, 1)) AS day, coalesce(known.prec, 'year') AS prec FROM (
  SELECT id, year, list_min(list_filter([{'on_day': stated, 'prec': 'day'}, {'on_day': posted, 'prec': 'month'}], lambda k: year(k.on_day) = year)) AS known FROM (
    SELECT id, year, CASE WHEN strftime(full_day, '%d%m') <> '0101' THEN full_day END AS stated, CASE WHEN arxiv_id SIMILAR TO '\d{4}\.\d{4,5}.*' THEN try_strptime('20' || left(arxiv_id, 4) || '15', '%Y%m%d')::DATE END AS posted
    FROM (SELECT id, year, arxiv_id, CASE WHEN publication_date SIMILAR TO '\d{4}-\d\d-\d\d' AND publication_date NOT LIKE '0000%' THEN try_cast(publication_date AS DATE) END AS full_day FROM papers WHERE year IS NOT NULL))))"""
VECTORS_SQL = f"""vec AS (SELECT emb_row AS r, min(emb) AS e, min(id) AS id FROM paper_vector WHERE emb_row IS NOT NULL AND len(emb) = {DIM}
  AND NOT list_contains(list_transform(emb, lambda x: coalesce(isfinite(x), false)), false) AND list_sum(list_transform(emb, lambda x: abs(x))) > 0 GROUP BY emb_row)"""


def papers(spark: SparkSession, d: str) -> DataFrame:
    """The current row of every work."""
    cols = "id doi arxiv_id title type publication_date publication_year pt_topic author_ids source_id n_refs refs cby_year cby_count cited_by_count is_retracted is_paratext updated_date ingested_at".split()
    rows = current_rows(table(spark, d, "work_detail").select(*cols), "id", ["updated_date", "ingested_at"])
    return rows.withColumn("year", F.col("publication_year").cast("int")).withColumnRenamed("pt_topic", "topic").drop("publication_year", "updated_date", "ingested_at")


def paper_year(p: DataFrame) -> DataFrame:
    """Citations from any source per paper and year."""
    return yearly_counts(p, "id", "cby_year", "cby_count")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct citation edges with their earliest year."""
    e = table(spark, d, "citation").filter("citing_id is not null and cited_id is not null and citing_id <> cited_id")
    return e.groupBy("citing_id", "cited_id").agg(F.min(F.col("citing_year").cast("int")).alias("year"), F.bool_or("is_self_cite").alias("is_self"), F.min("citing_topic").alias("topic"))


def edge_year(e: DataFrame) -> DataFrame:
    return edge_counts(e, "cited_id", "year")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """One row per predicted paper: group, split, true citations and two predictions on the log scale."""
    n = lambda c: F.coalesce(F.max(c), F.lit(0))
    s = table(spark, d, "pred_sample").filter("paper_id is not null")
    return s.groupBy("paper_id").agg(
        F.max(F.col("first_public_year").cast("int")).alias("g"), F.max("split").alias("split"), F.max("venue_at_t").alias("venue"), F.max("topic").alias("topic"),
        (n("y1") + n("y2") + n("y3a")).alias("y"), F.log1p(n("auth_cites_max")).alias("pred_a"), (F.log1p(n("topic_supply_y")) / 2).alias("pred_b"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """``r, e, id``: usable vectors by row, with the work they belong to."""
    v = table(spark, d, "paper_vector")
    ids = v.filter("emb_row is not null").groupBy("emb_row").agg(F.min("id").alias("id"))
    return usable_vectors(v, "emb_row", "emb", DIM).join(ids, "emb_row").select(F.col("emb_row").alias("r"), F.col("emb").alias("e"), "id")
