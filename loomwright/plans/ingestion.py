"""Queries over nested and textual sources, the analyst's star schema, and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.columns import tail_id, title_key, title_words
from loomwright.operators import models as L
from loomwright.plans.base import PAPERS_SQL, SCORED_SQL, papers, scored
from loomwright.registry import query
from loomwright.sources.ingest import arxiv_id, embedding_text, inverted_index_text, missing_ids
from loomwright.sources.tables import table

r6 = lambda c: F.round(c, 6)
SC = f"WITH {SCORED_SQL}"


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json(spark: SparkSession, d: str) -> DataFrame:
    """A field of a JSON column, parsed by schema."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("url_ids", "SELECT id, CAST(nullif(regexp_extract('https://works.example/W' || id, '([0-9]+)$', 1), '') AS BIGINT) AS from_url, try_cast(nullif(regexp_extract(doi, '/[A-Za-z]?([0-9]+)$', 1), '') AS BIGINT) AS from_doi FROM work_detail")
def q_urls(spark: SparkSession, d: str) -> DataFrame:
    """Numbers at the ends of URLs and identifiers."""
    return table(spark, d, "work_detail").select("id", tail_id(F.concat(F.lit("https://works.example/W"), F.col("id"))).alias("from_url"), tail_id("doi").alias("from_doi"))


@query("arxiv_ids", "SELECT id, CASE WHEN regexp_full_match(arxiv_id, '[0-9]{4}[.][0-9]{4,5}') THEN arxiv_id END AS arxiv FROM work_detail")
def q_arxiv(spark: SparkSession, d: str) -> DataFrame:
    """arXiv ids found again in location URLs."""
    url = F.concat(F.lit("http://arxiv.org/abs/"), F.col("arxiv_id"), F.lit("v2"))
    good = F.col("arxiv_id").rlike(r"^[0-9]{4}[.][0-9]{4,5}$")
    return table(spark, d, "work_detail").select("id", F.when(good, arxiv_id(F.lit(None).cast("string"), F.array(url))).alias("arxiv"))


@query("inverted_index_text", f"WITH {PAPERS_SQL} SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS text FROM papers WHERE trim(regexp_replace(title, '\\s+', ' ', 'g')) <> ''")
def q_inverted(spark: SparkSession, d: str) -> DataFrame:
    """Titles turned into word -> positions maps and back into text."""
    words = papers(spark, d).select("id", F.split(F.trim(F.regexp_replace("title", r"\s+", " ")), " ").alias("w")).filter("array_join(w, ' ') <> ''")
    at = words.select("id", F.posexplode("w").alias("p", "w")).groupBy("id", "w").agg(F.collect_list("p").alias("ps"))
    index = at.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return index.select("id", inverted_index_text(F.col("m")).alias("text"))


@query("title_keys", f"WITH {PAPERS_SQL} SELECT id, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g') AS key, trim(regexp_replace(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS words FROM papers")
def q_titles(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("id", title_key("title").alias("key"), title_words("title").alias("words"))


@query("embedding_text", "SELECT w.id, nullif(concat_ws(' [SEP] ', nullif(trim(coalesce(w.title, '')), ''), nullif(trim(coalesce(d.text, '')), '')), '') AS text FROM (SELECT id, min(title) AS title FROM work_detail GROUP BY id) w LEFT JOIN (SELECT work_id, min(text) AS text FROM documents WHERE section = 'abstract' GROUP BY work_id) d ON d.work_id = w.id")
def q_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    """Title and abstract of every work as one text for an encoder."""
    w = table(spark, d, "work_detail").groupBy("id").agg(F.min("title").alias("title"))
    t = table(spark, d, "documents").filter("section = 'abstract' and work_id is not null").groupBy(F.col("work_id").alias("id")).agg(F.min("text").alias("text"))
    return w.join(t, "id", "left").select("id", embedding_text(F.col("title"), F.col("text")).alias("text"))


@query("missing_vectors", "SELECT DISTINCT id FROM work_detail WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM paper_vector WHERE id IS NOT NULL)")
def q_missing(spark: SparkSession, d: str) -> DataFrame:
    """Works without a vector, for a back-fill."""
    return missing_ids(table(spark, d, "work_detail").select("id").filter("id is not null").distinct(), table(spark, d, "paper_vector"), "id")


@query(
    "vector_stats",
    "SELECT coalesce(len(emb), -1) AS dim, count(*) AS n, count(*) FILTER (WHERE len(list_filter(emb, lambda x: NOT coalesce(isfinite(x), false))) > 0) AS n_not_finite, count(*) FILTER (WHERE coalesce(list_sum(list_transform(emb, lambda x: abs(x))), 0) = 0) AS n_zero FROM paper_vector GROUP BY 1",
)
def q_vector_stats(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by length, with those that are not finite or zero."""
    bad = F.exists("emb", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.coalesce(F.exists("emb", lambda x: x != 0), F.lit(False))
    return table(spark, d, "paper_vector").groupBy(F.coalesce(F.when(F.col("emb").isNotNull(), F.size("emb")), F.lit(-1)).alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("n_not_finite"), F.count(F.when(zero, 1)).alias("n_zero")
    )


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def q_pricing(spark: SparkSession, d: str) -> DataFrame:
    """Grouped sums over the largest star table."""
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc"), r6(F.avg("l_discount")).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query("nation_year_revenue", "SELECT n_name, year(o_orderdate) AS y, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(DISTINCT o_custkey) AS n_customers FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def q_nation(spark: SparkSession, d: str) -> DataFrame:
    """A star join of four tables into a yearly panel."""
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    return j.groupBy("n_name", "y").agg(F.round(F.sum("v"), 4).alias("revenue"), F.countDistinct("o_custkey").alias("n_customers"))


@query("event_hours", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2")
def q_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of the event table, as the streaming job computes them."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("n_users"))


@query("naive_levels", SC + ", t AS (SELECT avg(ln(1 + y)) AS m FROM scored WHERE split = 'train'), h AS (SELECT topic, avg(ln(1 + y)) AS m FROM scored WHERE split = 'train' GROUP BY 1) SELECT paper_id, round(t.m, 6) AS carry, round(coalesce(h.m, t.m), 6) AS history FROM scored s CROSS JOIN t LEFT JOIN h ON h.topic IS NOT DISTINCT FROM s.topic")
def q_naive(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("ly", F.log1p("y"))
    not_train = ~F.coalesce(F.col("split") == "train", F.lit(False))
    return L.naive_levels(s, group="topic", year="g", value="ly", test=not_train).select("paper_id", r6("carry").alias("carry"), r6("history").alias("history"))


@query(
    "standardised_features",
    SC + ", t AS (SELECT avg(pred_a) AS ma, stddev_pop(pred_a) AS sa FROM scored WHERE split = 'train') SELECT paper_id, round(greatest(-8, least(8, (pred_a - ma) / sa)), 6) AS pred_a_z, CAST(pred_a IS NULL AS INT) AS pred_a_na FROM scored, t",
)
def q_standard(spark: SparkSession, d: str) -> DataFrame:
    s = L.standardise(scored(spark, d), ["pred_a"], F.col("split") == "train")
    return s.select("paper_id", r6("pred_a_z").alias("pred_a_z"), "pred_a_na")


@query("frequent_codes", SC + ", c AS (SELECT venue, count(*) AS n FROM scored WHERE split = 'train' AND venue IS NOT NULL GROUP BY 1 HAVING count(*) >= 20), k AS (SELECT venue, CAST(row_number() OVER (ORDER BY n DESC, venue) AS INT) AS code FROM c) SELECT paper_id, coalesce(code, 0) AS venue_code FROM scored s LEFT JOIN k ON k.venue = s.venue")
def q_codes(spark: SparkSession, d: str) -> DataFrame:
    return L.frequent_codes(scored(spark, d), "venue", F.col("split") == "train").select("paper_id", "venue_code")


@query("cell_log_softmax", SC + ", m AS (SELECT *, max(pred_a) OVER (PARTITION BY g) AS mx FROM scored) SELECT paper_id, round(pred_a - mx - ln(sum(exp(pred_a - mx)) OVER (PARTITION BY g)), 6) AS log_share FROM m")
def q_softmax(spark: SparkSession, d: str) -> DataFrame:
    return L.segment_log_softmax(scored(spark, d), "g", "pred_a").select("paper_id", r6("log_share").alias("log_share"))


def _train(s: DataFrame) -> DataFrame:
    return s.withColumn("ly", F.log1p("y"))


@query("boosted_trees")
def q_gbt(spark: SparkSession, d: str) -> DataFrame:
    """Gradient-boosted prediction of log citations, fitted on the training split."""
    return L.boosted(_train(scored(spark, d)), ["pred_a", "pred_b"], "ly", F.col("split") == "train").select("paper_id", "pred")


@query("ridge_regression")
def q_ridge(spark: SparkSession, d: str) -> DataFrame:
    return L.ridge(_train(scored(spark, d)), ["pred_a", "pred_b"], "ly", F.col("split") == "train", penalty=0.1).select("paper_id", "pred")


@query("isotonic_calibration")
def q_isotonic(spark: SparkSession, d: str) -> DataFrame:
    """Predictions calibrated on the validation split."""
    return L.isotonic(_train(scored(spark, d)), "pred_a", "ly", F.col("split") == "val").select("paper_id", "calibrated")


@query("stacking_weights")
def q_stack(spark: SparkSession, d: str) -> DataFrame:
    """Non-negative weights of two predictions with a free intercept."""
    return L.stack(_train(scored(spark, d)), ["pred_a", "pred_b"], "ly", F.col("split") == "val")
