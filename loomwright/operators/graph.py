"""Citation-style edges and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.functions.columns import overlap


def reference_edges(works: DataFrame, mapping: DataFrame | None, *, key: str, refs: str, year: str) -> DataFrame:
    """``citing_id, cited_id, citing_year``: distinct edges from reference lists, the earliest year of each.

    With ``mapping(old_id, new_id)`` both ends are replaced by their group; edges inside a group are dropped.
    """
    edges = works.select(F.col(key).alias("citing_id"), F.explode(F.array_distinct(refs)).alias("cited_id"), F.col(year).alias("citing_year"))
    edges = edges.filter(F.col("citing_id").isNotNull() & F.col("cited_id").isNotNull())
    if mapping is not None:
        edges = remap(remap(edges, mapping, "citing_id"), mapping, "cited_id")
    return edges.filter("citing_id <> cited_id").groupBy("citing_id", "cited_id").agg(F.min("citing_year").alias("citing_year"))


def remap(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` replaced by the mapping's new id where there is one."""
    m = mapping.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def self_citations(edges: DataFrame, works: DataFrame, *, key: str, authors: str) -> DataFrame:
    """``edges`` with ``is_self_cite``: both ends are known and share an author."""
    a = works.select(F.col(key).alias("citing_id"), F.col(authors).alias("_a"))
    b = works.select(F.col(key).alias("cited_id"), F.col(authors).alias("_b"))
    return edges.join(a, "citing_id", "left").join(b, "cited_id", "left").select(*edges.columns, overlap("_a", "_b").alias("is_self_cite"))


def mutual_flags(pairs: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``a_cites_b`` and ``b_cites_a``."""
    known = edges.select("citing_id", "cited_id").distinct()
    there = known.select(F.col("citing_id").alias(a), F.col("cited_id").alias(b), F.lit(True).alias("_f"))
    back = known.select(F.col("cited_id").alias(a), F.col("citing_id").alias(b), F.lit(True).alias("_r"))
    no = F.lit(False)
    return pairs.join(there, [a, b], "left").join(back, [a, b], "left").select(*pairs.columns, F.coalesce("_f", no).alias("a_cites_b"), F.coalesce("_r", no).alias("b_cites_a"))


def cocitation(pairs: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``n_cocited``: works that cite both. Edges are cut to the pairs' ends before they meet."""
    known = edges.select("citing_id", "cited_id").distinct()
    ends = pairs.select(F.explode(F.array(a, b)).alias("cited_id")).distinct()
    held = known.join(ends, "cited_id", "left_semi")
    first = pairs.select(a, b).distinct().join(held.select(F.col("cited_id").alias(a), "citing_id"), a)
    both = first.join(held.select(F.col("cited_id").alias(b), "citing_id"), [b, "citing_id"])
    counts = both.groupBy(a, b).agg(F.count(F.lit(1)).alias("n_cocited"))
    return pairs.join(counts, [a, b], "left").withColumn("n_cocited", F.coalesce("n_cocited", F.lit(0)))


def coupling(refs: DataFrame, *, paper: str, ref: str, year: str, hub: int = 500, least: int = 3, band: int = 1, jaccard: float = 0.05) -> DataFrame:
    """``a, b, shared, jaccard`` for papers a < b at most ``band`` years apart that share ``least`` references or more.

    References with more than ``hub`` citing papers are left out by definition, from the pairs but not from the set sizes. The
    band is part of the join key: a paper meets its own and the next ``band`` years, so each task sees one reference and year,
    and a bucket has at most ``hub`` papers.
    """
    own = refs.select(F.col(paper).alias("p"), F.col(ref).alias("r"), F.col(year).cast("int").alias("y")).dropna().distinct()
    sizes = own.groupBy("p").agg(F.countDistinct("r").alias("n"))
    kept = own.join(own.groupBy("r").agg(F.countDistinct("p").alias("c")).filter(F.col("c") <= hub).select("r"), "r", "left_semi")
    # each row is offered to the years up to `band` later; equal years are met once by the ids' order
    left = kept.select(F.col("p").alias("a"), "r", F.col("y").alias("ya"), F.explode(F.sequence(F.col("y"), F.col("y") + band)).alias("y"))
    right = kept.select(F.col("p").alias("b"), "r", "y")
    pairs = left.join(right, ["r", "y"]).filter((F.col("ya") < F.col("y")) | (F.col("a") < F.col("b"))).filter("a <> b")
    # one shuffle by pair does for the distinct references and for their count
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "r").repartition("a", "b")
    counts = pairs.groupBy("a", "b").agg(F.countDistinct("r").alias("shared")).filter(F.col("shared") >= least)
    na, nb = sizes.select(F.col("p").alias("a"), F.col("n").alias("na")), sizes.select(F.col("p").alias("b"), F.col("n").alias("nb"))
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return counts.join(na, "a").join(nb, "b").select("a", "b", "shared", j.alias("jaccard")).filter(F.col("jaccard") >= jaccard)


def shared_references(pairs: DataFrame, refs: DataFrame, *, a: str, b: str, paper: str, ref: str) -> DataFrame:
    """``pairs`` with ``shared`` and ``jaccard`` of the ends' whole reference sets, hubs and single shared references included.

    A pair whose ends both have no reference has a null Jaccard. The pairs lead the joins, so a hub costs no more than its papers' pairs.
    """
    own = refs.select(F.col(paper).alias("_p"), F.col(ref).alias("_r")).dropna().distinct()
    sizes = own.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    held = pairs.select(a, b).distinct().join(own.select(F.col("_p").alias(a), "_r"), a)
    both = held.join(own.select(F.col("_p").alias(b), "_r"), [b, "_r"]).groupBy(a, b).agg(F.count(F.lit(1)).alias("shared"))
    na, nb = (sizes.select(F.col("_p").alias(c), F.col("_n").alias(f"_n{i}")) for i, c in enumerate((a, b)))
    wide = pairs.join(both, [a, b], "left").join(na, a, "left").join(nb, b, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    union = F.coalesce("_n0", F.lit(0)) + F.coalesce("_n1", F.lit(0)) - F.col("shared")
    return wide.withColumn("jaccard", F.try_divide("shared", union)).select(*pairs.columns, "shared", "jaccard")


def dense_ids(nodes: DataFrame, group: list[str], node: str, out: str, slices: int = 256) -> DataFrame:
    """``nodes`` (distinct) with ``out``: their places from 0 in the order of ``node`` within their group.

    Slices of the nodes' range are counted per group and numbered on their own, so no task numbers a whole group.
    """
    cuts = nodes.agg(F.percentile_approx(node, [i / slices for i in range(1, slices)], 10_000).alias("_cuts"))
    sliced = nodes.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(node)))).drop("_cuts")  # one row
    counts = sliced.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    ahead = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # at most `slices` rows a group
    starts = counts.select(*group, "_b", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy(*group, "_b").orderBy(node))
    return sliced.join(starts, [*group, "_b"]).withColumn(out, F.col("_start") + inside - 1).drop("_b", "_start")


def export_lists(edges: DataFrame) -> DataFrame:
    """``id, refs, cites``: sorted neighbour lists of every node, for graph files."""
    out = edges.select(F.col("citing_id").alias("id"), F.col("cited_id").alias("r"), F.lit(None).cast("bigint").alias("c"))
    back = edges.select(F.col("cited_id").alias("id"), F.lit(None).cast("bigint").alias("r"), F.col("citing_id").alias("c"))
    return out.unionByName(back).groupBy("id").agg(F.array_sort(F.collect_set("r")).alias("refs"), F.array_sort(F.collect_set("c")).alias("cites"))
