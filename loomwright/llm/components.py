"""Consolidating pairwise matches into groups: hierarchical merging of spanning forests.

Union-find runs inside bounded edge partitions and keeps only a spanning forest of each. While more forest edges are left
than one task may hold, a level repartitions them, contracts every vertex onto one of its forest roots and goes on with the
edges between roots, a smaller graph; the last level is a single bounded partition. Labels are resolved back level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import materialise

#: Edges one task may hold.
TASK_EDGES = 2_000_000
#: Levels after which the contraction counts as stuck (each level keeps about two thirds of the vertices or fewer).
MAX_LEVELS = 100


def _mix(ids: np.ndarray, salt: int) -> np.ndarray:
    """A pseudo-random order of ids, another for every salt; salt 0 keeps the order of the ids themselves."""
    x = ids.astype(np.int64)
    if not salt:
        return x
    z = x.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def forest_roots(a: np.ndarray, b: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges ``(a, b)`` and each one's root, the least vertex of its tree in the order of ``salt``.

    Union-find over arrays: roots are hooked onto lesser roots for all edges at once, then all paths are compressed.
    """
    vertices = np.unique(np.concatenate([a, b]))
    vertices = vertices[np.argsort(_mix(vertices, salt), kind="stable")]
    order = np.argsort(vertices, kind="stable")
    u, v = (order[np.searchsorted(vertices, x, sorter=order)] for x in (a, b))
    parent = np.arange(len(vertices))
    while True:
        ru, rv = parent[u], parent[v]
        apart = ru != rv
        if not apart.any():
            return vertices, vertices[parent]
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _merged(a: np.ndarray, b: np.ndarray, more: list[tuple[np.ndarray, np.ndarray]], salt: int) -> tuple[np.ndarray, np.ndarray]:
    return forest_roots(np.concatenate([a, *[x for x, _ in more]]), np.concatenate([b, *[y for _, y in more]]), salt)


def _forest_kernel(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.empty(0, np.int64)  # the forest so far: at most one edge a vertex
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            waiting.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            held += batch.num_rows
            if held > max(200_000, len(a)):  # so that every edge is merged a few times only
                a, b = _merged(a, b, waiting, salt)
                waiting, held = [], 0
        if held:
            a, b = _merged(a, b, waiting, salt)
        for k in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], ["v", "root"])

    return run


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, task_edges: int = TASK_EDGES) -> DataFrame:
    """``comp, member_id``: every id that ``edges`` links with another one, with the least id of its group.

    Ids are bigint. Defined cases: edges with a missing end and of an id with itself are ignored (an id with no other edge has
    no row); repeated and turned-round edges change nothing; an empty table gives no row; other columns are ignored.

    Scale: the first forests are built where the edges are read, without a shuffle, so a hot id or a giant group leaves a
    task as at most one edge per vertex. Later levels hold at most ``task_edges`` edges a task. A vertex meets its roots in a
    map-side combined minimum; the hand-back joins have one row per vertex on either side. Levels are checkpointed; only
    counts reach the driver.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).cast("bigint").alias("v"), F.col(b).cast("bigint").alias("root")).filter("v <> root")
    stars = materialise(ends.mapInArrow(_forest_kernel(0), "v bigint, root bigint").filter("v <> root"))
    levels: list[DataFrame] = []
    for level in range(1, MAX_LEVELS):
        n = stars.count()
        parts = max(1, -(-n // task_edges))
        if parts == 1:
            top = stars.coalesce(1).mapInArrow(_forest_kernel(0), "v bigint, root bigint")
            break
        local = materialise(stars.repartition(parts, "v", "root").mapInArrow(_forest_kernel(level), "v bigint, root bigint"))
        # a vertex goes to its least root in this level's order; its other roots are linked with that one
        onto = materialise(local.groupBy("v").agg(F.min_by("root", F.xxhash64("root", F.lit(level))).alias("to")))
        levels.append(onto)
        stars = materialise(local.join(onto, "v").filter("root <> to").select(F.col("root").alias("v"), F.col("to").alias("root")).distinct())
    else:
        raise RuntimeError(f"{MAX_LEVELS} levels did not suffice")
    labels = top.select(F.col("v").alias("member_id"), F.col("root").alias("label"))
    if not levels:
        return labels.select(F.col("label").alias("comp"), "member_id")
    for onto in reversed(levels):
        up = labels.select(F.col("member_id").alias("to"), "label")
        labels = materialise(onto.join(up, "to", "left").select(F.col("v").alias("member_id"), F.coalesce("label", "to").alias("label")))
    least = labels.groupBy("label").agg(F.min("member_id").alias("comp"))
    return labels.join(least, "label").select("comp", "member_id")
