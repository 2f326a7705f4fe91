"""Per-key results where a few keys hold most records.

Everything here is a composition of algebraic aggregates: Spark's hash aggregation combines rows map-side in bounded tables
that spill, so only one partial state per key and task is shuffled, however hot the key is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_per_key(df: DataFrame, keys: list[str], item: str, out: str = "n") -> DataFrame:
    """``keys`` with the number of distinct non-null ``item`` values.

    The rows are first made distinct over (keys, item): the item is part of the shuffle key, so a hot key is spread over all
    tasks. The count per key is then combined map-side, and one partial count per key and task is shuffled.

    Defined cases: a null key is a key of its own; null items are not counted, and a key with only null items has no row;
    repeated rows count once; an empty table gives no row; other columns are ignored.
    """
    pairs = df.select(*keys, item).filter(F.col(item).isNotNull()).distinct()
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def heavy_keys(df: DataFrame, key: str, item: str, share: float) -> DataFrame:
    """Non-null keys that stand in at least ``share`` of the distinct (item, key) pairs: ``key, n, total, share``.

    Defined cases: pairs with a null key are left out, a null item is an item like any other; repeated rows count once; an
    empty table gives no row. The total is the sum of the per-key counts, so the pairs are shuffled once.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    pairs = df.select(key, item).filter(F.col(key).isNotNull()).distinct()
    counts = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    cut = F.col("n") >= F.ceil(F.col("total") * F.lit(share) - F.lit(1e-9))
    joined = counts.crossJoin(F.broadcast(total))  # one row
    return joined.filter(cut).select(key, "n", "total", (F.col("n") / F.col("total")).alias("share"))
