"""Attributes as known at event time, over bitemporal change logs.

Events and attribute changes are unioned, sorted by entity, availability time and a tie priority (changes before events),
and the best change so far is carried forward onto each event.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.session import materialise

#: An entity with more distinct (time, kind) rows than this is cut into time slices.
HOT_ROWS = 200_000
#: Slices of a hot entity.
SLICES = 64


def known_at(
    events: DataFrame,
    log: DataFrame,
    *,
    entity: list[tuple[str, str]],
    time: str,
    order: list[str],
    values: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Distinct ``(entity, time)`` of ``events`` with the ``values`` of ``log`` that were known at ``time``.

    ``entity`` pairs event columns with log columns. A log row is available from the latest of its ``order`` columns on; of
    the available rows the one with the greatest ``order`` columns (compared in turn) gives the values.

    Result: the event columns of ``entity``, ``time``, ``known`` (boolean: some row was available) and ``values``.

    Defined cases: rows of ``events`` with a null entity or time give no row; log rows with a null entity or ``order``
    column are never available; equal ``order`` columns are settled by the greatest values, nulls last; repeated rows change
    nothing; an empty log gives ``known`` false and null values; a change at exactly the event's time counts as known.
    Columns other than those named are ignored, so clashing names do no harm.

    Scale: both sides are reduced to one row per (entity, time) before the shuffle, so hot entities cost what their distinct
    times cost. Entities beyond ``hot_rows`` are cut into ``SLICES`` time slices by approximate quantiles; each slice is
    scanned on its own and the best change of the earlier slices, at most ``SLICES`` rows per entity, is carried in.
    """
    keys = [f"_k{i}" for i in range(len(entity))]
    ev = events.select(*[F.col(e).alias(k) for (e, _), k in zip(entity, keys)], F.col(time).alias("_t")).dropna().distinct()
    state = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    available = F.greatest(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    changes = (
        log.dropna(subset=list(dict.fromkeys([*[c for _, c in entity], *order])))
        .select(*[F.col(c).cast(events.schema[e].dataType).alias(k) for (e, c), k in zip(entity, keys)], available.alias("_t"), state.alias("_s"))
        .groupBy(*keys, "_t")
        .agg(F.max("_s").alias("_s"))
    )
    both = changes.withColumn("_p", F.lit(0)).unionByName(ev.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    hot = _hot_entities(both, keys, hot_rows)
    carried = _carry(both, keys) if hot is None else _carry_sliced(both, keys, hot)
    named = [F.col(k).alias(e) for (e, _), k in zip(entity, keys)]
    return carried.filter(F.col("_p") == 1).select(
        *named, F.col("_t").alias(time), F.col("_s").isNotNull().alias("known"), *[F.col(f"_s.v{i}").alias(c) for i, c in enumerate(values)]
    )


@dataclass(frozen=True)
class Lookup:
    """An attribute to look up for every event.

    ``on`` pairs event columns with columns of ``log``; with ``each`` the first event column is the name given to the elements of that
    array column, and the attribute is the greatest over the elements, where an element without a known row counts as ``default``.
    ``order`` has one or two timestamps, as in :func:`known_at`; ``value`` is a string or a whole number.
    """

    name: str
    log: DataFrame
    on: list[tuple[str, str]]
    order: list[str]
    value: str
    each: str | None = None
    default: int | None = None

    @property
    def is_text(self) -> bool:
        return dict(self.log.dtypes)[self.value] == "string"


def known_together(events: DataFrame, lookups: list[Lookup], *, id: str, time: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``events`` (with a unique ``id``) and a column for every lookup: the value known at the event's ``time``.

    All lookups are one union of events and changes, so whatever their number the logs are shuffled once, sorted once, and the
    values come back to their events in one aggregate. Rules, ties and hot entities are those of :func:`known_at`.

    Defined cases: an event with a null key or time has a null value, and for a lookup with ``each`` the default for every element
    if the array has any; a null or empty array has a null value; repeated log rows change nothing; an empty log gives nulls and
    defaults; other columns of the logs are ignored.
    """
    key = lambda cols: F.concat_ws("\x1f", *[c.cast("string") for c in cols])
    asks, changes = [], None
    for i, u in enumerate(lookups):
        fixed = [F.col(e) for e, _ in u.on[(1 if u.each else 0) :]]
        whole = F.lit(True)
        for c in fixed:
            whole = whole & c.isNotNull()
        none = F.array().cast("array<struct<_i:int,_k:string>>")
        one = lambda cols: F.struct(F.lit(i).alias("_i"), key(cols).alias("_k"))  # noqa: B023, E731
        sent = F.transform(F.array_distinct(F.array_compact(u.each)), lambda x: one([x, *fixed])) if u.each else F.array(one(fixed))  # noqa: B023
        asks.append(F.when(whole & F.col(u.each).isNotNull() if u.each else whole, sent).otherwise(none))
        held = u.log.dropna(subset=list(dict.fromkeys([*[c for _, c in u.on], *u.order])))
        times = [F.col(c).cast("timestamp_ntz") for c in u.order]
        value = F.col(u.value)
        state = F.struct(
            times[0].alias("a"), (times[1] if len(times) > 1 else F.lit(None).cast("timestamp_ntz")).alias("b"),
            (F.lit(None) if u.is_text else value).cast("bigint").alias("n"), (value if u.is_text else F.lit(None)).cast("string").alias("s"),
        )
        own = held.select(F.lit(i).alias("_i"), key([F.col(c) for _, c in u.on]).alias("_k"), (F.greatest(*times) if len(times) > 1 else times[0]).alias("_t"), state.alias("_s"))
        changes = own if changes is None else changes.unionByName(own)
    keys = ["_i", "_k"]
    changes = changes.groupBy(*keys, "_t").agg(F.max("_s").alias("_s"))
    asked = events.filter(F.col(time).isNotNull()).select(F.col(id).alias("_id"), F.col(time).cast("timestamp_ntz").alias("_t"), F.inline(F.concat(*asks)))
    both = changes.withColumn("_p", F.lit(0)).unionByName(asked.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    hot = _hot_entities(both, keys, hot_rows)
    carried = (_carry(both, keys) if hot is None else _carry_sliced(both, keys, hot)).filter(F.col("_p") == 1)
    found = []
    for i, u in enumerate(lookups):
        value = F.col("_s.s") if u.is_text else F.col("_s.n")
        if u.each and u.default is not None:
            value = F.when(F.col("_s").isNull(), F.lit(u.default)).otherwise(value)
        found.append(F.max(F.when(F.col("_i") == i, value)).alias(f"_v{i}"))
    wide = events.join(carried.groupBy(F.col("_id").alias(id)).agg(*found), id, "left")
    out = []
    for i, u in enumerate(lookups):
        v = F.col(f"_v{i}")
        if u.each and u.default is not None:
            unknown = F.col(time).isNull() | F.exists(u.each, lambda x: x.isNull())
            v = F.when(F.size(u.each) > 0, F.greatest(v, F.when(unknown, F.lit(u.default).cast("bigint"))))
        out.append(v.cast(dict(u.log.dtypes)[u.value]).alias(u.name))
    return wide.select(*events.columns, *out)


def _so_far(parts: list[str], order: list[str]) -> Column:
    return F.max("_s").over(W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))


def _carry(both: DataFrame, keys: list[str]) -> DataFrame:
    return both.withColumn("_s", _so_far(keys, ["_t", "_p"]))


def _hot_entities(both: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    cuts = F.percentile_approx("_t", [i / SLICES for i in range(1, SLICES)], 10_000)
    counts = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = materialise(counts.select(*keys))
    if hot.isEmpty():
        return None
    return both.join(hot, keys, "left_semi").groupBy(*keys).agg(cuts.alias("_cuts"))


def _carry_sliced(both: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    slice_of = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_t"))), F.lit(0))
    sliced = materialise(both.join(hot, keys, "left").withColumn("_b", F.when(F.col("_cuts").isNull(), 0).otherwise(slice_of)).drop("_cuts"))
    best = sliced.groupBy(*keys, "_b").agg(F.max("_s").alias("_m"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry_in = best.select(*keys, "_b", F.max("_m").over(before).alias("_in"))
    inside = sliced.repartition(*keys, "_b").withColumn("_s", _so_far([*keys, "_b"], ["_t", "_p"]))
    joined = inside.join(carry_in.filter(F.col("_in").isNotNull()), [*keys, "_b"], "left")
    return joined.withColumn("_s", F.greatest("_s", "_in")).drop("_in", "_b")
