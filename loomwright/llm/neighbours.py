"""Most similar vectors for every vector, by learned partitions.

On a bounded sample the neighbour graph is computed exactly and cut into balanced parts; a small softmax classifier learns the
part of a vector. Every vector of the collection is indexed under its most probable part, every query is routed to its several
most probable parts, and what it finds there is reranked by exact cosine. A part with too many members gets a sample, a graph
and a classifier of its own, and so on, so the number of parts has no ceiling and no classifier more than ``FANOUT`` parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.session import materialise, release, sized_broadcast

#: Vectors the first partition is learned on, and those of a part that is cut again; every vector is indexed.
SAMPLE, PART_SAMPLE = 12_000, 4_000
#: Wanted vectors of the collection a part, and the parts one classifier tells apart. A part is cut again from twice the rows on.
PART_ROWS, FANOUT = 2_000, 256
#: Levels of parts; what is still too large below is compared in blocks.
LEVELS = 6
#: A query goes to its most probable parts until they hold this share of the probability, to at least and at most so many.
MASS, LEAST_PROBES, PROBES = 0.85, 2, 8
#: Rows of one side that a task compares at once, and bytes of routers that are sent at once.
BLOCK, ROUTERS = 4_096, 64_000_000
#: Rows sent to parts that are no matter for a turn of their own; beyond them a turn sends about one copy of every vector.
ROWS_A_TURN = 100_000
#: Neighbours in the sample's graph.
GRAPH_K = 10


def _pack(m: np.ndarray) -> pa.Array:
    """Rows of floats as binaries whose order is the rows' lexicographic order."""
    bits = np.ascontiguousarray(m, np.float32).view(np.uint32)
    ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(">u4")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * m.shape[1]), len(m), [None, pa.py_buffer(ordered.tobytes())]).cast(pa.binary())


def _unpack(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of :func:`_pack`."""
    flat = np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint32)
    return np.where(flat >> 31, flat & np.uint32(0x7FFFFFFF), ~flat).view(np.float32).reshape(-1, dim)


def _shrink(m: np.ndarray) -> pa.Array:
    """Rows of floats as binaries, of two bytes a value where all of a row's values are half floats."""
    with np.errstate(over="ignore"):
        half = m.astype(np.float16)
    exact = (half == m).all(1)
    return pa.array([h.tobytes() if e else x.tobytes() for h, x, e in zip(half, m.astype(np.float32), exact)], pa.binary())


def _load(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of :func:`_shrink`."""
    held = column.to_pylist()
    out, short = np.empty((len(held), dim), np.float32), np.array([len(b) == 2 * dim for b in held], bool)
    for kind, at in ((np.float16, np.flatnonzero(short)), (np.float32, np.flatnonzero(~short))):
        out[at] = np.frombuffer(b"".join([held[i] for i in at]), kind).reshape(-1, dim)
    return out


def _units(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(vectors: DataFrame, key: str, emb: str, dim: int) -> DataFrame:
    """``row, vec``: a packed row for each row with a key and a vector of ``dim`` finite values that isn't all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            held = np.flatnonzero((np.asarray(lists.value_lengths().fill_null(-1)) == dim) & np.asarray(batch.column(0).is_valid()))
            m = lists.take(pa.array(held)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            fine = np.isfinite(m).all(1) & (m != 0).any(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held[fine])), _pack(m[fine])], ["row", "vec"])

    return vectors.select(F.col(key).cast("bigint").alias("row"), F.col(emb).cast("array<float>").alias("vec")).mapInArrow(run, "row bigint, vec binary")


@dataclass
class Router:
    """A softmax classifier over unit vectors: part logits are ``x @ weights + bias``."""

    weights: np.ndarray
    bias: np.ndarray

    def parts(self, x: np.ndarray, most: int, least: int = LEAST_PROBES, mass: float = MASS) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` most probable parts of every row, most probable first, and how many of them hold ``mass`` together."""
        z = x @ self.weights + self.bias
        most = min(most, z.shape[1])
        top = np.argpartition(-z, most - 1, axis=1)[:, :most]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, 1), axis=1, kind="stable"), 1)
        p = np.exp(z - z.max(1, keepdims=True))
        held = np.cumsum(np.take_along_axis(p, top, 1), axis=1) / p.sum(1, keepdims=True)
        return top, np.clip((held < mass).sum(1) + 1, min(least, most), most)


def balanced_parts(graph: np.ndarray, x: np.ndarray, n_parts: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """A part for every node of the neighbour graph (rows of neighbour numbers) with at most 1.25 times the mean size.

    Starts from balanced cells around random nodes, then moves nodes to the part most of their neighbours are in, while that
    part has room.
    """
    n = len(x)
    cap = int(np.ceil(1.25 * n / n_parts))
    part = _balanced_cells(x, x[rng.choice(n, n_parts, replace=False)], cap)
    for _ in range(2):
        sums = np.zeros((n_parts, x.shape[1]))
        np.add.at(sums, part, x)
        part = _balanced_cells(x, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), cap)
    size = np.bincount(part, minlength=n_parts)
    for _ in range(rounds):
        near = part[graph]
        best = np.array([np.bincount(row).argmax() for row in near])
        gain = (near == best[:, None]).sum(1) - (near == part[:, None]).sum(1)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < cap:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def _balanced_cells(x: np.ndarray, centres: np.ndarray, cap: int) -> np.ndarray:
    """Nearest centre with room, nodes with the clearest preference first."""
    sims = x @ centres.T
    ranked = np.argsort(-sims, axis=1, kind="stable")
    room = np.full(len(centres), cap)
    part = np.empty(len(x), np.int64)
    for i in np.argsort(-sims.max(1), kind="stable"):
        for c in ranked[i]:
            if room[c]:
                room[c] -= 1
                part[i] = c
                break
    return part


def learn_router(x: np.ndarray, n_parts: int, *, seed: int = 3, epochs: int = 30) -> Router:
    """Neighbour graph of the sample, its balanced partition, and the classifier trained on the parts (mini-batch softmax)."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    if n_parts <= 1 or n <= n_parts * 2:
        return Router(np.zeros((dim, 1)), np.zeros(1))
    k = min(GRAPH_K, n - 1)
    graph = np.empty((n, k), np.int64)
    single = x.astype(np.float32)
    for s in range(0, n, 1_000):
        sims = single[s : s + 1_000] @ single.T
        sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
        graph[s : s + 1_000] = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    part = balanced_parts(graph, x, n_parts, rng)
    sums = np.zeros((n_parts, dim))
    np.add.at(sums, part, x)
    weights = 8 * sums.T / np.maximum(np.linalg.norm(sums.T, axis=0, keepdims=True), 1e-12)
    bias = np.zeros(n_parts)
    for epoch in range(epochs):
        rate = 4.0 / (1 + epoch / 5)
        order = rng.permutation(n)
        for s in range(0, n, 256):
            own = order[s : s + 256]
            z = x[own] @ weights + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), part[own]] -= 1
            weights -= rate * x[own].T @ p / len(own)
            bias -= 0.1 * rate * p.mean(0)
    return Router(weights, bias)


def _split(routed: DataFrame, big: DataFrame, dim: int, part_rows: int, probes: int, mass: float) -> DataFrame:
    """``routed(row, vec, parts)`` with parts of their own in place of the ``big(part, m)`` ones; the first part stays the row's own,
    and is there as ``part`` as well, with ``own`` as in the cells.

    Each part's classifier is learned in one task from a sample of its members by hash. The classifiers are sent to the rows, at
    most ``ROUTERS`` bytes of them at a time, so the vectors stay where they are.
    """
    spark = routed.sparkSession
    big = sized_broadcast(big)
    drawn = routed.select(F.col("parts")[0].alias("part"), "row", "vec").join(big, "part").filter(F.pmod(F.xxhash64("row", "part"), F.lit(1_000_000)) * F.col("m") < F.lit(PART_SAMPLE * 1_000_000))

    def learn(key: tuple, t: pa.Table) -> pa.Table:
        x = _units(_load(t["vec"], dim))
        router = learn_router(x, min(FANOUT, -(-t["m"][0].as_py() // part_rows)))
        return pa.table({"part": [key[0].as_py()], "weights": [router.weights.astype(np.float32).tobytes()], "bias": [router.bias.astype(np.float32).tobytes()]})

    learned = drawn.select("part", "vec", "m").groupBy("part").applyInArrow(learn, "part bigint, weights binary, bias binary")
    routers = materialise(big.select("part").join(learned, "part", "left"))
    sizes = routers.select("part", F.coalesce(F.length("weights"), F.lit(0)).alias("n")).orderBy("part").collect()  # two numbers a big part
    pieces, held = [[]], 0
    for r in sizes:
        if held and held + r["n"] > ROUTERS:
            pieces.append([])
            held = 0
        pieces[-1].append(r["part"])
        held += r["n"]
    for piece in pieces:
        known = {}
        for r in routers.filter(F.col("part").between(piece[0], piece[-1])).collect():
            # a part that can't be told apart has no router: it is final, compared in blocks
            apart = r["weights"] is not None and len(r["bias"]) > 4
            known[r["part"]] = Router(np.frombuffer(r["weights"], np.float32).reshape(dim, -1), np.frombuffer(r["bias"], np.float32)) if apart else None
        sent = spark.sparkContext.broadcast(known)

        def route(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2_000):
                    batch = whole.slice(at, 2_000)
                    lists = batch.column(2)
                    ends, flat = np.asarray(lists.offsets).astype(np.int64), lists.flatten().to_numpy()
                    ends = ends - ends[0]
                    x = _units(_load(batch.column(1), dim))
                    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                    into, count = {}, np.ones(len(flat), np.int64)
                    for part in np.unique(flat):
                        if part in sent.value:
                            own = np.flatnonzero(flat == part)
                            router = sent.value[part]
                            top, n = router.parts(x[owner[own]], probes, mass=mass) if router else (None, np.ones(len(own), np.int64))
                            into[part], count[own] = (own, top, n), n
                    start = np.cumsum(count) - count
                    out = np.repeat(flat, count)
                    for part, (own, top, n) in into.items():
                        row = np.repeat(np.arange(len(own)), n)
                        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                        out[start[own][row] + nth] = -part if top is None else part * FANOUT + 1 + top[row, nth]
                    bounds = np.concatenate([[0], np.cumsum(count)])[ends].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bounds), pa.array(out))], ["row", "vec", "parts"])

        before, routed = routed, materialise(routed.select("row", "vec", "parts").mapInArrow(route, "row bigint, vec binary, parts array<bigint>"))
        release(before)
    return routed.withColumns({"part": F.col("parts")[0], "own": F.lit(True)})


def nearest(vectors: DataFrame, *, key: str, emb: str, dim: int, k: int = 5, least: float = 0.85, probes: int = PROBES, mass: float = MASS, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> DataFrame:
    """``row, other, cosine, rank``: for every usable vector its ``k`` most similar others of cosine at least ``least``.

    Equal cosines (to nine decimals) go to the smaller key. Defined cases: vectors that are null, not of ``dim`` values, with a
    null or non-finite value, or of length zero take no part; a repeated key counts once, with the least of its vectors; equal
    vectors under several keys are compared once and handed back to every key, so a group of copies costs k rows a copy, not all
    pairs; an empty table gives no row; other columns are ignored.

    Scale: ``sample`` vectors reach the driver. A vector is kept once, with the list of the parts it is routed to, the first of which
    holds it as a member, and is shuffled once for each of them, in half precision where that is exact. The cells are compared in turns
    of about one copy of every vector, whose shuffle files go before the next. Parts are cut until they have fewer than twice ``part_rows`` members. A part with more than ``BLOCK`` rows on a side is cut into blocks that are all
    compared, so balance is a matter of speed only. Copies of one vector are one row of the search. The exact way: ``probes`` of at
    least ``FANOUT`` with a ``mass`` above 1 sends every query to every part.
    """
    spark = vectors.sparkSession
    packed = usable(vectors, key, emb, dim)
    fine = packed.groupBy("row").agg(F.min("vec").alias("vec"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                own = batch.slice(at, 2_000)
                yield pa.RecordBatch.from_arrays([own.column(0), _shrink(_unpack(own.column(1), dim)), own.column(2), own.column(3)], ["row", "vec", "h", "g"])

    # copies are told by 128 bits of hash; one of each group stands for it
    fine = fine.select("row", "vec", F.xxhash64("vec").alias("h"), F.xxhash64("vec", F.lit(1)).alias("g"))
    fine = materialise(fine.mapInArrow(shrink, "row bigint, vec binary, h bigint, g bigint"))
    hashes = fine.select("row", "h", "g")
    groups = hashes.groupBy("h", "g").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("size"))
    rows = materialise(
        hashes.join(groups.filter("size > 1"), ["h", "g"]).select("row", "rep").unionByName(groups.filter("size = 1").select(F.col("rep").alias("row"), "rep"))
    )
    reps = rows.filter("row = rep").select("row")
    n = reps.count()
    if not n:
        return spark.createDataFrame([], "row bigint, other bigint, cosine double, rank int")
    taken = packed.orderBy(F.xxhash64("row"), "vec").limit(sample).select("vec").toArrow()["vec"]
    first = learn_router(_units(_unpack(taken.unique(), dim)), min(FANOUT, -(-n // part_rows)))
    sent = spark.sparkContext.broadcast(first)  # at most dim x FANOUT numbers

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                own = batch.slice(at, 2_000)
                top, count = sent.value.parts(_units(_load(own.column(1), dim)), probes, mass=mass)
                flat = (top + 1)[np.arange(top.shape[1]) < count[:, None]].astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["row", "vec", "parts"])

    routed = materialise(fine.join(reps, "row").select("row", "vec").mapInArrow(route, "row bigint, vec binary, parts array<bigint>"))
    release(fine)
    for level in range(LEVELS + 1):
        cells = routed.select(F.posexplode("parts").alias("at", "part"), "row", "vec").select("part", (F.col("at") == 0).alias("own"), "row", "vec")
        loads = materialise(cells.groupBy("part").agg(F.count(F.lit(1)).alias("q"), F.count(F.when(F.col("own"), 1)).alias("m")))
        big = loads.filter((F.col("m") >= 2 * part_rows) & (F.col("part") > 0)).select("part", "m")
        if level == LEVELS or big.isEmpty():
            break
        routed = _split(routed, big, dim, part_rows, probes, mass)
    # blocks: a part's queries are all its rows, its members those of their own part; one row a part with more than one block
    several = F.ceil(F.col("q") / BLOCK).cast("int"), F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK)).cast("int")
    wide = sized_broadcast(loads.select("part", several[0].alias("nq"), several[1].alias("nm")).filter("nq > 1"))
    one, digest = F.lit(1), F.xxhash64("row")
    sized = cells.join(wide, "part", "left").withColumns({"nq": F.coalesce("nq", one), "nm": F.coalesce("nm", one)})
    qb, mb = F.pmod(digest, F.col("nq")).cast("int"), F.pmod(digest, F.col("nm")).cast("int")
    asks = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda i: F.struct(qb.alias("qb"), i.alias("mb"), F.lit(True).alias("asks"), ((i == mb) & F.col("own")).alias("own")))
    # a member that asks in the same cell travels once
    offers = F.when(F.col("own"), F.transform(F.filter(F.sequence(F.lit(0), F.col("nq") - 1), lambda i: i != qb), lambda i: F.struct(i.alias("qb"), mb.alias("mb"), F.lit(False).alias("asks"), F.lit(True).alias("own")))).otherwise(F.array())
    placed = sized.select("part", "row", "vec", F.inline(F.concat(asks, offers)))

    def compare(t: pa.Table) -> pa.Table:
        ids = t["row"].to_numpy()
        x = _units(_load(t["vec"], dim))
        single = x.astype(np.float32)
        qi, mi = np.flatnonzero(t["asks"].to_numpy()), np.flatnonzero(t["own"].to_numpy())
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        mi = mi[np.argsort(ids[mi], kind="stable")]
        for s in range(0, len(qi) if len(mi) else 0, 512):
            own = qi[s : s + 512]
            rough = single[own] @ single[mi].T  # within 1e-5 of the cosines; what may count is worked out in double precision
            cut = np.full(len(own), least - 1e-5)
            if len(mi) > 2 * (k + 1):  # all that may equal the k-th stay, the query itself beside them
                cut = np.maximum(cut, -np.partition(-rough, k, axis=1)[:, k] - 2e-5)
            a, b = np.nonzero(rough >= cut[:, None])
            apart = ids[own[a]] != ids[mi[b]]
            a, b = a[apart], b[apart]
            cos = np.round(np.einsum("ij,ij->i", x[own[a]], x[mi[b]]), 9)
            fits = cos >= least
            a, b, cos = a[fits], b[fits], cos[fits]
            if len(a):
                # of each query the first k by cosine and key
                order = np.lexsort((ids[mi[b]], -cos, a))
                a, b, cos = a[order], b[order], cos[order]
                first = np.arange(len(a)) - np.searchsorted(a, a) < k
                out.append((ids[own[a[first]]], ids[mi[b[first]]], cos[first]))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"row": pa.array(cols[0]), "other": pa.array(cols[1]), "cosine": pa.array(cols[2])})

    sends = loads.agg(F.sum(F.col("q") * several[1])).first()[0]
    turns = max(1, min(-(-sends // n), -(-sends // ROWS_A_TURN)))
    found = []
    for t in range(turns):
        now = placed.filter(F.pmod(F.xxhash64("part", "qb", "mb"), F.lit(turns)) == t) if turns > 1 else placed
        found.append(materialise(_first(now.groupBy("part", "qb", "mb").applyInArrow(compare, "row bigint, other bigint, cosine double"), "row", "other", k)))
    best = materialise(_first(reduce(DataFrame.unionByName, found), "row", "other", k))
    release(*found)
    between = best.select(F.col("row").alias("rep"), F.col("other").alias("near"), "cosine")
    # copies: the first k + 1 keys of a group stand for it as neighbours
    heads = rows.select("rep", "row").withColumn("at", F.row_number().over(W.partitionBy("rep").orderBy("row"))).filter(F.col("at") <= k + 1).select("rep", F.col("row").alias("other"))
    candidates = between.join(heads.withColumnRenamed("rep", "near"), "near").select("rep", "other", "cosine").unionByName(heads.select("rep", "other", F.lit(1.0).alias("cosine")))
    # of each class the best k + 1: one of them may be the asking key itself
    asked = rows.select("row", "rep").join(_first(candidates, "rep", "other", k + 1), "rep").filter("row <> other").select("row", "other", "cosine")
    return _first(asked, "row", "other", k, "rank")


def _first(df: DataFrame, by: str, then: str, k: int, rank: str | None = None) -> DataFrame:
    """The ``k`` rows of greatest cosine per ``by``, ties to the least ``then``."""
    at = rank or "_at"
    top = df.withColumn(at, F.row_number().over(W.partitionBy(by).orderBy(F.desc("cosine"), then))).filter(F.col(at) <= k)
    return top if rank else top.drop(at)
