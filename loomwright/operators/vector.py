"""Exact vector search, counting, clustering and regression over blocks of dense vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.functions.columns import cosine
from loomwright.session import materialise, partitions, release

#: Vectors of either side that one task multiplies.
BLOCK = 16_384
#: Copies of all members that are in the shuffle at a time, and the rows that are no matter for a turn of their own.
COPIES, ROWS_A_TURN = 4, 500_000
#: Vectors that are packed into a row for counting pairs, and the rows and columns of products counted at a time.
PIECE, TILE = 2_048, (256, 1_024)
#: Stands for all values below a stretch.
BELOW = -(2**62)
#: Decimals at which similarities are compared, so that thresholds and ties don't hang on the order of summation.
DECIMALS = 9


def usable_vectors(df: DataFrame, key: str, emb: str, dim: int) -> DataFrame:
    """One row per key with a vector of ``dim`` finite values that is not all zero: the least of a key's vectors."""
    v = F.col(emb)
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).groupBy(key).agg(F.min(emb).alias(emb))


def block_pairs(queries: DataFrame, members: DataFrame, *, key: str, emb: str, dim: int, least: float = -1.0, k: int | None = None, year: str | None = None, back: int = 0, ahead: int = 0) -> DataFrame:
    """``q, m, sim``: pairs of different keys with a cosine of at least ``least``; with ``k`` only the k best of each query.

    With ``year``, a member counts if its year lies between the query's year - back and + ahead; rows without a year take no part.
    Ties go to the smaller key. The year is part of the block key: a query is sent to the years it looks at, and meets no others.
    Within a year both sides are hashed into blocks of about ``BLOCK`` rows, every pair of blocks is multiplied in one task, and
    with ``k`` a block hands on only its own k best of each query, which are merged afterwards. Nothing is approximated. Where the
    rows for the blocks are more than ``COPIES`` of all members, the pairs of blocks take turns, whose shuffle files go before the next.
    """
    when = F.col(year).cast("int") if year else F.lit(0)
    pick = lambda d: materialise(d.select(F.col(key).cast("bigint").alias("key"), F.col(emb).cast("array<float>").alias("vec"), when.alias("year")).filter("year is not null"))
    q = pick(queries)
    m = q if queries is members else pick(members)
    # members by year, and queries by the year they look at: one row a year reaches the driver
    held = {r["year"]: r["count"] for r in m.groupBy("year").count().collect()}
    looks = F.filter(F.array(*[F.lit(y) for y in sorted(held)]), lambda y: (y >= F.col("year") - back) & (y <= F.col("year") + ahead)) if held else F.array().cast("array<int>")
    asking = q.select("key", "vec", F.explode(looks if year else F.array(F.lit(0))).alias("at"))
    asked = {r["at"]: r["count"] for r in asking.groupBy("at").count().collect()}
    if not held or not asked:
        return m.sparkSession.createDataFrame([], "q bigint, m bigint, sim double")
    number = lambda counts: F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, -(-n // BLOCK))])
    nq, nm = number(asked)[F.col("at")], number(held)[F.col("at")]
    side = lambda d, own, other, n_own, n_other, ask: d.select(
        "at", F.pmod(F.xxhash64("key"), n_own).cast("int").alias(own), F.explode(F.sequence(F.lit(0), n_other.cast("int") - 1)).alias(other), F.lit(ask).alias("ask"), "key", "vec"
    )
    present = m.select("key", "vec", F.col("year").alias("at")).filter(F.col("at").isin(*asked))
    both = side(asking, "qb", "mb", nq, nm, True).unionByName(side(present, "mb", "qb", nm, nq, False))

    def multiply(t: pa.Table) -> pa.Table:
        ask, ids = (t[c].to_numpy() for c in ("ask", "key"))
        x = np.asarray(t["vec"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        qi, mi = np.flatnonzero(ask), np.flatnonzero(~ask)
        mi = mi[np.argsort(ids[mi], kind="stable")]
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for s in range(0, len(qi), 256):
            own = qi[s : s + 256]
            sim = np.round(x[own] @ x[mi].T, DECIMALS)
            a, b = np.nonzero((sim >= least) & (ids[own][:, None] != ids[mi][None, :]))
            if k is not None and len(a):
                order = np.lexsort((b, -sim[a, b], a))
                a, b = a[order], b[order]
                first = np.arange(len(a)) - np.searchsorted(a, a) < k
                a, b = a[first], b[first]
            parts.append((ids[own[a]], ids[mi[b]], sim[a, b]))
        cols = [np.concatenate(c) for c in zip(*parts)]
        return pa.table({"q": pa.array(cols[0]), "m": pa.array(cols[1]), "sim": pa.array(cols[2])})

    cells = sum(-(-n // BLOCK) * -(-held[y] // BLOCK) for y, n in asked.items() if y in held)
    width = max(1, min(cells, 4 * partitions(m.sparkSession)))
    blocks = lambda n: -(-n // BLOCK)
    sent = sum(n * blocks(held[y]) + held[y] * blocks(n) for y, n in asked.items() if y in held)
    turns = max(1, min(-(-sent // ROWS_A_TURN), -(-sent // (COPIES * sum(held.values())))))
    turn = F.pmod(F.xxhash64("at", "qb", "mb"), F.lit(turns))
    search = lambda d: d.repartition(width, "at", "qb", "mb").groupBy("at", "qb", "mb").applyInArrow(multiply, "q bigint, m bigint, sim double")
    found = search(both) if turns == 1 else reduce(DataFrame.unionByName, [materialise(search(both.filter(turn == t))) for t in range(turns)])
    return found if k is None else ranked(found, k).drop("rank")


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each query with their ``rank`` from 1 on; ties go to the smaller key."""
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "m"))).filter(F.col("rank") <= k)


def threshold_counts(pairs: DataFrame, thresholds: list[float], sides: dict[str, object]) -> DataFrame:
    """Per query and threshold one row: ``q, tau``, and a count for every named condition over the pairs.

    Each pair is given to its greatest threshold only; sums over the thresholds above give the counts, so the number of
    aggregates doesn't grow with the number of thresholds.
    """
    taus = sorted(thresholds)
    level = sum(((F.col("sim") >= t).cast("int") for t in taus), F.lit(0))
    own = pairs.withColumn("_level", level).filter("_level > 0").groupBy("q", "_level").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in sides.items()])
    spread = own.select("q", *sides, F.explode(F.slice(F.array(*[F.lit(t) for t in taus]), F.lit(1), F.col("_level"))).alias("tau"))
    return spread.groupBy("q", "tau").agg(*[F.sum(n).alias(n) for n in sides])


def pair_percentiles(df: DataFrame, *, key: str, emb: str, dim: int, label: str, quantiles: list[float], block: int = BLOCK, step: int = 50_000, asks: Column | None = None) -> DataFrame:
    """``same, n, values``: exact quantiles (interpolated) of the cosines of all ordered pairs of rows, apart for pairs of equal and of other ``label``.

    With ``asks`` only the pairs whose first row it holds for count; ``key`` is unique. A null label equals none. Cosines are whole numbers of 1e-9.
    Every pair is multiplied twice in single precision, whose error has a bound. A first pass counts the products in bins of ``step`` units: the value of
    a wanted rank is within the bound of its bin. A second pass counts the pairs certainly below that stretch, and those that may be in it by their
    cosine in double precision. Both merge counts, so nothing is sampled or sorted. The driver sees a count per bin and the wanted values. The vectors go
    to the pairs of blocks packed by the ``PIECE``, in turns of ``COPIES`` of all of them. Work grows with the square of the rows.
    """
    spark, scale = df.sparkSession, 10**DECIMALS
    top = scale // step  # products are shifted and scaled to 0 .. 2 * top, a bin being 1
    slack = top * ((dim + 16) * 2.0**-24 + 1.0 / scale)  # rounding of both vectors, of the scaled one, of every sum and of the shift
    aside = 2 * top + 4 + int(np.ceil(4 * slack))  # where what is no pair goes
    times = 2 if asks is None else 1  # a cosine is the same both ways round: orders of a pair that one counted pair stands for
    picked = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    rows = materialise(df.select(F.col(key).alias("key"), F.col(emb).cast("array<float>").alias("vec"), F.col(label).cast("double").alias("label"), picked.alias("asks")))
    held, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    n, n_asked = (max(1, -(-c // block)) for c in (held, asked))

    def pack(t: pa.Table) -> pa.Table:
        what = t["label"].to_numpy()
        order = np.argsort(what, kind="stable")
        x = np.asarray(t["vec"].combine_chunks().flatten(), dtype=np.float32).reshape(-1, dim)
        cuts = [order[s : s + PIECE] for s in range(0, len(order), PIECE)]
        packed = {c: pa.array([a[i].tobytes() for i in cuts], pa.binary()) for c, a in (("ids", t["key"].to_numpy()), ("labels", what), ("vecs", x))}
        return pa.table({"own": pa.array([t["own"][0].as_py()] * len(cuts), pa.int32()), "piece": pa.array(range(len(cuts)), pa.int32()), **packed})

    def packed(d: DataFrame, blocks: int) -> DataFrame:
        own = d.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("own"), F.col("key").cast("bigint").alias("key"), "vec", "label")
        width = max(1, min(blocks, 4 * partitions(spark)))
        return materialise(own.repartition(width, "own").groupBy("own").applyInArrow(pack, "own int, piece int, ids binary, labels binary, vecs binary"))

    whole = packed(rows, n)
    asking = None if asks is None else packed(rows.filter("asks"), n_asked)  # in blocks of their own: each meets all blocks once
    release(rows)
    sent = n * held if asks is None else n * asked + n_asked * held
    turns = max(1, min(-(-sent // ROWS_A_TURN), -(-sent // max(1, COPIES * held))))
    # wide, so that few pairs of blocks share a task
    width = max(1, min(-(-4 * (n * (n + 1) // 2 if asks is None else n_asked * n) // turns), 8 * partitions(spark)))

    def cells(turn: int) -> DataFrame:
        def meet(d: DataFrame, others: int, cell, first) -> DataFrame:
            now = F.filter(F.sequence(F.lit(0), F.lit(others - 1)), lambda o: F.pmod(F.xxhash64(*cell(o)), F.lit(turns)) == turn)
            lo, hi = cell(F.col("o"))
            return d.withColumn("o", F.explode(now)).select(lo.alias("lo"), hi.alias("hi"), first.alias("first"), "piece", "ids", "labels", "vecs")

        own = F.col("own")
        if asks is None:
            return meet(whole, n, lambda o: (F.least(own, o), F.greatest(own, o)), own <= F.col("o"))
        return meet(asking, n, lambda o: (own, o), F.lit(True)).unionByName(meet(whole, n_asked, lambda o: (o, own), F.lit(False)))

    def side(pieces: list[dict]) -> dict[str, np.ndarray]:
        read = lambda c, kind: np.frombuffer(b"".join(p[c] for p in sorted(pieces, key=lambda p: p["piece"])), kind)
        x = read("vecs", np.float32).reshape(-1, dim)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        return {"x": x, "norm": norm, "unit": (x / norm[:, None]).astype(np.float32), "ids": read("ids", np.int64), "label": read("labels", np.float64)}

    def tiles(t: pa.Table):
        """The rows of either side, their shifted products, and the places in these where both have the same label."""
        pieces = t.to_pylist()
        within = times == 2 and pieces[0]["lo"] == pieces[0]["hi"]
        q = side([p for p in pieces if p["first"]])
        m = q if within else side([p for p in pieces if not p["first"]])
        kept = np.empty(TILE[0] * TILE[1], np.float32)
        for r in range(0, len(q["x"]), TILE[0]):
            a = {c: v[r : r + TILE[0]] for c, v in q.items()}
            scaled = a["unit"] * np.float32(top)
            for s in range(r // TILE[1] * TILE[1] if within else 0, len(m["x"]), TILE[1]):
                b = {c: v[s : s + TILE[1]] for c, v in m.items()}
                at = kept[: len(a["x"]) * len(b["x"])].reshape(len(a["x"]), -1)
                np.matmul(scaled, b["unit"].T, out=at)
                at += np.float32(top)
                if within and s < r + len(a["x"]):
                    at[np.arange(s, s + at.shape[1]) <= np.arange(r, r + at.shape[0])[:, None]] = aside
                elif times == 1:
                    at[a["ids"][:, None] == b["ids"]] = aside
                begin, end = (np.searchsorted(b["label"], a["label"], how) for how in ("left", "right"))
                many = np.where(np.isnan(a["label"]), 0, end - begin)
                same = np.repeat(np.arange(len(many)) * at.shape[1] + begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
                yield a, b, at, same

    def coarse(t: pa.Table) -> pa.Table:
        acc, kept = np.zeros((2, aside + 1), np.int64), np.empty(TILE[0] * TILE[1], np.intp)
        for _, _, at, same in tiles(t):
            bins = kept[: at.size]
            np.copyto(bins, at.ravel(), casting="unsafe")
            alike = np.bincount(bins[same], minlength=aside + 1)
            acc[0] += np.bincount(bins, minlength=aside + 1) - alike
            acc[1] += alike
        acc[:, aside] = 0
        k, at = np.nonzero(acc)
        return pa.table({"k": pa.array(k, pa.int32()), "at": pa.array(at, pa.int64()), "c": pa.array(acc[k, at])})

    def counted(work, names: tuple[str, str]) -> DataFrame:
        """Counts by two names over the cells of all turns; what a turn shuffled goes before the next."""
        schema = f"{names[0]} int, {names[1]} bigint, c bigint"
        add = lambda d: d.groupBy(*names).agg(F.sum("c").alias("c"))
        parts = [materialise(add(cells(i).repartition(width, "lo", "hi").groupBy("lo", "hi").applyInArrow(work, schema))) for i in range(turns)]
        return parts[0] if turns == 1 else add(reduce(DataFrame.unionByName, parts))

    found = counted(coarse, ("k", "at")).toArrow()
    bins = np.zeros((2, aside), np.int64)
    bins[found["k"].to_numpy(), found["at"].to_numpy()] = found["c"].to_numpy()
    ends = np.cumsum(bins, axis=1)
    total = times * ends[:, -1]
    places = {k: [q * (int(total[k]) - 1) for q in quantiles] for k in range(2) if total[k]}
    ranks = sorted({(k, int(end(p)) // times) for k, ps in places.items() for p in ps for end in (np.floor, np.ceil)})  # among the pairs counted
    stretches: list[list] = []  # class, from, to; apart from each other
    inside = {}
    for k, rank in ranks:
        b = int(np.searchsorted(ends[k], rank, side="right"))
        if stretches and stretches[-1][0] == k and b - 2 * slack <= stretches[-1][2]:
            stretches[-1][2] = b + 1 + 2 * slack
        else:
            stretches.append([k, b - 2 * slack if b else -1.0 - 2 * slack, b + 1 + 2 * slack])
        inside[k, rank] = len(stretches) - 1

    least = np.array([int((lo - slack) * step) - 2 for _, lo, _ in stretches], np.int64)  # in units
    first = np.cumsum([0, *[int((hi + slack) * step) + 2 - u for u, (_, _, hi) in zip(least, stretches)]])  # places of a stretch's units
    own = [[(w, np.float32(lo), np.float32(hi)) for w, (c, lo, hi) in enumerate(stretches) if c == k] for k in range(2)]

    def fine(t: pa.Table) -> pa.Table:
        acc, below = np.zeros(first[-1], np.int64), np.zeros(len(stretches), np.int64)
        flags, room = (np.zeros(-(-TILE[0] * TILE[1] // 8) * 8, bool) for _ in range(2))
        for a, b, at, same in tiles(t):
            flat = at.ravel()
            alike = flat[same]
            flags[:] = False
            marked, under = flags[: flat.size], room[: flat.size]
            for w, lo, hi in own[0]:
                np.less(flat, lo, out=under)
                below[w] += np.count_nonzero(under) - np.count_nonzero(alike < lo)
                marked ^= under
                marked ^= np.less(flat, hi, out=under)
            words = np.flatnonzero(flags.view(np.int64))  # few are marked
            word, byte = np.nonzero(flags.reshape(-1, 8)[words])
            hits = [words[word] * 8 + byte]
            i, j = np.divmod(hits[0], at.shape[1])
            hits[0] = hits[0][a["label"][i] != b["label"][j]]
            stretch = [np.array([w for w, _, _ in own[0]], np.int64)[np.searchsorted([lo for _, lo, _ in own[0]], flat[hits[0]], side="right") - 1]]
            for w, lo, hi in own[1]:
                under = alike < lo
                below[w] += np.count_nonzero(under)
                hits.append(same[under ^ (alike < hi)])
                stretch.append(np.full(len(hits[-1]), w))
            stretch = np.concatenate(stretch)
            i, j = np.divmod(np.concatenate(hits), at.shape[1])
            if len(i) > at.size // 32:
                dots = (a["x"].astype(np.float64) @ b["x"].T.astype(np.float64))[i, j]
            else:
                dots = np.einsum("ij,ij->i", a["x"][i], b["x"][j], dtype=np.float64)
            unit = np.rint(np.round(dots / (a["norm"][i] * b["norm"][j]), DECIMALS) * scale).astype(np.int64) + scale
            np.add.at(acc, first[stretch] + unit - least[stretch], 1)
        at = np.flatnonzero(acc)
        stretch = np.searchsorted(first, at, side="right") - 1
        return pa.table({
            "w": pa.array(np.concatenate([np.arange(len(below)), stretch]), pa.int32()),
            "unit": pa.array(np.concatenate([np.full(len(below), BELOW), at - first[stretch] + least[stretch]]), pa.int64()),
            "c": pa.array(np.concatenate([below, acc[at]]), pa.int64()),
        })

    value = {}
    if ranks:
        upto = F.sum("c").over(W.partitionBy("w").orderBy("unit").rowsBetween(W.unboundedPreceding, 0))
        wanted = [F.min(F.when((F.col("w") == inside[r]) & (F.col("upto") > r[1]), F.col("unit"))) for r in ranks]
        units = counted(fine, ("w", "unit")).withColumn("upto", upto).agg(*wanted).first()
        value = {r: (u - scale) / scale for r, u in zip(ranks, units)}
    out = []
    for k, ps in places.items():
        low_high = [(value[k, int(np.floor(p)) // times], value[k, int(np.ceil(p)) // times]) for p in ps]
        out.append((bool(k), int(total[k]), [float(lo + (p - np.floor(p)) * (hi - lo)) for p, (lo, hi) in zip(ps, low_high)]))
    return spark.createDataFrame(out, "same boolean, n bigint, values array<double>")


def pair_cosine(pairs: DataFrame, vectors: DataFrame, *, key: str, emb: str, a: str, b: str) -> DataFrame:
    """``pairs`` with ``sim``, the cosine of their ends; null where an end has no vector."""
    x, y = (vectors.select(F.col(key).alias(c), F.col(emb).alias(f"_{c}")) for c in (a, b))
    return pairs.join(x, a, "left").join(y, b, "left").withColumn("sim", cosine(f"_{a}", f"_{b}")).drop(f"_{a}", f"_{b}")


def knn_regression(neighbours: DataFrame, targets: DataFrame, *, key: str, y: str, temperature: float | None = None) -> DataFrame:
    """``q, pred, n`` from neighbours(q, m, sim): the mean of log1p(y), weighted by exp(temperature * sim) if given."""
    known = neighbours.join(targets.select(F.col(key).alias("m"), F.log1p(y).alias("_y")).dropna(), "m")
    # cosines are at most 1, so the exponent is shifted by the temperature
    w = F.lit(1.0) if temperature is None else F.exp(F.lit(temperature) * (F.col("sim") - 1))
    return known.groupBy("q").agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("pred"), F.count(F.lit(1)).alias("n"))


def centroids(df: DataFrame, label: str, emb: str) -> DataFrame:
    """``label, centroid``: mean vectors, summed position by position map-side."""
    flat = df.select(F.col(label).alias("label"), F.posexplode(emb).alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest_centroid(df: DataFrame, centres: DataFrame, *, key: str, emb: str, k: int = 1, most: int = 10_000) -> DataFrame:
    """``key, label, sim, rank``: the k centroids of greatest cosine. The centroids are broadcast while at most ``most``."""
    if centres.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} centroids")
    sims = df.select(key, emb).crossJoin(F.broadcast(centres)).select(key, "label", F.round(cosine(emb, "centroid"), DECIMALS).alias("sim"))
    return sims.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("sim"), "label"))).filter(F.col("rank") <= k)


def spherical_kmeans(df: DataFrame, *, key: str, emb: str, k: int, fit_on=None, seed: int = 1, iterations: int = 30) -> DataFrame:
    """``key, cluster`` by cosine k-means (k-means|| start); fitted on the rows ``fit_on`` holds for, all rows assigned."""
    vectors = df.withColumn("_v", array_to_vector(F.col(emb).cast("array<double>")))
    train = vectors if fit_on is None else vectors.filter(fit_on)
    model = KMeans(k=k, distanceMeasure="cosine", initMode="k-means||", featuresCol="_v", predictionCol="cluster", seed=seed, maxIter=iterations).fit(train)
    return model.transform(vectors).select(key, "cluster")


def principal_components(df: DataFrame, *, key: str, emb: str, k: int, fit_on=None) -> DataFrame:
    """``key, pc``: projections on the first k components of the rows ``fit_on`` holds for."""
    vectors = df.withColumn("_v", array_to_vector(F.col(emb).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors if fit_on is None else vectors.filter(fit_on))
    return model.transform(vectors).select(key, vector_to_array("_p").alias("pc"))
