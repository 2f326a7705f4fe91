"""Near-duplicate strings: an exact prefix-tree self-join of n-gram sets.

Every string becomes the set of its n-grams in one global order, rarest first. The sets form a prefix tree whose first level
is the first gram two sets have in common: a set hangs under each gram at which a partner could first meet it. Below that the
tree branches by the sets' remaining lengths, and pairs of subtrees whose remaining lengths can't reach the overlap needed are
pruned whole. The leaves are bursts: small containers of sets compared at once by 256-bit parity sketches, whose Hamming
distance never exceeds the number of grams two sets differ in, so nothing that qualifies is lost. What is left is verified on
the whole sets. README gives the figures of a tree that branches by the second common gram as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import materialise, partitions, release

GRAM = 4
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
#: The size of the gram universe, which bounds the global order: 36^4 entries.
UNIVERSE = len(ALPHABET) ** GRAM
#: Sets under one gram that one task compares at once; longer lists are cut into blocks and compared block by block.
BLOCK = 16_384
#: Row shares of a shuffle partition.
ROWS_A_PART = 1_000_000
#: Rows of the tree per string that are in the shuffle at a time, and the rows that are no matter for a turn of their own.
ROWS_A_STRING, ROWS_A_TURN = 16, 1_000_000
#: Jaccard threshold as a fraction, 3 of 5.
NUMERATOR, DENOMINATOR = 3, 5

#: A set under a gram: sketch, string, size, and twice its position, plus 1 if it is on the left of two different blocks. A cell's key is
#: the gram and the numbers of both blocks, of so many bits each.
SET, CELL = np.dtype([("sketch", np.uint64, 4), ("cid", np.int64), ("size", np.int32), ("pos", np.int32)]), 20

_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i


def gram_sets(strings: pa.Array, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and gram codes (or their ranks) of the distinct grams of every string over the alphabet, sorted by both, and sizes."""
    strings = strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings
    lengths = np.asarray(pc.binary_length(strings)).astype(np.int64)
    text = "".join(strings.to_pylist()).encode()
    codes = _CODE[np.frombuffer(text, np.uint8)]
    rows = np.repeat(np.arange(len(lengths)), lengths)
    if len(codes) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(lengths), np.int64)
    grams = np.zeros(len(codes) - GRAM + 1, np.int64)
    for k in range(GRAM):
        grams = grams * len(ALPHABET) + codes[k : len(codes) - GRAM + 1 + k]
    inside = rows[: len(grams)] == rows[GRAM - 1 :]
    grams = grams[inside]
    both = np.sort(rows[: len(inside)][inside] * UNIVERSE + (grams if rank is None else rank[grams]))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    r, g = np.divmod(both, UNIVERSE)
    return r, g, np.bincount(r, minlength=len(lengths))


def _ordered(strings: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, gram ranks, positions in the global order and sizes."""
    r, k, sizes = gram_sets(strings, rank)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return r, k, np.arange(len(r)) - starts[r], sizes


def _prefix(pos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions at which a first common gram still leaves enough grams for some partner size: overlap >= 0.6 size."""
    return DENOMINATOR * (size - pos) >= NUMERATOR * size


def _sketch(r: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """256 parity bits of every set: Hamming distance <= symmetric difference."""
    h = (g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    odd = np.bincount(r * 256 + h.astype(np.int64), minlength=n * 256).reshape(n, 256) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def _ranks(ordered: np.ndarray) -> np.ndarray:
    """The rank of every gram code, from the codes that occur in their global order; the others are never looked up."""
    rank = np.zeros(UNIVERSE, np.int64)
    rank[ordered] = np.arange(len(ordered))
    return rank


def _counts_kernel(ordered: np.ndarray | None):
    """Gram counts of a partition: document frequencies, or prefix frequencies by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNIVERSE, np.int64)
        rank = None if ordered is None else _ranks(ordered)
        for batch in batches:
            if rank is None:
                total += np.bincount(gram_sets(batch.column(0))[1], minlength=UNIVERSE)
            else:
                r, k, pos, sizes = _ordered(batch.column(0), rank)
                total += np.bincount(k[_prefix(pos, sizes[r])], minlength=UNIVERSE)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["gram", "n"])

    return run


def _gram_counts(strings: DataFrame, ordered: np.ndarray | None) -> np.ndarray:
    """Counts over all strings; at most ``UNIVERSE`` rows reach the driver, whatever the input."""
    rows = strings.mapInArrow(_counts_kernel(ordered), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(UNIVERSE, np.int64)
    counts[np.asarray(rows["gram"])] = np.asarray(rows["n"])
    return counts


def _insert_kernel(tree_b, first: int, last: int):
    """Rows of the tree below the grams of the ranks first..last - 1: a set under each of its prefix grams, in each pair of blocks it has to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, blocks = tree_b.value
        rank = _ranks(ordered)
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                cids = np.asarray(batch.column(0))
                r, k, pos, sizes = _ordered(batch.column(1), rank)
                bits = _sketch(r, k, len(cids))
                keep = _prefix(pos, sizes[r]) & (k >= first) & (k < last)
                keep &= blocks[k] > 0  # a gram that is in one prefix only leads to nobody
                r, k, pos = r[keep], k[keep], pos[keep]
                nb = blocks[k]
                own = (cids[r].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % nb
                again = np.repeat(np.arange(len(r)), nb)
                other = np.arange(len(again)) - np.repeat(np.cumsum(nb) - nb, nb)
                own = own[again]
                lo, hi = np.minimum(own, other), np.maximum(own, other)
                sets = np.empty(len(again), SET)
                sets["sketch"], sets["cid"], sets["size"] = bits.view(np.uint64)[r[again]], cids[r][again], sizes[r][again]
                sets["pos"] = pos[again] * 2 + ((own == lo) & (lo != hi))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SET.itemsize), len(again), [None, pa.py_buffer(sets.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array((k[again] << 2 * CELL) + (lo << CELL) + hi), packed], ["cell", "packed"])

    return run


#: Pairs compared in one go, so that the words stay in the processor's cache.
GO = 1 << 16


def _meet(x: np.ndarray, y: np.ndarray, size: np.ndarray, reach: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two leaves' sets that their remaining lengths and sketches let through. ``reach``: the greatest partner size."""
    none = np.empty(0, np.int64)
    alone = x is y
    x = x[reach[x] >= size[y].min()]
    if not len(x):
        return none, none
    y = x if alone else y[reach[y] >= size[x].min()]
    if not len(y):
        return none, none
    # J >= 3/5 <=> 4 * difference <= size + size; the leaves' greatest sizes bound it for all their pairs
    most = np.uint8(min(255, (int(size[x].max()) + int(size[y].max())) // 4))
    bx, by = np.ascontiguousarray(bits[x].T), np.ascontiguousarray(bits[y].T)
    step = max(1, GO // len(y))
    found_x, found_y = [], []
    for k in range(0, len(x), step):
        skip = k if alone else 0  # within one leaf every pair is met once
        far = np.bitwise_count(bx[0, k : k + step, None] ^ by[0, skip:])
        for w in (1, 2):
            far += np.bitwise_count(bx[w, k : k + step, None] ^ by[w, skip:])
        near = np.flatnonzero(far.ravel() <= most)
        if len(near):
            p, q = np.divmod(near, len(y) - skip)
            p, q = p + k, q + skip
            all_ = far.ravel()[near].astype(np.int64) + np.bitwise_count(bx[3, p] ^ by[3, q])
            p, q = x[p], y[q]
            ok = (4 * all_ <= size[p] + size[q]) & (reach[p] >= size[q]) & (size[p] <= reach[q])
            if ok.any():
                found_x.append(p[ok])
                found_y.append(q[ok])
    return (np.concatenate(found_x), np.concatenate(found_y)) if found_x else (none, none)


def _search(cid: np.ndarray, pos: np.ndarray, size: np.ndarray, bits: np.ndarray, left: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (lesser id first) among the sets below one gram, or between two blocks of them."""
    # partner size b needs 8 (size - pos) >= 3 (size + b)
    reach = (5 * size - 8 * pos) // 3
    order = np.argsort(size, kind="stable")
    # sets that can't even meet the shortest partner leave the subtree at once
    order = order[reach[order] >= size.min()]
    nodes = [n for n in np.array_split(order, min(24, max(1, len(order) // 256))) if len(n)]
    bounds = [(size[n[0]], size[n[-1]], reach[n].max()) for n in nodes]
    xs, ys = [], []
    for a, u in enumerate(nodes):
        for v, (least, _, far) in zip(nodes[a:], bounds[a:]):
            # sizes of v are the greater: the least of v must not exceed what the remaining lengths of u allow, and inversely
            if NUMERATOR * least > DENOMINATOR * bounds[a][1] or bounds[a][2] < least or far < bounds[a][0]:
                continue
            sides = [(u, v)] if same else [(u[left[u]], v[~left[v]])] + ([(v[left[v]], u[~left[u]])] if u is not v else [])
            for x, y in sides:
                if len(x) and len(y):
                    x, y = _meet(x, y, size, reach, bits)
                    xs.append(x)
                    ys.append(y)
    if not xs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = cid[np.concatenate(xs)], cid[np.concatenate(ys)]
    lo, hi = np.minimum(x, y), np.maximum(x, y)
    apart = lo != hi
    return lo[apart], hi[apart]


#: Sets under one gram up to which all short lists of a stretch of rows are compared together, and the rows of a stretch.
SHORT, STRETCH = 32, 50_000


def _short_lists(starts: np.ndarray, lengths: np.ndarray, pos: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of the short lists that their remaining lengths and sketches let through, for all lists at once."""
    own = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    after = lengths[own] - 1 - place  # rows of the same list that follow
    row = starts[own] + place
    x = np.repeat(row, after)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)
    reach = (5 * size - 8 * pos) // 3
    fits = (reach[x] >= size[y]) & (reach[y] >= size[x])
    x, y = x[fits], y[fits]
    far = np.zeros(len(x), np.int64)
    for w in range(bits.shape[1]):
        far += np.bitwise_count(bits[x, w] ^ bits[y, w])
    near = 4 * far <= size[x] + size[y]
    return x[near], y[near]


def _join_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a partition sorted by cell; holds a stretch of rows that ends with a cell, beyond it at most one cell."""
    none = np.empty(0, np.int64)

    def matched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        cell = t["cell"].to_numpy()
        packed = pa.concat_arrays(t["packed"].chunks).cast(pa.binary(SET.itemsize))
        sets = np.frombuffer(packed.buffers()[1], SET)[packed.offset : packed.offset + len(packed)]
        bits, cid, size = np.ascontiguousarray(sets["sketch"]), sets["cid"].copy(), sets["size"].astype(np.int64)
        pos, left = sets["pos"].astype(np.int64) >> 1, (sets["pos"] & 1).astype(bool)
        starts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
        lengths = np.diff(np.append(starts, len(cid)))
        lo_hi = cell[starts] & ((1 << 2 * CELL) - 1)
        alone = (lo_hi >> CELL) == (lo_hi & ((1 << CELL) - 1))
        short = alone & (lengths <= SHORT)
        x, y = _short_lists(starts[short & (lengths > 1)], lengths[short & (lengths > 1)], pos, size, bits)
        found = [(np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y]))]
        for k in np.flatnonzero(~short):
            s, e = starts[k], starts[k] + lengths[k]
            found.append(_search(cid[s:e], pos[s:e], size[s:e], bits[s:e], left[s:e], alone[k]))
        a, b = (np.concatenate(c) if c else none for c in zip(*found))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(a[fresh]), pa.array(b[fresh])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= STRETCH:
            # the last cell may go on: it stays
            last = held[-1]
            cell = np.asarray(last.column(0))
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut:
                yield from matched([*held[:-1], last.slice(0, cut)])
                held = [last.slice(cut)]
                rows = last.num_rows - cut
    if held:
        yield from matched(held)


def _verify_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (ra, ga, na), (rb, gb, nb) = gram_sets(batch.column(2)), gram_sets(batch.column(3))
        common = np.intersect1d(ra * UNIVERSE + ga, rb * UNIVERSE + gb, assume_unique=True) // UNIVERSE
        n = np.bincount(common, minlength=batch.num_rows)
        ok = DENOMINATOR * n >= NUMERATOR * (na + nb - n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n / (na + nb - n))], ["a", "b", "similarity"]).filter(pa.array(ok))


def similar_strings(strings: DataFrame, key: str = "cid", text: str = "s", held: bool = False) -> DataFrame:
    """``a, b, similarity``: all pairs a < b of strings whose 4-gram sets have a Jaccard similarity of at least 3/5.

    ``key`` is a unique bigint, ``text`` a distinct string over 0-9a-z of at least 4 characters; :func:`title_classes` makes
    such a table out of raw titles. An empty table gives no row. The result is exact. ``held``: the strings are materialised already.

    Scale: the global order is a table of at most 36^4 counts. A set is shuffled once per prefix gram (two fifths of its grams)
    with a 32-byte sketch, never its text, and in turns: each takes the grams of a stretch of the order and holds about
    ``ROWS_A_STRING`` rows a string on disk, which go before the next. Grams in more than ``BLOCK`` prefixes are cut into blocks, so a
    task holds two blocks at most; every pair of blocks is compared, so nothing is cut off. Only verified candidates fetch the texts.
    """
    spark = strings.sparkSession
    strings = strings.select(F.col(key).alias("cid"), F.col(text).alias("s"))
    if not held:
        strings = materialise(strings)
    counts = _gram_counts(strings.select("s"), None)
    used = np.flatnonzero(counts)
    ordered = used[np.lexsort((used, counts[used]))].astype(np.int32)
    prefixes = _gram_counts(strings.select("s"), ordered)[: len(ordered)]
    blocks = np.where(prefixes > 1, -(-prefixes // BLOCK), 0)
    load = np.concatenate([[0], np.cumsum(prefixes * blocks)])
    rows = int(load[-1])
    turns = max(1, min(-(-rows // ROWS_A_TURN), -(-rows // max(1, ROWS_A_STRING * strings.count()))))
    cuts = np.searchsorted(load, [rows * t / turns for t in range(turns)]).tolist() + [len(ordered)]
    cuts[0] = 0
    tree_b = spark.sparkContext.broadcast((ordered, blocks.astype(np.int32)))  # at most 36^4 entries each
    if blocks.max(initial=0) >> CELL:
        raise ValueError(f"more than {BLOCK << CELL} strings under one gram")
    found = []
    for first, last in zip(cuts, cuts[1:]):
        width = max(partitions(spark), -(-int(load[last] - load[first]) // ROWS_A_PART))
        tree = strings.mapInArrow(_insert_kernel(tree_b, first, last), "cell bigint, packed binary").repartition(width, "cell").sortWithinPartitions("cell")
        found.append(materialise(tree.mapInArrow(_join_kernel, "a bigint, b bigint").distinct()))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    left = strings.select(F.col("cid").alias("a"), F.col("s").alias("sa"))
    right = strings.select(F.col("cid").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    verified = materialise(both.mapInArrow(_verify_kernel, "a bigint, b bigint, similarity double"))
    release(*found)
    return verified


def title_classes(records: DataFrame, key: str, title: str, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Members and classes of equal stripped titles: ``(cid, id)`` and ``(cid, s)``, cid the least id of the class.

    The stripped title is the lower-cased title without any character outside a-z and 0-9. Null keys and titles, and stripped
    titles under ``least`` characters take no part; repeated rows count once. An id with several titles is in several classes.
    Both are materialised.
    """
    stripped = F.regexp_replace(F.lower(F.col(title)), "[^a-z0-9]", "")
    own = records.select(F.col(key).alias("id"), stripped.alias("s")).filter(F.col("id").isNotNull() & (F.length("s") >= least)).distinct()
    own = materialise(own)
    classes = materialise(own.groupBy("s").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("n")))
    shared = own.join(classes.filter("n > 1"), "s").select("cid", "id")
    members = materialise(shared.unionByName(classes.filter("n = 1").select("cid", F.col("cid").alias("id"))))
    release(own)
    return members, classes.select("cid", "s")
