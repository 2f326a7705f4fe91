"""Entity resolution of versions: edges, groups, representatives, roll-ups, and the cleaning of records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.columns import clean_array, full_date, jaccard, overlap, shared, title_key, title_words
from loomwright.session import materialise

#: Whole titles that name no work (fixed values).
STOP_TITLES = (
    "^(references?|bibliography|index|author index|subject index|preface|foreword|contents|table of contents|front matter|"
    "back matter|frontmatter|backmatter|editorial|introduction|conclusions?|appendix.*|glossary|abbreviations|acknowledg.*|"
    "title page|copyright|list of (figures|tables)|notes|about the authors?|editorial board|cover|erratum|corrigendum|"
    "abstracts?|withdrawn|retracted|front cover|back cover|other topics|background|summary|bibliographie|"
    "literaturverzeichnis|inhaltsverzeichnis|vorwort|einleitung|index of authors|keyword index|contributors|"
    "list of contributors|(chapter|part|section) [0-9ivx]+)$"
)
#: Words that tell parts of a series apart (fixed values).
PART_WORD = "^([0-9]+|i{1,3}|iv|v|vi{1,3}|ix|x|xi{1,3})$"
#: Largest group of versions that is believed.
MAX_GROUP = 6


#: Patterns of venue names and the class each stands for, the first that fits (fixed values).
VENUE_CLASSES = (("%arxiv%", "arxiv"), ("%preprint%", "repository"), ("%repository%", "repository"), ("%ebook%", "ebook"), ("%book%", "book series"), ("%conference%", "conference"), ("%journal%", "journal"))


def venue_classes(df: DataFrame, name: str, out: str = "kind") -> DataFrame:
    """``df`` with the class of its venue name by :data:`VENUE_CLASSES`; a null name or one that fits none has the class none."""
    kind = F.lit("none")
    for pattern, c in reversed(VENUE_CLASSES):
        kind = F.when(F.col(name).ilike(pattern), c).otherwise(kind)
    return df.withColumn(out, kind)


def is_junk(title: str) -> Column:
    """Whether a title is too short (under ten characters as words) or names no work."""
    words = title_words(title)
    return (F.length(words) < 10) | words.rlike(STOP_TITLES)


def version_edges(cand: DataFrame, *, block: int = 5, years: int = 3, least: int = 20) -> DataFrame:
    """``a, b, via`` of candidates(id, doi, arxiv_id, title, author_ids, type, year).

    via doi and arxiv: equal identifiers, case aside; every record is linked with the least of its identifier, so a shared
    identifier of many records costs one edge each. via title: equal stripped titles of ``least`` characters in blocks of at
    most ``block`` records, with a shared author, one side a preprint or with an arXiv id, years close and arXiv ids not at odds.
    """
    rows = cand.dropDuplicates(["id"]).filter(F.col("id").isNotNull())

    def star(c: str, via: str) -> DataFrame:
        own = rows.select("id", F.lower(F.trim(c)).alias("k")).filter(F.length("k") > 0)
        head = own.groupBy("k").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        return own.join(head, "k").filter("id <> a").select("a", F.col("id").alias("b"), F.lit(via).alias("via"))

    early = (F.coalesce(F.lower(F.trim("type")), F.lit("")) == "preprint") | F.col("arxiv_id").isNotNull()
    titled = rows.select("id", title_key("title").alias("k"), "author_ids", "year", "arxiv_id", early.alias("early")).filter(F.length("k") >= least)
    small = titled.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, block))
    held = titled.join(small, "k", "left_semi")
    x, y = held.select("k", *[F.col(c).alias(f"{c}_x") for c in held.columns if c != "k"]), held.select("k", *[F.col(c).alias(f"{c}_y") for c in held.columns if c != "k"])
    at_odds = F.coalesce(F.col("arxiv_id_x") != F.col("arxiv_id_y"), F.lit(False))
    close = F.abs(F.col("year_x") - F.col("year_y")) <= years
    fits = (F.col("id_x") < F.col("id_y")) & (F.col("early_x") | F.col("early_y")) & close & ~at_odds & overlap("author_ids_x", "author_ids_y")
    titles = x.join(y, "k").filter(fits).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"), F.lit("title").alias("via"))
    return star("doi", "doi").unionByName(star("arxiv_id", "arxiv")).unionByName(titles)


#: Links that one task joins up by itself.
TASK_LINKS = 1_000_000


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every vertex of the partition's links, but the least of its group, linked with that least one."""
    above: dict[int, int] = {}

    def top(v: int) -> int:
        while (up := above.setdefault(v, v)) != v:
            above[v] = above[up]
            v = up
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(a), top(b)
            above[max(x, y)] = min(x, y)
    rows = [(v, t) for v in above if (t := top(v)) != v]
    for k in range(0, len(rows), 100_000):
        v, t = zip(*rows[k : k + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])


def group_ids(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``member_id, comp``: groups of the records that edges link; comp is the least id.

    Each partition first joins its links up into stars. If all stars fit one task (``TASK_LINKS``) it joins them up too; else labels
    are propagated over the stars with pointer jumping: every round a record takes the least label around it and then its label's
    label, so paths shorten by doubling. Rounds are checkpointed, and the driver sees only whether anything moved.
    """
    links = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    e = materialise(links.mapInArrow(_joined_up, "a bigint, b bigint"))
    if e.limit(TASK_LINKS + 1).count() <= TASK_LINKS:
        stars = e.coalesce(1).mapInArrow(_joined_up, "a bigint, b bigint")
        return stars.select(F.col("b").alias("member_id"), F.col("a").alias("comp")).unionByName(stars.select(F.col("a").alias("member_id"), F.col("a").alias("comp")).distinct())
    both = materialise(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("member_id")).agg(F.min("b").alias("m")).select("member_id", F.least("member_id", "m").alias("comp")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("member_id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("member_id")).agg(F.min("comp").alias("low"))
        hooked = labels.join(near, "member_id").select("member_id", "comp", F.least("comp", "low").alias("new"))
        jump = hooked.select(F.col("member_id").alias("new"), F.col("new").alias("next"))
        after = materialise(hooked.join(jump, "new", "left").select("member_id", "comp", F.coalesce(F.least("new", "next"), "new").alias("new")))
        if after.filter("comp <> new").isEmpty():
            return after.select("member_id", "comp")
        labels = after.select("member_id", F.col("new").alias("comp"))
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def believed_groups(groups: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """Groups of at most ``most`` members; larger ones are dropped whole, not split."""
    sizes = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    return groups.join(sizes.select("comp"), "comp", "left_semi").select("member_id", "comp")


def representatives(members: DataFrame, group: str, order: list[Column], key: str) -> DataFrame:
    """``group, paper_id``: each group's first member by ``order``, then key; a map-side combined minimum."""
    best = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(key).alias("key")))
    return members.groupBy(group).agg(best["key"].alias("paper_id"))


def roll_up(members: DataFrame, group: str) -> DataFrame:
    """One row per group of members(type, year, author_ids, refs, cited_by_count, is_retracted): earliest year, unions of lists,
    sums of citations, whether any is a preprint or retracted, and the number of versions."""
    listed = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(clean_array(c)))))
    return members.groupBy(group).agg(
        F.min("year").alias("first_year"), listed("author_ids").alias("authors_union"), listed("refs").alias("refs_union"),
        F.coalesce(F.sum("cited_by_count"), F.lit(0)).alias("cited_by_count"), F.coalesce(F.bool_or(F.lower(F.trim("type")) == "preprint"), F.lit(False)).alias("has_preprint"),
        F.coalesce(F.bool_or("is_retracted"), F.lit(False)).alias("any_retracted"), F.count(F.lit(1)).alias("n_versions"),
    )


def date_precision(versions: DataFrame, group: str) -> DataFrame:
    """``group, first_year, first_date, precision`` of versions(publication_date, arxiv_id, year).

    A date that isn't 1 January is precise to the day, an arXiv id YYMM.number to the month (the 15th); the earliest precise
    date counts if it lies in the group's earliest year, else 1 January of that year with precision 'year'.
    """
    day = full_date("publication_date")
    exact = F.when(~((F.month(day) == 1) & (F.dayofmonth(day) == 1)), day)
    arxiv = F.coalesce(F.col("arxiv_id"), F.lit(""))
    mm = F.substring(arxiv, 3, 2)
    month = F.when(arxiv.rlike(r"^[0-9]{4}[.][0-9]{4,5}") & mm.between("01", "12"), F.concat(F.lit("20"), F.substring(arxiv, 1, 2), F.lit("-"), mm, F.lit("-15")).try_cast("date"))
    first = versions.filter("year is not null").groupBy(group).agg(F.min("year").alias("first_year"))
    both = F.filter(F.array(F.struct(exact.alias("d"), F.lit(0).alias("p")), F.struct(month.alias("d"), F.lit(1).alias("p"))), lambda x: x["d"].isNotNull())
    cand = versions.select(group, F.inline(both)).join(first, group).filter(F.year("d") == F.col("first_year"))
    best = cand.groupBy(group).agg(F.min(F.struct("d", "p")).alias("b"))
    fallback = F.make_date(F.col("first_year"), F.lit(1), F.lit(1))
    precision = F.when(F.col("b").isNull(), "year").when(F.col("b.p") == 0, "day").otherwise("month")
    return first.join(best, group, "left").select(group, "first_year", F.coalesce("b.d", fallback).alias("first_date"), precision.alias("precision"))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity of two strings' UTF-8 bytes (prefix scale 0.1, up to four, from a Jaro similarity of 0.7 on)."""
    if a == b:
        return 1.0
    a, b = a.encode(), b.encode()
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used = bytearray(lb)
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = 1
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    half = sum(x != y for x, y in zip(matched, (b[j] for j in range(lb) if used[j]))) // 2
    jaro = (m / la + m / lb + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def title_similarity(pairs: DataFrame, a: str, b: str, out: str = "title_sim") -> DataFrame:
    """``pairs`` with the Jaro-Winkler similarity of two title columns, in Arrow batches over already blocked pairs."""

    @F.pandas_udf("double")
    def sim(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in it:
            yield pd.Series([jaro_winkler(p, q) if p is not None and q is not None else None for p, q in zip(x, y)], dtype="float64")

    return pairs.withColumn(out, sim(a, b))


def near_duplicate_edges(cand: DataFrame, papers: DataFrame, *, years: int = 3, authors: float = 0.5, titles: float = 0.9) -> DataFrame:
    """Of the candidate pairs (a, b) of papers(id, title, author_ids, year) those that are one paper.

    They share an author, are at most ``years`` apart, differ in no part word, and either have the same title words or agree in
    authors (Jaccard) and title (Jaro-Winkler).
    """
    own = papers.select("id", title_words("title").alias("t"), "author_ids", "year")
    x, y = (own.select(F.col("id").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("t", "author_ids", "year")]) for c in ("a", "b"))
    pairs = cand.select("a", "b").filter("a < b").distinct().join(x, "a").join(y, "b")
    words = lambda p, q: F.array_except(F.split(f"t_{p}", " "), F.split(f"t_{q}", " "))
    parts = F.size(F.filter(F.concat(words("a", "b"), words("b", "a")), lambda w: w.rlike(PART_WORD)))
    close = pairs.filter((shared("author_ids_a", "author_ids_b") > 0) & (F.abs(F.col("year_a") - F.col("year_b")) <= years) & (parts == 0))
    same = F.col("t_a") == F.col("t_b")
    # only pairs that can still qualify are compared letter by letter: a title similarity of 0.9 needs a Jaro similarity of 5/6
    # with the longest prefix, and that lengths of at least one to two
    shorter, longer = F.least(*[F.octet_length(c) for c in ("t_a", "t_b")]), F.greatest(*[F.octet_length(c) for c in ("t_a", "t_b")])
    bound = (2 + F.try_divide(shorter, longer)) / 3 if titles > 0.7 else F.lit(1.0)
    hopeful = close.withColumn("auth_jacc", jaccard("author_ids_a", "author_ids_b")).filter(same | ((F.col("auth_jacc") >= authors) & (bound + 0.4 * (1 - bound) >= titles - 1e-9)))
    rated = title_similarity(hopeful, "t_a", "t_b")
    return rated.filter(((F.col("auth_jacc") >= authors) & (F.col("title_sim") >= titles)) | same).select("a", "b", "title_sim", "auth_jacc", same.alias("same_title"))


def same_title_pairs(papers: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """Pairs a < b of equal, non-empty title words in blocks of ``least`` to ``most`` papers."""
    own = papers.select("id", title_words("title").alias("t")).filter("t <> ''").distinct()
    held = own.join(own.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, most)), "t", "left_semi")
    return held.select("t", F.col("id").alias("a")).join(held.select("t", F.col("id").alias("b")), "t").filter("a < b").select("a", "b")


def merge_map(groups: DataFrame, chosen: DataFrame) -> DataFrame:
    """``old_id, new_id``: every member and its group's representative."""
    return groups.join(chosen, "comp").select(F.col("member_id").alias("old_id"), F.col("paper_id").alias("new_id"))
