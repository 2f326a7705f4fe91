"""Column helpers: null-safe arrays, text normalisation, dates, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_array(c: Column | str) -> Column:
    """The array without nulls; a null array is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.array_compact(c), F.array())


def shared(a: Column | str, b: Column | str) -> Column:
    """Number of distinct non-null elements in both arrays; 0 for null arrays."""
    return F.size(F.array_intersect(clean_array(a), clean_array(b)))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Whether two arrays share a non-null element; false for null arrays."""
    return F.coalesce(F.arrays_overlap(clean_array(a), clean_array(b)), F.lit(False))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two arrays as sets of non-null elements; 0 if both are empty."""
    union = F.size(F.array_union(clean_array(a), clean_array(b)))
    return shared(a, b) / F.greatest(union, F.lit(1))


def title_words(c: Column | str) -> Column:
    """Lower-case letters and digits of any script, words parted by single blanks; a null title is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def title_key(c: Column | str) -> Column:
    """The lower-case title without any character outside a-z and 0-9; a null title is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def full_date(c: Column | str) -> Column:
    """A date of the form YYYY-MM-DD that exists, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (c >= "0001"), c.try_cast("date"))


def log1p(c: Column | str) -> Column:
    return F.log1p(F.col(c) if isinstance(c, str) else c)


def log_growth(a: Column | str, b: Column | str) -> Column:
    """ln((a + 1) / (b + 1)), nulls as 0."""
    a, b = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for c in (a, b))
    return F.log((a + 1) / (b + 1))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays in double precision."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; null if one has length zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tail_id(c: Column | str) -> Column:
    """The number at the end of an id or URL, else null."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.nullif(F.regexp_extract(c, r"(?:^|/)[A-Za-z]?([0-9]+)$", 1), F.lit("")).try_cast("bigint")
