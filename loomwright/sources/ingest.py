"""Ingest of nested JSON-lines records into columnar tables, and Parquet and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.columns import tail_id

_NODE = "struct<id:string,display_name:string>"
#: Fields read from a work record; what isn't named is never parsed.
WORK_SCHEMA = (
    "id string, doi string, title string, type string, publication_year int, publication_date string, updated_date string, "
    f"primary_topic struct<id:string,subfield:{_NODE},field:{_NODE}>, topics array<struct<id:string,score:double>>, "
    "authorships array<struct<author:struct<id:string>,institutions:array<struct<id:string,country_code:string>>>>, referenced_works array<string>, "
    "counts_by_year array<struct<year:int,cited_by_count:int>>, cited_by_count int, is_retracted boolean, is_paratext boolean, "
    "primary_location struct<source:struct<id:string,display_name:string,type:string>,landing_page_url:string,is_oa:boolean,version:string>, "
    "locations array<struct<landing_page_url:string,pdf_url:string,source:struct<id:string>>>, open_access struct<is_oa:boolean,oa_status:string>, "
    "concepts array<struct<id:string,score:double>>, keywords array<struct<id:string,score:double>>, mesh array<struct<descriptor_ui:string,is_major_topic:boolean>>, "
    "grants array<struct<funder:string,award_id:string>>, fwci double, language string, "
    "abstract_inverted_index map<string,array<int>>, _corrupt_record string"
)


def read_json_lines(spark: SparkSession, path: str, schema: str = WORK_SCHEMA) -> DataFrame:
    """Records of JSON-lines files, split by Spark; a line that can't be parsed is kept in ``_corrupt_record``."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def bad_lines(records: DataFrame) -> DataFrame:
    """One row ``n, n_bad``."""
    return records.select("id", "_corrupt_record").agg(F.count(F.lit(1)).alias("n"), F.count("_corrupt_record").alias("n_bad"))


def inverted_index_text(index: Column) -> Column:
    """The text of a word -> positions map, words ordered by position and joined by blanks; null for a null map."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


#: arXiv identifiers. Until March 2007 an archive, with or without a subject class, and seven digits (YYMM and a number of the
#: month); from April 2007 on YYMM, a dot, and a number of four digits, from 2015 on of five. A version may follow either.
ARXIV_OLD = r"[a-z]+(?:-[a-z]+)?(?:\.[A-Za-z]{2})?/\d{2}(?:0[1-9]|1[0-2])\d{3}"
ARXIV_NEW = r"\d{2}(?:0[1-9]|1[0-2])\.\d{4,5}"
ARXIV_ID = f"((?:{ARXIV_OLD})|(?:{ARXIV_NEW}))(?:v\\d+)?"


def arxiv_id(doi: Column, urls: Column) -> Column:
    """The arXiv id, without its version, in a DOI of arXiv's prefix, else in the first of the URLs that holds one; null if none does."""
    within = lambda text, before: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?i){before}{ARXIV_ID}(?![\w.]*\d)", 1), F.lit(""))
    found = F.filter(F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: within(u, r"arxiv\.org/[a-z]+/")), lambda x: x.isNotNull())
    return F.coalesce(within(doi, r"10\.48550/arxiv\."), F.get(found, F.lit(0)))


def work_tables(records: DataFrame, fields: list[int], first: int = 2016, last: int = 2024) -> tuple[DataFrame, DataFrame]:
    """``(lite, detail)`` of good records: narrow rows of all works, wide rows of the wanted fields and years.

    Two projections of one scan; ids are the numbers at the end of their URLs, null if there is none.
    """
    ids = lambda c: F.array_compact(F.transform(c, tail_id))
    none = F.array().cast("array<string>")
    good = records.filter(F.col("_corrupt_record").isNull())
    base = good.select(
        tail_id("id").alias("id"), F.col("publication_year").cast("smallint").alias("year"), "type", tail_id("primary_topic.id").cast("int").alias("pt_topic"),
        tail_id("primary_topic.subfield.id").cast("smallint").alias("pt_subfield"), tail_id("primary_topic.field.id").cast("smallint").alias("pt_field"),
        F.transform(ids(F.col("topics.id")), lambda x: x.cast("int")).alias("topic_ids"), F.col("topics.score").cast("array<float>").alias("topic_scores"),
        ids(F.col("referenced_works")).alias("refs"), F.array_distinct(ids(F.col("authorships.author.id"))).alias("author_ids"), tail_id("primary_location.source.id").alias("source_id"),
        F.col("counts_by_year.year").cast("array<smallint>").alias("cby_year"), F.col("counts_by_year.cited_by_count").alias("cby_count"), "cited_by_count", "is_retracted", "is_paratext",
        "doi", "title", "publication_date", "updated_date", arxiv_id(F.col("doi"), F.concat(F.coalesce("locations.landing_page_url", none), F.coalesce("locations.pdf_url", none))).alias("arxiv_id"),
        F.array_distinct(ids(F.flatten("authorships.institutions").getField("id"))).alias("institution_ids"), inverted_index_text(F.col("abstract_inverted_index")).alias("abstract"),
        F.array_distinct(F.array_compact(F.flatten("authorships.institutions").getField("country_code"))).alias("countries"), F.col("primary_location.source.display_name").alias("venue_name"),
        F.col("primary_location.source.type").alias("venue_type"), F.col("primary_location.version").alias("location_version"), F.size(F.coalesce("locations", F.array().cast("array<struct<landing_page_url:string,pdf_url:string,source:struct<id:string>>>"))).alias("n_locations"),
        F.col("open_access.is_oa").alias("is_oa"), F.col("open_access.oa_status").alias("oa_status"), ids(F.col("concepts.id")).alias("concept_ids"), F.col("concepts.score").cast("array<float>").alias("concept_scores"),
        F.col("keywords.id").alias("keywords"), F.col("mesh.descriptor_ui").alias("mesh_ids"), F.array_distinct(F.array_compact(F.transform("grants.funder", tail_id))).alias("funder_ids"), F.coalesce(F.size("grants"), F.lit(0)).alias("n_grants"), "fwci", "language",
    ).withColumn("n_refs", F.coalesce(F.size("refs"), F.lit(0)))
    narrow = "id year type pt_topic pt_subfield pt_field topic_ids topic_scores n_refs refs author_ids source_id cby_year cby_count cited_by_count is_retracted is_paratext".split()
    return base.select(*narrow), base.filter(F.col("pt_field").isin(fields) & F.col("year").between(first, last))


def yearly_rows(entities: DataFrame, key: str = "id", counts: str = "counts_by_year") -> DataFrame:
    """One row per entity and year of a nested yearly count."""
    return entities.select(tail_id(key).alias(key), F.inline(counts))


#: Fields read from an entity file: venues, and the levels of the subject tree.
SOURCE_SCHEMA = "id string, display_name string, type string, issn_l string, host_organization string, works_count bigint, cited_by_count bigint, is_oa boolean, counts_by_year array<struct<year:int,works_count:int,cited_by_count:int>>, _corrupt_record string"
SUBJECT_SCHEMA = f"id string, display_name string, works_count bigint, cited_by_count bigint, subfield {_NODE}, field {_NODE}, domain {_NODE}, _corrupt_record string"


def source_tables(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sources, source_years)`` of venue records: one row a venue, and one a venue and year. Records without an id are left out."""
    good = entities.filter("_corrupt_record is null and id is not null")
    flat = good.select(tail_id("id").alias("id"), F.col("display_name").alias("name"), "type", "issn_l", tail_id("host_organization").alias("publisher_id"), "works_count", "cited_by_count", "is_oa")
    return flat, yearly_rows(good)


def subject_table(entities: DataFrame) -> DataFrame:
    """One row per topic or higher subject with the ids of the levels above it, null where a level does not apply."""
    above = [tail_id(f"{k}.id").cast("int").alias(f"{k}_id") for k in ("subfield", "field", "domain")]
    return entities.filter("_corrupt_record is null and id is not null").select(tail_id("id").cast("int").alias("id"), F.col("display_name").alias("name"), *above, "works_count", "cited_by_count")


def write_parquet(df: DataFrame, path: str, *, rows: int = 100_000, sort: list[str] = (), mode: str = "error") -> None:
    """Zstandard Parquet files of at most ``rows`` rows, each partition sorted."""
    df = df.sortWithinPartitions(*sort) if sort else df
    df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv", mode: str = "error") -> None:
    """A result table as one CSV or JSON file, for results that are small by nature."""
    writer = df.coalesce(1).write.mode(mode)
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def embedding_text(title: Column, abstract: Column) -> Column:
    """Title [SEP] abstract; either alone if the other is empty; null if both are."""
    part = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.nullif(F.concat_ws(" [SEP] ", part(title), part(abstract)), F.lit(""))


def missing_ids(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet, for back-fills."""
    return wanted.join(present.select(key).distinct(), key, "left_anti")
