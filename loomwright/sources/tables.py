"""Readers of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings work_detail merge_edge citation "
    "paper_ref pred_sample topic_year paper_vector venue_log author_log ref_work deleted_work mix_target doc_label"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``sf_dir``, a file or a directory of Parquet parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views of the tables for ``spark.sql``."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
