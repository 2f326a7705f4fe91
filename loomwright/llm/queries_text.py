"""Queries over texts (problems 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.abuse import THRESHOLD, score, train
from loomwright.llm.mixing import mix, mix_report, plan, uses
from loomwright.llm.queries import LLM
from loomwright.llm.tokens import decode_corpus, encode_corpus
from loomwright.session import materialise
from loomwright.sources.tables import table


@LLM.query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, d, "documents"))


@LLM.query("p8_roundtrip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return decode_corpus(encode_corpus(table(spark, d, "documents")))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return materialise(encode_corpus(docs, keep=["doc_id", "source"], ids=False, counts=True))


@LLM.query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Per source: what the mixture takes of it, and the shares and repeats really reached."""
    sized, targets = _sized(spark, d), table(spark, d, "mix_target")
    return mix_report(uses(sized, plan(sized, targets)), sized, targets)


@LLM.query("p9_schedule")
def p9_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document, in training order."""
    placed = mix(_sized(spark, d), table(spark, d, "mix_target"))
    return placed.select("doc_id", "source", "pass", "n_tokens", F.round("position", 9).alias("position"))


def _scored(spark: SparkSession, d: str, located: bool = False) -> DataFrame:
    docs = table(spark, d, "documents")
    return score(docs, train(docs, table(spark, d, "doc_label")), keep=["doc_id", "source"], located=located)


@LLM.query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    return _scored(spark, d).filter(F.col("score") >= THRESHOLD).select("doc_id")


@LLM.query("p10_scores")
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document's score and its offending sentences."""
    return _scored(spark, d, located=True).select("doc_id", F.round("score", 6).alias("score"), F.round("worst", 6).alias("worst"), "offending")


@LLM.query("p10_rates")
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of offending documents per source."""
    hit = F.col("score") >= THRESHOLD
    return _scored(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(hit, 1)).alias("n_offending"), F.round(F.avg(hit.cast("int")), 6).alias("rate"))
