"""Streaming forms: a table's files as a stream, incremental yearly panels and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def yearly_stream(works: DataFrame, key: str = "id", years: str = "cby_year", counts: str = "cby_count") -> DataFrame:
    """The yearly panel as a running aggregate over a stream of works."""
    flat = works.select(F.col(key), F.inline(F.arrays_zip(F.col(years).alias("year"), F.col(counts).alias("n"))))
    return flat.dropna(subset=["year", "n"]).groupBy(key, "year").agg(F.sum("n").alias("cites"))


def windowed_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and kind; events later than ``late`` behind the newest are dropped, windows are emitted once."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, write Parquet with exactly-once files, and stop; a second run resumes from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
