"""Streaming: documents that arrive in files are deduplicated by content within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.dedup import shingle_sets


def document_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_copies(stream: DataFrame, time: str, delay: str = "1 hour", column: str = "text") -> DataFrame:
    """The first of texts with one normal form; state older than the watermark is dropped."""
    keyed = stream.withColumn("form", F.md5(text.normalise_exact(F.coalesce(F.col(column), F.lit("")))))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["form"])


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows of each key in tumbling windows; late rows beyond the watermark are left out."""
    got = stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return got.select(F.col("window.start").alias("start"), key, "n")


def stream_shingles(stream: DataFrame, key: str = "doc_id") -> DataFrame:
    """Shingle sets of arriving documents: stateless, so any sink will do."""
    return shingle_sets(stream, key)
