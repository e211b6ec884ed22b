"""The training-data pipeline: quality rules, line dedup, near-dedup, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import lines, minhash, mixing, pieces, quality
from textloom.llm.common import durable, free_name, remove
from textloom.llm.queries import LINES_SQL, MEASURES_SQL, mix_sql, near_sql

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; null and empty texts are rejected, repeated rows judged one by one."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text. Copies of whole pages are left to the next stage.

    A null source is a source; null and empty texts stay as they are.
    """
    got = lines.strip_lines(docs, whole_copies=True)
    gone = F.col(free_name("n_removed", docs.columns))
    return got.withColumn("n_chars", F.when(gone > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Rows with a null id and texts without words stay, and so do repeated rows of a document that stays.
    """
    return minhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or go, so that sources reach their target weights; a null source is a source."""
    return mixing.mix_sources(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with digests of the ids and of the text decoded from them; a null text counts as empty."""
    got = pieces.encode_documents(docs.select("doc_id", "source", "text"), only=["doc_id", "source"])
    return got.select("doc_id", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("sentencepiece", encode)]

#: Encoding is no matter for SQL; see MIXED_SQL for all that comes before it.
ORACLE_SQL = None

#: DuckDB SQL for the rows after mix_sources.
MIXED_SQL = f"""
WITH RECURSIVE {MEASURES_SQL},
docs_in AS (SELECT d.* FROM documents d JOIN ruled USING (doc_id) WHERE kept),
{LINES_SQL},
{near_sql("stripped", 5, 80)},
firsts AS (SELECT s.* FROM stripped s JOIN near n USING (doc_id) WHERE doc_id = component_id),
{mix_sql("firsts")}
SELECT doc_id, text, lang, source, CASE WHEN n_removed > 0 THEN length(text) ELSE n_chars END AS n_chars FROM mixed
"""


def run(spark: SparkSession, sf_dir: str, stages=None) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the checkpoint folder and read again.

    A stage's rows are removed once the next stage's are written; the last one's stay, since the result reads them.
    """
    durable(spark)
    root = os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"pipeline-{uuid.uuid4().hex}")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES if stages is None else stages:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
