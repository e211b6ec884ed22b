"""Shared tables of the text engine: tokens, postings, lengths, and bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: What counts as small enough to broadcast, in rows, when a side's rows have been counted.
BROADCAST_ROWS = 200_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "library.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(d, f), os.path.relpath(os.path.join(d, f), os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Few rows with much work each, dealt out over all cores, several times their number."""
    return df.repartition(max(64, 4 * df.sparkSession.sparkContext.defaultParallelism), *by)


def listed(df: DataFrame, column: str, most: int = 10_000) -> list | None:
    """The distinct values of a column if there are at most ``most``, for a test inside an expression; else None."""
    got = df.select(column).distinct().limit(most + 1).collect()
    return [r[0] for r in got] if len(got) <= most else None


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the cluster's folder (a temporary one where none is set)."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def tokens(docs: DataFrame, key: str = "doc_id", column: str = "text", tokenize: Callable[[Column], Column] = text.words) -> DataFrame:
    """(key, pos from 0, token)."""
    return docs.select(key, F.posexplode(tokenize(F.col(column))).alias("pos", "token"))


def postings(docs: DataFrame, key: str = "doc_id", column: str = "text", tokenize: Callable[[Column], Column] = text.words) -> DataFrame:
    """(key, token, tf long). Counts are summed on the map side before the shuffle."""
    return docs.select(key, F.explode(tokenize(F.col(column))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str = "doc_id", column: str = "text", tokenize: Callable[[Column], Column] = text.words) -> DataFrame:
    """(key, len long), empty documents included; no shuffle."""
    return docs.select(key, F.size(tokenize(F.col(column))).cast("long").alias("len"))
