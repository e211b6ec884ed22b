"""Where queries and their SQL are gathered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: DuckDB: the tokens of documents, with places from 0.
TOK = "tok AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents))"
POST = TOK + ", post AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY doc_id, token), sizes AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))::BIGINT AS len FROM documents), n_all AS (SELECT count(*) AS n FROM documents)"


def _long(df: DataFrame) -> DataFrame:
    """Whole numbers leave as longs, whatever made them."""
    return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if kind == "int" else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf: _long(f(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
