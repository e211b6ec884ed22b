"""Mixing sources to target weights by Poisson replication.

A source with target weight w and n documents gets the mean repetition rate
w * total / n. Each document's count is drawn by inverting the Poisson distribution at a
uniform number hashed from (seed, document id), so that a
rerun draws the same; the document is then exploded into as many copies, and all copies are
dealt into random global order by a hash of (seed, id, copy).

The distribution is worked out once for each source: its cumulative probabilities from the
first to the last count that a uniform number of 48 bits can reach, about 16 times the root
of the rate, from sums of logarithms, so that no rate under- or overflows. A document looks
its number up there.

Defined results: null sources are a source of their own; null ids draw as the text "null";
rows that repeat an id draw the same count; null, empty and very long texts are copied like
others; an empty table gives an empty result; a weight of 0 drops its source; sources
without a weight keep the share that the default rule gives them, and those with one divide
the rest in proportion to their weights. Every column of the input passes through; where one
is named copy or shuffle_key, the operator's own gets an underscore appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bind, cut, free_name

#: Tables of probabilities are broadcast up to this many numbers in all (8 bytes each); beyond it the join shuffles.
BROADCAST_NUMBERS = 2_000_000
#: Uniform numbers have 48 bits: none is beyond this distance from 0 or 1.
EDGE = 2.0**-49


def uniform(*parts: Column | str, seed: int) -> Column:
    """A number in (0, 1) from 48 bits of an MD5 of the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def poisson_tables(rates: DataFrame) -> DataFrame:
    """rates: __m_s, __m_rate. Adds __m_low (long), __m_cdf: P(X <= __m_low + i) where it differs from 0 and 1 by ``EDGE``, and __m_steps: powers of two to search it by.

    Rows: one for each source and count within 12 standard deviations and 30 of the rate.
    """
    rate = F.col("__m_rate")
    reach = 12 * F.sqrt(rate) + 30
    terms = rates.where(rate > 0).withColumn("__m_k", F.explode(F.sequence(F.greatest(F.floor(rate - reach), F.lit(0)).cast("long"), F.ceil(rate + reach).cast("long"))))
    own = W.partitionBy("__m_s").orderBy("__m_k")
    whole = W.partitionBy("__m_s")
    first = F.col("__m_k") == F.min("__m_k").over(whole)
    terms = terms.withColumn("__m_l", F.when(first, 0.0).otherwise(F.log(rate / F.col("__m_k"))))
    terms = terms.withColumn("__m_l", F.sum("__m_l").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
    terms = terms.withColumn("__m_p", F.exp(F.col("__m_l") - F.max("__m_l").over(whole)))
    terms = terms.withColumn("__m_c", F.sum("__m_p").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)) / F.sum("__m_p").over(whole))
    inside = F.col("__m_c").between(EDGE, 1 - EDGE)
    below = F.max(F.when(F.col("__m_c") < EDGE, F.col("__m_k") + 1))
    got = terms.groupBy("__m_s", "__m_rate").agg(
        F.coalesce(below, F.min("__m_k")).alias("__m_low"),
        F.array_sort(F.collect_list(F.when(inside, F.struct("__m_k", "__m_c")))).alias("__m_cdf"),
    )
    got = got.withColumn("__m_cdf", F.transform("__m_cdf", lambda x: x["__m_c"]))
    bits = F.ceil(F.log2(F.size("__m_cdf") + 1.0)).cast("int")
    return got.withColumn("__m_steps", F.transform(F.sequence(bits, F.lit(0)), lambda i: F.pow(F.lit(2), i).cast("int")))


def poisson(u: Column) -> Column:
    """The smallest k with P(X <= k) >= u, from a row of ``poisson_tables``, by halving."""
    step = lambda x: lambda at, s: F.when(F.coalesce(F.get("__m_cdf", at + s - 1) < x, F.lit(False)), at + s).otherwise(at)
    return F.col("__m_low") + bind(u, lambda x: F.aggregate("__m_steps", F.lit(0), step(x)))


def tempered_rates(docs: DataFrame, source: str, alpha: float, weights: dict[str | None, float] | None = None, total: float | None = None) -> DataFrame:
    """(__m_s, __m_rate), counted over all documents. Shares default to n ** alpha, normalised."""
    n = docs.groupBy(F.col(source).alias("__m_s")).agg(F.count("*").alias("n"))
    power = F.pow(F.col("n").cast("double"), F.lit(alpha))
    if weights:
        named = n.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "__m_k string, w double")
        n = n.join(F.broadcast(named), F.col("__m_s").cast("string").eqNullSafe(F.col("__m_k")), "left").drop("__m_k")
    else:
        n = n.withColumn("w", F.lit(None).cast("double"))
    n = n.withColumn("d", power)
    has = F.col("w").isNotNull()
    one = n.agg(F.sum("n").alias("sum_n"), F.sum("d").alias("sum_d"), F.sum(F.when(has, F.col("d"))).alias("named_d"), F.sum("w").alias("named_w"))
    w = F.when(~has, F.col("d")).when(F.col("named_w") > 0, F.col("w") / F.col("named_w") * F.col("named_d")).otherwise(0.0)
    kept = F.when(F.col("named_w") == 0, F.col("sum_d") - F.col("named_d")).otherwise(F.col("sum_d"))
    whole = F.lit(float(total)) if total is not None else F.col("sum_n")
    return n.crossJoin(F.broadcast(one)).select("__m_s", F.when(w > 0, w / kept * whole / F.col("n")).otherwise(0.0).alias("__m_rate"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", alpha: float = 0.5, weights: dict[str | None, float] | None = None, total: float | None = None, seed: int = 11) -> DataFrame:
    """Copies of ``docs`` in global random order, with copy (int) and shuffle_key (double) added."""
    tables = cut(poisson_tables(tempered_rates(docs, source, alpha, weights, total))).drop("__m_rate")
    numbers = tables.agg(F.sum(F.size("__m_cdf") + 8)).first()[0] or 0
    side = F.broadcast(tables) if numbers <= BROADCAST_NUMBERS else tables
    got = docs.join(side, docs[source].eqNullSafe(tables["__m_s"]))
    copy, key = free_name("copy", docs.columns), free_name("shuffle_key", docs.columns)
    got = got.withColumn("__m_n", poisson(uniform(doc_id, seed=seed)).cast("int")).where("__m_n > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("__m_n")))).drop("__m_s", "__m_low", "__m_cdf", "__m_steps", "__m_n")
    return got.withColumn(key, uniform(doc_id, copy, seed=seed + 1)).repartitionByRange(key).sortWithinPartitions(key)
