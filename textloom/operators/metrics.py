"""Evaluation of ranked lists and predictions, and paired resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..plans.tables import bounded, listed, spread


def containing(docs: DataFrame, passages: DataFrame, qid: str = "item_id") -> DataFrame:
    """(qid, doc_id) of documents that contain a passage's text: the gold pairs of a passage search.

    A document that contains a passage contains its first three words in a row; those are
    joined by equality, and the candidates are tested by the whole text.
    """
    opening = lambda c: F.array_join(F.slice(F.split(c, " "), 2, 3), " ")
    p = passages.where(F.size(F.split("text", " ")) >= 5).select(F.col(qid).alias("qid"), F.col("text").alias("passage"), opening(F.col("text")).alias("k"), F.get(F.split("text", " "), F.lit(1)).alias("head"))
    # the words are a column of their own, or each step of the transform would split the text again
    d = docs.where("text is not null").select("doc_id", "text", F.split("text", " ").alias("w"))
    run = lambda i: F.array_join(F.slice("w", i, 3), " ")
    places = F.when(F.size("w") >= 3, F.sequence(F.lit(1), F.size("w") - 2))
    heads, keys = listed(p, "head"), listed(p, "k")
    if heads is not None and keys is not None:  # only places where a passage may open become rows
        at = F.filter(places, lambda i: F.get("w", i - 1).isin(heads))
        found = F.array_distinct(F.filter(F.transform(at, run), lambda k: k.isin(keys)))
        both = d.select("doc_id", "text", F.explode(found).alias("k")).join(bounded(p), "k")
    else:  # ids alone are joined, then texts are fetched
        pairs = d.select("doc_id", F.explode(F.array_distinct(F.transform(places, run))).alias("k")).join(p.select("qid", "k"), "k").select("doc_id", "qid").distinct()
        both = pairs.join(d.select("doc_id", "text"), "doc_id").join(p.select("qid", "passage"), "qid")
    long = both.where(F.contains("text", "passage")).select("qid", "doc_id")
    short = passages.where(F.size(F.split("text", " ")) < 5).select(F.col(qid).alias("qid"), F.col("text").alias("passage"))
    few = docs.where("text is not null").select("doc_id", "text").join(bounded(short), F.contains("text", "passage")).select("qid", "doc_id")
    return long.unionByName(few).distinct()


def recall_mrr(ranking: DataFrame, gold: DataFrame, cutoffs: list[int], depth: int = 100, by: list[str] | None = None) -> DataFrame:
    """(k, recall, mrr, n_queries): means over queries that have gold; a query without hits counts 0."""
    by = by or []
    total = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    hits = ranking.join(gold, ["qid", "doc_id"], "left_semi").groupBy(*by, "qid").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in cutoffs], F.min(F.when(F.col("rank") <= depth, F.col("rank"))).alias("first"))
    groups = ranking.select(*by).distinct() if by else None
    base = total if groups is None else groups.crossJoin(F.broadcast(total))
    per = base.join(hits, [*by, "qid"], "left")
    got = per.groupBy(*by).agg(*[F.avg(F.coalesce(F.col(f"h{k}") / F.col("n_gold"), F.lit(0.0))).alias(f"r{k}") for k in cutoffs], F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n_queries"))
    return got.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in cutoffs])).alias("x"), "mrr", "n_queries").select(*by, "x.k", "x.recall", "mrr", "n_queries")


def per_query_recall(ranking: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(qid, recall) for every query with gold."""
    hits = ranking.where(F.col("rank") <= k).join(gold, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("h"))
    return gold.groupBy("qid").agg(F.count("*").alias("n")).join(hits, "qid", "left").select("qid", F.coalesce(F.col("h") / F.col("n"), F.lit(0.0)).alias("recall"))


def paired_bootstrap(diffs: DataFrame, resamples: int = 2000, seed: int = 5) -> DataFrame:
    """diffs: (qid, d). One row: mean, lo, hi (95 %), p, significant. Queries are drawn with replacement, by hash."""
    spark = diffs.sparkSession
    n = diffs.count()
    if not n:
        raise ValueError("no pairs to resample")
    numbered = diffs.withColumn("i", F.row_number().over(W.orderBy("qid")) - 1)  # one row a query of an evaluation
    draws = spark.range(resamples).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    draws = draws.withColumn("i", F.floor(uniform(seed, "b", "j") * n).cast("int"))
    means = draws.join(bounded(numbered.select("i", "d")), "i").groupBy("b").agg(F.avg("d").alias("m"))
    got = means.agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), F.avg((F.col("m") <= 0).cast("double")).alias("below"), F.avg((F.col("m") >= 0).cast("double")).alias("above"))
    mean = diffs.agg(F.avg("d").alias("mean"))
    return got.crossJoin(mean).select("mean", "lo", "hi", F.least(F.lit(1.0), 2 * F.least("below", "above")).alias("p"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))


def poisson_sums(per: DataFrame, key: str, columns: list[str], resamples: int, seed: int) -> DataFrame:
    """(b from 1, columns...): sums of the columns over resamples that weigh each key by a Poisson count (of mean 1, from a hash of 32 bits), so that rows need no numbering.

    A task adds up its rows' weights times their values; no row is made for a key and a resample.
    """
    import math

    below = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13)]

    def run(batches):
        from hashlib import md5

        import numpy as np
        import pyarrow as pa

        heads = [f"{seed}:{b}:".encode() for b in range(1, resamples + 1)]
        total, rows = np.zeros((resamples, len(columns))), 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            x = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False).astype("f8") for i in range(len(columns))])
            for a in range(0, len(keys), 256):
                drawn = b"".join([md5(h + k).digest()[:4] for k in (k.encode() for k in keys[a : a + 256]) for h in heads])
                u = np.frombuffer(drawn, ">u4").astype("f8").reshape(-1, resamples) / 4294967296.0
                total += np.searchsorted(below, u, side="right").T @ x[a : a + 256]
            rows += len(keys)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(1, resamples + 1), pa.int32()), *[pa.array(total[:, i]) for i in range(len(columns))]], names=["b", *columns])

    rows = spread(per.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), *columns), "k")
    sums = rows.mapInArrow(run, ", ".join(["b int", *(f"`{c}` double" for c in columns)]))
    return sums.groupBy("b").agg(*[F.sum(c).alias(c) for c in columns])


def majority(labels: DataFrame, label: str) -> DataFrame:
    """(label, accuracy) of always answering the most frequent label (ties: the smallest)."""
    n = labels.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return n.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), (F.max("n") / F.sum("n")).alias("accuracy"))
