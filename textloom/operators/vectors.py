"""Dense vectors: norms, cosine search, pooling, nearest-neighbour votes, k-means and its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import bounded, cut
from .blocks import top_dots

POOLINGS = ("first", "mean", "max", "last", "idf_mean")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def unit(df: DataFrame, column: str, out: str) -> DataFrame:
    """The vector over its length; a zero vector stays. The length is a column before the division refers to it."""
    got = df.withColumn("__norm", F.greatest(norm(F.col(column)), F.lit(1e-10)))
    return got.withColumn(out, F.transform(column, lambda x: x.cast("double") / F.col("__norm"))).drop("__norm")


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, rank, key, score): the k nearest items of each query, itself excluded.

    Blocks of queries meet blocks of items as matrix products; no more than k rows of a task travel for a query.
    """
    q = queries.select(F.col(key).alias("qid"), F.col(vector).alias("qv"))
    scores = top_dots(q, items, k, "qid", key, "qv", vector, apart=True, unit=True).withColumn("score", F.round("score", 9))
    w = W.partitionBy("qid").orderBy(F.col("score").desc(), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", key, "score")


def pooled(df: DataFrame, name: str, by: str, order: str, vector: str, weight: str | None = None) -> DataFrame:
    """One vector a group of vectors in an order: (by, dim, value) by the named pooling."""
    if name not in POOLINGS:
        raise ValueError(f"unknown pooling {name!r}; one of {POOLINGS}")
    rows = df.select(by, order, *([weight] if weight else []), F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    agg = {"first": F.min_by("x", order), "last": F.max_by("x", order), "max": F.max("x"), "mean": F.avg("x"), "idf_mean": F.sum(F.col("x") * F.col(weight)) / F.sum(weight) if weight else F.avg("x")}[name]
    return rows.groupBy(by, "dim").agg(agg.alias("value"))


def knn_votes(near: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """near: (qid, rank, vec_id); labels: (vec_id, label). (k, qid, label, votes, first): votes and the best rank of each label."""
    rows = near.join(labels, "vec_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    return rows.groupBy("k", "qid", "label").agg(F.count("*").alias("votes"), F.min("rank").alias("first"))


def knn_predict(votes: DataFrame, truth: DataFrame, rule: str) -> DataFrame:
    """(k, qid, predicted). Ties go by ``nearest`` (best rank), ``oracle`` (the truth if it ties), or ``random`` (by hash)."""
    if rule not in ("nearest", "oracle", "random"):
        raise ValueError(f"unknown tie rule {rule!r}")
    x = votes.join(bounded(truth), "qid") if rule == "oracle" else votes
    tie = {"nearest": lambda: F.col("first"), "oracle": lambda: F.when(F.col("label") == F.col("truth"), 0).otherwise(F.col("first")), "random": lambda: F.xxhash64("qid", "label")}[rule]()
    w = W.partitionBy("k", "qid").orderBy(F.col("votes").desc(), tie)
    return x.withColumn("r", F.row_number().over(w)).where("r = 1").select("k", "qid", F.col("label").alias("predicted"))


def kmeans(items: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", spherical: bool = True, seed: int = 1, rounds: int = 30) -> DataFrame:
    """(key, cluster) by Lloyd's algorithm with scalable seeding; cosine for ``spherical``, else Euclidean."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = (unit(items, vector, "v") if spherical else items.withColumn("v", F.col(vector))).select(key, array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine" if spherical else "euclidean").fit(data)
    return model.transform(data).select(key, F.col("prediction").alias("cluster"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari) of two labelings."""
    two = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    n = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    cells = n.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("t"))
    rows = n.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("r"))
    cols = n.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("c"))
    x = cells.crossJoin(rows).crossJoin(cols).withColumn("e", F.col("r") * F.col("c") / F.nullif(two("t"), F.lit(0.0))).withColumn("m", (F.col("r") + F.col("c")) / 2)
    return x.select(F.when(F.coalesce(F.col("m") == F.col("e"), F.lit(True)), 0.0).otherwise((F.col("s") - F.col("e")) / F.nullif(F.col("m") - F.col("e"), F.lit(0.0))).alias("ari"))


def purity(pairs: DataFrame, cluster: str, truth: str) -> DataFrame:
    n = pairs.groupBy(cluster, truth).agg(F.count("*").alias("n"))
    return n.groupBy(cluster).agg(F.max("n").alias("m"), F.sum("n").alias("s")).agg((F.sum("m") / F.sum("s")).alias("purity"))


def silhouette(items: DataFrame, cluster: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row (silhouette): mean over rows of (b - a) / max(a, b) by cosine distance.

    A row's mean cosine distance to a cluster is one minus its product with the cluster's sum
    of unit vectors over its size, so clusters' sums are all that rows are joined with: no pairs.
    """
    u = cut(unit(items, vector, "u").select(key, cluster, "u"))
    dims = u.select(cluster, F.posexplode("u").alias("dim", "x")).groupBy(cluster, "dim").agg(F.sum("x").alias("x"))
    sums = dims.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("total"))
    sums = sums.join(u.groupBy(cluster).agg(F.count("*").alias("n")), cluster).select(F.col(cluster).alias("other"), "total", "n")
    d = u.crossJoin(bounded(sums, 100_000)).withColumn("own", F.col("other") == F.col(cluster))  # clusters, not rows, are crossed
    d = d.withColumn("p", dot(F.col("u"), F.col("total")))
    dist = F.when(F.col("own"), F.when(F.col("n") > 1, 1 - (F.col("p") - 1) / (F.col("n") - 1))).otherwise(1 - F.col("p") / F.col("n"))
    per = d.withColumn("dist", dist).groupBy(key).agg(F.min(F.when(~F.col("own"), F.col("dist"))).alias("b"), F.min(F.when(F.col("own"), F.col("dist"))).alias("a"))
    return per.agg(F.avg(F.when(F.col("b").isNull(), float("nan")).otherwise(F.when(F.col("a").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))).alias("silhouette"))
