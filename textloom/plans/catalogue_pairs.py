"""Queries of duplicate detection and dense vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup
from ..operators import vectors as vec
from .registry import query
from .tables import cut, read

WS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]"
SETS = """ts AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
sh AS (SELECT doc_id, list_distinct(list_transform(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END, lambda g: ('0x' || substr(md5(g), 1, 8))::BIGINT % 2147483647)) AS s FROM ts)"""
SIGS = f"""{SETS}, cf AS (SELECT i, {dedup.coefficient_sql('a', 'i')} AS a, {dedup.coefficient_sql('b', 'i')} AS b FROM range(0, 128) r(i)),
sl AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh), mn AS (SELECT doc_id, n, i, min((x * a + b) % 2147483647) AS m FROM sl, cf GROUP BY doc_id, n, i)"""
PAIRS = f"""{SIGS}, bd AS (SELECT doc_id, i // 4 AS band, md5(string_agg(m::VARCHAR, ',' ORDER BY i)) AS bucket FROM mn GROUP BY doc_id, i // 4),
bk AS (SELECT band, bucket FROM bd GROUP BY band, bucket HAVING count(*) BETWEEN 2 AND 200), bj AS (SELECT bd.* FROM bd JOIN bk USING (band, bucket)),
cp AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bj x JOIN bj y ON x.band = y.band AND x.bucket = y.bucket AND x.doc_id < y.doc_id),
jc AS (SELECT a, b, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS j FROM cp JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b)"""
EXACT = f"ef AS (SELECT doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS f FROM documents), ep AS (SELECT x.doc_id AS a, y.doc_id AS b FROM ef x JOIN ef y ON x.f = y.f AND x.doc_id < y.doc_id)"


def _docs(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text")


def _sets(spark, sf):
    return cut(dedup.shingle_sets(_docs(spark, sf)))


def _sigs(sets):
    return cut(dedup.signatures(sets))


@query("exact_dup_pairs", f"WITH {EXACT} SELECT a, b FROM ep")
def exact_dup_pairs(spark, sf):
    return dedup.same_form(_docs(spark, sf), text.normalise_exact)


@query("structural_dup_pairs")
def structural_dup_pairs(spark, sf):
    return dedup.same_form(_docs(spark, sf), text.normalise_structural)


@query("minhash_signatures", f"WITH {SIGS} SELECT doc_id, any_value(n)::BIGINT AS n_shingles, md5(string_agg(m::VARCHAR, ',' ORDER BY i)) AS sig FROM mn GROUP BY doc_id")
def minhash_signatures(spark, sf):
    s = dedup.signatures(_sets(spark, sf))
    return s.where("n_shingles > 0").select("doc_id", "n_shingles", F.md5(F.concat_ws(",", F.transform("sig", lambda x: x.cast("string")))).alias("sig"))


@query("lsh_candidates", f"WITH {PAIRS} SELECT a, b FROM cp")
def lsh_candidates(spark, sf):
    return dedup.candidates(_sigs(_sets(spark, sf)))


@query("near_dups_verified", f"WITH {PAIRS} SELECT a, b, round(j, 6) AS jaccard FROM jc WHERE j >= 0.8")
def near_dups_verified(spark, sf):
    sets = _sets(spark, sf)
    return dedup.verified(dedup.candidates(_sigs(sets)), sets).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("dups_missed_by_hash", f"WITH {PAIRS}, {EXACT} SELECT jc.a, jc.b, x.toxic IS DISTINCT FROM y.toxic OR x.quality IS DISTINCT FROM y.quality AS conflict FROM jc LEFT JOIN labels x ON x.doc_id = jc.a LEFT JOIN labels y ON y.doc_id = jc.b WHERE j >= 0.8 AND NOT EXISTS (SELECT 1 FROM ep WHERE ep.a = jc.a AND ep.b = jc.b)")
def dups_missed_by_hash(spark, sf):
    sets = _sets(spark, sf)
    near = dedup.verified(dedup.candidates(_sigs(sets)), sets).join(dedup.same_form(_docs(spark, sf), text.normalise_exact), ["a", "b"], "left_anti")
    lab = read(spark, sf, "labels")
    side = lambda c: lab.select(F.col("doc_id").alias(c), F.struct("toxic", "quality").alias(f"l{c}"))
    return near.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", (~F.col("la.toxic").eqNullSafe(F.col("lb.toxic")) | ~F.col("la.quality").eqNullSafe(F.col("lb.quality"))).alias("conflict"))


@query("minhash_mae", f"WITH {PAIRS}, dn AS (SELECT a, b, j FROM jc WHERE j >= 0.8), eq AS (SELECT a, b, any_value(j) AS j, avg((x.m = y.m)::INT) AS e FROM dn JOIN mn x ON x.doc_id = a JOIN mn y ON y.doc_id = b AND y.i = x.i GROUP BY a, b) SELECT count(*) AS n_pairs, round(avg(abs(e - j)), 6) AS mae, round(1 / sqrt(128), 6) AS theory FROM eq")
def minhash_mae(spark, sf):
    """How far signatures' agreement lies from the exact similarity, over the verified pairs."""
    sets = _sets(spark, sf)
    sigs = _sigs(sets)
    near = dedup.verified(dedup.candidates(sigs), sets)
    side = lambda c: sigs.select(F.col("doc_id").alias(c), F.col("sig").alias(f"s{c}"))
    err = F.abs(dedup.agreement(F.col("sa"), F.col("sb")) - F.col("jaccard"))
    return near.join(side("a"), "a").join(side("b"), "b").agg(F.count("*").alias("n_pairs"), F.round(F.avg(err), 6).alias("mae"), F.round(F.lit(1) / F.sqrt(F.lit(128)), 6).alias("theory"))


UNIT = "ev AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-10)) AS v FROM embeddings)"
NEAREST = f"{UNIT}, cs AS (SELECT q.vec_id AS qid, d.vec_id, round(list_dot_product(q.v, d.v), 9) AS score FROM ev q JOIN ev d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0), cr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM cs)"


#: Every row asks, for what is counted over rows.
EACH = NEAREST.replace(" WHERE q.vec_id % 20 = 0", "")


def _near(spark, sf, k):
    e = read(spark, sf, "embeddings")
    return vec.cosine_topk(e.where("vec_id % 20 = 0"), e, k)  # the stated query set, against all rows


def _nearest(spark, sf, k, dims=None):
    """The k nearest of every row, by the whole vector or by its first numbers."""
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding") if dims is None else F.slice("embedding", 1, dims).alias("embedding"))
    return vec.cosine_topk(e, e, k)


@query("cosine_topk", f"WITH {NEAREST} SELECT qid, rank, vec_id, round(score, 6) AS score FROM cr WHERE rank <= 10")
def cosine_topk(spark, sf):
    return _near(spark, sf, 10).select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


KS = (1, 2, 3, 5, 11)
VOTES = f"{NEAREST}, vt AS (SELECT k, qid, label, count(*) AS votes, min(rank) AS first FROM cr JOIN embeddings USING (vec_id), unnest([{', '.join(map(str, KS))}]) r(k) WHERE rank <= k GROUP BY k, qid, label), tr AS (SELECT vec_id AS qid, label AS truth FROM embeddings)"


def _votes(spark, sf, near):
    e = read(spark, sf, "embeddings")
    return vec.knn_votes(near(spark, sf, max(KS)), e.select("vec_id", "label"), list(KS)), e.select(F.col("vec_id").alias("qid"), F.col("label").alias("truth"))


@query("knn_vote", f"WITH {VOTES.replace(NEAREST, EACH)}, pn AS (SELECT 'nearest' AS rule, k, qid, label FROM vt QUALIFY row_number() OVER (PARTITION BY k, qid ORDER BY votes DESC, first) = 1 UNION ALL SELECT 'oracle', k, qid, label FROM vt JOIN tr USING (qid) QUALIFY row_number() OVER (PARTITION BY k, qid ORDER BY votes DESC, CASE WHEN label = truth THEN 0 ELSE first END) = 1) SELECT rule, k::BIGINT AS k, round(avg((label = truth)::INT), 6) AS accuracy FROM pn JOIN tr USING (qid) GROUP BY rule, k")
def knn_vote(spark, sf):
    """Accuracy of the neighbours' votes over all rows, each judged by all others."""
    votes, truth = _votes(spark, sf, _nearest)
    votes = cut(votes)
    one = lambda r: vec.knn_predict(votes, truth, r).select(F.lit(r).alias("rule"), "*")
    return one("nearest").unionByName(one("oracle")).join(truth, "qid").groupBy("rule", "k").agg(F.round(F.avg((F.col("predicted") == F.col("truth")).cast("double")), 6).alias("accuracy"))


@query("knn_tie_rate", f"WITH {VOTES}, mx AS (SELECT k, qid, count(*) FILTER (votes = m) AS tied FROM (SELECT *, max(votes) OVER (PARTITION BY k, qid) AS m FROM vt) GROUP BY k, qid) SELECT k::BIGINT AS k, round(avg((tied > 1)::INT), 6) AS tie_rate FROM mx GROUP BY k")
def knn_tie_rate(spark, sf):
    votes, _ = _votes(spark, sf, _near)
    top = votes.groupBy("k", "qid").agg(F.max("votes").alias("m"), F.collect_list("votes").alias("all"))
    return top.groupBy("k").agg(F.round(F.avg((F.size(F.filter("all", lambda v: v == F.col("m"))) > 1).cast("double")), 6).alias("tie_rate"))


@query("neighbour_agreement", f"WITH {EACH}, half AS (SELECT q.vec_id AS qid, d.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.h, d.h), 9) DESC, d.vec_id) AS rank FROM (SELECT vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-10)) AS h FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS e FROM embeddings)) q JOIN (SELECT vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-10)) AS h FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS e FROM embeddings)) d ON q.vec_id <> d.vec_id), a AS (SELECT qid, list(vec_id) AS x FROM cr WHERE rank <= 10 GROUP BY qid), b AS (SELECT qid, list(vec_id) AS y FROM half WHERE rank <= 10 GROUP BY qid), jj AS (SELECT len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS j FROM a JOIN b USING (qid)) SELECT round(avg(j), 6) AS mean, round(quantile_cont(j, 0.5), 6) AS median, round(avg((j = 0)::INT), 6) AS share_zero FROM jj")
def neighbour_agreement(spark, sf):
    """How alike the ten nearest neighbours are under the whole vector and under its first half, over all rows."""
    a = _nearest(spark, sf, 10).groupBy("qid").agg(F.collect_list("vec_id").alias("x"))
    b = _nearest(spark, sf, 10, 32).groupBy("qid").agg(F.collect_list("vec_id").alias("y"))
    j = a.join(b, "qid").select((F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("j"))
    return j.agg(F.round(F.avg("j"), 6).alias("mean"), F.round(F.percentile("j", F.lit(0.5)), 6).alias("median"), F.round(F.avg((F.col("j") == 0).cast("double")), 6).alias("share_zero"))


def _pool_sql(agg):
    return f"SELECT label::BIGINT AS label, dim::BIGINT AS dim, round({agg}, 6) AS value FROM (SELECT vec_id, label, 1.0 + vec_id % 7 AS w, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label, dim"


for _n, _a in {"first": "min_by(x, vec_id)", "mean": "avg(x)", "max": "max(x)", "last": "max_by(x, vec_id)", "idf_mean": "sum(x * w) / sum(w)"}.items():
    query(f"pool_{_n}", _pool_sql(_a))(lambda spark, sf, n=_n: vec.pooled(read(spark, sf, "embeddings").withColumn("w", F.lit(1.0) + F.col("vec_id") % 7), n, "label", "vec_id", "embedding", "w" if n == "idf_mean" else None).select("label", "dim", F.round("value", 6).alias("value")))


@query("majority_baseline", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT (arg_max(label, n * 1000000 - label))::BIGINT AS label, round(max(n) / sum(n), 6) AS accuracy FROM n")
def majority_baseline(spark, sf):
    from ..operators.metrics import majority

    return majority(read(spark, sf, "embeddings"), "label").select("label", F.round("accuracy", 6).alias("accuracy"))


@query("kmeans_ari")
def kmeans_ari(spark, sf):
    e = read(spark, sf, "embeddings")
    got = None
    for k in (2, 8):
        for spherical in (True, False):
            c = cut(vec.kmeans(e, k, spherical=spherical).join(e.select("vec_id", "label"), "vec_id"))
            row = vec.adjusted_rand(c, "cluster", "label").crossJoin(vec.purity(c, "cluster", "label")).select(F.lit(k).alias("k"), F.lit("cosine" if spherical else "euclidean").alias("distance"), "ari", "purity")
            got = row if got is None else got.unionByName(row)
    return got


@query("label_ari", "WITH x AS (SELECT label AS a, vec_id % 4 AS b FROM embeddings), n AS (SELECT a, b, count(*) AS n FROM x GROUP BY a, b), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM n), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM n GROUP BY a)), c AS (SELECT sum(n * (n - 1) / 2) AS c FROM (SELECT sum(n) AS n FROM n GROUP BY b)) SELECT round((s - r * c / (t * (t - 1) / 2)) / ((r + c) / 2 - r * c / (t * (t - 1) / 2)), 6) AS ari FROM s, r, c")
def label_ari(spark, sf):
    x = read(spark, sf, "embeddings").select("label", (F.col("vec_id") % 4).alias("b"))
    return vec.adjusted_rand(x, "label", "b").select(F.round("ari", 6).alias("ari"))


@query("purity", "WITH n AS (SELECT vec_id % 4 AS c, label, count(*) AS n FROM embeddings GROUP BY 1, 2), m AS (SELECT c, max(n) AS m, sum(n) AS s FROM n GROUP BY c) SELECT round(sum(m) / sum(s), 6) AS purity FROM m")
def purity(spark, sf):
    return vec.purity(read(spark, sf, "embeddings").select("label", (F.col("vec_id") % 4).alias("c")), "c", "label").select(F.round("purity", 6).alias("purity"))


@query("silhouette", f"WITH {UNIT}, d AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(1 - list_dot_product(a.v, b.v)) AS dist FROM ev a JOIN ev b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label), p AS (SELECT vec_id, min(dist) FILTER (own <> other) AS b, min(dist) FILTER (own = other) AS a FROM d GROUP BY vec_id) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM p")
def silhouette(spark, sf):
    return vec.silhouette(read(spark, sf, "embeddings"), "label").select(F.round("silhouette", 6).alias("silhouette"))
