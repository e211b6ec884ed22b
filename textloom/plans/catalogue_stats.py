"""Queries of association, Zipf and Heaps statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import uniform, uniform_sql
from ..operators import statistics as st
from .catalogue_text import COUNTS
from .registry import TOK, query
from .tables import bounded, cut, lengths, read, tokens

LEAST = 5
BIGRAMS = f"""{TOK}, pr AS (SELECT token AS w1, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM tok),
nn AS (SELECT w1, w2, count(*) AS a FROM pr WHERE w2 IS NOT NULL GROUP BY w1, w2), lm AS (SELECT w1, sum(a)::BIGINT AS l FROM nn GROUP BY w1), rmg AS (SELECT w2, sum(a)::BIGINT AS r FROM nn GROUP BY w2), tt AS (SELECT sum(a)::BIGINT AS t FROM nn),
cg AS (SELECT w1, w2, a, l - a AS b, r - a AS c, t - l - r + a AS d FROM nn JOIN lm USING (w1) JOIN rmg USING (w2), tt WHERE a >= {LEAST}),
ce AS (SELECT *, (a + b)::DOUBLE * (a + c) / (a + b + c + d) AS e1, (a + b)::DOUBLE * (b + d) / (a + b + c + d) AS e2, (c + d)::DOUBLE * (a + c) / (a + b + c + d) AS e3, (c + d)::DOUBLE * (b + d) / (a + b + c + d) AS e4 FROM cg)"""
SCORES = {
    "pmi": "log2(a / e1)",
    "ppmi": "greatest(0, log2(a / e1))",
    "t": "(a - e1) / sqrt(a)",
    "llr": "2 * (CASE WHEN a > 0 THEN a * ln(a / e1) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / e2) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c / e3) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d / e4) ELSE 0 END)",
    "chi2": "CASE WHEN (a + b)::DOUBLE * (c + d) * (a + c) * (b + d) = 0 THEN 0 ELSE (a + b + c + d)::DOUBLE * (a::DOUBLE * d - b::DOUBLE * c) * (a::DOUBLE * d - b::DOUBLE * c) / ((a + b)::DOUBLE * (c + d) * (a + c) * (b + d)) END",
}


def _bigrams(spark, sf):
    return st.bigrams(read(spark, sf, "documents"), least=LEAST)


@query("bigram_contingency", f"WITH {BIGRAMS} SELECT * FROM cg")
def bigram_contingency(spark, sf):
    return _bigrams(spark, sf)


for _m, _s in SCORES.items():
    query(f"assoc_{_m}", f"WITH {BIGRAMS} SELECT w1, w2, round({_s}, 4) AS score FROM ce")(lambda spark, sf, m=_m: _bigrams(spark, sf).select("w1", "w2", F.round(st.association(m), 4).alias("score")))


@query("chi2_validity", f"WITH {BIGRAMS} SELECT count(*) AS n_pairs, count(*) FILTER (least(e1, e2, e3, e4) < 5) AS below_five FROM ce")
def chi2_validity(spark, sf):
    return _bigrams(spark, sf).agg(F.count("*").alias("n_pairs"), F.count_if(st.expected_below()).alias("below_five"))


@query("hapax_share", f"WITH {BIGRAMS} SELECT round(count(*) FILTER (a = 1) / count(*), 6) AS hapax_share, count(*) AS n_pairs FROM nn")
def hapax_share(spark, sf):
    n = st.bigrams(read(spark, sf, "documents"))
    return n.agg(F.round(F.count_if(F.col("a") == 1) / F.count("*"), 6).alias("hapax_share"), F.count("*").alias("n_pairs"))


_TOPS = " UNION ALL ".join(f"SELECT '{m}' AS measure, w1, w2 FROM (SELECT w1, w2, row_number() OVER (ORDER BY round({s}, 6) DESC, w1, w2) AS r FROM ce) WHERE r <= 20" for m, s in SCORES.items())


@query("assoc_overlap", f"WITH {BIGRAMS}, tp AS ({_TOPS}) SELECT x.measure AS first, y.measure AS second, round(count(*) / (40 - count(*)), 6) AS jaccard FROM tp x JOIN tp y ON x.w1 = y.w1 AND x.w2 = y.w2 AND x.measure < y.measure GROUP BY x.measure, y.measure")
def assoc_overlap(spark, sf):
    """Jaccard similarity of the top 20 pairs of each two measures."""
    n = cut(_bigrams(spark, sf))
    top = None
    for m in SCORES:
        one = n.select(F.lit(m).alias("measure"), "w1", "w2", F.round(st.association(m), 6).alias("s")).orderBy(F.col("s").desc(), "w1", "w2").limit(20).drop("s")
        top = one if top is None else top.unionByName(one)
    top = cut(top)
    other = top.withColumnRenamed("measure", "second")
    return top.withColumnRenamed("measure", "first").join(F.broadcast(other), ["w1", "w2"]).where("first < second").groupBy("first", "second").agg(F.round(F.count("*") / (40 - F.count("*")), 6).alias("jaccard"))


def _tokens_counts(spark, sf):
    return tokens(read(spark, sf, "documents")).groupBy("token").agg(F.count("*").alias("cnt"))


def _rounded(df):
    return df.select("estimator", F.round("a", 6).alias("a"), "n_used")


RF = f"{COUNTS}, rf AS (SELECT cnt::DOUBLE AS f, row_number() OVER (ORDER BY cnt DESC, token) AS rank FROM c)"


@query("zipf_ols", f"{RF} SELECT 'ols' AS estimator, round(-regr_slope(ln(f), ln(rank)), 6) AS a, count(*) AS n_used FROM rf")
def zipf_ols(spark, sf):
    return _rounded(st.zipf_ols(_tokens_counts(spark, sf)))


@query("zipf_head", f"{RF} SELECT 'head' AS estimator, round(-regr_slope(ln(f), ln(rank)), 6) AS a, count(*) AS n_used FROM rf WHERE rank <= 1000")
def zipf_head(spark, sf):
    return _rounded(st.zipf_ols(_tokens_counts(spark, sf), head=1000, name="head"))


@query("zipf_binned", f"{RF}, bn AS (SELECT avg(ln(rank)) AS x, avg(ln(f)) AS y FROM rf GROUP BY floor(log10(rank) * 10 + 1e-9)) SELECT 'binned' AS estimator, round(-regr_slope(y, x), 6) AS a, count(*) AS n_used FROM bn")
def zipf_binned(spark, sf):
    return _rounded(st.zipf_binned(_tokens_counts(spark, sf)))


@query("zipf_mle", f"{COUNTS}, g AS (SELECT 1 + count(*) / sum(ln(cnt / 0.5)) AS gamma, count(*) AS n_used FROM c) SELECT 'mle' AS estimator, round(1 / (gamma - 1), 6) AS a, n_used FROM g")
def zipf_mle(spark, sf):
    return st.mle_gamma(_tokens_counts(spark, sf)).select(F.lit("mle").alias("estimator"), F.round("a", 6).alias("a"), "n_used")


@query("zipf_split_half", f"WITH {TOK}, h AS (SELECT token, count(*) FILTER (u < 0.5) AS fa, count(*) FILTER (u >= 0.5) AS fb FROM (SELECT token, {uniform_sql(21, 'doc_id', 'pos')} AS u FROM tok) GROUP BY token), ra AS (SELECT fb, row_number() OVER (ORDER BY fa DESC, token) AS rank FROM h WHERE fa > 0) SELECT 'split half' AS estimator, round(-regr_slope(ln(fb), ln(rank)), 6) AS a, count(*) AS n_used FROM ra WHERE fb > 0")
def zipf_split_half(spark, sf):
    return _rounded(st.zipf_split_half(tokens(read(spark, sf, "documents")).select("token", uniform(21, "doc_id", "pos").alias("u"))))


@query("zipf_xmin")
def zipf_xmin(spark, sf):
    return st.x_min_scan(_tokens_counts(spark, sf)).orderBy("ks", "x_min").limit(1).select("x_min", F.round("gamma", 6).alias("gamma"), "n_tail", F.round("ks", 6).alias("ks"))


@query("zipf_goodness_of_fit")
def zipf_goodness_of_fit(spark, sf):
    return st.goodness_of_fit(cut(_tokens_counts(spark, sf)))


@query("hurwitz_zeta", "WITH p AS (SELECT s::DOUBLE AS s, q::DOUBLE AS q FROM unnest([1.5, 2.0, 3.0, 5.0]) x(s), unnest([1.0, 2.5, 10.0, 100.0]) y(q)) SELECT s, q, round((SELECT sum(pow(q + i, -s)) FROM range(0, 24) r(i)) + pow(q + 24, 1 - s) / (s - 1) + 0.5 * pow(q + 24, -s) + s / 12 * pow(q + 24, -s - 1) - s * (s + 1) * (s + 2) / 720 * pow(q + 24, -s - 3) + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) / 30240 * pow(q + 24, -s - 5), 9) AS zeta FROM p")
def hurwitz_zeta(spark, sf):
    p = spark.createDataFrame([(s, q) for s in (1.5, 2.0, 3.0, 5.0) for q in (1.0, 2.5, 10.0, 100.0)], "s double, q double")
    return p.select("s", "q", F.round(st.zeta(F.col("s"), F.col("q")), 9).alias("zeta"))


GLOBAL = f"{TOK}, gp AS (SELECT token, row_number() OVER (ORDER BY doc_id, pos) AS g FROM tok), fs AS (SELECT token, min(g) AS first FROM gp GROUP BY token), tn AS (SELECT count(*) AS n FROM tok)"
CURVE = f"{GLOBAL}, mk AS (SELECT DISTINCT greatest(1, round(exp(ln(n) * i / 59)))::BIGINT AS n FROM tn, range(0, 60) r(i)), cv AS (SELECT mk.n, count(*) AS types FROM mk JOIN fs ON fs.first <= mk.n GROUP BY mk.n)"


def _stream(spark, sf):
    docs = read(spark, sf, "documents")
    sizes = lengths(docs)
    return tokens(docs), st.running_offsets(sizes), sizes.agg(F.sum("len")).first()[0]


def _curve(spark, sf):
    tok, offsets, total = _stream(spark, sf)
    return st.heaps_curve(st.first_places(tok, offsets), total)


@query("heaps_curve", f"WITH {CURVE} SELECT n, types FROM cv")
def heaps_curve(spark, sf):
    return _curve(spark, sf)


@query("heaps_fit", f"WITH {CURVE} SELECT round(regr_slope(ln(types), ln(n)), 6) AS beta, round(exp(regr_intercept(ln(types), ln(n))), 6) AS k, round(regr_r2(ln(types), ln(n)), 6) AS r2 FROM cv")
def heaps_fit(spark, sf):
    return st.heaps_fit(_curve(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("beta", "k", "r2")])


@query("heaps_drift", f"WITH {CURVE}, ix AS (SELECT *, row_number() OVER (ORDER BY n) - 1 AS i FROM cv), wn AS (SELECT s AS start, regr_slope(ln(types), ln(n)) AS beta, count(*) AS m FROM ix, range(0, 60, 4) r(s) WHERE i >= s AND i < s + 12 GROUP BY s) SELECT start, round(beta, 6) AS beta FROM wn WHERE m = 12")
def heaps_drift(spark, sf):
    return st.heaps_drift(_curve(spark, sf)).select("start", F.round("beta", 6).alias("beta"))


SIZES = (1000, 2000, 5000, 10000, 20000)
HALVES = f"{GLOBAL}, hv AS (SELECT token, count(*) FILTER (g <= n // 2) AS a, count(*) FILTER (g > n // 2) AS b, min(g) AS first FROM gp, tn GROUP BY token), rk AS (SELECT *, CASE WHEN a > 0 THEN row_number() OVER (ORDER BY a DESC, first) END AS r FROM hv)"


def _halves(spark, sf):
    tok, offsets, total = _stream(spark, sf)
    at = tok.join(offsets, "doc_id").select("token", (F.col("before") + F.col("pos") + 1).alias("g"))
    half = total // 2
    return at.groupBy("token").agg(F.count_if(F.col("g") <= half).alias("a"), F.count_if(F.col("g") > half).alias("b"), F.min("g").alias("first"))


@query("oov_cost", f"WITH {HALVES} SELECT v::BIGINT AS vocabulary, round(sum(b) FILTER (r IS NULL OR r > v) / sum(b), 6) AS token_rate, round(count(*) FILTER (b > 0 AND (r IS NULL OR r > v)) / count(*) FILTER (b > 0), 6) AS type_rate, v > max(r) AS capped FROM rk, unnest([{', '.join(map(str, SIZES))}]) s(v) GROUP BY v")
def oov_cost(spark, sf):
    """Rates of unknown tokens and types in the second half for vocabularies of the first half's top words."""
    h = cut(_halves(spark, sf))
    top = h.where("a > 0").orderBy(F.col("a").desc(), "first").limit(max(SIZES))
    ranked = top.withColumn("r", F.row_number().over(W.orderBy(F.col("a").desc(), "first"))).select("token", "r")
    known = h.where("a > 0").count()
    x = h.join(bounded(ranked), "token", "left").withColumn("vocabulary", F.explode(F.array(*[F.lit(v) for v in SIZES])))
    out = F.col("r").isNull() | (F.col("r") > F.col("vocabulary"))
    got = x.groupBy("vocabulary").agg((F.sum(F.when(out, F.col("b")).otherwise(0)) / F.sum("b")).alias("t"), (F.count_if(out & (F.col("b") > 0)) / F.count_if(F.col("b") > 0)).alias("y"))
    return got.select("vocabulary", F.round("t", 6).alias("token_rate"), F.round("y", 6).alias("type_rate"), (F.col("vocabulary") > known).alias("capped"))


@query("oov_floor", f"WITH {HALVES} SELECT round(sum(b) FILTER (a = 0) / sum(b), 6) AS token_floor, round(count(*) FILTER (b > 0 AND a = 0) / count(*) FILTER (b > 0), 6) AS type_floor FROM rk")
def oov_floor(spark, sf):
    return _halves(spark, sf).agg(F.round(F.sum(F.when(F.col("a") == 0, F.col("b")).otherwise(0)) / F.sum("b"), 6).alias("token_floor"), F.round(F.count_if((F.col("b") > 0) & (F.col("a") == 0)) / F.count_if(F.col("b") > 0), 6).alias("type_floor"))
