"""Queries of ranked retrieval and its evaluation: benchmark passages against documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import uniform, uniform_sql
from ..operators import metrics, search
from .registry import POST, query
from .tables import bounded, cut, read


def _tables(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "benchmark").select("item_id", "text")


def _gold(docs, items):
    return cut(metrics.containing(docs, items))


QTOK = "q AS (SELECT item_id AS qid, token, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY item_id, token)"
BM25 = f"""{POST}, {QTOK},
df AS (SELECT token, count(*) AS df FROM post GROUP BY token), mean AS (SELECT avg(len) AS m FROM sizes),
parts AS (SELECT p.doc_id, p.token, p.tf, s.len, greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m)) AS part
  FROM post p JOIN df USING (token) JOIN sizes s ON p.doc_id = s.doc_id, n_all, mean WHERE p.token IN (SELECT token FROM q)),
bm AS (SELECT qid, doc_id, sum(qtf * part) AS score FROM parts JOIN q USING (token) GROUP BY qid, doc_id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)"""
TFIDF = f"""{POST}, {QTOK},
idf AS (SELECT token, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM post, n_all GROUP BY token),
x AS (SELECT doc_id, token, tf * idf AS x FROM post JOIN idf USING (token)), norm AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM x GROUP BY doc_id),
y AS (SELECT qid, token, qtf * idf AS y FROM q JOIN idf USING (token)), qnorm AS (SELECT qid, sqrt(sum(y * y)) AS qnorm FROM y GROUP BY qid),
ti AS (SELECT y.qid, x.doc_id, sum(x * y) / any_value(norm) / any_value(qnorm) AS score FROM x JOIN y USING (token) JOIN norm ON norm.doc_id = x.doc_id JOIN qnorm ON qnorm.qid = y.qid GROUP BY y.qid, x.doc_id),
tir AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ti)"""
GOLD = "gold AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _topk(ranked):
    return ranked.select(F.col("qid").alias("item_id"), "rank", "doc_id", F.round("score", 6).alias("score"))


@query("bm25_topk", f"WITH {BM25} SELECT qid AS item_id, rank, doc_id, round(score, 6) AS score FROM bmr WHERE rank <= 10")
def bm25_topk(spark, sf):
    return _topk(search.ranked(search.bm25_best(*_tables(spark, sf), 10), 10))


@query("tfidf_topk", f"WITH {TFIDF} SELECT qid AS item_id, rank, doc_id, round(score, 6) AS score FROM tir WHERE rank <= 10")
def tfidf_topk(spark, sf):
    return _topk(search.ranked(search.tfidf_best(*_tables(spark, sf), 10), 10))


@query("bm25_terms", f"WITH {POST} SELECT token, count(*) AS df, round(greatest(0, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1)), 6) AS idf FROM post, n_all GROUP BY token")
def bm25_terms(spark, sf):
    from .tables import lengths, postings

    docs, _ = _tables(spark, sf)
    post = postings(docs)
    return post.groupBy("token").agg(F.count("*").alias("df")).join(search.bm25_terms(post, lengths(docs)), "token").select("token", "df", F.round("idf", 6).alias("idf"))


@query("gold_coverage", f"WITH {GOLD}, c AS (SELECT qid, count(*) AS n FROM gold GROUP BY qid) SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM benchmark) AS n_queries, (SELECT count(*) FROM gold) AS n_gold, min(n) AS least_gold, max(n) AS most_gold, (SELECT count(*) FROM benchmark WHERE item_id NOT IN (SELECT qid FROM c)) AS without_gold FROM c")
def gold_coverage(spark, sf):
    docs, items = _tables(spark, sf)
    per = _gold(docs, items).groupBy("qid").agg(F.count("*").alias("n"))
    missing = items.join(per, items["item_id"] == per["qid"], "left_anti").agg(F.count("*").alias("without_gold"))
    got = per.agg(F.sum("n").alias("n_gold"), F.min("n").alias("least_gold"), F.max("n").alias("most_gold"))
    return docs.agg(F.count("*").alias("n_docs")).crossJoin(items.agg(F.count("*").alias("n_queries"))).crossJoin(got).crossJoin(missing)


def _recall_sql(rank, ks=(1, 5, 10, 20)):
    rows = " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, avg(coalesce(h{k} / n_gold, 0)) AS recall, avg(coalesce(1.0 / first, 0)) AS mrr, count(*) AS n_queries FROM per" for k in ks)
    hits = ", ".join(f"count(*) FILTER (rank <= {k})::DOUBLE AS h{k}" for k in ks)
    return f"tot AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid), hit AS (SELECT r.qid, {hits}, min(rank) FILTER (rank <= 100) AS first FROM {rank} r JOIN gold g ON r.qid = g.qid AND r.doc_id = g.doc_id GROUP BY r.qid), per AS (SELECT tot.*, hit.* EXCLUDE (qid) FROM tot LEFT JOIN hit USING (qid)), rm AS ({rows}) SELECT k, round(recall, 6) AS recall, round(mrr, 6) AS mrr, n_queries FROM rm"


@query("recall_mrr", f"WITH {BM25}, {GOLD}, {_recall_sql('bmr')}")
def recall_mrr(spark, sf):
    docs, items = _tables(spark, sf)
    got = metrics.recall_mrr(search.ranked(search.bm25_best(docs, items, 100), 100), _gold(docs, items), [1, 5, 10, 20])
    return got.select("k", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "n_queries")


@query("recall_mrr_tfidf", f"WITH {TFIDF}, {GOLD}, {_recall_sql('tir')}")
def recall_mrr_tfidf(spark, sf):
    docs, items = _tables(spark, sf)
    got = metrics.recall_mrr(search.ranked(search.tfidf_best(docs, items, 100), 100), _gold(docs, items), [1, 5, 10, 20])
    return got.select("k", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "n_queries")


@query("random_control", f"WITH s AS (SELECT item_id AS qid, doc_id, {uniform_sql(9, 'item_id', 'doc_id')} AS u FROM benchmark, documents), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(u, 9) DESC, doc_id) AS rank FROM s) SELECT qid, rank, doc_id FROM r WHERE rank <= 10")
def random_control(spark, sf):
    docs, items = _tables(spark, sf)
    pairs = docs.select("doc_id").crossJoin(bounded(items.select(F.col("item_id").alias("qid"))))  # the stated query set, against all rows
    return search.ranked(pairs.withColumn("score", uniform(9, "qid", "doc_id")), 10).select("qid", "rank", "doc_id")


SMART_T = {"n": "tf::DOUBLE", "l": "1 + ln(tf)", "a": "0.5 + 0.5 * tf / max(tf) OVER w", "b": "1.0", "L": "(1 + ln(tf)) / (1 + ln(avg(tf) OVER w))"}
SMART_D = {"n": "1.0", "t": "ln(n / df)", "p": "greatest(0, CASE WHEN n > df THEN ln((n - df) / df) ELSE ln(1e-300) END)"}


def _smart_sql(schemes, queries="ltc"):
    def weigh(src, row, pivot, which):
        parts = []
        for s in which:
            base = f"SELECT {row} AS row_id, token, ({SMART_T[s[0]]}) * ({SMART_D[s[1]]}) AS w, count(*) OVER w AS u FROM {src} WINDOW w AS (PARTITION BY {row})"
            norm = {"n": "w", "c": "w * CASE WHEN sqrt(sum(w * w) OVER (PARTITION BY row_id)) > 0 THEN 1 / sqrt(sum(w * w) OVER (PARTITION BY row_id)) ELSE 0 END", "u": f"w / (0.8 * {pivot} + 0.2 * u)"}[s[2]]
            parts.append(f"SELECT '{s}' AS scheme, row_id, token, {norm} AS w FROM ({base})")
        return " UNION ALL ".join(parts)

    return f"""{POST}, {QTOK}, st AS (SELECT token, count(*)::DOUBLE AS df FROM post GROUP BY token),
pd AS (SELECT doc_id, token, tf, df, n::DOUBLE AS n FROM post JOIN st USING (token), n_all), pq AS (SELECT qid, token, qtf AS tf, df, n::DOUBLE AS n FROM q JOIN st USING (token), n_all),
wd AS ({weigh('pd', 'doc_id', '(SELECT (SELECT count(*) FROM pd)::DOUBLE / n FROM n_all)', schemes)}),
wq AS ({weigh('pq', 'qid', '(SELECT (SELECT count(*) FROM pq)::DOUBLE / (SELECT count(*) FROM benchmark))', [queries])}),
sm AS (SELECT d.scheme, q.row_id AS qid, d.row_id AS doc_id, sum(d.w * q.w) AS score FROM wd d JOIN wq q USING (token) GROUP BY ALL HAVING sum(d.w * q.w) > 0),
smr AS (SELECT *, row_number() OVER (PARTITION BY scheme, qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sm),
tot AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid),
hit AS (SELECT scheme, r.qid, count(*)::DOUBLE AS h FROM smr r JOIN gold g ON r.qid = g.qid AND r.doc_id = g.doc_id WHERE rank <= 10 GROUP BY scheme, r.qid),
rec AS (SELECT s.scheme, avg(coalesce(h / n_gold, 0)) AS recall FROM (SELECT DISTINCT scheme FROM sm) s, tot LEFT JOIN hit ON hit.scheme = s.scheme AND hit.qid = tot.qid GROUP BY s.scheme)"""


def _grid(spark, sf, schemes):
    docs, items = _tables(spark, sf)
    scores = search.smart_best(docs, items, 10, schemes, ["ltc"]).withColumn("both", F.concat_ws("/", "scheme", "qid"))
    ranked = search.ranked(scores, 10, by="both").drop("both")
    return metrics.recall_mrr(ranked, _gold(docs, items), [10], by=["scheme"]).select("scheme", "recall")


@query("smart_grid_recall", f"WITH {GOLD}, {_smart_sql(search.all_schemes())} SELECT scheme, round(recall, 6) AS recall FROM rec")
def smart_grid_recall(spark, sf):
    """All 45 document weightings in one pass, against one query weighting."""
    return _grid(spark, sf, search.all_schemes()).select("scheme", F.round("recall", 6).alias("recall"))


@query("smart_component_spread", f"WITH {GOLD}, {_smart_sql(search.all_schemes())}, m AS (SELECT place, letter, avg(recall) AS mean FROM (SELECT 'tf' AS place, scheme[1] AS letter, recall FROM rec UNION ALL SELECT 'df', scheme[2], recall FROM rec UNION ALL SELECT 'norm', scheme[3], recall FROM rec) GROUP BY place, letter) SELECT place, letter, round(mean, 6) AS mean FROM m")
def smart_component_spread(spark, sf):
    """Mean recall of each letter in each place: grouping sets over the grid."""
    g = _grid(spark, sf, search.all_schemes())
    x = g.select("recall", *[F.substring("scheme", i, 1).alias(n) for i, n in enumerate(("tf", "df", "norm"), 1)])
    got = x.groupingSets([[F.col("tf")], [F.col("df")], [F.col("norm")]], "tf", "df", "norm").agg(F.avg("recall").alias("mean"))
    return got.select(F.when(F.col("tf").isNotNull(), "tf").when(F.col("df").isNotNull(), "df").otherwise("norm").alias("place"), F.coalesce("tf", "df", "norm").alias("letter"), F.round("mean", 6).alias("mean"))


RM3 = f"""{BM25}, fb AS (SELECT qid, doc_id, score / sum(score) OVER (PARTITION BY qid) AS p FROM bmr WHERE rank <= 10),
rm AS (SELECT qid, token, sum(p * tf / len) AS weight FROM fb JOIN post USING (doc_id) JOIN sizes USING (doc_id) GROUP BY qid, token),
rmt AS (SELECT * FROM rm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(weight, 12) DESC, token) <= 20),
ex AS (SELECT qid, token, sum(weight) AS weight FROM (SELECT qid, token, 0.5 * qtf / sum(qtf) OVER (PARTITION BY qid) AS weight FROM q UNION ALL SELECT qid, token, 0.5 * weight / sum(weight) OVER (PARTITION BY qid) FROM rmt) GROUP BY qid, token)"""


@query("rm3_expansion", f"WITH {RM3} SELECT qid AS item_id, token AS term, round(weight, 6) AS weight FROM rmt")
def rm3_expansion(spark, sf):
    docs, items = _tables(spark, sf)
    return search.relevance_model(docs, search.bm25_best(docs, items, 10)).select(F.col("qid").alias("item_id"), F.col("token").alias("term"), F.round("weight", 6).alias("weight"))


@query("rm3_topk", f"""WITH {RM3}, p2 AS (SELECT p.doc_id, p.token, greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m)) AS part
  FROM post p JOIN df USING (token) JOIN sizes s ON p.doc_id = s.doc_id, n_all, mean), sc AS (SELECT qid, doc_id, sum(weight * part) AS score FROM p2 JOIN ex USING (token) GROUP BY qid, doc_id),
r2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) SELECT qid AS item_id, rank, doc_id, round(score, 6) AS score FROM r2 WHERE rank <= 10""")
def rm3_topk(spark, sf):
    docs, items = _tables(spark, sf)
    model = search.relevance_model(docs, search.bm25_best(docs, items, 10))
    return _topk(search.ranked(search.weighted_best(docs, search.expanded(items, model), 10), 10))


DEPTHS = (0, 10, 20, 50, 100)
OVERLAP = "ov AS (SELECT qid, doc_id, count(*)::DOUBLE / any_value(len) AS s FROM q JOIN post USING (token) JOIN sizes USING (doc_id) WHERE len > 0 GROUP BY qid, doc_id)"


@query("rerank_depth_sweep", f"""WITH {BM25}, {GOLD}, {OVERLAP}, dp AS (SELECT unnest([{', '.join(map(str, DEPTHS))}]) AS depth),
top AS (SELECT * FROM bmr WHERE rank <= 100),
rr AS (SELECT depth, top.qid, top.doc_id, row_number() OVER (PARTITION BY depth, top.qid ORDER BY CASE WHEN rank <= depth THEN 0 ELSE 1 END, CASE WHEN rank <= depth THEN round(s, 9) END DESC NULLS LAST, rank) AS r FROM top LEFT JOIN ov ON ov.qid = top.qid AND ov.doc_id = top.doc_id, dp),
tot AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid),
h AS (SELECT depth, rr.qid, count(*) FILTER (r <= 10)::DOUBLE AS after, count(*) FILTER (r <= depth)::DOUBLE AS ceil FROM rr JOIN gold g ON g.qid = rr.qid AND g.doc_id = rr.doc_id GROUP BY depth, rr.qid),
res AS (SELECT dp.depth, avg(coalesce(after / n_gold, 0)) AS after, avg(coalesce(ceil / n_gold, 0)) AS ceiling FROM dp, tot LEFT JOIN h ON h.depth = dp.depth AND h.qid = tot.qid GROUP BY dp.depth)
SELECT depth::BIGINT AS depth, round(after, 6) AS after, round(ceiling, 6) AS ceiling, round(coalesce(after / nullif(ceiling, 0), 0), 6) AS conversion FROM res""")
def rerank_depth_sweep(spark, sf):
    """Reranking the first 100 by the share of a document's words that the query has; all depths in one pass."""
    from .tables import bounded, lengths, postings

    docs, items = _tables(spark, sf)
    first = search.ranked(search.bm25_best(docs, items, 100), 100).select("qid", "doc_id", "rank")
    q = postings(items, "item_id").select(F.col("item_id").alias("qid"), "token")
    used = cut(docs.join(bounded(first.select("doc_id").distinct()), "doc_id", "left_semi"))
    scores = postings(used).join(bounded(q), "token").groupBy("qid", "doc_id").agg(F.count("*").alias("n")).join(lengths(used), "doc_id").select("qid", "doc_id", (F.col("n") / F.col("len")).alias("rerank_score"))
    gold = _gold(docs, items)
    total = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    hits = search.rerank(first, scores, list(DEPTHS)).join(gold, ["qid", "doc_id"], "left_semi").groupBy("depth", "qid").agg(F.count_if(F.col("rank") <= 10).alias("a"), F.count_if(F.col("rank") <= F.col("depth")).alias("c"))
    all_ = total.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in DEPTHS]))).join(hits, ["depth", "qid"], "left")
    got = all_.groupBy("depth").agg(F.avg(F.coalesce(F.col("a") / F.col("n_gold"), F.lit(0.0))).alias("after"), F.avg(F.coalesce(F.col("c") / F.col("n_gold"), F.lit(0.0))).alias("ceiling"))
    ratio = F.when(F.col("ceiling") == 0, 0.0).otherwise(F.col("after") / F.nullif("ceiling", F.lit(0.0)))
    return got.select("depth", F.round("after", 6).alias("after"), F.round("ceiling", 6).alias("ceiling"), F.round(ratio, 6).alias("conversion"))


def _per(rank):
    return f"(SELECT t.qid, coalesce(h / n_gold, 0) AS recall FROM (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid) t LEFT JOIN (SELECT r.qid, count(*)::DOUBLE AS h FROM {rank} r JOIN gold g ON r.qid = g.qid AND r.doc_id = g.doc_id WHERE rank <= 10 GROUP BY r.qid) USING (qid))"


@query("paired_bootstrap", f"""WITH {BM25}, {TFIDF.split(QTOK + ',', 1)[1]}, {GOLD},
d AS (SELECT a.qid, a.recall - b.recall AS d, row_number() OVER (ORDER BY a.qid) - 1 AS i, count(*) OVER () AS n FROM {_per('bmr')} a JOIN {_per('tir')} b USING (qid)),
dr AS (SELECT b, floor({uniform_sql(5, 'b', 'j')} * n)::BIGINT AS i FROM range(2000) x(b), (SELECT any_value(n) AS n FROM d) z, unnest(range(0, z.n)) AS y(j)),
ms AS (SELECT b, avg(d) AS m FROM dr JOIN d USING (i) GROUP BY b),
f AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg((m <= 0)::INT) AS below, avg((m >= 0)::INT) AS above FROM ms)
SELECT round((SELECT avg(d) FROM d), 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(least(1, 2 * least(below, above)), 6) AS p, lo > 0 OR hi < 0 AS significant FROM f""")
def paired_bootstrap(spark, sf):
    docs, items = _tables(spark, sf)
    gold = _gold(docs, items)
    a = metrics.per_query_recall(search.ranked(search.bm25_best(docs, items, 10), 10), gold, 10).withColumnRenamed("recall", "x")
    b = metrics.per_query_recall(search.ranked(search.tfidf_best(docs, items, 10), 10), gold, 10).withColumnRenamed("recall", "y")
    got = metrics.paired_bootstrap(a.join(b, "qid").select("qid", (F.col("x") - F.col("y")).alias("d")))
    return got.select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi", "p")], "significant")
