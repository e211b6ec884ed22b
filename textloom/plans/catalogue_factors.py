"""Queries of latent factors, simulated streams, subsampling, retrieval of misspelt words and two-way spreads."""

from __future__ import annotations

import zlib

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import strings, text
from ..functions.rng import uniform, uniform_sql
from ..operators import entities, factors, metrics, models
from ..operators.blocks import top_dots
from ..operators.vectors import dot
from .catalogue_models import LEXICON, OTHER, _langs, _map
from .catalogue_text import _typed, _words
from .registry import TOK, query
from .tables import bounded, cut, postings, read, tokens


def _rows(spark, sf):
    docs = read(spark, sf, "documents")
    rows, vocab = factors.sparse_rows(cut(postings(docs)), docs.count())
    return cut(rows), vocab, vocab.count()


def _near(items, docs, k=10):
    s = top_dots(items.select("item_id", F.col("v").alias("qv")), docs, k, "item_id", "doc_id", "qv", "v").withColumn("score", F.round("score", 9))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query("lsa_topk")
def lsa_topk(spark, sf):
    rows, vocab, size = _rows(spark, sf)
    basis = factors.lsa(rows, size)
    items = factors.encode(postings(read(spark, sf, "benchmark"), "item_id"), vocab, "item_id")
    return _near(factors.project(items, basis, "item_id"), factors.project(rows, basis, "doc_id"))


@query("word2vec_topk")
def word2vec_topk(spark, sf):
    """Documents and passages as means of word vectors; zero for a text without known words."""
    from pyspark.ml.functions import vector_to_array

    size = read(spark, sf, "documents").agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    docs = read(spark, sf, "documents").select("doc_id", text.words(F.col("text")).alias("t"))
    items = read(spark, sf, "benchmark").select("item_id", text.words(F.col("text")).alias("t"))
    model = factors.averaged_vectors(docs, "t", dims=32, characters=size)
    unit = lambda d, key: d.select(key, vector_to_array("v").alias("w")).withColumn("n", F.greatest(F.sqrt(dot(F.col("w"), F.col("w"))), F.lit(1e-10))).select(key, F.transform("w", lambda x: x / F.col("n")).alias("v"))
    return _near(unit(model.transform(items), "item_id"), unit(model.transform(docs), "doc_id"))


@query("nmf_topics")
def nmf_topics(spark, sf):
    """The ten heaviest words of each of eight non-negative topics."""
    rows, vocab, size = _rows(spark, sf)
    h = factors.nmf(rows, size, k=8)
    top = [(k, r, int(i), float(h[k, i])) for k in range(len(h)) for r, i in enumerate(h[k].argsort()[::-1][:10])]
    return spark.createDataFrame(top, "topic int, rank int, i int, weight double").join(F.broadcast(vocab), "i").select("topic", "rank", "token", "weight")


@query("zipf_bias_table")
def zipf_bias_table(spark, sf):
    return factors.bias_table(factors.zipf_streams(spark, [0.8, 1.0, 1.2, 1.5]))


@query("heaps_simulated")
def heaps_simulated(spark, sf):
    """Types against draws for simulated streams of growing length, and the fitted exponent."""
    got = None
    for n in (1000, 3000, 10000, 30000):
        one = factors.zipf_streams(spark, [0.9, 1.1, 1.4], repeats=1, draws=n).groupBy("a").agg(F.count("*").alias("types")).withColumn("n", F.lit(n))
        got = one if got is None else got.unionByName(one)
    return got.groupBy("a").agg(F.regr_slope(F.log("types"), F.log("n")).alias("beta"), F.least(F.lit(1.0), 1 / F.first("a")).alias("asymptotic"))


@query("subsampled_counts", f"WITH {TOK}, c AS (SELECT token, count(*)::DOUBLE AS f, sum(count(*)) OVER ()::DOUBLE AS t FROM tok GROUP BY token), k AS (SELECT token, least(1, sqrt(1e-3 * t / f) + 1e-3 * t / f) AS p FROM c) SELECT token, count(*) AS kept FROM tok JOIN k USING (token) WHERE {uniform_sql(13, 'doc_id', 'pos')} < p GROUP BY token")
def subsampled_counts(spark, sf):
    """Occurrences that subsampling of frequent words keeps."""
    tok = tokens(read(spark, sf, "documents"))
    c = tok.groupBy("token").agg(F.count("*").cast("double").alias("f"))
    p = c.crossJoin(F.broadcast(c.agg(F.sum("f").alias("t")))).select("token", models.keep_probability(F.col("f"), F.col("t"), 1e-3).alias("p"))
    return tok.withColumn("u", uniform(13, "doc_id", "pos")).join(p, "token").where("u < p").groupBy("token").agg(F.count("*").alias("kept"))


@query("length_correlation", "SELECT lang, round(corr(length(text), len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))), 6) AS r, count(*) AS n FROM documents GROUP BY lang")
def length_correlation(spark, sf):
    d = read(spark, sf, "documents").select("lang", F.length("text").cast("double").alias("x"), F.size(F.array_distinct(text.words(F.col("text")))).cast("double").alias("y"))
    return d.groupBy("lang").agg(F.round(F.corr("x", "y"), 6).alias("r"), F.count("*").alias("n"))


@query("string_retrieval")
def string_retrieval(spark, sf):
    """Share of misspelt words that each measure brings back, and alone."""
    typed, words = cut(_typed(spark, sf)), cut(_words(spark, sf))
    got = None
    for m in strings.MEASURES:
        r = strings.retrieve(typed, words, lambda a, b, m=m: 1 - F.round(strings.similarity(m, a, b), 9)).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("n")).select(F.lit(m).alias("measure"), "accuracy", "n")
        got = r if got is None else got.unionByName(r)
    return got


@F.pandas_udf(T.LongType())
def _deflated(s):  # a pandas Series
    return s.map(lambda x: len(zlib.compress((x or "").encode(), 9)))


PROFILE = 8000


def _profiles(docs):
    """(label, p): the first ``PROFILE`` characters of each label's texts, joined in id order."""
    docs = docs.where("text is not null")
    w = W.partitionBy("label").orderBy("doc_id")
    # from ids and lengths alone, the last id that a profile needs; a text and the blank after it add one character at least
    sizes = docs.select("label", "doc_id", (F.length("text") + 1).alias("n")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= PROFILE)
    ends = sizes.withColumn("before", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).where(F.col("before") < PROFILE).groupBy(F.col("label").alias("of")).agg(F.max("doc_id").alias("end"))
    start = docs.join(bounded(cut(ends)), F.col("label").eqNullSafe(F.col("of"))).where("doc_id is null or doc_id <= end").select("label", "doc_id", F.substring("text", 1, PROFILE).alias("t"))
    return start.groupBy("label").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"]), " "), 1, PROFILE).alias("p"))


@query("langid_compression")
def langid_compression(spark, sf):
    """Languages by how much a text adds to a compressed profile, the first 8,000 characters of a language's joined whole texts: confusion counts."""
    d = _langs(spark, sf)
    prof = cut(_profiles(d.where("not test")).withColumn("c", _deflated(F.col("p"))))
    t = d.where("test").select("doc_id", F.col("label").alias("truth"), F.substring("text", 1, 200).alias("t")).join(bounded(prof.withColumnRenamed("label", "predicted"), 1000), how="cross")
    s = t.select("doc_id", "truth", "predicted", (_deflated(F.concat_ws(" ", "p", "t")) - F.col("c")).alias("added"))
    best = s.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("added", "predicted"))).where("r = 1")
    return best.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


RESAMPLES = 1000


@query("spread_bootstrap")
def spread_bootstrap(spark, sf):
    """Whether the choice of lexicon or of rules moves accuracy more: resampled difference of spreads.

    The tables hold no sentiment labels; whether a turn is the assistant's is what is predicted.
    """
    t = read(spark, sf, "conversations").select("conv_id", (F.col("role") == "assistant").alias("y"), text.opinion_tokens(F.col("text")).alias("t"))
    cells = [(ln, lex, rule) for ln, lex in (("first", LEXICON), ("second", OTHER)) for rule in ("bag", "negation", "intensifier", "contrastive")]
    ok = t.select("conv_id", *[((entities.sentiment(rule, F.col("t"), _map(lex)) > 0) == F.col("y")).cast("double").alias(f"c{i}") for i, (_, lex, rule) in enumerate(cells)])
    columns = [f"c{i}" for i in range(len(cells))]
    per = ok.groupBy("conv_id").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns], F.count("*").cast("double").alias("n"))
    sums = metrics.poisson_sums(per, "conv_id", [*columns, "n"], RESAMPLES, 17)
    cell = lambda i, ln, rule: F.struct(F.lit(ln).alias("lexicon"), F.lit(rule).alias("rule"), (F.col(f"c{i}") / F.col("n")).alias("acc"))
    per = sums.where("n > 0").select("b", F.explode(F.array(*[cell(i, ln, rule) for i, (ln, _, rule) in enumerate(cells)])).alias("x")).select("b", "x.*")
    a = per.groupBy("b", "rule").agg((F.max("acc") - F.min("acc")).alias("s")).groupBy("b").agg(F.max("s").alias("lexicons"))
    r = per.groupBy("b", "lexicon").agg((F.max("acc") - F.min("acc")).alias("s")).groupBy("b").agg(F.max("s").alias("rules"))
    x = a.join(r, "b").withColumn("d", F.col("lexicons") - F.col("rules"))
    return x.agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"), F.avg((F.col("d") > 0).cast("double")).alias("above"))
