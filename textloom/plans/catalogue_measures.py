"""Queries of measures beside the main ones: churn, spreads of estimators, overlaps, oracles of senses, matrices step by step."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rng import uniform, uniform_sql
from ..operators import dedup, entities, metrics, models, scan, search
from ..operators import statistics as st
from .catalogue_models import _SENT, _VALUES, CO, LEXICON, OTHER, OT, TAGS, VOCAB, _map, _pmi_sql, _sentiments, _stream, _tagged, _weights, gazetteer_matches
from .catalogue_pairs import SIGS, _sets
from .catalogue_search import GOLD, _gold, _smart_sql, _tables
from .catalogue_stats import BIGRAMS, LEAST, SCORES
from .registry import ORACLES, POST, QUERIES, query
from .tables import bounded, cut, postings, read, tokens

CUTOFFS = (1, 2, 5, 10, 25, 50)
TOP = 20
_ALL_PAIRS = BIGRAMS.replace(f"a >= {LEAST}", "a >= 1")
_TOPS = " UNION ALL ".join(f"SELECT cutoff, '{m}' AS measure, w1, w2, a FROM (SELECT cutoff, w1, w2, a, row_number() OVER (PARTITION BY cutoff ORDER BY round({s}, 6) DESC, w1, w2) AS r FROM ct) WHERE r <= {TOP}" for m, s in SCORES.items())


@query("collocation_churn", f"""WITH {_ALL_PAIRS}, ks AS (SELECT *, row_number() OVER (ORDER BY cutoff) AS step FROM (SELECT cutoff, count(*) AS kept FROM ce, unnest([{', '.join(map(str, CUTOFFS))}]) k(cutoff) WHERE a >= cutoff GROUP BY cutoff HAVING count(*) >= {TOP})),
ct AS (SELECT cutoff, ce.* FROM ce JOIN ks ON a >= cutoff), tp AS ({_TOPS}), md AS (SELECT cutoff, measure, floor(quantile_cont(a, 0.5))::BIGINT AS median_freq FROM tp GROUP BY ALL),
ov AS (SELECT y.cutoff, y.measure, count(*) AS same FROM tp x JOIN ks kx ON kx.cutoff = x.cutoff JOIN ks ky ON ky.step = kx.step + 1 JOIN tp y ON y.cutoff = ky.cutoff AND y.measure = x.measure AND y.w1 = x.w1 AND y.w2 = x.w2 GROUP BY ALL)
SELECT cutoff::BIGINT AS cutoff, kept, measure, median_freq, CASE WHEN step > 1 THEN round(coalesce(same, 0) / (2 * {TOP} - coalesce(same, 0)), 6) END AS overlap FROM ks JOIN md USING (cutoff) LEFT JOIN ov USING (cutoff, measure)""")
def collocation_churn(spark, sf):
    """How the top 20 pairs of each measure change as rare pairs are left out, and how frequent they are."""
    n = cut(st.bigrams(read(spark, sf, "documents")).select("*", *[F.round(st.association(m), 6).alias(m) for m in SCORES]))
    kept = n.agg(*[F.count_if(F.col("a") >= c).alias(f"k{c}") for c in CUTOFFS]).first()
    cutoffs = [c for c in CUTOFFS if kept[f"k{c}"] >= TOP]
    if not cutoffs:
        return spark.createDataFrame([], "cutoff long, kept long, measure string, median_freq long, overlap double")
    about = spark.createDataFrame([(step, c, kept[f"k{c}"]) for step, c in enumerate(cutoffs)], "step int, cutoff long, kept long")
    tops = cut(scan.tops(n, cutoffs, list(SCORES), TOP).join(F.broadcast(about), "step"))
    before = tops.select((F.col("step") + 1).alias("step"), "measure", "w1", "w2", F.lit(1).alias("was"))
    got = tops.join(F.broadcast(before), ["step", "measure", "w1", "w2"], "left").groupBy("step", "cutoff", "kept", "measure").agg(F.floor(F.percentile("a", F.lit(0.5))).alias("median_freq"), F.count("was").alias("same"))
    return got.select(F.col("cutoff").cast("long").alias("cutoff"), F.col("kept").cast("long").alias("kept"), "measure", "median_freq", F.when(F.col("step") > 0, F.round(F.col("same") / (2 * TOP - F.col("same")), 6)).alias("overlap"))


@query("minhash_random_pairs", f"""WITH {SIGS}, rk AS (SELECT doc_id, row_number() OVER (ORDER BY {uniform_sql(4, 'doc_id')}, doc_id) - 1 AS r FROM sh WHERE len(s) > 0 QUALIFY r < 800),
rp AS (SELECT min(doc_id) AS a, max(doc_id) AS b FROM rk GROUP BY r // 2 HAVING min(doc_id) < max(doc_id)),
eq AS (SELECT a, b, len(list_intersect(any_value(x.s), any_value(y.s))) / len(list_distinct(list_concat(any_value(x.s), any_value(y.s)))) AS j, avg((p.m = q.m)::INT) AS e FROM rp JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b JOIN mn p ON p.doc_id = a JOIN mn q ON q.doc_id = b AND q.i = p.i GROUP BY a, b)
SELECT count(*) AS n_pairs, round(avg(abs(e - j)), 6) AS mae, round(1 / sqrt(128), 6) AS theory FROM eq""")
def minhash_random_pairs(spark, sf):
    """How far signatures' agreement lies from the exact similarity, over 400 random pairs of texts with shingles."""
    sets = _sets(spark, sf).where(F.size("s") > 0)
    pairs = cut(dedup.sampled_pairs(sets))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    own = cut(sets.join(F.broadcast(ids), "doc_id").select("doc_id", "s", dedup.signature(F.col("s")).alias("sig")))
    side = lambda c: own.select(F.col("doc_id").alias(c), F.struct("s", "sig").alias(f"x{c}"))
    err = F.abs(dedup.agreement(F.col("xa.sig"), F.col("xb.sig")) - dedup.jaccard(F.col("xa.s"), F.col("xb.s")))
    return pairs.join(side("a"), "a").join(side("b"), "b").agg(F.count("*").alias("n_pairs"), F.round(F.avg(err), 6).alias("mae"), F.round(F.lit(1) / F.sqrt(F.lit(128)), 6).alias("theory"))


#: DuckDB: of a document's tags the longest, then the leftmost, that overlap none chosen before.
CHOSEN = f"""{TAGS}, so AS (SELECT doc_id, list({{'m': -n::BIGINT, 's': start::BIGINT, 'p': pattern::BIGINT}} ORDER BY -n, start, pattern) AS l FROM tg GROUP BY doc_id),
gr AS (SELECT doc_id, l, 1 AS i, []::STRUCT(m BIGINT, s BIGINT, p BIGINT)[] AS acc FROM so UNION ALL SELECT doc_id, l, i + 1, CASE WHEN len(list_filter(acc, lambda y: l[i].s < y.s - y.m AND y.s < l[i].s - l[i].m)) > 0 THEN acc ELSE list_append(acc, l[i]) END FROM gr WHERE i <= len(l)),
ch AS (SELECT doc_id, l, acc FROM gr WHERE i = len(l) + 1)"""
ORACLES["gazetteer_longest"] = f"WITH RECURSIVE {CHOSEN}, x AS (SELECT doc_id, unnest(acc) AS x FROM ch) SELECT doc_id, x.p AS pattern, x.s AS start, -x.m AS n FROM x"


@query("gazetteer_overlaps", f"WITH RECURSIVE {CHOSEN} SELECT count(*) AS tagged, sum(len(l))::BIGINT AS matches, sum(len(l) - len(acc))::BIGINT AS dropped, round(sum(len(list_distinct(list_transform(acc, lambda x: x.p)))) / (SELECT count(*) FROM documents), 6) AS per_document FROM ch")
def gazetteer_overlaps(spark, sf):
    """Tagged documents, their matches, those that longer ones displace, and distinct entries a document."""
    tags = cut(gazetteer_matches(spark, sf))
    chosen = entities.longest_first(tags).groupBy("doc_id").agg(F.count("*").alias("kept"), F.count_distinct("pattern").alias("entries"))
    x = tags.groupBy("doc_id").agg(F.count("*").alias("n")).join(chosen, "doc_id").agg(F.count("*").alias("tagged"), F.sum("n").alias("matches"), F.sum(F.col("n") - F.col("kept")).alias("dropped"), F.sum("entries").alias("e"))
    return x.crossJoin(F.broadcast(read(spark, sf, "documents").agg(F.count("*").alias("all")))).select("tagged", "matches", "dropped", F.round(F.col("e") / F.col("all"), 6).alias("per_document"))


def _self_sql(lists):
    return f"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark), own AS (SELECT item_id, array_to_string(t[1:3], ' ') AS gram FROM t WHERE len(t) >= 3)
SELECT count(*) AS items, count(*) FILTER (contains({lists}, ' ' || gram || ' '))::BIGINT AS found FROM own JOIN t USING (item_id)"""


@query("gazetteer_self_found", _self_sql("' ' || array_to_string(t, ' ') || ' '"))
def gazetteer_self_found(spark, sf):
    """Passages in which their own entry, their first three words, is tagged after overlaps are resolved."""
    b = read(spark, sf, "benchmark")
    own = b.select("item_id", text.words(F.col("text")).alias("t")).where(F.size("t") >= 3).select(F.col("item_id").alias("pattern"), F.array_join(F.slice("t", 1, 3), " ").alias("gram"))
    # entries with one gram stand for each other: the smallest is the pattern
    names = own.groupBy("gram").agg(F.min("pattern").alias("pattern"))
    tags = entities.tag(b, names, 3, "item_id").join(bounded(names), "pattern").select("item_id", "gram").distinct().withColumn("hit", F.lit(1))
    return own.withColumnRenamed("pattern", "item_id").join(tags, ["item_id", "gram"], "left").agg(F.count("*").alias("items"), F.count("hit").alias("found"))


_TRUTH = "(SELECT conv_id, turn, role = 'assistant' AS y FROM conversations)"
_FIRED = " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS n, count(*) FILTER (b.score <> a.score) AS changed, count(*) FILTER (b.score <> a.score AND (b.score > 0) <> (a.score > 0)) AS flipped, count(*) FILTER (b.score <> a.score AND (b.score > 0) <> (a.score > 0) AND (b.score > 0) = y) AS well FROM ({_SENT['bag']}) a JOIN ({_SENT[r]}) b USING (conv_id, turn) JOIN {_TRUTH} t USING (conv_id, turn)" for r in ("negation", "intensifier", "contrastive"))


@query("flip_precision", f"SELECT rule, round(changed / n, 6) AS changes_score, round(flipped / n, 6) AS flips_call, round(coalesce(well / nullif(flipped, 0), 0), 6) AS flip_precision FROM ({_FIRED})")
def flip_precision(spark, sf):
    """How often each rule set changes a score against plain sums, changes the call, and is then right.

    The tables hold no sentiment labels; whether a turn is the assistant's is what is predicted.
    """
    t = read(spark, sf, "conversations").select((F.col("role") == "assistant").alias("y"), text.opinion_tokens(F.col("text")).alias("t"))
    names = ("negation", "intensifier", "contrastive")
    s = t.select("y", *[F.round(entities.sentiment(r, F.col("t"), _map(LEXICON)), 6).alias(r) for r in ("bag", *names)])
    rows = s.select("y", "bag", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in names])).alias("x")).select("y", "bag", "x.*")
    changed = F.col("score") != F.col("bag")
    flipped = changed & ((F.col("score") > 0) != (F.col("bag") > 0))
    x = rows.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(changed).alias("c"), F.count_if(flipped).alias("f"), F.count_if(flipped & ((F.col("score") > 0) == F.col("y"))).alias("w"))
    return x.select("rule", F.round(F.col("c") / F.col("n"), 6).alias("changes_score"), F.round(F.col("f") / F.col("n"), 6).alias("flips_call"), F.round(F.coalesce(F.col("w") / F.nullif("f", F.lit(0)), F.lit(0.0)), 6).alias("flip_precision"))


def _lexicon_sql(lexicon):
    return OT.rsplit("lx AS", 1)[0] + "lx AS (SELECT MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in lexicon.items()) + "} AS m)"


_BAGGED = " UNION ALL ".join(f"SELECT '{n}' AS lexicon, conv_id, turn, score FROM (WITH {_lexicon_sql(x)} SELECT conv_id, turn, round(coalesce(list_sum(list_transform(t, lambda x: coalesce(m[x], 0))), 0)::DOUBLE, 9) AS score FROM ot, lx)" for n, x in (("first", LEXICON), ("second", OTHER)))


@query("lexicon_coverage", f"WITH s AS ({_BAGGED}), x AS (SELECT lexicon, avg((score = 0)::INT) AS unscored, avg(CASE WHEN score <> 0 THEN ((score > 0) = y)::INT END) AS p FROM s JOIN {_TRUTH} t USING (conv_id, turn) GROUP BY lexicon) SELECT lexicon, round(unscored, 6) AS unscored, round(p, 6) AS accuracy_when_scored, coalesce(p > lag(p) OVER (ORDER BY unscored, lexicon), true) AS rises FROM x")
def lexicon_coverage(spark, sf):
    """Abstentions of each lexicon and accuracy where it scores; whether accuracy rises with each step of abstention."""
    truth = read(spark, sf, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("y"))
    one = lambda n, x: _sentiments(spark, sf, "bag", x).select(F.lit(n).alias("lexicon"), "conv_id", "turn", F.round("score", 9).alias("score"))
    x = one("first", LEXICON).unionByName(one("second", OTHER)).join(truth, ["conv_id", "turn"]).groupBy("lexicon").agg(F.avg((F.col("score") == 0).cast("double")).alias("unscored"), F.avg(F.when(F.col("score") != 0, ((F.col("score") > 0) == F.col("y")).cast("double"))).alias("p"))
    rises = F.coalesce(F.col("p") > F.lag("p").over(W.orderBy("unscored", "lexicon")), F.lit(True))
    return x.withColumn("rises", rises).select("lexicon", F.round("unscored", 6).alias("unscored"), F.round("p", 6).alias("accuracy_when_scored"), "rises")


_AXIS = _smart_sql(["lnc"]).replace("d.scheme, q.row_id", "q.scheme, q.row_id")
_AXIS = _AXIS.replace(_AXIS[_AXIS.index("wq AS (") : _AXIS.index("sm AS (")], "wq AS (" + (lambda s: s[s.index("wd AS (") + 7 : s.index("wq AS (")])(_smart_sql(search.all_schemes())).replace("FROM pd", "FROM pq").replace("doc_id AS row_id", "qid AS row_id").replace("PARTITION BY doc_id", "PARTITION BY qid").replace("/ n FROM n_all)", "/ (SELECT count(*) FROM benchmark))"))


@query("smart_query_recall", f"WITH {GOLD}, {_AXIS} SELECT scheme, round(recall, 6) AS recall FROM rec")
def smart_query_recall(spark, sf):
    """All 45 query weightings against one document weighting."""
    docs, items = _tables(spark, sf)
    scores = search.smart_best(docs, items, 10, ["lnc"], search.all_schemes()).withColumn("both", F.concat_ws("/", "scheme", "qid"))
    ranked = search.ranked(scores, 10, by="both").drop("both")
    return metrics.recall_mrr(ranked, _gold(docs, items), [10], by=["scheme"]).select("scheme", F.round("recall", 6).alias("recall"))


@query("query_terms_dropped", f"WITH {POST}, q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark), k AS (SELECT item_id, unnest(t) AS token FROM q), m AS (SELECT item_id, count(*) AS terms, count(*) FILTER (token NOT IN (SELECT token FROM post)) AS gone FROM k GROUP BY item_id) SELECT (SELECT count(*) FROM q) AS queries, coalesce(sum(terms), 0)::BIGINT AS terms, coalesce(sum(gone), 0)::BIGINT AS dropped, ((SELECT count(*) FROM q) - count(*) FILTER (terms > gone))::BIGINT AS empty FROM m")
def query_terms_dropped(spark, sf):
    """Terms of queries that no document holds, and queries without any other."""
    docs, items = _tables(spark, sf)
    known = tokens(docs).select("token").distinct().withColumn("known", F.lit(1))
    q = postings(items, "item_id").select("item_id", "token").join(known, "token", "left")
    per = q.groupBy("item_id").agg(F.count("*").alias("terms"), F.count("known").alias("k"))
    x = items.select("item_id").join(per, "item_id", "left")
    return x.agg(F.count("*").alias("queries"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.col("terms") - F.col("k")), F.lit(0)).alias("dropped"), F.count_if(F.coalesce("k", F.lit(0)) == 0).alias("empty"))


@query("token_idf", f"WITH {POST} SELECT token, round(ln((any_value(n) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM post, n_all GROUP BY token")
def token_idf(spark, sf):
    """Smoothed inverse document frequencies, the weights of idf pooling."""
    docs = read(spark, sf, "documents")
    df = postings(docs).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("token", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


@query("zipf_estimates", " UNION ALL ".join(f"SELECT estimator, a, n_used FROM ({ORACLES[q]})" for q in ("zipf_ols", "zipf_head", "zipf_binned", "zipf_mle", "zipf_split_half")))
def zipf_estimates(spark, sf):
    """Five estimates of one stream's exponent."""
    got = None
    for q in ("zipf_ols", "zipf_head", "zipf_binned", "zipf_mle", "zipf_split_half"):
        one = QUERIES[q](spark, sf).select("estimator", "a", "n_used")
        got = one if got is None else got.unionByName(one)
    return got


_SIZES = "WITH s AS (SELECT list_sort(list(octet_length(encode(coalesce(text, ''))))) AS s FROM benchmark), m AS (SELECT s[len(s) // 2 + 1] AS md, s[-1] + CASE WHEN len(s) > 1 THEN s[-2] ELSE 0 END AS pr FROM s)"


@query("window_pressure", f"{_SIZES} SELECT md AS median_bytes, pr AS largest_pair_bytes, 2 * md AS median_pair_bytes, 32768::BIGINT AS window_bytes, pr > 32768 AS worst_case_exceeds_window, 2 * md > 32768 AS median_case_exceeds_window FROM m")
def window_pressure(spark, sf):
    return models.window_pressure(read(spark, sf, "benchmark"))


@query("ncd_by_compressor")
def ncd_by_compressor(spark, sf):
    """Mean compression distance of each two passages under three compressors."""
    b = read(spark, sf, "benchmark")
    pairs = cut(b.select(F.col("item_id").alias("a"), F.col("text").alias("ta")).join(bounded(b.select(F.col("item_id").alias("b"), F.col("text").alias("tb"))), F.col("a") < F.col("b")))
    got = None
    for name in models.COMPRESSORS:
        one = models.ncd(pairs, name).agg(F.lit(name).alias("compressor"), F.count("*").alias("n"), F.avg("ncd").alias("mean"), F.min("ncd").alias("least"), F.max("ncd").alias("most"))
        got = one if got is None else got.unionByName(one)
    return got


@query("random_sense", f"WITH {_VALUES}, sn AS (SELECT lemma, pos, list_sort(list(DISTINCT sense)) AS s FROM tr GROUP BY lemma, pos) SELECT document, sent::BIGINT AS sent, place::BIGINT AS place, coalesce(s[1 + floor({uniform_sql(41, 'document', 'sent', 'place')} * len(s))::INT], 1)::BIGINT AS predicted FROM te LEFT JOIN sn USING (lemma, pos)")
def random_sense(spark, sf):
    return models.random_sense(*_tagged(spark))


@query("discourse_oracle", f"WITH {_VALUES}, o AS (SELECT a.document, a.sent, a.place, b.sense, count(*) AS n FROM te a JOIN te b ON a.document = b.document AND a.lemma = b.lemma AND a.pos = b.pos AND (a.sent <> b.sent OR a.place <> b.place) GROUP BY ALL), m AS (SELECT document, sent, place, sense AS top FROM o QUALIFY row_number() OVER (PARTITION BY document, sent, place ORDER BY n DESC, sense) = 1) SELECT document, sent::BIGINT AS sent, place::BIGINT AS place, coalesce(top, mfs, 1)::BIGINT AS predicted FROM te LEFT JOIN m USING (document, sent, place) LEFT JOIN mf USING (lemma, pos)")
def discourse_oracle(spark, sf):
    return models.discourse_oracle(*_tagged(spark))


@query("document_split", f"WITH d AS (SELECT conv_id, row_number() OVER (ORDER BY {uniform_sql(42, 'conv_id')}, conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT conv_id, turn, r > floor(0.7 * n) AS test FROM conversations JOIN d USING (conv_id)")
def document_split(spark, sf):
    """Turns, 70 % of the conversations for training: whole conversations are dealt, in hashed order."""
    c = read(spark, sf, "conversations").select("conv_id", "turn")
    ids = c.select("conv_id").distinct().withColumn("u", uniform(42, "conv_id"))
    n = ids.count()
    edge = ids.select(F.percentile_approx("u", 0.7, 1).alias("x")) if n == 0 else ids.orderBy("u", "conv_id").limit(int(0.7 * n)).agg(F.max(F.struct("u", "conv_id")).alias("x"))
    at = ids.crossJoin(F.broadcast(edge)).select("conv_id", (F.struct("u", "conv_id") > F.col("x")).alias("test")) if n else ids.select("conv_id", F.lit(False).alias("test"))
    return c.join(at, "conv_id").select("conv_id", "turn", F.coalesce("test", F.lit(True)).alias("test"))


# The steps of the count-vector ladder, each added to all before it.
LADDER = (
    ("PPMI + SVD", {}), ("+ dynamic context window", {"dynamic": True}), ("+ subsample frequent words", {"sub": True}), ("+ context distribution smoothing", {"alpha": 0.75}),
    ("+ shifted PMI", {"k": 5.0}), ("+ eigenvalue weighting", {"p": 0.5}), ("+ context vectors", {"context": True}),
)
SUBSAMPLE = 1e-3


def _rungs():
    now, out = {"dynamic": False, "sub": False, "alpha": 1.0, "k": 1.0, "p": 1.0, "context": False}, []
    for label, change in LADDER:
        now = {**now, **change}
        out.append((label, now))
    return out


def _ladder(spark, sf):
    """(label, settings, weights) of the rungs; counts are shared by those that agree on them."""
    stream = _stream(spark, sf)
    counts, weights = {sub: cut(models.pair_counts(stream, VOCAB, SUBSAMPLE if sub else None)) for sub in (False, True)}, {}
    for label, s in _rungs():
        key = (s["dynamic"], s["sub"])
        if key not in weights:
            weights[key] = cut(models.cooccurrence(counts[s["sub"]], dynamic=s["dynamic"]))
        yield label, s, models.pmi(weights[key], alpha=s["alpha"], k=s["k"]).where("value > 1e-9")


def _rung_sql(label, s):
    base = CO
    if s["sub"]:
        base = base.replace("sm AS (SELECT id,", f"s0 AS (SELECT id, row_number() OVER (ORDER BY g) AS pos FROM gp JOIN vb USING (token)), kp AS (SELECT id, least(1, sqrt({SUBSAMPLE} * t / f) + {SUBSAMPLE} * t / f) AS p FROM (SELECT id, count(*)::DOUBLE AS f, sum(count(*)) OVER ()::DOUBLE AS t FROM s0 GROUP BY id)), sm AS (SELECT id, row_number() OVER (ORDER BY pos) AS pos FROM s0 JOIN kp USING (id) WHERE {uniform_sql(43, 'pos')} < p), unused AS (SELECT id,", 1)
    if not s["dynamic"]:
        for d in range(1, 6):
            base = base.replace(f"{(6 - d) / 5}::DOUBLE AS x", "1.0::DOUBLE AS x")
    return f"SELECT '{label}' AS rung, count(*) AS nnz, round(1 - count(*) / ({VOCAB} * {VOCAB}.0), 6) AS sparsity FROM (WITH {base}, {_pmi_sql(s['alpha'], s['k'])})"


@query("count_ladder", " UNION ALL ".join(_rung_sql(*r) for r in _rungs()))
def count_ladder(spark, sf):
    """Cells of the word-context matrix and its sparsity at each rung; the last two change only the factors."""
    got = None
    for label, _, weights in _ladder(spark, sf):
        one = weights.agg(F.lit(label).alias("rung"), F.count("*").alias("nnz"), F.round(1 - F.count("*") / (VOCAB * VOCAB), 6).alias("sparsity"))
        got = one if got is None else got.unionByName(one)
    return got


@query("ladder_vectors")
def ladder_vectors(spark, sf):
    """Words' vectors at each rung."""
    got = None
    for label, s, weights in _ladder(spark, sf):
        one = models.word_vectors(weights, VOCAB, dims=20, p=s["p"], context=s["context"]).select(F.lit(label).alias("rung"), "id", "vec")
        got = one if got is None else got.unionByName(one)
    return got


@query("svd_spectrum")
def svd_spectrum(spark, sf):
    """The twenty largest singular values, exact and by random projection."""
    weights = cut(models.pmi(_weights(spark, sf)))
    exact = models.exact_singular_values(weights, VOCAB, 20)
    vecs = models.word_vectors(weights, VOCAB, dims=20, p=1.0)
    found = vecs.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("randomised"))
    return spark.createDataFrame(list(enumerate(exact)), "i int, exact double").join(found, "i")


def _soundex_sql(word):
    """The census code: equal neighbours are one, h and w do not part them, vowels do."""
    return f"""(SELECT CASE WHEN b = '' THEN '' ELSE upper(b[1]) || substr(replace(array_to_string(list_transform(list_filter(range(2, len(c) + 1), lambda i: c[i] <> c[i - 1]), lambda i: c[i]), ''), '0', '') || '000', 1, 3) END
FROM (SELECT b, string_split(translate(b[1], 'abcdefghijklmnopqrstuvwxyz', '01230127022455012623017202') || replace(translate(b[2:], 'abcdefghijklmnopqrstuvwxyz', '01230127022455012623017202'), '7', ''), '') AS c FROM (SELECT regexp_replace(lower({word}), '[^a-z]', '', 'g') AS b)))"""


def _metaphone_sql(word):
    from ..functions.strings import METAPHONE

    got = f"regexp_replace(lower({word}), '[^a-z]', '', 'g')"
    for a, b in METAPHONE:
        got = f"replace({got}, '{a}', '{b}')"
    return f"(SELECT array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1]), lambda i: c[i]), '') FROM (SELECT string_split(m[1] || regexp_replace(m[2:], '[aeiou]', '', 'g'), '') AS c FROM (SELECT {got} AS m)))"


def _late():
    """SQL of queries that stand in other modules."""
    from .catalogue_models import _CH
    from .catalogue_text import WORDS_SQL

    ORACLES["soundex_match"] = f"WITH {WORDS_SQL} SELECT word, {_soundex_sql('word')} AS code FROM words"
    ORACLES["metaphone_code"] = f"WITH {WORDS_SQL} SELECT word, {_metaphone_sql('word')} AS code FROM words"
    learned = ORACLES["learned_abbreviations"].removeprefix("WITH ").replace("w AS (", "lw AS (", 1).replace("FROM w ", "FROM lw ").replace(" SELECT word, n, round(", ", la AS (SELECT word, n, round(") + " ORDER BY n DESC, word LIMIT 2000)"
    ORACLES["sentence_split_trained"] = f"WITH {_CH}, {learned} SELECT doc_id, count(*) AS n, sum(p)::BIGINT AS places FROM bo WHERE NOT (l[-1:] = '.' AND lower(regexp_extract(l[-60:], '([\\p{{L}}\\p{{N}}'']*)[.!?]$', 1)) IN (SELECT word FROM la)) GROUP BY doc_id"


_late()
