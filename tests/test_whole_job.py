"""Whole jobs: rows that were left out before, and plans that must not meet all rows one by one."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import blocks, dedup, entities, factors, metrics, models, scan, search, statistics
from textloom.operators import vectors as vec
from textloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def brute(x, k):
    u = blocks.units(x)
    s = np.array([[blocks.scored(u[i : i + 1], u[j : j + 1])[0] for j in range(len(x))] for i in range(len(x))])
    return {(i, r + 1): j for i in range(len(x)) for r, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:k])}


def test_search_multiplies_blocks(spark):
    """no nested loop over pairs, and the same ranks, ties by id, as all pairs one by one."""
    x = np.random.default_rng(3).integers(-2, 3, (150, 6)).astype(float)  # many equal cosines
    x[17] = 0.0
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    got = vec.cosine_topk(e, e, 5)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert {(r["qid"], r["rank"]): r["vec_id"] for r in got.collect()} == brute(x, 5)


def test_search_with_odd_vectors(spark):
    """Rows without a usable vector keep the places that the expression gives them."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [float("nan"), 1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vec.cosine_topk(e.where("vec_id < 2"), e, 3).orderBy("qid", "rank").collect()
    assert [r["vec_id"] for r in got] == [3, 1, 2, 3, 0, 2]


@pytest.mark.parametrize("tile", [3, 64])
def test_block_tiles(tile, monkeypatch):
    monkeypatch.setattr(blocks, "TILE_Q", tile)
    monkeypatch.setattr(blocks, "TILE_D", tile)
    monkeypatch.setattr(blocks, "KEPT", 50)
    x = blocks.units(np.random.default_rng(4).standard_normal((60, 4)))
    a, b, s = blocks.best_of(np.arange(60), x, np.arange(60), x, 4, True)
    at = blocks.first_k(a, s, b, 4)
    want = brute(x, 4)
    assert sorted(zip(a[at], b[at], strict=True)) == sorted((q, d) for (q, _), d in want.items())


@pytest.mark.parametrize("name", ["knn_vote", "neighbour_agreement"])
def test_every_row_asks(spark, tmp_path, name):
    """rows whose ids 20 does not divide are counted too."""
    rows = [(i, [float(np.float32(np.cos(i + j))) for j in range(64)], i % 2) for i in range(1, 20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert got and all(x is not None for r in got for x in r)
    assert "% 20" not in catalogue.ORACLES[name]


def test_compression_pairs_are_dealt_out(spark):
    """pairs of a table in one file do not stay in one task."""
    b = spark.createDataFrame([(i, f"text number {i}") for i in range(6)], "a int, ta string").coalesce(1)
    got = models.ncd(b.crossJoin(b.selectExpr("a as b", "ta as tb").coalesce(1)).where("a < b").coalesce(1), "gzip")
    assert "REPARTITION_BY_NUM" in plan(got) and got.count() == 15


def test_resamples_are_summed_in_tasks(spark):
    """F8: weights of Poisson counts by hash, without a row for each key and resample."""
    per = spark.createDataFrame([(i, float(i % 3), 2.0) for i in range(40)], "conv_id long, c double, n double")
    got = {r["b"]: (r["c"], r["n"]) for r in metrics.poisson_sums(per, "conv_id", ["c", "n"], 30, 17).collect()}
    below = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13)]
    for b in range(1, 31):
        w = [sum(c <= int(hashlib.md5(f"17:{b}:{i}".encode()).hexdigest()[:8], 16) / 2**32 for c in below) for i in range(40)]
        assert got[b] == (sum(w[i] * (i % 3) for i in range(40)), 2.0 * sum(w))
    assert "Generate explode(sequence" not in plan(catalogue.QUERIES["spread_bootstrap"](spark, SF))


def top(df, k, by):
    got = search.ranked(df.withColumn("both", F.concat_ws("/", *by)), k, by="both").collect()
    return {(*[r[c] for c in by], r["rank"]): (r["doc_id"], round(r["score"], 8)) for r in got}


def test_documents_are_scored_inside_tasks(spark, monkeypatch):
    """The same best documents as from a row for each document, query and scheme."""
    monkeypatch.setattr(scan, "FREQUENT", 40)  # most words' frequencies are joined
    monkeypatch.setattr(scan, "SLICE", 3)
    monkeypatch.setattr(scan, "HITS", 500)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id < 8").select("item_id", "text")
    assert top(search.bm25_best(docs, items, 4), 4, ["qid"]) == top(search.bm25(docs, items), 4, ["qid"])
    assert top(search.tfidf_best(docs, items, 4), 4, ["qid"]) == top(search.tfidf(docs, items), 4, ["qid"])
    some = ["ntc", "lpu", "atn", "bnc", "Lpc", "ltu"]
    assert top(search.smart_best(docs, items, 4, some, ["ltc"]), 4, ["scheme", "qid"]) == top(search.smart_grid(docs, items, some), 4, ["scheme", "qid"])
    assert top(search.smart_best(docs, items, 4, ["lnc"], some), 4, ["scheme", "qid"]) == top(search.smart_query_grid(docs, items, some), 4, ["scheme", "qid"])


def test_words_of_passes(spark):
    """Letters that become ASCII in lower case are words there too, and the first place of a word is by document, then place."""
    docs = spark.createDataFrame([(2, "b A b"), (1, "Kİx9 éa A"), (3, None)], "doc_id long, text string")
    got = {r["token"]: (r["n"], tuple(r["first"])) for r in scan.word_counts(docs).collect()}
    want = docs.select("doc_id", F.posexplode(text.words(F.col("text"))).alias("pos", "token")).groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).collect()
    assert got == {r["token"]: (r["n"], tuple(r["first"])) for r in want} and len(got) > 3
    assert {r["token"]: r["df"] for r in scan.document_frequencies(docs).collect()}["a"] == 2


def test_grams_in_bounded_tables(spark, monkeypatch):
    """a task holds few texts' grams at a time; counts and first places are those of each text by itself."""
    assert models.CHARS <= 4_000_000
    monkeypatch.setattr(models, "CHARS", 15)
    texts = [("a", "abcab"), ("a", "cab_é"), ("b", None), ("b", "")] * 3 + [("a", "x" * 40)]
    d = spark.createDataFrame(texts, "label string, text string")
    want = {}
    for label, t in texts:
        s = f"_{t or ''}_"
        for n in range(1, 6):
            for i in range(len(s) - n + 1):
                c, f = want.get((label, s[i : i + n]), (0, 10**18))
                want[label, s[i : i + n]] = (c + 1, min(f, n * models.PLACES + i + 1))
    assert {(r["label"], r["gram"]): (r["cnt"], r["first"]) for r in models.counted_grams(d, ["label"]).collect()} == want


def test_texts_are_placed_where_they_are_read(spark, monkeypatch):
    """the same languages as by a row for each gram, which stays for profiles too many for every task."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text")
    profiles = models.top_grams(models.counted_grams(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("lang").alias("label"), "text"), ["label"]), ["label"])
    got = models.placed(profiles, docs, "doc_id", [10, 40])
    opened = docs.withColumn("length", F.explode(F.array(F.lit(10), F.lit(40)))).withColumn("text", F.expr("substring(coalesce(text, ''), 1, length)"))
    want = models.out_of_place(profiles, models.top_grams(models.counted_grams(opened, ["length", "doc_id"]), ["length", "doc_id"]), ["length", "doc_id"])
    rows = lambda x: {(r["length"], r["doc_id"]): r["predicted"] for r in x.collect()}
    assert rows(got) == rows(want)
    monkeypatch.setattr(models, "PROFILES", 5)
    assert models.placed(profiles, docs, "doc_id", [10]) is None


@pytest.mark.parametrize("subsample", [None, 0.05])
def test_pairs_across_partitions(spark, subsample):
    """counted inside partitions, with what spans several of them; no row for a word and distance."""
    vocab = [f"w{i}" for i in range(6)]
    rng = np.random.default_rng(5)
    lists = [rng.choice(8, rng.integers(0, 4)).tolist() for _ in range(40)]  # texts shorter than a window
    docs = spark.createDataFrame([(i, " ".join(f"W{x}" for x in own)) for i, own in enumerate(lists)], "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rows = models.encoded(docs, vocab)
        parts = rows.select(F.spark_partition_id()).distinct().count()
        got = {(r["w"], r["c"]): tuple(r[f"n{d}"] for d in range(1, 6)) for r in models.pair_counts(rows, 6, subsample).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert parts > 5
    s = [x for own in lists for x in own if x < 6]
    if subsample is not None:
        f = [s.count(i) for i in range(6)]
        p = [min(1.0, math.sqrt(subsample * len(s) / n) + subsample * len(s) / n) for n in f]
        s = [x for i, x in enumerate(s, 1) if int(hashlib.md5(f"43:{i}".encode()).hexdigest()[:8], 16) / 2**32 < p[x]]
    want = {}
    for d in range(1, 6):
        for a, b in zip(s, s[d:], strict=False):
            want.setdefault((a, b), [0] * 5)[d - 1] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_splitters_in_one_pass(spark):
    """pieces are read once, without a join of three splitters, and offsets are a running sum."""
    docs = spark.createDataFrame([(1, "Dr. Who left. He saw a cat. it ran! Yes? no. " * 20)], "doc_id long, text string")
    got = entities.disagreements(docs)
    assert "Join" not in plan(got)
    naive, short, strict = ({r["at"] for r in entities.boundaries(docs, rule).collect()} for rule in ("naive", "abbreviation", "conservative"))
    assert {r["at"] for r in got.collect()} == naive - (short & strict) and len(naive) == 120 > len(short) > len(strict)


def test_training_grows_with_the_texts(spark):
    """one partition is not asked to train on everything."""
    docs = spark.createDataFrame([(i, [f"w{i % 3}", "x", "y"]) for i in range(40)], "doc_id long, t array<string>")
    one, many = (factors.averaged_vectors(docs, "t", dims=4, characters=c) for c in (0, 3 * factors.TRAINED))
    assert one.getOrDefault("numPartitions") == 1 and many.getOrDefault("numPartitions") == 3


def test_sets_and_signatures_by_expression(spark):
    """the same sets and signatures as the column functions give, worked out in batches."""
    docs = spark.createDataFrame([(1, "a b c d e f a b c d e"), (2, "a B"), (3, ""), (4, None), (5, "x " * 9)], "doc_id long, text string")
    want = docs.select("doc_id", text.words(F.col("text")).alias("t")).select("doc_id", text.shingles(F.col("t"), 5).alias("s"))
    got = dedup.shingle_sets(docs)
    assert "MapInArrow" in plan(got) and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sig = {r["doc_id"]: (r["n_shingles"], r["sig"]) for r in dedup.signatures(want).collect()}
    assert sig == {r["doc_id"]: (r["n"], r["sig"]) for r in want.select("doc_id", F.size("s").alias("n"), dedup.signature(F.col("s")).alias("sig")).collect()}


def test_neighbours_without_a_window(spark):
    """pairs of neighbours are counted where texts are read, and all tops come from one pass."""
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "c A b"), (3, None), (4, "a")], "doc_id long, text string")
    got = statistics.bigrams(docs)
    assert {(r["w1"], r["w2"]): r["a"] for r in got.collect()} == {("a", "b"): 3, ("b", "a"): 1, ("b", "c"): 1, ("c", "a"): 1}
    assert "Window" not in plan(got)
    rows = spark.createDataFrame([(f"w{i % 7}", f"v{i}", i % 5, float(i % 3), float(-i)) for i in range(60)], "w1 string, w2 string, a long, x double, y double").repartition(4)
    tops = {(r["step"], r["measure"], r["w1"], r["w2"]) for r in scan.tops(rows, [1, 3], ["x", "y"], 6).collect()}
    want = set()
    for step, c in enumerate((1, 3)):
        for m in "xy":
            want |= {(step, m, r["w1"], r["w2"]) for r in rows.where(F.col("a") >= c).orderBy(F.col(m).desc(), "w1", "w2").limit(6).collect()}
    assert tops == want
