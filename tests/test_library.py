"""Column functions and operators on small inputs with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import strings, text
from textloom.operators import entities, metrics, models, search, statistics
from textloom.operators import vectors as vec
from textloom.sources import readers

STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "falling": "fall", "happy": "happi", "sky": "sky", "relational": "relat", "adoption": "adopt", "at": "at"}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(("word", "stem"), STEMS.items())
def test_porter(word, stem):
    assert text.porter_stem(word) == stem


def test_tokenizers(spark):
    t = F.col("t")
    assert one(spark, text.words(t), t="The cat's 2 mats.") == ["the", "cat", "s", "2", "mats"]
    assert len(one(spark, text.code_tokens(t), t="if (x) { y++; }")) == 10
    assert one(spark, text.code_tokens(t), t=None) == []
    assert one(spark, text.opinion_tokens(t), t="Don't stop! ''") == ["dont", "stop", "!", "''"]
    assert one(spark, text.char_ngrams(t, 1), t="") == ["_", "_"]
    assert one(spark, text.tokenizer(remove_stopwords=True, stemmed=True, min_length=3)(t), t="The ponies are at sea") == ["poni", "sea"]
    assert one(spark, text.normalise_structural(t), t='int f(int a) { return a + 10; } // "x"') == "int V(int V) { return V + V; }"


def test_shingles(spark):
    d = spark.createDataFrame([([f"w{i}" for i in range(20)],), (["a", "b"],), ([],)], "t array<string>")
    assert [r[0] for r in d.select(F.size(text.shingles(F.col("t")))).collect()] == [16, 1, 0]


def test_strings(spark):
    assert strings.osa("ca", "abc") == 3 and strings.osa("form", "from") == 1 and strings.osa("", "abc") == 3
    assert abs(strings.jaro("martha", "marhta") - 0.944444) < 1e-5 and strings.jaro("", "") == 1.0
    assert strings.keyboard("cat", "cst") == 0.4
    assert [one(spark, strings.soundex(F.col("w")), w=w) for w in ("Ashcraft", "Tymczak", "Pfister", "12")] == ["A261", "T522", "P236", ""]
    assert one(spark, strings.metaphone(F.col("w")), w="phone") == "fn"
    assert one(spark, strings.similarity("levenshtein", F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)


@pytest.mark.parametrize("call", [lambda: text.view("no", F.lit("x")), lambda: strings.similarity("no", F.lit("x"), F.lit("y")), lambda: strings.corrupt("no", F.lit("x"), 1), lambda: statistics.association("no"), lambda: entities.sentiment("no", F.lit("x"), F.lit("x")), lambda: models.compressed_length("no")])
def test_unknown_names(spark, call):
    with pytest.raises(ValueError):
        call()


def test_association(spark):
    d = spark.createDataFrame([(25.0, 25.0, 25.0, 25.0)], "a double, b double, c double, d double")
    row = d.select(*[statistics.association(m).alias(m) for m in statistics.MEASURES]).first()
    assert row["pmi"] == 0 and row["chi2"] == 0 and abs(row["llr"]) < 1e-9


def test_zeta(spark):
    got = spark.range(1).select(statistics.zeta(F.lit(2.0), F.lit(1.0)), statistics.zeta(F.lit(1.0), F.lit(1.0))).first()
    assert abs(got[0] - math.pi**2 / 6) < 1e-12 and got[1] is None


def test_bm25_and_metrics(spark):
    docs = spark.createDataFrame([(0, "the cat sat on the mat"), (1, "dogs bark"), (2, "quantum states of matter"), (3, "quantum field theory"), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quantum theory")], "item_id long, text string")
    got = search.ranked(search.bm25(docs, items), 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [3, 2]
    gold = spark.createDataFrame([(1, 2), (9, 0)], "qid long, doc_id long")
    m = {r["k"]: r for r in metrics.recall_mrr(search.ranked(search.bm25(docs, items), 10), gold, [1, 2]).collect()}
    assert m[1]["recall"] == 0 and m[2]["recall"] == 0.5 and m[1]["mrr"] == 0.25


def test_rerank(spark):
    first = spark.createDataFrame([(1, 10 + i, i + 1) for i in range(5)], "qid long, doc_id long, rank int")
    scores = spark.createDataFrame([(1, 10 + i, float(i + 1)) for i in range(5)], "qid long, doc_id long, rerank_score double")
    got = search.rerank(first, scores, [0, 3]).orderBy("depth", "rank").collect()
    assert [r["doc_id"] for r in got] == [10, 11, 12, 13, 14, 12, 11, 10, 13, 14]


def test_sentiment(spark):
    lex = F.create_map(F.lit("good"), F.lit(1.0), F.lit("bad"), F.lit(-1.0))
    d = spark.createDataFrame([("not very good",), ("good but bad",), ("",)], "t string").select(text.opinion_tokens(F.col("t")).alias("t"))
    assert [r[0] for r in d.select(entities.sentiment("contrastive", F.col("t"), lex)).collect()] == [-1.5, -1.0, 0.0]


def test_sentences(spark):
    d = spark.createDataFrame([(1, "One sentence. "), (2, "A. B! C? D"), (3, "Dr. Who is 3.5 here."), (4, None)], "doc_id long, text string")
    n = {r["doc_id"]: r["n"] for r in entities.boundaries(d, "naive").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 1, 2: 3, 3: 1}
    assert entities.boundaries(d, "abbreviation").where("doc_id = 3").count() == 0


def test_matching_is_one_to_one(spark):
    found = spark.createDataFrame([(1, 5), (1, 6), (1, 20)], "doc_id long, at int")
    wanted = spark.createDataFrame([(1, 5), (2, 9)], "doc_id long, at int")
    r = entities.matched(found, wanted).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 1)


def test_longest_first(spark):
    tags = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 1, 3), (1, 3, 5, 1)], "doc_id long, pattern long, start int, n int")
    assert sorted(r["pattern"] for r in entities.longest_first(tags).collect()) == [2, 3]


def test_vectors(spark):
    e = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(5)], "vec_id long, embedding array<double>")
    got = vec.cosine_topk(e.where("vec_id = 0"), e, 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2]
    with pytest.raises(ValueError):
        vec.pooled(e, "no", "vec_id", "vec_id", "embedding")


def test_pmi(spark):
    pairs = spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 5.0)], "w int, c int, x double")
    got = {(r["w"], r["c"]): r["value"] for r in models.pmi(pairs).collect()}
    assert got[0, 0] == pytest.approx(math.log(0.3 / 0.16)) and (0, 1) not in got


def test_bootstrap(spark):
    d = spark.createDataFrame([(i, 1.0) for i in range(20)], "qid long, d double")
    r = metrics.paired_bootstrap(d, 50).first()
    assert r["mean"] == 1.0 and r["lo"] == 1.0 and r["significant"]


def test_readers(spark):
    lines = spark.createDataFrame([("good\t2.0\tx",), ("bad\t-4.0",), ("broken",), ("odd\tnope",)], "value string")
    assert {r["word"]: r["polarity"] for r in readers.lexicon_scored(lines).collect()} == {"good": 0.5, "bad": -1.0}
    sgml = spark.createDataFrame([("d", '<s snum=1><wf cmd=done pos=NN lemma=bank wnsn=1;3>bank</wf><wf cmd=ignore pos=DT>the</wf></s>')], "document string, content string")
    assert [(r["lemma"], r["sense"], r["surface"]) for r in readers.tagged_sentences(sgml).collect()] == [("bank", 1, "bank")]
    index = spark.createDataFrame([("bank n 2 1 @ 2 1 00001 00002",)], "value string")
    assert [(r["sense"], r["offset"]) for r in readers.sense_index(index).orderBy("sense").collect()] == [(1, "00001"), (2, "00002")]
    s = spark.createDataFrame([(["a" * 30, "b" * 30],)], "sentences array<string>")
    assert readers.joined_sentences(s).first()["at"] == [30]


def test_language_profiles_join_whole_texts(spark):
    from textloom.plans.catalogue_factors import _profiles

    rows = [(i, "en", f"{i} " + "word " * 600) for i in range(40)] + [(100, "de", None), (101, "de", "kurz")]
    got = {r["label"]: r["p"] for r in _profiles(spark.createDataFrame(rows, "doc_id long, label string, text string")).collect()}
    assert got == {"en": " ".join(t for _, label, t in rows if label == "en")[:8000], "de": "kurz"}


def test_random_control_ranks_every_item(spark, tmp_path):
    from textloom.plans import catalogue

    spark.range(3).selectExpr("id AS doc_id", "'a' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(10_500).selectExpr("id AS item_id", "'a' AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert catalogue.QUERIES["random_control"](spark, str(tmp_path)).select("qid").distinct().count() == 10_500
