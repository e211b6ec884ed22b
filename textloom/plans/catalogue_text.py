"""Queries over tokens, vocabularies, views and string functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import strings, text
from .registry import TOK, query
from .tables import postings, read, tokens

COUNTS = f"WITH {TOK}, c AS (SELECT token, count(*) AS cnt FROM tok GROUP BY token)"


@query("token_counts", f"{COUNTS} SELECT token, cnt FROM c")
def token_counts(spark, sf):
    return tokens(read(spark, sf, "documents")).groupBy("token").agg(F.count("*").alias("cnt"))


@query("vocab_top", f"{COUNTS} SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) AS rank FROM c QUALIFY rank <= 1000")
def vocab_top(spark, sf):
    top = token_counts(spark, sf).orderBy(F.col("cnt").desc(), "token").limit(1000)  # the feature is a top list
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("cnt").desc(), "token")))


@query("doc_lengths", "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))::BIGINT AS len FROM documents")
def doc_lengths(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("len"))


def _counts(name, table, key, column, tokenize, pattern, lower=False):
    source = f"lower(coalesce({column}, ''))" if lower else f"coalesce({column}, '')"
    sql = f"SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all({source}, '{pattern}')) AS token FROM {table}) GROUP BY token"
    query(name, sql)(lambda spark, sf: tokens(read(spark, sf, table), key, column, tokenize).groupBy("token").agg(F.count("*").alias("cnt")))


_counts("code_tokens", "documents", "doc_id", "text", text.code_tokens, r"[A-Za-z_][\p{L}\p{N}_]*|[0-9]+|[^\s\p{L}\p{N}_]")
_counts("code_tokens_parts", "part", "p_partkey", "p_name", text.code_tokens, r"[A-Za-z_][\p{L}\p{N}_]*|[0-9]+|[^\s\p{L}\p{N}_]")
_counts("word_tokens", "documents", "doc_id", "text", text.words_underscore, "[a-z0-9_]+", lower=True)
_counts("urdu_tokens", "documents", "doc_id", "text", lambda c: text.matches(c, text.URDU), text.URDU)
_counts("opinion_tokens_raw", "conversations", "conv_id", "text", lambda c: text.matches(F.lower(c), text.OPINION), "[a-z'']+|[!?]", lower=True)


@query("char_ngrams", """
WITH p AS (SELECT p_partkey, '_' || coalesce(p_name, '') || '_' AS s FROM part)
SELECT g AS gram, count(*) AS cnt FROM (SELECT substr(s, i, n) AS g FROM p, unnest([1, 2, 3, 4, 5]) AS r(n), unnest(range(1, length(s) - n + 2)) AS q(i)) GROUP BY g""")
def char_ngrams(spark, sf):
    return read(spark, sf, "part").select(F.explode(text.char_ngrams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt"))


def _in(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@query("token_views", None)
def token_views(spark, sf):
    d = read(spark, sf, "documents").select("text")
    one = lambda n: d.select(F.lit(n).alias("view"), F.explode(text.view(n, F.col("text"))).alias("token"))
    got = one("lexical").unionByName(one("masked")).unionByName(one("structural")).unionByName(one("layout"))
    return got.groupBy("view", "token").agg(F.count("*").alias("cnt"))


@query("layout_view", r"""
WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents),
b AS (SELECT x, regexp_replace(regexp_replace(x, '^[\s\x{b}\x{a0}\x{2028}]+', ''), '[\s\x{b}\x{a0}\x{2028}]+$', '') AS s, length(x) - length(regexp_replace(x, '^[\s\x{b}\x{a0}\x{2028}]+', '')) AS ind FROM l),
f AS (SELECT unnest(list_filter([
 'len' || CASE WHEN length(x) < 20 THEN 0 WHEN length(x) < 40 THEN 1 WHEN length(x) < 60 THEN 2 WHEN length(x) < 80 THEN 3 WHEN length(x) < 120 THEN 4 ELSE 5 END,
 'ind' || CASE WHEN ind < 1 THEN 0 WHEN ind < 2 THEN 1 WHEN ind < 4 THEN 2 WHEN ind < 8 THEN 3 ELSE 4 END,
 CASE WHEN s = '' THEN 'blank' END, CASE WHEN starts_with(s, '/*') OR starts_with(s, '*') OR starts_with(s, '//') THEN 'comment' END,
 CASE WHEN starts_with(s, '{') THEN 'brace_own_line' END, CASE WHEN ends_with(s, '{') THEN 'brace_trailing' END, CASE WHEN starts_with(s, '#') THEN 'preprocessor' END,
 CASE WHEN ends_with(s, ';') THEN 'stmt_end' END, CASE WHEN s <> '' AND contains(x, chr(9)) THEN 'tab' END], lambda v: v IS NOT NULL)) AS feature FROM b)
SELECT feature, count(*) AS cnt FROM f GROUP BY feature""")
def layout_view(spark, sf):
    return read(spark, sf, "documents").select(F.explode(text.view("layout", F.col("text"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("cnt"))


def _variant(name, lower, stops, least):
    tok = "lower(coalesce(text, ''))" if lower else "coalesce(text, '')"
    pattern = "[a-z0-9]+" if lower else "[A-Za-z0-9]+"
    where = " AND ".join(["true", *([f"lower(token) NOT IN ({_in(text.STOPWORDS)})"] if stops else []), *([f"length(token) >= {least}"] if least else [])])
    return f"SELECT '{name}' AS variant, count(DISTINCT token) AS vocabulary, count(*) AS total_tokens FROM (SELECT unnest(regexp_extract_all({tok}, '{pattern}')) AS token FROM documents) WHERE {where}"


def _variant_query(variant):
    def run(spark, sf):
        per = tokens(read(spark, sf, "documents"), tokenize=text.tokenizer(**text.VARIANTS[variant])).groupBy("token").agg(F.count("*").alias("n"))
        return per.agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens")).select(F.lit(variant).alias("variant"), "vocabulary", "total_tokens")

    return run


for _name, _key, _args in (("tokens_baseline", "baseline", (True, False, 0)), ("stopword_filter", "stopwords", (True, True, 0)), ("min_length_filter", "min length 3", (True, False, 3)), ("case_sensitive", "cased", (False, False, 0))):
    query(_name, _variant(_key, *_args))(_variant_query(_key))


@query("stemmed_variants")
def stemmed_variants(spark, sf):
    """The variants with stemming: distinct words are stemmed once each, then counted."""
    counts = token_counts(spark, sf)
    stems = counts.select("cnt", text.stem(F.col("token")).alias("stem"), F.col("token").isin(text.STOPWORDS).alias("stop"))
    rows = stems.select("cnt", "stem", F.explode(F.array_compact(F.array(F.lit("porter"), F.when(~F.col("stop"), "stopwords and stem"), F.when(~F.col("stop") & (F.length("stem") >= 3), "full")))).alias("variant"))
    return rows.groupBy("variant", "stem").agg(F.sum("cnt").alias("n")).groupBy("variant").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("total_tokens"))


@query("porter_stem_vocab")
def porter_stem_vocab(spark, sf):
    return token_counts(spark, sf).select(F.col("token").alias("term"), text.stem(F.col("token")).alias("stem"))


@query("first_seen_vocab", f"WITH {TOK} SELECT token, count(*) AS cnt, min(doc_id * 1000000 + pos) AS first_pos, row_number() OVER (ORDER BY count(*) DESC, min(doc_id * 1000000 + pos)) AS rank FROM tok GROUP BY token HAVING count(*) >= 3 QUALIFY rank <= 20000")
def first_seen_vocab(spark, sf):
    """Vocabulary by count, ties by first occurrence, capped as a parameter (20,000)."""
    n = tokens(read(spark, sf, "documents")).groupBy("token").agg(F.count("*").alias("cnt"), F.min(F.col("doc_id") * 1000000 + F.col("pos")).alias("first_pos")).where("cnt >= 3")
    top = n.orderBy(F.col("cnt").desc(), "first_pos").limit(20000)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("cnt").desc(), "first_pos")))


@query("stripped_titles", r"SELECT p_partkey, trim(regexp_replace(p_name || ' (x)', '\s*\([^)]*\)\s*$', '')) AS title FROM part")
def stripped_titles(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.strip_disambiguator(F.concat("p_name", F.lit(" (x)"))).alias("title"))


def _words(spark, sf):
    """Words of part names, the candidates of string search."""
    return postings(read(spark, sf, "part"), "p_partkey", "p_name").select(F.col("token").alias("word")).where(F.length("word") >= 4).distinct()


WORDS_SQL = "words AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(coalesce(p_name, '')), '[a-z0-9]+')) AS w FROM part) WHERE length(w) >= 4)"
_U = "(('0x' || substr(md5(concat_ws(':', '{seed}', word)), 1, 8))::BIGINT / 4294967296.0)"
#: A transposition at a hashed place: the error model of the string searches below.
BAD_SQL = f"{WORDS_SQL}, bad AS (SELECT word, substr(word, 1, p) || substr(word, p + 2, 1) || substr(word, p + 1, 1) || substr(word, p + 3) AS typed FROM (SELECT word, floor({_U.format(seed=3)} * (length(word) - 1))::INT AS p FROM words))"


def _typed(spark, sf):
    return strings.transposed(_words(spark, sf), "word", 3)


@query("levenshtein_match", f"WITH {BAD_SQL}, d AS (SELECT a.word, a.typed, b.word AS candidate, levenshtein(a.typed, b.word) AS distance, rank() OVER (PARTITION BY a.word ORDER BY levenshtein(a.typed, b.word)) AS r FROM bad a, words b WHERE a.typed <> a.word), best AS (SELECT word, typed, any_value(distance) AS distance, count(*) AS n, min(candidate) AS first FROM d WHERE r = 1 GROUP BY word, typed) SELECT word, typed, distance, n, n = 1 AND first = word AS correct FROM best")
def levenshtein_match(spark, sf):
    """Every changed word against all candidates, in one block of candidates; right only if the best is unique."""
    return strings.retrieve(_typed(spark, sf), _words(spark, sf), lambda a, b: F.levenshtein(a, b))


@query("string_measures")
def string_measures(spark, sf):
    """All measures of each changed word with its original."""
    t = _typed(spark, sf)
    return t.select("word", "typed", *[F.round(strings.similarity(m, F.col("word"), F.col("typed")), 6).alias(m) for m in strings.MEASURES])


@query("jaro_winkler", f"WITH {BAD_SQL}, j AS (SELECT word, typed, jaro_similarity(word, typed) AS j, length(word) AS n FROM bad) SELECT word, typed, round(j, 6) AS jaro, round(j + 0.1 * (1 - j) * CASE WHEN substr(word, 1, 4) = substr(typed, 1, 4) THEN 4 WHEN substr(word, 1, 3) = substr(typed, 1, 3) THEN 3 WHEN substr(word, 1, 2) = substr(typed, 1, 2) THEN 2 WHEN substr(word, 1, 1) = substr(typed, 1, 1) THEN 1 ELSE 0 END, 6) AS jaro_winkler FROM j")
def jaro_winkler(spark, sf):
    return _typed(spark, sf).select("word", "typed", F.round(strings.similarity("jaro", F.col("word"), F.col("typed")), 6).alias("jaro"), F.round(strings.similarity("jaro_winkler", F.col("word"), F.col("typed")), 6).alias("jaro_winkler"))


@query("bigram_jaccard", f"WITH {BAD_SQL}, g AS (SELECT word, typed, list_distinct(list_transform(range(1, length(word)), lambda i: substr(word, i, 2))) AS a, list_distinct(list_transform(range(1, length(typed)), lambda i: substr(typed, i, 2))) AS b FROM bad) SELECT word, typed, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score FROM g")
def bigram_jaccard(spark, sf):
    return _typed(spark, sf).select("word", "typed", F.round(strings.similarity("bigram", F.col("word"), F.col("typed")), 6).alias("score"))


@query("soundex_match")
def soundex_match(spark, sf):
    return _words(spark, sf).select("word", strings.soundex(F.col("word")).alias("code"))


@query("metaphone_code")
def metaphone_code(spark, sf):
    return _words(spark, sf).select("word", strings.metaphone(F.col("word")).alias("code"))


@query("corrupted_words")
def corrupted_words(spark, sf):
    w = _words(spark, sf)
    return w.select("word", strings.corrupt("typing", F.col("word"), 7).alias("typing"), strings.corrupt("phonetic", F.col("word"), 7).alias("phonetic"))
