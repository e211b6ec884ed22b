"""Readers of the corpora's file formats, and sinks. Paths are parameters; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rng import uniform


def nested_questions(rows: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and queries of nested question rows (id, question, level, type, context, supporting_facts).

    Documents: (doc_id = title, text = sentences joined by a space), the first copy of a title
    by (row id, place). Queries: (qid, question, gold: distinct titles in order, level, type).
    """
    r = rows if limit is None else rows.orderBy("id").limit(limit)
    flat = r.select("id", F.posexplode(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))).alias("at", "c")).select("id", "at", "c.title", "c.sentences")
    w = W.partitionBy("title").orderBy("id", "at")
    docs = flat.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("title").alias("doc_id"), F.trim(F.array_join("sentences", " ")).alias("text"))
    missing = [F.col(c) if c in rows.columns else F.lit("").alias(c) for c in ("level", "type")]
    return docs, r.select(F.col("id").alias("qid"), "question", F.array_distinct("supporting_facts.title").alias("gold"), *missing)


def seeded_subset(df: DataFrame, n: int, key: str, seed: int = 7) -> DataFrame:
    """n rows by hash of their key: a subset without replacement that does not depend on row order."""
    return df.orderBy(uniform(seed, key), key).limit(n)


def truncated(tok: DataFrame, n: int) -> DataFrame:
    """The first n tokens of a stream with global places from 1 in ``g``."""
    return tok.where(F.col("g") <= n)


def _rescaled(df: DataFrame) -> DataFrame:
    """Divided by the largest magnitude; all zeros stay."""
    top = df.agg(F.coalesce(F.nullif(F.max(F.abs("polarity")), F.lit(0.0)), F.lit(1.0)).alias("top"))
    return df.crossJoin(F.broadcast(top)).select("word", (F.col("polarity") / F.col("top")).alias("polarity"))


def _parts(line: Column) -> Column:
    return F.split(line, "\t")


def _last(rows: DataFrame) -> DataFrame:
    return _rescaled(rows.where("polarity is not null and word != ''").groupBy("word").agg(F.max_by("polarity", "at").alias("polarity")))


def _place(order: str | None) -> Column:
    """What tells a later line from an earlier one: a column, or the place in the lines as they are read."""
    return (F.monotonically_increasing_id() if order is None else F.col(order)).alias("at")


def lexicon_scored(lines: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """word TAB score TAB ...; malformed rows are skipped; the last row of a word, by ``order``, counts."""
    p = lines.select(_parts(F.col(column)).alias("p"), _place(order)).where(F.size("p") >= 2)
    return _last(p.select("at", F.lower(F.trim(F.get("p", F.lit(0)))).alias("word"), F.get("p", F.lit(1)).try_cast("double").alias("polarity")))


def lexicon_lists(positive: DataFrame, negative: DataFrame, column: str = "value") -> DataFrame:
    """Two lists of words, ``;`` beginning a comment; a word in both is negative."""
    words = lambda d, v: d.select(F.lower(F.trim(F.col(column))).alias("word")).where("word != '' and not startswith(word, ';')").select("word", F.lit(v).alias("polarity"))
    both = words(positive, 1.0).unionByName(words(negative, -1.0))
    return both.groupBy("word").agg(F.min("polarity").alias("polarity"))


def lexicon_senses(lines: DataFrame, column: str = "value", senses: int = 3) -> DataFrame:
    """pos TAB id TAB positive TAB negative TAB terms#rank: mean of the first non-zero senses by rank; underscores are blanks."""
    p = lines.where(~F.col(column).startswith("#")).select(_parts(F.col(column)).alias("p")).where(F.size("p") >= 5)
    rows = p.select((F.get("p", F.lit(2)).try_cast("double") - F.get("p", F.lit(3)).try_cast("double")).alias("s"), F.explode(F.split(F.get("p", F.lit(4)), r"\s+")).alias("t"))
    term = lambda i: F.regexp_extract("t", r"^(.+)#([0-9]+)$", i)
    rows = rows.select("s", F.lower(F.replace(term(1), F.lit("_"), F.lit(" "))).alias("word"), term(2).try_cast("int").alias("rank")).where("s is not null and s != 0 and rank is not null")
    w = W.partitionBy("word").orderBy("rank", "s")
    return _rescaled(rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= senses).groupBy("word").agg(F.avg("s").alias("polarity")))


def lexicon_last_tab(lines: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """Phrases and scores parted by the last tab; the last row of a phrase, by ``order``, counts."""
    v = F.col(column)
    got = lines.where(F.instr(v, "\t") > 0).select(_place(order), F.lower(F.trim(F.regexp_extract(v, r"^(.*)\t[^\t]*$", 1))).alias("word"), F.substring_index(v, "\t", -1).try_cast("double").alias("polarity"))
    return _last(got)


def sentence_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """One sentence a line, (text)."""
    return spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").csv(path, schema="text string").where("text is not null and trim(text) != ''").select(F.trim("text").alias("text"))


def json_texts(lines: DataFrame, column: str = "value") -> DataFrame:
    """The ``text`` of JSON lines; lines that do not parse are skipped."""
    return lines.select(F.get_json_object(column, "$.text").alias("text")).where("text is not null")


def tagged_sentences(files: DataFrame, document: str = "document", content: str = "content") -> DataFrame:
    """Sense-tagged SGML: (document, sent, place, lemma, pos, sense, surface) of finished tokens; the first of several senses; senses from 1."""
    s = files.select(document, F.posexplode(F.regexp_extract_all(content, F.lit(r"(?s)<s [^>]*>(.*?)</s>"), F.lit(1))).alias("sent", "body"))
    w = s.select(document, "sent", F.posexplode(F.regexp_extract_all("body", F.lit(r"<wf [^>]*>[^<]*</wf>"), F.lit(0))).alias("place", "wf"))
    attr = lambda n: F.regexp_extract("wf", rf"\b{n}=\"?([^\s\">]+)", 1)
    rows = w.select(document, "sent", "place", attr("cmd").alias("cmd"), attr("lemma").alias("lemma"), attr("pos").alias("pos"), F.substring_index(attr("wnsn"), ";", 1).try_cast("int").alias("sense"), F.regexp_extract("wf", ">([^<]*)<", 1).alias("surface"))
    return rows.where("cmd = 'done' and lemma != '' and sense >= 1").drop("cmd")


def sense_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """Space-delimited index lines (lemma pos synsets p_cnt pointers... senses tagged offsets...): (lemma, pos, sense, offset)."""
    p = lines.where(~F.col(column).startswith(" ")).select(F.split(F.trim(column), " +").alias("p"))
    skip = F.get("p", F.lit(3)).try_cast("int") + 6
    return p.where(skip.isNotNull()).select(F.get("p", F.lit(0)).alias("lemma"), F.get("p", F.lit(1)).alias("pos"), F.posexplode(F.slice("p", skip + 1, F.greatest(F.size("p") - skip, F.lit(0)))).alias("i", "offset")).select("lemma", "pos", (F.col("i") + 1).alias("sense"), "offset")


def sense_glosses(lines: DataFrame, column: str = "value") -> DataFrame:
    """(offset, gloss): what follows the first bar of a data line."""
    return lines.where(~F.col(column).startswith(" ")).select(F.substring_index(column, " ", 1).alias("offset"), F.trim(F.regexp_extract(column, r"^[^|]*\|(.*)$", 1)).alias("gloss"))


def fold_pos(tag: Column) -> Column:
    """Penn tags to n, v, a, r; null for others."""
    return F.when(tag.startswith("NN"), "n").when(tag.startswith("VB"), "v").when(tag.startswith("JJ"), "a").when(tag.startswith("RB"), "r")


def title_queries(articles: DataFrame, least_body: int = 60, least_title: int = 1) -> DataFrame:
    """Titles as queries for their own body, the title being blanked in the body: (title, body)."""
    body = F.replace("text", F.col("title"), F.lit(" "))
    rows = articles.select("title", body.alias("body")).withColumn("tb", text.urdu_tokens(F.col("body"))).withColumn("tt", text.urdu_tokens(F.col("title")))
    return rows.where((F.size("tb") >= least_body) & (F.size("tt") >= least_title)).select("title", "body")


def joined_sentences(rows: DataFrame, sentences: str = "sentences", least: int = 40) -> DataFrame:
    """(text, at): sentences set one after the other, and the offsets where one ends inside the text."""
    ends = F.aggregate(F.slice(sentences, 1, F.size(sentences) - 1), F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(x))))
    return rows.where(F.size(sentences) > 1).select(F.array_join(sentences, "").alias("text"), ends.alias("at")).where(F.length("text") > least)


def upsert(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """``old`` with rows of ``new`` in place of those that share the key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_rows(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrites ``path``; kind: parquet or json."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"unknown sink {kind!r}")
    df.write.mode("overwrite").format(kind).save(path)
