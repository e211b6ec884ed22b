"""Queries of the readers of corpora's formats: lines of each format are made from the tables, then read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..operators import statistics as st
from ..sources import readers
from .catalogue_stats import GLOBAL
from .registry import query
from .tables import cut, lengths, read, tokens

# Each line is one expression that both engines read.
SCORED = "CASE WHEN p_partkey % 11 = 0 THEN p_type WHEN p_partkey % 13 = 0 THEN concat(p_type, chr(9), 'n/a') ELSE concat(p_type, chr(9), p_size % 9 - 4, chr(9), 'x') END"
LISTED = "CASE WHEN p_partkey % 5 = 0 THEN concat('; ', p_type) ELSE concat(' ', p_type) END"
SENSES = "CASE WHEN p_partkey % 17 = 0 THEN '# remark' ELSE concat('a', chr(9), p_partkey, chr(9), (p_size % 5) / 4.0, chr(9), (p_size % 3) / 4.0, chr(9), replace(lower(p_type), ' ', '_'), '#', p_size % 4 + 1, ' ', replace(lower(p_brand), '#', '_'), '#', p_size % 2 + 1, chr(9), 'gloss') END"
LAST_TAB = "CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE concat(p_type, chr(9), p_size % 11 - 5) END"
INDEX = "CASE WHEN p_partkey % 5 = 0 THEN '  1 license' ELSE concat(replace(lower(p_type), ' ', '_'), ' n 2 1 @ 2 1 ', 10000000 + p_partkey, ' ', 20000000 + p_size, '  ') END"
GLOSS = "CASE WHEN p_partkey % 5 = 0 THEN '  1 license' ELSE concat(10000000 + p_partkey, ' 03 n 01 x 0 | ', p_name, ' | more') END"
TAGGED = "concat('<s snum=1>', '<wf cmd=done pos=NN lemma=a', p_size, ' wnsn=', p_size % 3, ';2 lexsn=1:09:00::>', p_type, '</wf><wf cmd=ignore pos=DT>the</wf><wf cmd=done pos=VBD lemma=run wnsn=', p_size % 4, '>ran</wf></s>')"
JSON = "CASE WHEN p_partkey % 9 = 0 THEN '{broken' ELSE concat('{\"text\": \"', p_name, '\", \"n\": ', p_size, '}') END"
_DIVIDED = "SELECT word, round(s / (SELECT coalesce(nullif(max(abs(s)), 0), 1) FROM w), 6) AS polarity FROM w"


def _lines(spark, sf, line):
    return read(spark, sf, "part").select("p_partkey", "p_size", F.expr(line).alias("value"))


def _polarity(df):
    return df.select("word", F.round("polarity", 6).alias("polarity"))


@query("lexicon_scored", f"WITH l AS (SELECT p_partkey AS line, string_split({SCORED}, chr(9)) AS p FROM part), r AS (SELECT line, lower(trim(p[1])) AS word, try_cast(p[2] AS DOUBLE) AS s FROM l WHERE len(p) >= 2), w AS (SELECT word, arg_max(s, line) AS s FROM r WHERE s IS NOT NULL AND word <> '' GROUP BY word) {_DIVIDED}")
def lexicon_scored(spark, sf):
    return _polarity(readers.lexicon_scored(_lines(spark, sf, SCORED), order="p_partkey"))


@query("lexicon_lists", f"SELECT lower(trim(v)) AS word, min(s)::DOUBLE AS polarity FROM (SELECT {LISTED} AS v, 1 AS s FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT {LISTED}, -1 FROM part WHERE p_partkey % 3 = 1 AND p_size < 25) WHERE trim(v) <> '' AND NOT starts_with(trim(v), ';') GROUP BY 1")
def lexicon_lists(spark, sf):
    x = _lines(spark, sf, LISTED)
    return readers.lexicon_lists(x.where("p_partkey % 3 = 0"), x.where("p_partkey % 3 = 1 and p_size < 25"))


@query("lexicon_senses", rf"""WITH l AS (SELECT {SENSES} AS v FROM part), p AS (SELECT string_split(v, chr(9)) AS p FROM l WHERE NOT starts_with(v, '#')),
t AS (SELECT try_cast(p[3] AS DOUBLE) - try_cast(p[4] AS DOUBLE) AS s, unnest(regexp_split_to_array(p[5], '\s+')) AS t FROM p WHERE len(p) >= 5),
r AS (SELECT replace(lower(regexp_extract(t, '^(.+)#([0-9]+)$', 1)), '_', ' ') AS word, regexp_extract(t, '^(.+)#([0-9]+)$', 2)::INT AS rank, s FROM t WHERE s <> 0 AND regexp_matches(t, '^.+#[0-9]+$')),
c AS (SELECT word, s FROM r QUALIFY row_number() OVER (PARTITION BY word ORDER BY rank, s) <= 3), w AS (SELECT word, avg(s) AS s FROM c GROUP BY word) {_DIVIDED}""")
def lexicon_senses(spark, sf):
    return _polarity(readers.lexicon_senses(_lines(spark, sf, SENSES)))


@query("lexicon_last_tab", f"WITH l AS (SELECT p_partkey AS line, string_split({LAST_TAB}, chr(9)) AS p FROM part), r AS (SELECT line, lower(trim(array_to_string(p[:-2], chr(9)))) AS word, try_cast(p[-1] AS DOUBLE) AS s FROM l WHERE len(p) > 1), w AS (SELECT word, arg_max(s, line) AS s FROM r WHERE s IS NOT NULL AND word <> '' GROUP BY word) {_DIVIDED}")
def lexicon_last_tab(spark, sf):
    return _polarity(readers.lexicon_last_tab(_lines(spark, sf, LAST_TAB), order="p_partkey"))


@query("sense_index", f"WITH l AS (SELECT {INDEX} AS v FROM part), p AS (SELECT regexp_split_to_array(trim(v), ' +') AS p FROM l WHERE NOT starts_with(v, ' ')), o AS (SELECT p[1] AS lemma, p[2] AS pos, p[p[4]::INT + 7:] AS o FROM p) SELECT lemma, pos, unnest(range(1, len(o) + 1)) AS sense, unnest(o) AS \"offset\" FROM o")
def sense_index(spark, sf):
    return readers.sense_index(_lines(spark, sf, INDEX))


@query("sense_glosses", f"WITH l AS (SELECT {GLOSS} AS v FROM part) SELECT split_part(v, ' ', 1) AS \"offset\", trim(substr(v, instr(v, '|') + 1)) AS gloss FROM l WHERE NOT starts_with(v, ' ')")
def sense_glosses(spark, sf):
    return readers.sense_glosses(_lines(spark, sf, GLOSS))


@query("tagged_sentences", "SELECT p_partkey AS document, 0::BIGINT AS sent, 0::BIGINT AS place, 'a' || p_size AS lemma, 'n' AS pos, (p_size % 3)::BIGINT AS sense, p_type AS surface FROM part WHERE p_size % 3 >= 1 UNION ALL SELECT p_partkey, 0, 2, 'run', 'v', p_size % 4, 'ran' FROM part WHERE p_size % 4 >= 1")
def tagged_sentences(spark, sf):
    """Sense-tagged tokens; tags are folded to four parts of speech."""
    got = readers.tagged_sentences(_lines(spark, sf, TAGGED), "p_partkey", "value")
    return got.withColumn("pos", readers.fold_pos(F.col("pos"))).withColumnRenamed("p_partkey", "document")


@query("json_texts", "SELECT p_name AS text FROM part WHERE p_partkey % 9 <> 0")
def json_texts(spark, sf):
    return readers.json_texts(_lines(spark, sf, JSON))


@query("title_queries", "WITH a AS (SELECT split_part(text, ' ', 1) AS title, text FROM documents WHERE text IS NOT NULL), b AS (SELECT title, replace(text, title, ' ') AS body FROM a WHERE title <> '') SELECT title, count(*) AS n, sum(length(body))::BIGINT AS chars FROM b WHERE len(regexp_extract_all(body, '[ؠ-يً-ٟ٠-٩ٰ-ۓەۥ-ۦۮ-ۿݐ-ݿ]+|[A-Za-z]+|[0-9]+')) >= 60 AND len(regexp_extract_all(title, '[ؠ-يً-ٟ٠-٩ٰ-ۓەۥ-ۦۮ-ۿݐ-ݿ]+|[A-Za-z]+|[0-9]+')) >= 1 GROUP BY title")
def title_queries(spark, sf):
    """First words as titles, to be found in their own texts without them; texts by title."""
    a = read(spark, sf, "documents").where("text is not null").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("title"), "text").where("title != ''")
    return readers.title_queries(a).groupBy("title").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


@query("seeded_subset", f"SELECT doc_id FROM documents ORDER BY {uniform_sql(7, 'doc_id')}, doc_id LIMIT 100")
def seeded_subset(spark, sf):
    """A hundred documents by hash: a sampling operator."""
    return readers.seeded_subset(read(spark, sf, "documents").select("doc_id"), 100, "doc_id")


@query("truncated_stream", f"WITH {GLOBAL} SELECT token, count(*) AS cnt FROM gp WHERE g <= 20000 GROUP BY token")
def truncated_stream(spark, sf):
    """Counts over the first 20,000 tokens: registers are compared at one length."""
    docs = read(spark, sf, "documents")
    tok = tokens(docs).join(st.running_offsets(lengths(docs)), "doc_id").withColumn("g", F.col("before") + F.col("pos") + 1)
    return readers.truncated(tok, 20000).groupBy("token").agg(F.count("*").alias("cnt"))


def _shared(spark):
    """A folder that all executors see: the checkpoint folder."""
    return f"{cut(spark.range(1)).sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/rows-{uuid.uuid4().hex}"


@query("written_rows", "SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels")
def written_rows(spark, sf):
    """Labels through the JSON sink and back."""
    path = _shared(spark)
    readers.write_rows(read(spark, sf, "labels"), path, "json")
    return spark.read.schema("doc_id long, quality long, toxic long").json(path)


@query("sentence_lines", "SELECT trim(l) AS text, count(*) AS n FROM (SELECT unnest(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10))) AS l FROM benchmark) WHERE trim(l) <> '' GROUP BY 1")
def sentence_lines(spark, sf):
    """Lines of the passages, written as text and read again."""
    path = _shared(spark)
    lines = read(spark, sf, "benchmark").select(F.explode(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), "\n")).alias("value"))
    lines.write.text(path)
    return readers.sentence_lines(spark, path, "UTF-8").groupBy("text").agg(F.count("*").alias("n"))
