"""The queries opN_<name> and pipeline, with the SQL that the exact ones are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw, html, lines, minhash, mixing, pieces, quality, sharding, substring, toxicity
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, size=3, percent=85, bands=20, rows=5)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    got = lines.strip_lines(docs)
    return got.select("doc_id", "source", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), only=["doc_id"])
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs).select("doc_id", "source", "copy", "shuffle_key")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline} | {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_embedding_dedup, op4_minhash_dedup, op5_line_dedup, op6_sentencepiece, op7_mix_sources, op8_substring_dedup, op9_html_extraction, op10_shard_balance)}


_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

MEASURES_SQL = rf"""
base AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
part AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM base),
grams AS (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g, i FROM part, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest([0, 1, 2]) AS r(k) GROUP BY doc_id),
m AS (SELECT part.doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM part LEFT JOIN covered ON part.doc_id = covered.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
ruled AS (SELECT *, NOT base_failed AND NOT (n_symbols * 20 > word_chars)
  AND NOT ((length(t) - length(replace(t, '!', ''))) * 20 > word_chars)
  AND NOT (n_dup_lines * 10 > 7 * len(string_split(t, chr(10))))
  AND NOT (word_chars > 40 * n_words) AND regexp_matches(t, '\p{{L}}')
  AND NOT ((length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) * 2 > word_chars) AS kept FROM judged)
"""

def lines_sql(whole_copies: bool) -> str:
    """CTEs up to ``stripped`` over the relation ``docs_in``."""
    n = f"len(list_filter(rest, lambda x: regexp_matches(x, '{_WORD}'))) = 0" if whole_copies else "false"
    return rf"""
pages AS (SELECT source, count(*) AS n_pages FROM docs_in GROUP BY source),
lined AS (SELECT source, unnest(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')))) AS line FROM docs_in),
bad AS (SELECT l.source, l.line FROM lined l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source GROUP BY l.source, l.line, n_pages
  HAVING (count(*) >= 10 AND count(*) > 0.02 * n_pages) OR (count(*) >= 3 AND count(*) > 0.5 * n_pages)),
lists AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
cutting AS (SELECT d.*, string_split(coalesce(text, ''), chr(10)) AS ls, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT coalesce(list_contains(bad, x), false)) AS rest FROM docs_in d LEFT JOIN lists b ON d.source IS NOT DISTINCT FROM b.source),
stripped AS (SELECT doc_id, lang, source, n_chars, len(ls)::BIGINT AS n_lines,
  CASE WHEN {n} THEN 0 ELSE len(ls) - len(rest) END::BIGINT AS n_removed,
  CASE WHEN text IS NULL OR {n} THEN text ELSE array_to_string(rest, chr(10)) END AS text FROM cutting)
"""


#: The line dedup of the pipeline, where copies of pages are left to the near-dedup.
LINES_SQL = lines_sql(True)


def uniform_sql(seed: int, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *(f"coalesce({p}::VARCHAR, 'null')" for p in parts)])
    return f"((('0x' || substr(md5({text}), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)"


def mix_sql(docs: str, alpha: float = 0.5, seed: int = 11) -> str:
    """CTEs n_mix, rate_mix, terms_mix and mixed over the relation ``docs``."""
    return rf"""
n_mix AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
rate_mix AS (SELECT source, pow(n, {alpha}) / sum(pow(n, {alpha})) OVER () * sum(n) OVER () / n AS rate FROM n_mix),
terms_mix AS (SELECT source, i AS k, sum(exp(-rate + i * ln(rate) - lgamma(i + 1))) OVER (PARTITION BY source ORDER BY i) AS cdf
  FROM rate_mix, unnest(range(0, (rate + 12 * sqrt(rate) + 31)::BIGINT)) AS r(i)),
mixed AS (SELECT d.*, unnest(range(1, n_copies + 1))::INT AS copy FROM (
  SELECT d.*, (SELECT count(*) FROM terms_mix t WHERE t.source IS NOT DISTINCT FROM d.source AND t.cdf < {uniform_sql(seed, "d.doc_id")}) AS n_copies FROM {docs} d) d)
"""


def near_sql(docs: str, size: int, percent: int) -> str:
    """CTEs up to ``near``: doc_id, n_shingles, component_id."""
    return rf"""
nw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM {docs}),
ns AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' '))) END AS s FROM nw),
nx AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM ns),
np AS (SELECT a.doc_id AS a, b.doc_id AS b FROM nx a JOIN nx b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
ne AS (SELECT a, b FROM np UNION ALL SELECT b, a FROM np),
nr(u, v) AS (SELECT doc_id, doc_id FROM ns UNION SELECT nr.u, ne.b FROM nr JOIN ne ON nr.v = ne.a),
near AS (SELECT ns.doc_id, len(s)::BIGINT AS n_shingles, c.component_id FROM ns JOIN (SELECT u, min(v) AS component_id FROM nr GROUP BY u) c ON ns.doc_id = c.u)
"""


SUBSTRING_SQL = rf"""
WITH b AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM b, unnest(range(1, len(w) - 48)) AS r(i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM win) WHERE doc_id > lo),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS p FROM late, unnest(range(0, 50)) AS r(k) GROUP BY doc_id),
kept AS (SELECT b.doc_id, len(w) AS n, coalesce(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT coalesce(list_contains(p, i), false)), lambda i: w[i]), []) AS k FROM b LEFT JOIN gone ON b.doc_id = gone.doc_id)
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, p.b FROM r JOIN p ON r.w = p.a),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON u = vec_id LEFT JOIN l ON a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": f"WITH {MEASURES_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ruled",
        "op3_embedding_dedup": VECTORS_SQL,
        "op4_minhash_dedup": f"WITH RECURSIVE {near_sql('documents', 3, 85)} SELECT *, doc_id = component_id AS kept FROM near",
        "op5_line_dedup": f"WITH docs_in AS (SELECT * FROM documents), {lines_sql(False)} SELECT doc_id, source, n_lines, n_removed, md5(text) AS kept_md5 FROM stripped",
        "op8_substring_dedup": SUBSTRING_SQL,
        "op7_mix_sources": f"WITH {mix_sql('documents')} SELECT doc_id, source, copy, {uniform_sql(12, 'doc_id', 'copy')} AS shuffle_key FROM mixed",
    }
