"""Queries of readers, streaming and subwords, on the given tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..operators import subwords
from ..sources import readers
from ..streaming import incremental
from .catalogue_text import _words
from .registry import query
from .tables import cut, read, tokens


@query("nested_documents", "WITH r AS (SELECT doc_id % 50 AS title, text, doc_id FROM documents) SELECT title::VARCHAR AS doc_id, trim(text) AS text FROM r QUALIFY row_number() OVER (PARTITION BY title ORDER BY doc_id) = 1")
def nested_documents(spark, sf):
    """Nested rows made from documents, then flattened again; the first copy of a title stays."""
    d = read(spark, sf, "documents")
    ctx = F.struct(F.array((F.col("doc_id") % 50).cast("string")).alias("title"), F.array(F.array("text")).alias("sentences"))
    rows = d.select(F.col("doc_id").alias("id"), F.lit("").alias("question"), ctx.alias("context"), F.struct(F.array(F.lit("x")).alias("title")).alias("supporting_facts"))
    return readers.nested_questions(rows)[0]


@query("joined_sentences", "WITH s AS (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY conv_id) SELECT array_to_string(l, '') AS text, len(l) - 1 AS n FROM s WHERE len(l) > 1 AND length(array_to_string(l, '')) > 40")
def joined_sentences(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("sentences"))
    return readers.joined_sentences(c).select("text", F.size("at").alias("n"))


@query("upsert_labels", "SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 1 - quality, toxic FROM labels WHERE doc_id % 3 = 0")
def upsert_labels(spark, sf):
    old = read(spark, sf, "labels")
    return readers.upsert(old.where("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality")), old, "doc_id")


@query("event_windows", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    """Tumbling windows over the events; the streaming form is in ``streaming.incremental``."""
    return read(spark, sf, "events").groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("subword_fertility")
def subword_fertility(spark, sf):
    """Fertility of public vocabularies on the distinct words of the documents."""
    import public_tokenizers

    words = cut(tokens(read(spark, sf, "documents")).select(F.col("token").alias("word")).distinct())
    got = None
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        one = subwords.fertility(subwords.pieces_of(words, public_tokenizers.path(name))).select(F.lit(name).alias("vocabulary"), "*")
        got = one if got is None else got.unionByName(one)
    return got


@query("subword_agreement")
def subword_agreement(spark, sf):
    import public_tokenizers

    words = cut(_words(spark, sf))
    return subwords.agreement(*[subwords.pieces_of(words, public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")])


@query("streamed_first_copies", "SELECT DISTINCT item_id FROM benchmark")
def streamed_first_copies(spark, sf):
    """The benchmark table as a stream, its duplicates dropped within a watermark."""
    durable = cut(spark.range(1))  # sees that there is a checkpoint folder
    root = durable.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()
    where = tempfile.mktemp(prefix="stream-", dir="").split("/")[-1]
    src = read(spark, sf, "benchmark").withColumn("ts", F.timestamp_seconds(F.col("item_id") + 86400))  # a stream's watermark begins at 1970: what is not after it is late
    path = f"{root}/{where}"
    src.union(src).write.parquet(f"{path}/in")
    s = incremental.document_stream(spark, f"{path}/in", "item_id long, text string, ts timestamp")
    q = incremental.first_copies(s, "ts", "365 days").select("item_id").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("item_id long").parquet(f"{path}/out")
