"""How public subword vocabularies cut words. Vocabularies are files by path; none is trained here."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pieces_of(words: DataFrame, path: str, column: str = "word") -> DataFrame:
    """(word, pieces): each distinct word encoded once, in Arrow batches, by a tokenizer file of the ``tokenizers`` library."""

    def run(frames: Iterator):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        for f in frames:
            f["pieces"] = [e.tokens for e in t.encode_batch([w or "" for w in f[column]], add_special_tokens=False)]
            yield f[[column, "pieces"]]

    return words.select(column).distinct().mapInPandas(run, f"{column} string, pieces array<string>")


def fertility(pieces: DataFrame, unknown: str = "[UNK]") -> DataFrame:
    """One row: mean pieces a word, share of words left whole, share with an unknown piece."""
    return pieces.agg(F.count("*").alias("words"), F.avg(F.size("pieces")).alias("fertility"), F.avg((F.size("pieces") == 1).cast("double")).alias("intact"), F.avg(F.array_contains("pieces", unknown).cast("double")).alias("unknown"))


def agreement(a: DataFrame, b: DataFrame, column: str = "word", marker: str = "##|</w>|Ġ") -> DataFrame:
    """One row: share of words that two vocabularies cut alike, markers apart."""
    bare = lambda c: F.transform(c, lambda p: F.regexp_replace(p, marker, ""))
    j = a.select(column, bare(F.col("pieces")).alias("x")).join(b.select(column, bare(F.col("pieces")).alias("y")), column)
    return j.agg(F.count("*").alias("words"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreement"))
