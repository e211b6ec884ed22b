"""Line dedup by site-relative frequency, in DataFrame operations only.

Pages are grouped by host. For each line of a host, the share of the host's pages that
contain it is worked out; lines above a boilerplate ratio are dropped from the host's
pages. A line counts once for a page, however often the page repeats it. Two rules say what
is above: more than ``ratio`` of the pages and at least ``min_count`` of them, or, so that
small hosts have a rule as well, more than ``small_ratio`` and at least ``small_count``.

Defined results: a null text counts as empty and stays null; a null host is a host of its
own; lines without a word are neither counted nor dropped; a page may lose all its lines, and
its text is empty then, unless ``whole_copies`` is set: a page whose every worded line is
boilerplate then counts as a copy of other pages and stays whole; repeated rows are pages of
their own; texts of any length are split whole; an empty table gives an empty
result. Every other column passes through; where one is named n_lines or n_removed, the
operator's own gets an underscore appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, free_name

#: Lists of boilerplate lines go to every task if they have no more hosts, lines in all, and lines of one host.
BROADCAST_HOSTS = 10_000
BROADCAST_LINES = 200_000
LONGEST_LIST = 2_000


def _lines(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, "\n")), lambda x: F.translate(x, SPACES, "") != "")


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_count: int, small_ratio: float, small_count: int) -> DataFrame:
    """(h, line): hashes of the lines that are boilerplate on their host.

    Two aggregates with partial sums on the map side. A host has fewer such lines than its
    mean number of lines per page divided by the ratio.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    pages = docs.groupBy(F.col(host).alias("h")).agg(F.count("*").alias("n_pages"))
    lines = docs.select(F.col(host).alias("h"), F.explode(F.transform(_lines(t), lambda x: F.xxhash64(x))).alias("line"))
    counts = lines.groupBy("h", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min(min_count, small_count))
    found = counts.join(pages, counts["h"].eqNullSafe(pages["h"]))
    above = ((F.col("n") >= min_count) & (F.col("n") > ratio * F.col("n_pages"))) | ((F.col("n") >= small_count) & (F.col("n") > small_ratio * F.col("n_pages")))
    return found.where(above).select(counts["h"].alias("h"), "line")


def _own_lists(docs: DataFrame, bad: DataFrame, host: str, text: str) -> DataFrame:
    """``docs`` with __l_lines, joined by (host, line): no task gets a host's whole list, nor a host's pages.

    A page is told by hashes of its text: pages with one text on one host have the same lines.
    """
    keyed = docs.withColumns({"__l_1": F.xxhash64(F.lit(1), text), "__l_2": F.xxhash64(F.lit(2), text)})
    lines = keyed.select(F.col(host).alias("h"), "__l_1", "__l_2", F.explode(F.transform(_lines(F.coalesce(F.col(text), F.lit(""))), lambda x: F.xxhash64(x))).alias("line"))
    hit = lines.join(bad.select(F.col("h").alias("h2"), F.col("line").alias("line2")), (F.col("line") == F.col("line2")) & F.col("h").eqNullSafe(F.col("h2")))
    own = hit.groupBy(F.col("h").alias("__l_h"), F.col("__l_1").alias("__l_3"), F.col("__l_2").alias("__l_4")).agg(F.collect_set("line").alias("__l_lines"))
    same = (F.col("__l_1") == F.col("__l_3")) & (F.col("__l_2") == F.col("__l_4")) & F.col(host).eqNullSafe(F.col("__l_h"))
    return keyed.join(own, same, "left").drop("__l_1", "__l_2", "__l_3", "__l_4", "__l_h")


def strip_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.02, min_count: int = 10, small_ratio: float = 0.5, small_count: int = 3, whole_copies: bool = False) -> DataFrame:
    """``docs`` with ``text`` free of boilerplate lines, and n_lines and n_removed (long) added."""
    bad = cut(boilerplate(docs, host, text, ratio, min_count, small_ratio, small_count))
    sizes = bad.groupBy("h").agg(F.count("*").alias("n")).agg(F.count("*").alias("hosts"), F.sum("n").alias("lines"), F.max("n").alias("most")).first()
    if sizes["hosts"] <= BROADCAST_HOSTS and (sizes["lines"] or 0) <= BROADCAST_LINES and (sizes["most"] or 0) <= LONGEST_LIST:
        lists = F.broadcast(bad.groupBy(F.col("h").alias("__l_h")).agg(F.collect_list("line").alias("__l_lines")))
        got = docs.join(lists, F.col(host).eqNullSafe(F.col("__l_h")), "left").drop("__l_h")
    else:
        got = _own_lists(docs, bad, host, text)
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rest = F.filter(split, lambda x: ~F.coalesce(F.array_contains(F.col("__l_lines"), F.xxhash64(x)), F.lit(False)))
    got = got.withColumn("__l_rest", F.when(F.col("__l_lines").isNotNull(), rest))
    if whole_copies:
        worded = F.exists("__l_rest", lambda x: F.translate(x, SPACES, "") != "")
        got = got.withColumn("__l_rest", F.when(worded, F.col("__l_rest")))
    names = [free_name(c, docs.columns) for c in ("n_lines", "n_removed")]
    return got.withColumns({
        text: F.when(F.col("__l_rest").isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join("__l_rest", "\n")),
        names[0]: F.size(split).cast("long"),
        names[1]: F.coalesce(F.size(split) - F.size("__l_rest"), F.lit(0)).cast("long"),
    }).drop("__l_lines", "__l_rest")
