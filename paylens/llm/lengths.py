"""Token counts from an exact length histogram.

Documents are encoded once and aggregated by encoded length (combined before
the shuffle, so copies of a length cost one row per task).  Running sums over
the histogram answer, for every length as a context limit, how many documents
fit, the corpus's tokens, its tokens when every document is truncated to the
limit (tokens of the fitting documents plus the limit for each longer one), and
the share of documents that fit, from which quantiles are read.  The running
sums are taken inside ranges of lengths and over the ranges' totals.

Defined results: null and empty texts have length 0; rows that repeat count
each; an empty table has no limits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from paylens.llm.bpe import RANKS, encode
from paylens.llm.store import stored, table

RANGE = 4096


def length_histogram(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(length, docs): number of documents of each encoded length."""
    return encode(docs, path).select(F.size("ids").cast("long").alias("length")) \
        .groupBy("length").agg(F.count(F.lit(1)).alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """One row per length, read as a context limit."""
    h = stored(histogram, "lengths").withColumn("range", F.floor(F.col("length") / RANGE)) \
        .withColumn("tokens", F.col("length") * F.col("docs"))
    totals = h.groupBy("range").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = totals.select("range", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_later"),
                          F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_later"),
                          F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    suffix = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    longer = h.select("length", "docs", "range", F.coalesce(F.sum("docs").over(suffix), F.lit(0)).alias("d"),
                      F.coalesce(F.sum("tokens").over(suffix), F.lit(0)).alias("t")).join(later, "range")
    over, tokens_over = F.col("d") + F.col("docs_later"), F.col("t") + F.col("tokens_later")
    return longer.select(
        F.col("length").alias("context_limit"), F.col("docs").alias("docs_at_limit"), over.alias("docs_over"),
        (F.col("total_docs") - over).alias("docs_within"), "total_docs", "total_tokens",
        (F.col("total_tokens") - tokens_over + F.col("length") * over).alias("truncated_total"),
        (tokens_over - F.col("length") * over).alias("tokens_cut"),
        ((F.col("total_docs") - over) / F.col("total_docs")).alias("share_within"))


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share ``q`` of documents does not exceed."""
    return limits.filter(F.col("share_within") >= q).agg(F.min("context_limit").alias("length"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens of the corpus with every document truncated to ``limit``, which need not be a length that occurs."""
    return histogram.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("docs")), F.lit(0)).alias("tokens"))


def op10(spark, sf_dir: str) -> DataFrame:
    return context_limits(length_histogram(table(spark, sf_dir, "documents")))
