"""Corpus pipeline: documents to packed training sequences.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and reread as the next one's ``docs``.  All but the last return the
columns of ``documents``.  A stage decides about every row that its predecessor
kept, and drops what its operator rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paylens.llm import langid, minhash, packing, toxicity
from paylens.llm.store import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no letters, or a narrow margin) go."""
    found = langid.identify(docs, langid.fit_dictionaries(docs), COLUMNS)
    return found.filter("not rejected").select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, field, COLUMNS).filter("score < 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (its smallest id); rows without an id stay.

    Different texts under one id are documents of their own: all but the first by
    fingerprint are grouped under a number made of id and text, above all ids.
    """
    printed = docs.withColumn("_print", F.xxhash64("text"))
    clashing = printed.groupBy("doc_id").agg(F.min("_print").alias("_first"), F.max("_print").alias("_last")) \
        .filter("doc_id is not null and _first < _last").select("doc_id", "_first")
    other = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = printed.join(stored(clashing, "clashing-ids"), "doc_id", "left").withColumn(
        "_key", F.when(F.col("_print") > F.col("_first"), F.when(F.col("doc_id").isNotNull(), other))
        .otherwise(F.col("doc_id").cast("long")))
    kept = minhash.near_duplicates(keyed, id_col="_key").filter("kept and doc_id is not null") \
        .select(F.col("doc_id").alias("_key")).distinct()
    chosen = keyed.join(kept, "_key", "leftsemi").dropDuplicates(["_key"])
    return chosen.select(*COLUMNS).union(docs.filter("doc_id is null").select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every id of the remaining documents gets its place in a sequence."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("minhash_near_dedup", near_dedup),
          ("packing", pack_sequences)]

#: compression, trained fields, signatures and BPE have no SQL form; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
